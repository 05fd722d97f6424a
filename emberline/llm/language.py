"""Language identification by rank-order n-gram profiles and out-of-place distance.

A profile is the list of a language's most frequent letter n-grams (one to three letters, words
padded with one blank).  A document's own most frequent n-grams are compared with every profile: each
adds how far its rank is out of place, or the profile's length where the profile lacks it.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HELD_OUT, fold, lean, slices

UNKNOWN, BLANK, SHIFT = "und", 32, 21


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngrams(text: str) -> np.ndarray:
    """Codes of all one- to three-character n-grams with a letter in the middle or at either end."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(letters()[codes], codes, BLANK).astype(np.int64)
    codes = np.concatenate(([BLANK], codes, [BLANK]))
    inner = codes != BLANK
    keep = inner.copy()
    keep[1:] |= inner[:-1]
    keep[0] = True
    codes = codes[keep]
    pairs = codes[:-1] << SHIFT | codes[1:]
    triples = (pairs[:-1] << SHIFT | codes[2:])[codes[1:-1] != BLANK]
    return np.concatenate((codes[codes != BLANK], pairs[(codes[:-1] != BLANK) | (codes[1:] != BLANK)], triples))


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The size most frequent codes, ties to the smaller code."""
    if len(codes) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.lexsort((codes, -counts))][:size]


def profiles(rows: DataFrame, size: int = 400, language: str = "lang", text: str = "text") -> DataFrame:
    """(lang, code, place) of each language's most frequent n-grams over all rows; null langs and texts are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for part in (part for batch in batches for part in slices(batch, 1, 1 << 19)):
            by: dict[str, list[np.ndarray]] = {}
            for name, value in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                by.setdefault(name, []).append(ngrams(value.as_py()))
            for name, parts in by.items():
                codes, counts = np.unique(np.concatenate(parts), return_counts=True)
                if name in held:
                    codes, back = np.unique(np.concatenate((held[name][0], codes)), return_inverse=True)
                    counts = np.bincount(back, np.concatenate((held[name][1], counts))).astype(np.int64)
                held[name] = codes, counts
        for name, (codes, counts) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes), pa.array(counts.astype(np.int64))], names=["lang", "code", "n"])

    known = rows.filter(F.col(language).isNotNull() & F.col(text).isNotNull()).select(F.col(language).alias("lang"), F.col(text).alias("text"))
    counts = known.mapInArrow(lean(run), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    return counts.withColumn("place", place).filter(F.col("place") <= size).select("lang", "code", (F.col("place") - 1).alias("place"))


class Profiles:
    """Profiles as one table of places; a language has at most `size` rows, whatever the corpus."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.size = size
        self.names = sorted({r[0] for r in rows})
        self.codes = np.array(sorted({r[1] for r in rows}), np.int64)
        self.places = np.full((len(self.names), len(self.codes) + 1), -1, np.int64)
        at = {name: i for i, name in enumerate(self.names)}
        for name, code, place in rows:
            self.places[at[name], np.searchsorted(self.codes, code)] = place

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, similarity from 0 to 1); ties go to the first name."""
        codes, counts = np.unique(ngrams(text or ""), return_counts=True)
        if not len(codes) or not self.names:
            return UNKNOWN, 0.0
        own = ranked(codes, counts, self.size)
        at = np.searchsorted(self.codes, own)
        at = np.where((at < len(self.codes)) & (self.codes[np.minimum(at, len(self.codes) - 1)] == own), at, len(self.codes))
        places = self.places[:, at]
        out = np.where(places >= 0, np.minimum(np.abs(places - np.arange(len(own))), self.size), self.size).sum(axis=1)
        best = int(np.argmin(out))
        return self.names[best], float(1 - out[best] / (self.size * len(own)))


def _judged(df: DataFrame, size: int, key: str, text: str, language: str) -> DataFrame:
    """(_row, held_out, lang_pred, score): whole rows with what is predicted for them."""
    held = fold(F.col(key)) == HELD_OUT
    rows = profiles(df.filter(~held), size, language, text).collect()  # size rows a language at most
    model = df.sparkSession.sparkContext.broadcast(Profiles([tuple(r) for r in rows], size))

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts):
        import pandas as pd

        return pd.DataFrame([model.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    out = df.select(F.struct("*").alias("_row"), held.alias("held_out"), predicted(F.col(text)).alias("_p"))
    return out.select("_row", "held_out", "_p.lang_pred", "_p.score")


def identify(df: DataFrame, size: int = 400, key: str = "doc_id", text: str = "text", language: str = "lang") -> DataFrame:
    """(key, held_out, lang_pred, score): every row's language, from profiles of the rows whose fold is not held out.

    Null texts and texts without a letter are `und` with score 0; so are all where nothing could be
    learnt.  Rows with a null language or text are not learnt from.  A null key counts as the empty text
    for the fold; repeated rows count and are judged each; other columns are ignored; an empty table
    gives no rows; long texts are counted in slices of bounded bytes.
    """
    return _judged(df.select(key, text, language), size, key, text, language).select(f"_row.{key}", "held_out", "lang_pred", "score")


def in_known_language(df: DataFrame, least_score: float, size: int = 400, key: str = "doc_id", text: str = "text", language: str = "lang") -> DataFrame:
    """The rows, with their own columns, that some profile fits at least so well; null texts and texts without a letter go."""
    kept = _judged(df, size, key, text, language).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score))
    return kept.select(*[F.col(f"_row.`{c}`").alias(c) for c in df.columns])
