"""Toxicity by class-conditional Kneser-Ney models over the letters of words.

Both class models are interpolated Kneser-Ney models of order ORDER over the characters of padded
words; what a class has not seen backs off to continuation counts that the classes share, so an
unseen form of a toxic stem still scores by its stem.  An expression (word) scores the difference of
its toxic and ordinary log-likelihoods; a document scores by the length-normalised difference over
its whole text and by its strongest expressions, calibrated on a fold that the counts do not use.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HELD_OUT, Remembered, bounded, fold, lean, slices, small_enough, written

ORDER, DISCOUNT, START, END = 5, 0.75, "^", "$"
WORD = re.compile(r"\w+")
#: Fold used for calibration alone, and the greatest number of labelled rows that it takes.
CALIBRATION, MAX_CALIBRATION_ROWS = 3, 50_000
#: A model of more n-grams (16 bytes each) than this is joined by shuffles instead of being broadcast.
MAX_BROADCAST_GRAMS = 4_000_000
#: Words that a task counts before it hands on sums, and words whose ratio it remembers in each of two generations.
MAX_COUNTED, MAX_REMEMBERED = 120_000, 100_000
FEATURES = ("mean_llr", "top_llr", "top3_llr", "top10_llr", "log_words")


def word_counts(labelled: DataFrame) -> DataFrame:
    """(word, toxic, other): occurrences in (toxic, text) rows, summed per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())

        def rows() -> pa.RecordBatch:
            words = list(counts[0].keys() | counts[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([counts[k][w] for w in words], pa.int64()) for k in (1, 0))], names=["word", "toxic", "other"])
            for c in counts:
                c.clear()
            return out

        for batch in batches:
            for toxic, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts[int(toxic == 1)].update(WORD.findall((value.as_py() or "").lower()))
            if len(counts[0]) + len(counts[1]) > MAX_COUNTED:
                yield rows()
        yield rows()

    found = labelled.select("toxic", "text").mapInArrow(lean(run), "word string, toxic long, other long")
    return found.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def kneser_ney(words: DataFrame, order: int = ORDER, discount: float = DISCOUNT) -> tuple[DataFrame, DataFrame]:
    """Log-likelihood ratios (gram, llr) of the n-grams seen and (context, llr) of any other letter after a context seen."""
    padded = F.concat(F.lit(START * (order - 1)), F.col("word"), F.lit(END))
    starts = F.sequence(F.lit(1), F.length("word") + 1)
    grams = words.select("toxic", "other", F.explode(F.transform(starts, lambda k: padded.substr(k, F.lit(order)))).alias("gram"))
    grams = written(grams.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")), "grams")

    def tail(column: str, n: int):
        return F.expr(f"right({column}, {n})")

    def head(column: str):
        return F.expr(f"left({column}, length({column}) - 1)")

    counts, levels = grams.select(F.col("gram").alias("g")), []
    for n in range(order - 1, 0, -1):
        counts = counts.groupBy(tail("g", n).alias("s")).agg(F.count("*").alias("n")).withColumnRenamed("s", "g")
        levels.append(counts)
    lowest = levels.pop()
    total = lowest.agg(F.sum("n").alias("total"))
    shared = lowest.join(F.broadcast(total)).select("g", (F.col("n") / F.col("total")).alias("p"))  # total is one row
    for level in reversed(levels):
        contexts = level.groupBy(head("g").alias("h")).agg(F.sum("n").alias("total"), F.count("*").alias("types"))
        level = level.withColumn("h", head("g")).withColumn("back", F.expr("right(g, length(g) - 1)"))
        lower = shared.select(F.col("g").alias("back"), "p")
        p = (F.greatest(F.col("n") - discount, F.lit(0.0)) + discount * F.col("types") * F.col("p")) / F.col("total")
        shared = level.join(contexts, "h").join(lower, "back").select("g", p.alias("p"))
    top = grams.withColumn("h", head("gram")).withColumn("g", tail("gram", order - 1))
    contexts = top.groupBy("h").agg(*[f(c).alias(f"{c}_{n}") for c in ("toxic", "other") for n, f in (("sum", F.sum), ("types", lambda c: F.count_if(F.col(c) > 0)))])

    def weight(c: str):
        """Mass that a class leaves to the shared letters after this context; all of it where the class never saw it."""
        return F.when(F.col(f"{c}_sum") > 0, discount * F.col(f"{c}_types") / F.col(f"{c}_sum")).otherwise(F.lit(1.0))

    def likelihood(c: str):
        seen = F.when(F.col(f"{c}_sum") > 0, F.greatest(F.col(c) - discount, F.lit(0.0)) / F.col(f"{c}_sum")).otherwise(F.lit(0.0))
        return F.log(seen + weight(c) * F.col("p"))

    scored = top.join(contexts, "h").join(shared, "g").select("gram", (likelihood("toxic") - likelihood("other")).alias("llr"))
    unseen = contexts.select(F.col("h").alias("gram"), (F.log(weight("toxic")) - F.log(weight("other"))).alias("llr"))
    return scored, unseen


def word_llr(word: str, known: dict[str, float], order: int = ORDER) -> float:
    """Log-likelihood ratio of one word by a dictionary of the model: the definition, for tests and small uses."""
    padded = START * (order - 1) + word + END
    total = 0.0
    for k in range(len(word) + 1):
        gram = padded[k : k + order]
        value = known.get(gram)
        total += known.get(gram[:-1], 0.0) if value is None else value
    return total


#: Odd multipliers that name an n-gram by one number, from a seeded generator.
_PLACES = np.random.default_rng(19).integers(1, 1 << 62, ORDER, dtype=np.int64) * 2 + 1


def gram_codes(letters: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit code of every run of n letters (code points) in a row."""
    codes = sum(letters[k : len(letters) - n + 1 + k] * _PLACES[k] for k in range(n)) * 8 + n
    codes ^= codes >> 29
    return codes * _PLACES[0]


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) + 1


class Model:
    """Ratios by gram code, in two arrays."""

    def __init__(self, codes: np.ndarray, llrs: np.ndarray):
        order = np.argsort(codes)
        self.codes, self.llrs = codes[order], llrs[order]

    def look_up(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(llr or 0, whether known)."""
        distinct, back = np.unique(codes, return_inverse=True)
        at = np.minimum(np.searchsorted(self.codes, distinct), max(len(self.codes) - 1, 0))
        known = self.codes[at] == distinct if len(self.codes) else np.zeros(len(distinct), bool)
        return np.where(known, self.llrs[at] if len(self.codes) else 0.0, 0.0)[back], known[back]

    def word_llrs(self, words: list[str]) -> dict[str, float]:
        """Ratios of non-empty words, as word_llr defines them."""
        if not words:
            return {}
        letters = _letters("".join(START * (ORDER - 1) + w + END for w in words))
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        first = np.cumsum(sizes + ORDER - 1) - (sizes + ORDER - 1)
        starts = np.cumsum(sizes) - sizes
        at = np.repeat(first - starts, sizes) + np.arange(sizes.sum())
        value, known = self.look_up(gram_codes(letters, ORDER)[at])
        unknown = np.flatnonzero(~known)
        value[unknown] = self.look_up(gram_codes(letters, ORDER - 1)[at[unknown]])[0]
        return dict(zip(words, np.add.reduceat(value, starts).tolist(), strict=True))


def _features(llrs: np.ndarray, chars: int) -> tuple[float, ...]:
    """Length-normalised ratio of the whole text, its strongest expressions, and its length."""
    if not len(llrs):
        return 0.0, 0.0, 0.0, 0.0, 0.0
    top = np.sort(llrs if len(llrs) <= 10 else np.partition(llrs, len(llrs) - 10)[-10:])[::-1]
    return float(llrs.sum()) / (chars + len(llrs)), float(top[0]), float(top[:3].sum()) / 3, float(top.sum()) / 10, math.log(len(llrs))


def _words(value: pa.Scalar) -> list[str]:
    return WORD.findall((value.as_py() or "").lower())


def features(df: DataFrame, model: DataFrame, key: str, text: str, max_broadcast_grams: int = MAX_BROADCAST_GRAMS) -> DataFrame:
    """(key, features) of every whole text, by a model (gram, llr) that is broadcast if its counted size allows.

    Otherwise distinct words are scored by joins with the model and joined to each document's words:
    the same words, ratios and features, but for the order in which numbers are added.
    """
    spec = f"`{key}` long, " + ", ".join(f"{f} double" for f in FEATURES)
    narrow = df.select(F.col(key).cast("long").alias(key), F.col(text).alias("text"))
    if not small_enough(model, max_broadcast_grams):
        return _joined_features(narrow, model, key)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.zeros(len(batch), np.int64)
            grams = batch.column(0).to_pylist()
            for n in (ORDER - 1, ORDER):
                own = [i for i, g in enumerate(grams) if len(g) == n]
                if own:
                    codes[own] = gram_codes(_letters("".join(grams[i] for i in own)), n)[::n]
            yield pa.RecordBatch.from_arrays([pa.array(codes), batch.column(1)], names=["code", "llr"])

    table = model.select("gram", "llr").mapInArrow(coded, "code long, llr double").toArrow()
    shared = df.sparkSession.sparkContext.broadcast(Model(table.column("code").to_numpy(), table.column("llr").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Remembered(shared.value.word_llrs, MAX_REMEMBERED)
        for batch in batches:
            for part in slices(batch, 1):
                lists = list(map(_words, part.column(1)))
                words = pa.array(chain.from_iterable(lists), pa.string()).dictionary_encode()
                distinct = words.dictionary.to_pylist()
                codes, counts = words.indices.to_numpy(), [len(x) for x in lists]
                llrs = np.array(known.values(distinct), float)[codes]
                chars = np.concatenate(([0], np.cumsum(np.fromiter(map(len, distinct), np.int64, len(distinct))[codes])))
                ends = np.cumsum(counts)
                rows = [_features(llrs[b - n : b], int(chars[b] - chars[b - n])) for b, n in zip(ends.tolist(), counts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0)] + [pa.array(c, pa.float64()) for c in zip(*rows, strict=True)], names=[key, *FEATURES])

    return narrow.mapInArrow(lean(run), spec)


def _joined_features(narrow: DataFrame, model: DataFrame, key: str) -> DataFrame:
    def each_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, value in zip(batch.column(0), batch.column(1), strict=True):
                counts = Counter(_words(value))
                yield pa.RecordBatch.from_arrays([pa.array([row.as_py()] * len(counts), pa.int64()), pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["_row", "word", "n"])

    rows = written(narrow.withColumn("_row", F.monotonically_increasing_id()), "rows")
    each = written(rows.select("_row", "text").mapInArrow(lean(each_word), "_row long, word string, n long"), "words")
    padded = F.concat(F.lit(START * (ORDER - 1)), F.col("word"), F.lit(END))
    grams = each.select("word").distinct().select("word", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda k: padded.substr(k, F.lit(ORDER)))).alias("gram"))
    seen, context = model.select("gram", "llr"), model.select(F.col("gram").alias("_h"), F.col("llr").alias("_back"))
    scored = grams.join(seen, "gram", "left").join(context, F.expr("left(gram, length(gram) - 1)") == F.col("_h"), "left")
    scored = scored.groupBy("word").agg(F.sum(F.coalesce("llr", "_back", F.lit(0.0))).alias("llr"))
    joined = each.join(scored, "word").groupBy("_row").agg(
        F.sum(F.col("n") * F.col("llr")).alias("total"),
        F.sum(F.col("n") * (F.length("word") + 1)).alias("chars"),
        F.sum("n").alias("count"),
        F.slice(F.sort_array(F.flatten(F.collect_list(F.array_repeat("llr", F.least("n", F.lit(10)).cast("int")))), asc=False), 1, 10).alias("top"),
    )
    total = lambda n: F.aggregate(F.slice("top", 1, n), F.lit(0.0), lambda a, x: a + x) / n
    values = [F.col("total") / F.col("chars"), F.try_element_at("top", F.lit(1)), total(3), total(10), F.log("count")]
    return rows.select("_row", key).join(joined, "_row", "left").select(key, *[F.coalesce(v, F.lit(0.0)).alias(f) for v, f in zip(values, FEATURES, strict=True)])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton steps on standardised features; gives (mean, scale, weights with the intercept last)."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack(((x - mean) / scale, np.ones(len(x))))
    w = np.zeros(z.shape[1])
    penalty = ridge * np.eye(len(w))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (p - y) + penalty @ w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def score_toxicity(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label_key: str | None = None) -> DataFrame:
    """Score every whole text for toxicity; learns from labels of rows whose fold is not held out.

    Gives (key, held_out, score, predicted).  Counts come from all labelled rows of two folds, calibration from up to MAX_CALIBRATION_ROWS rows of a third.
    Null and empty texts get the score of a text without words; without labels of both classes every
    score is the share of toxic labels (0 without labels).  Repeated labels of a key count as toxic if
    any says so; null labels and null keys of labels are left out.
    """
    label_id = F.col(label_key or key).cast("long")
    known = written(labels.filter(label_id.isNotNull() & F.col("toxic").isNotNull()).groupBy(label_id.alias("_id")).agg(F.max("toxic").alias("_toxic")), "labels")
    usable = df.filter(F.col(text).isNotNull() & (fold(F.col(key)) != HELD_OUT))
    known = bounded(known)
    counted = usable.filter(fold(F.col(key)) != CALIBRATION).select(F.col(key), F.col(text).alias("text")).join(known, F.col(key) == F.col("_id")).select(F.col("_toxic").alias("toxic"), "text")
    scored, unseen = kneser_ney(written(word_counts(counted), "word-counts"))
    model = written(scored.union(unseen), "toxic-model")
    found = written(features(df, model, key, text), "toxic-features")
    folded = found.select(key, *FEATURES).filter(fold(F.col(key)) == CALIBRATION)
    sample = folded.join(known, F.col(key) == F.col("_id")).orderBy(F.xxhash64(key)).limit(MAX_CALIBRATION_ROWS).select(F.col("_toxic").alias("toxic"), *FEATURES).toPandas()
    y = (sample["toxic"].to_numpy() == 1).astype(float)
    if len(y) and 0 < y.sum() < len(y):
        mean, scale, w = logistic(sample[list(FEATURES)].to_numpy(float), y)
        logit = F.lit(float(w[-1])) + sum((F.col(f) - float(m)) * float(b / s) for f, m, s, b in zip(FEATURES, mean, scale, w, strict=False))
        score = 1 / (1 + F.exp(-F.greatest(F.least(logit, F.lit(30.0)), F.lit(-30.0))))
    else:
        score = F.lit(float(y.mean()) if len(y) else 0.0)
    judged = found.select(F.col(key), score.alias("score"))
    return judged.select(key, (fold(F.col(key)) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
