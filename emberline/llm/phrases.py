"""Phrase collocations: count-min sketches rule rare n-grams out, a second pass counts the rest exactly.

Each task fills a sketch of all n-grams of its documents; tasks' sketches are added up in Spark slab by
slab.  Their cells never show less than an n-gram's true count, so an n-gram with a cell below the
threshold is rare for certain.  The second pass counts only the others, exactly.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, gathered, lean, spread_join, written

#: Rows of a sketch, cells in a slab, and the most cells in a row: a task holds at most DEPTH * MOST_CELLS bytes.
DEPTH, SLAB, LEAST_CELLS, MOST_CELLS = 2, 1 << 15, 1 << 17, 1 << 27
#: Bytes of text that a task reads, so that it adds up many n-grams before they are shuffled, whatever the size of a file split.
A_TASK = 128 << 20
#: Bytes of text for each cell of a row (about four rare n-grams) and bytes of text that are worked on at a time.
BYTES_PER_CELL, AT_ONCE = 32, 4 << 20
#: Word numbers within one part of a text take 21 bits of a key, so three fit into 63; a part of 4 MB has fewer distinct words.
WORD_BITS = 21
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Lower-cases A-Z and makes every piece end a full stop and every tab a space.
_PIECES = bytes(b"."[0] if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else _LOWER[c] for c in range(256))
_WORD = re.compile(rb"[^ ]+")
_END = b"."


def _parts(data: bytes, longest: int):
    """(words, of which so many are the part's own); a part also shows the next words, which begin none of its phrases."""
    at = 0
    while at < len(data):
        cut = len(data) if len(data) - at <= AT_ONCE else data.find(b" ", at + AT_ONCE)
        cut = len(data) if cut < 0 else cut
        words = data[at:cut].split()
        own = len(words)
        words += [m[0] for m in islice(_WORD.finditer(data, cut), longest - 1)]
        yield words, own
        at = cut


def _grams(texts: list[bytes], longest: int):
    """For each part of the texts: (distinct words, keys, sizes, counts) of its distinct n-grams.

    A key holds the numbers of its words, the first in the highest bits; number 0 (words[0]) is a piece's end.
    """
    data = b" . ".join(texts).translate(_PIECES).replace(_END, b" . ")
    for words, own in _parts(data, longest):
        numbers: dict[bytes, int] = defaultdict(count().__next__)
        numbers[_END]  # number 0
        ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        if len(numbers) >= 1 << WORD_BITS:
            raise ValueError("a part has too many distinct words")
        ids = np.concatenate([ids, np.zeros(longest, np.int64)])
        inside = ids[:own] > 0
        key = ids[:own] << WORD_BITS * (longest - 1)
        keys, sizes, counts = [], [], []
        for size in range(1, longest + 1):
            if size > 1:
                following = ids[size - 1 : size - 1 + own]
                inside = inside & (following > 0)
                key = key | following << WORD_BITS * (longest - size)
            found, times = np.unique(key[inside], return_counts=True)
            keys.append(found)
            sizes.append(np.full(len(found), size))
            counts.append(times)
        if any(map(len, keys)):
            yield list(numbers), np.concatenate(keys), np.concatenate(sizes), np.concatenate(counts)


def _numbers(keys: np.ndarray, longest: int) -> list[np.ndarray]:
    """The word numbers of keys, one array a place (0 where a phrase is shorter)."""
    return [keys >> WORD_BITS * (longest - 1 - place) & (1 << WORD_BITS) - 1 for place in range(longest)]


def _cells(lang: str, words: list[bytes], keys: np.ndarray, longest: int, width: int) -> list[np.ndarray]:
    """The cell of every key in each row of the sketch; the same words of a language have the same cells everywhere."""
    from xxhash import xxh64_intdigest

    seed = xxh64_intdigest(lang) & 0xFFFFFFFF
    hashes = np.fromiter((xxh64_intdigest(w, seed) | 1 for w in words), np.uint64, len(words))
    hashes[0] = 0
    mixed = np.full(len(keys), seed, np.uint64)
    for numbers in _numbers(keys, longest):
        mixed = (mixed ^ hashes[numbers]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    step = (mixed >> np.uint64(32)) | np.uint64(1)
    return [((mixed + np.uint64(row) * step) & np.uint64(width - 1)).astype(np.int64) for row in range(DEPTH)]


def _by_language(batches):
    """(language, texts) for each language of each few megabytes of text."""
    for batch in gathered(batches, 1, AT_ONCE):
        texts = defaultdict(list)
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            texts[lang].append(text.as_py())
        yield from texts.items()


def _add(cells: np.ndarray, at: np.ndarray, counts: np.ndarray, most: int) -> None:
    """Add counts to cells, which stop at `most`; several counts may meet in a cell."""
    order = np.sort(at << 32 | np.minimum(counts, most))
    at, counts = order >> 32, order & 0xFFFFFFFF
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    sums = np.add.reduceat(counts, first)
    cells[at[first]] = np.minimum(cells[at[first]] + sums, most)


def heavy_cells(texts: DataFrame, least: int, longest: int, width: int) -> dict[int, bytes]:
    """Slab number -> bits of the cells that reach `least` in the merged sketch of texts (lang, text).

    Cells stop at `least`, so they take few bytes and a sum still reaches it whenever the true count does.
    What comes to the driver is bounded by DEPTH * width / 8 bytes, however many documents there are.
    """
    from zstandard import ZstdCompressor, ZstdDecompressor

    kind = np.min_scalar_type(least)

    def fill(batches):
        rows = np.zeros((DEPTH, width), kind)
        for lang, held in _by_language(batches):
            for words, keys, _, counts in _grams(held, longest):
                for cells, at in zip(rows, _cells(lang, words, keys, longest, width)):
                    _add(cells, at, counts, least)
        packer = ZstdCompressor(level=1)
        for slab, cells in enumerate(rows.reshape(-1, min(SLAB, width))):
            if cells.any():
                yield pa.RecordBatch.from_pydict({"slab": pa.array([slab], pa.int32()), "cells": [packer.compress(cells.tobytes())]})

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        unpacker = ZstdDecompressor()
        for batch in batches:
            for slab, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                cells = np.frombuffer(unpacker.decompress(packed.as_py()), kind).astype(np.int64)
                sums[slab] = np.minimum(sums[slab] + cells, least) if slab in sums else cells
        for slab, cells in sums.items():
            yield pa.RecordBatch.from_pydict({"slab": pa.array([slab], pa.int32()), "bits": [np.packbits(cells >= least).tobytes()]})

    sketches = texts.mapInArrow(lean(fill), "slab int, cells binary")
    merged = sketches.repartition("slab").mapInArrow(lean(merge), "slab int, bits binary")
    return {row.slab: bytes(row.bits) for row in merged.collect()}


def phrase_counts(docs: DataFrame, least: int = 10, longest: int = 3) -> DataFrame:
    """(lang, size, phrase, f) of every phrase of 1 to `longest` words with at least `least` occurrences in its language,
    and a row of size 0 with the empty phrase for each language: the number of its words.

    f is exact: a phrase that the sketch lets through by mistake is counted and then dropped.  The
    sketch grows with the text up to MOST_CELLS; beyond that it lets more through, never less.
    """
    if longest not in (1, 2, 3):
        raise ValueError("phrases have 1 to 3 words")
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").filter("text <> ''")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    texts = texts.coalesce(max(size // A_TASK, texts.sparkSession.sparkContext.defaultParallelism))
    width = min(MOST_CELLS, max(LEAST_CELLS, 1 << (size // BYTES_PER_CELL).bit_length()))
    slab = min(SLAB, width)
    heavy = texts.sparkSession.sparkContext.broadcast(heavy_cells(texts, least, longest, width))

    def count_survivors(batches):
        bits = np.zeros((DEPTH * width // slab, slab // 8), np.uint8)
        for number, packed in heavy.value.items():
            bits[number] = np.frombuffer(packed, np.uint8)
        rows = bits.reshape(DEPTH, width // 8)
        for lang, held in _by_language(batches):
            for words, keys, sizes, counts in _grams(held, longest):
                often = np.ones(len(keys), bool)
                for row, at in zip(rows, _cells(lang, words, keys, longest, width)):
                    often &= (row[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
                total = int(counts[sizes == 1].sum())
                keys, sizes, counts = keys[often], sizes[often], counts[often]
                names = pa.array(words, pa.binary())
                for length in range(1, longest + 1):
                    these = sizes == length
                    if these.any():
                        parts = [names.take(pa.array(n)) for n in _numbers(keys[these], longest)[:length]]
                        phrase = pc.binary_join_element_wise(*parts, b" ").cast(pa.string())
                        n = len(phrase)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([length] * n, pa.int32()), phrase, pa.array(counts[these], pa.int64())], ["lang", "size", "phrase", "f"])
                yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([0], pa.int32()), pa.array([""]), pa.array([total], pa.int64())], ["lang", "size", "phrase", "f"])

    found = texts.mapInArrow(lean(count_survivors), "lang string, size int, phrase string, f bigint")
    return found.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).filter((F.col("f") >= least) | (F.col("size") == 0))


def score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)) of these columns."""
    a, left, right = (f"cast({c} AS decimal(38,0))" for c in (a, left, right))
    return F.expr(f"({a} * {a} * 1000000BD) DIV ({left} * {right})")


def possible(ends: DataFrame, longest: int, keep: int) -> DataFrame:
    """The candidates (lang, size, phrase, a; l and r: counts of their first and last words) that can be among a language's best, with `least`.

    No count of a phrase is above those of its words or below those of longer phrases that hold it.  So a phrase's score is
    at least `least`, that of its end words (of two words it is that), and one of three words scores at most floor(1000000 a / max(l, r)).
    Phrases of `longest` words are in no longer one and stay: if `keep` of them have at least some score, none below it is needed.
    """
    bounds = ends.withColumn("least", score("a", "l", "r"))
    most = F.when(F.col("size") == 2, F.col("least")).otherwise(F.expr("(cast(a AS decimal(38,0)) * 1000000BD) DIV cast(greatest(l, r) AS decimal(38,0))"))
    # Scores are at most 1000000, so a language has a few hundred bins.
    bins = bounds.filter(F.col("size") == longest).groupBy("lang", F.floor(16 * F.log2(F.col("least") + 1)).alias("bin")).agg(F.count("*").alias("n"), F.min("least").alias("floor"))
    reached = bins.withColumn("above", F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("bin"))))
    floors = written(reached.filter(F.col("above") >= keep).groupBy("lang").agg(F.max("floor").alias("_floor")), "floors")
    return bounds.join(bounded(floors), "lang", "left").filter(F.col("_floor").isNull() | (most >= F.col("_floor"))).drop("_floor")


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, share: int = 50, keep: int = 2000) -> DataFrame:
    """Each language's best `keep` phrases: (lang, rank, phrase, a, l, r, n, score).

    A phrase of 2 to `longest` words with a >= `least` occurrences is cut in two at its weakest place;
    score = floor(1000000 a a / (l r)).  It goes if a longer candidate holds its words and has at least
    `share` per cent of its occurrences.  Arithmetic is decimal with 38 digits, exact for counts up to 10^15.
    Null languages count as `und`; null and empty texts hold no words.  Very long texts are read in parts
    that share their border words.  Repeated rows count each time, other columns are ignored, and an
    empty table gives no rows.  Ties go to the larger a, then to the phrase in byte order.
    """
    counts = written(phrase_counts(docs, least, longest), "phrases")
    words = F.split("phrase", " ")
    ends = counts.filter("size >= 2").select("lang", "size", "phrase", F.col("f").alias("a"), F.element_at(words, 1).alias("_first"), F.element_at(words, -1).alias("_last"))
    single = counts.filter("size = 1").select("lang", "phrase", "f")
    for end, name in (("_first", "l"), ("_last", "r")):
        ends = written(spread_join(ends, single.withColumnsRenamed({"phrase": end, "f": name}), ["lang", end], "phrase").drop(end), "ends")
    hopeful = written(possible(ends, longest, keep), "hopeful")

    # Pairs go where a longer candidate holds them, hopeful or not.
    pairs, triples = hopeful.filter("size = 2").select("lang", "phrase", "a", "l", "r", F.col("least").alias("score")), hopeful.filter("size = 3")
    first, rest = F.array_join(F.slice(words, 1, 2), " "), F.array_join(F.slice(words, 2, 2), " ")
    longer = counts.filter("size = 3").select("lang", F.col("phrase").alias("_whole"), first.alias("_first"), rest.alias("_rest"), F.col("f").alias("_longer"))
    names = pairs.select("lang", "phrase")
    holders = [spread_join(longer.select("lang", F.col(end).alias("phrase"), "_longer", "_whole"), names, ["lang", "phrase"], "_whole", "left_semi") for end in ("_first", "_rest")]
    held = holders[0].unionByName(holders[1]).groupBy("lang", "phrase").agg(F.max("_longer").alias("_longer"))
    kept = pairs.join(held, ["lang", "phrase"], "left").filter(F.col("_longer").isNull() | (100 * F.col("_longer").cast("decimal(38,0)") < share * F.col("a").cast("decimal(38,0)"))).drop("_longer")

    double = counts.filter("size = 2").select("lang", "phrase", "f")
    cuts = triples.select("lang", "phrase", "a", "l", "r", first.alias("_first"), rest.alias("_rest"))
    for end in ("_first", "_rest"):
        cuts = written(spread_join(cuts, double.withColumnsRenamed({"phrase": end, "f": f"{end}_f"}), ["lang", end], "phrase"), "cuts")
    both = [F.struct(score("a", left, right).alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r")) for k, left, right in ((1, "l", "_rest_f"), (2, "_first_f", "r"))]
    weakest = cuts.select("lang", "phrase", "a", F.least(*both).alias("_cut"))
    scored = kept.unionByName(weakest.select("lang", "phrase", "a", "_cut.l", "_cut.r", "_cut.score"))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The best of each of 32 shares of a language come first, so no task orders a whole language.
    shares = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(32))).orderBy(*order)
    best = scored.withColumn("_place", F.row_number().over(shares)).filter(F.col("_place") <= keep)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= keep)
    totals = counts.filter("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(bounded(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
