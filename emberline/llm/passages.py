"""Removal of passages that repeat across documents.

Paragraphs are lines.  Near-duplicate paragraphs meet by MinHash bands over word shingles and are
verified by exact Jaccard similarity on 64-bit shingle hashes, which a second pass takes from the
texts of those paragraphs alone that meet others.  Copies are folded before any join.  A bucket's
paragraphs are compared with central ones of it first; what these leave in different components is
compared in full, less the pairs that exact bounds rule out, so no link is lost.

A passage may also sit in the middle of otherwise different paragraphs, where whole paragraphs are
not alike; so lines are cut further at words chosen by content (least hash within a few words on
either side), once line by line and once through the whole document, as a passage may be set in short
lines or wrapped anew, and pieces that are equal in two documents are found by one grouped count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, lean, written
from .graph import connected_components

MAX_REMEMBERED = 100_000
UNITS = "paragraph boolean, doc_id long, start int, n int, key long, bands array<long>"
#: Fixed odd multipliers, from a seeded generator.
_RANDOM = np.random.default_rng(7).integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_count(similarity: float, rows: int, recall: float) -> int:
    """Bands of so many rows that a pair of this similarity meets in at least one with this probability."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _RANDOM[0]
    return x ^ (x >> np.uint64(29))


def _multipliers(n: int) -> np.ndarray:
    """A multiplier for each place of a piece or paragraph."""
    return _RANDOM[:n] if n <= len(_RANDOM) else _mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


def _keys(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    place = np.arange(len(ids)) - np.repeat(starts, lengths)
    most = int(lengths.max())
    table = _multipliers(most) if most <= len(_RANDOM) else np.concatenate((_RANDOM, _mix(np.arange(len(_RANDOM), most, dtype=np.uint64)) | np.uint64(1)))
    return _mix(np.add.reduceat(ids * table[place], starts) + lengths.astype(np.uint64))


def _shingles(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every run of n words."""
    return _mix(sum(ids[k : len(ids) - n + 1 + k] * _RANDOM[100 + k] for k in range(n)))


def _word_ids(words: list[str], known: dict[str, int]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    for w in set(words).difference(known):
        known[w] = xxh64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _lines(text: str) -> list[list[str]]:
    return [words for line in text.lower().split("\n") if (words := line.split())]


def units(df: DataFrame, radius: int, shingle: int, min_paragraph: int, bands: int, rows: int, key: str, text: str) -> DataFrame:
    """One row per content-defined piece and per paragraph of at least min_paragraph words, in word offsets."""

    def cut(docs: list[tuple[int, list[list[str]]]], known: dict[str, int]) -> pa.RecordBatch:
        ids = _word_ids([w for _, lines in docs for line in lines for w in line], known)
        sizes = np.array([len(line) for _, lines in docs for line in lines])
        owner = np.repeat(np.arange(len(docs)), [len(lines) for _, lines in docs])
        line_starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        doc_starts = line_starts[np.searchsorted(owner, np.arange(len(docs)))]
        line = np.repeat(np.arange(len(sizes)), sizes)
        pair = _mix(ids + _mix(np.concatenate((ids[1:], ids[:1]))))

        def pieces(part: np.ndarray, part_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            last = np.concatenate((part[1:] != part[:-1], [True]))
            least = ~last
            for d in range(1, min(radius, len(ids) - 1) + 1):
                same = part[d:] == part[:-d]
                usable = same & ~last[d:]
                least[d:] &= ~same | (pair[d:] < pair[:-d])
                least[:-d] &= ~usable | (pair[:-d] < pair[d:])
            least[part_starts] = True
            starts = np.flatnonzero(least)
            return starts, np.append(starts[1:], len(ids))

        # Lines are cut alone, so that a repeated line is whole, and whole documents too, so that pieces run over line ends.
        starts, stops = pieces(line, line_starts)
        spans = [(starts, stops), pieces(owner[line], doc_starts)]
        # Lines that are cut too finely count whole; those of under shingle words with what precedes or follows them.
        low, tiny = (sizes >= shingle) & (sizes < 2 * (radius + 1)), np.flatnonzero(sizes < shingle)
        spans.append((line_starts[low], (line_starts + sizes)[low]))
        here, doc_stops = line_starts[tiny], np.append(doc_starts[1:], len(ids))
        after = np.searchsorted(stops, here + shingle)
        fits = stops[np.minimum(after, len(stops) - 1)] <= doc_stops[owner[tiny]]
        fits &= after < len(stops)
        spans.append((here[fits], stops[after[fits]]))
        before = np.searchsorted(starts, here + sizes[tiny] - shingle, side="right") - 1
        fits = (before >= 0) & (starts[before] >= doc_starts[owner[tiny]])
        spans.append((starts[before[fits]], (here + sizes[tiny])[fits]))
        starts, stops = (np.concatenate(c) for c in zip(*spans, strict=True))
        starts, stops = np.divmod(np.unique((starts * (len(ids) + 1) + stops)[stops - starts >= shingle]), len(ids) + 1)
        lengths = stops - starts
        doc_ids = np.array([d for d, _ in docs], np.int64)
        piece_doc = owner[line[starts]]
        offsets = np.cumsum(lengths) - lengths
        piece_keys = _keys(ids[np.arange(lengths.sum()) + np.repeat(starts - offsets, lengths)], offsets, lengths) if len(starts) else np.array([], np.uint64)
        columns = [
            [np.zeros(len(starts), bool), doc_ids[piece_doc], starts - doc_starts[piece_doc], lengths, piece_keys.view(np.int64)],
        ]
        long = np.flatnonzero(sizes >= min_paragraph)
        band_values = []
        if len(long):
            line_keys = _keys(ids, line_starts, sizes)
            columns.append([np.ones(len(long), bool), doc_ids[owner[long]], (line_starts - doc_starts[owner])[long], sizes[long], line_keys[long].view(np.int64)])
            hashes = _shingles(ids, shingle)
            within = np.concatenate([np.arange(line_starts[i], line_starts[i] + sizes[i] - shingle + 1) for i in long])
            hashes, counts = hashes[within], sizes[long] - shingle + 1
            at = np.concatenate(([0], np.cumsum(counts)[:-1]))
            values = np.empty((len(long), bands), np.uint64)
            for b in range(bands):
                value = np.full(len(long), b + 1, np.uint64)
                for r in range(rows):
                    value = _mix(value + np.minimum.reduceat(_mix(hashes * _RANDOM[200 + b * rows + r]), at))
                values[:, b] = value
            band_values = values.view(np.int64)
        n, m = len(starts), len(long)
        flat = [np.concatenate(c) for c in zip(*columns, strict=True)]
        offsets = np.concatenate((np.zeros(n + 1, np.int32), np.arange(1, m + 1, dtype=np.int32) * bands))
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.ravel(band_values).astype(np.int64) if m else np.array([], np.int64)))
        types = [pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(flat, types, strict=True)] + [lists], names=[c.split()[0] for c in UNITS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        held, size = [], 0
        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                lines = _lines(value.as_py())
                if lines:
                    held.append((doc_id, lines))
                    size += sum(map(len, lines))
                if size >= 100_000:
                    yield cut(held, known)
                    held, size = [], 0
                    if len(known) > MAX_REMEMBERED:
                        known.clear()
        if held:
            yield cut(held, known)

    rows_ = df.filter(F.col(key).isNotNull() & F.col(text).isNotNull())
    return rows_.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(run), UNITS)


def jaccard(x: bytes, y: bytes) -> float:
    """Jaccard similarity of two sorted lists of distinct 64-bit shingle hashes."""
    x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def paragraph_shingles(df: DataFrame, wanted: DataFrame, shingle: int, key: str, text: str) -> DataFrame:
    """(key, size, shingles): sorted distinct shingle hashes of the wanted paragraphs (key, doc_id, start) of the texts."""
    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("start", "key")).alias("_wanted"))
    side = bounded(written(lists.withColumnRenamed("doc_id", "_doc"), "wanted"))
    rows = df.filter(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).join(side, F.col("doc_id") == F.col("_doc")).select("text", "_wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            keys, found = [], []
            for value, places in zip(batch.column(0), batch.column(1), strict=True):
                at, own = 0, {p["start"]: p["key"] for p in places.as_py()}
                for words in _lines(value.as_py()):
                    if at in own and len(words) >= shingle:
                        keys.append(own[at])
                        found.append(np.unique(_shingles(_word_ids(words, known), shingle)))
                    at += len(words)
                if len(known) > MAX_REMEMBERED:
                    known.clear()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(map(len, found), pa.int32()), pa.array([f.astype("<u8").tobytes() for f in found], pa.binary())], names=["key", "size", "shingles"])

    # Rows that repeat a document's key may hold other texts: one paragraph of a key is enough.
    return rows.mapInArrow(lean(run), "key long, size int, shingles binary").groupBy("key").agg(F.first("size").alias("size"), F.first("shingles").alias("shingles"))


def shared_shingles(paragraphs: DataFrame) -> DataFrame:
    """(key, shared): how many of a paragraph's shingles another paragraph has too.

    A shingle's homes are folded to the least and the largest, so frequent ones meet as partial results.
    """
    each = F.expr("transform(sequence(0, size - 1), i -> substring(shingles, i * 8 + 1, 8))")
    homes = paragraphs.select("key", F.explode(each).alias("shingle")).groupBy("shingle").agg(F.min("key").alias("key"), F.max("key").alias("last"))
    alone = homes.groupBy("key").agg(F.sum(F.when(F.col("key") == F.col("last"), 1).otherwise(0)).alias("alone"))
    return paragraphs.select("key", "size").join(alone, "key", "left").select("key", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("shared"))


def band_buckets(classes: DataFrame) -> DataFrame:
    """(key, band, value, crowd): the band buckets that hold several of these distinct paragraphs (key, bands)."""
    met = classes.select("key", F.posexplode("bands").alias("band", "value"))
    crowds = met.groupBy("band", "value").agg(F.count("*").alias("crowd")).filter("crowd > 1")
    return met.join(crowds, ["band", "value"])


def paragraph_links(classes: DataFrame, buckets: DataFrame, shingles: DataFrame, similarity: float, hub_rounds: int = 2, block: int = 2048) -> DataFrame:
    """Links (a, b) between paragraph keys that connect all that share a band bucket and are alike.

    classes (key, bands), buckets as by band_buckets, shingles (key, size, shingles).  In each of the first rounds the
    paragraph of a bucket that meets most others is compared with the bucket's members in other components
    than its own.  Then all pairs of a bucket that are still in different components are compared,
    each in the first band that they share, but for those that exact bounds rule out: Jaccard distance
    is a metric, so distances to the bucket's first paragraph must lie near enough; and two paragraphs
    have at most those shingles in common that each shares with any other.  Large buckets are
    compared in blocks, so that tasks stay even.
    """

    @F.pandas_udf("double")
    def _jaccard(a, b):
        import pandas as pd

        return pd.Series([jaccard(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    own, other = shingles.select("key", F.col("shingles").alias("own")), shingles.select(F.col("key").alias("hub"), "shingles")

    def compared(pairs: DataFrame) -> DataFrame:
        return written(pairs.join(own, "key").join(other, "hub").select("key", "hub", _jaccard("own", "shingles").alias("s")), "compared")

    bucket, reach = ["band", "value"], 1 - similarity + 1e-9
    # Whoever meets most others over all bands is nearest the middle of its group.
    weights = buckets.groupBy("key").agg(F.sum("crowd").alias("weight"))
    counts = shingles.select("key", "size").join(shared_shingles(shingles), "key").filter(F.col("shared") >= similarity * F.col("size") - 1e-9)
    left = buckets.drop("crowd").join(weights.join(counts, "key"), "key").withColumns({"component": F.col("key"), "done": F.lit(False)})
    left, found, first = written(left, "buckets"), None, None
    for _ in range(hub_rounds):
        central = F.min(F.struct("done", (-F.col("weight")).alias("weight"), F.col("key").alias("hub"), F.col("component").alias("hub_component")))
        tops = written(left.groupBy(*bucket).agg(central.alias("top")).select(*bucket, "top.hub", "top.hub_component"), "hubs")
        scored = compared(left.join(tops, bucket).filter("component <> hub_component").select("key", "hub").distinct())
        first = first or (tops, scored)
        links = scored.filter(F.col("s") >= similarity).select(F.col("key").alias("a"), F.col("hub").alias("b"))
        found = links if found is None else found.union(links)
        components = written(connected_components(found).select(F.col("node").alias("key"), F.col("component").alias("now")), "components")
        left = left.join(components, "key", "left").withColumn("component", F.coalesce("now", "component")).drop("now", "done")
        hubs = tops.select(*bucket, F.col("hub").alias("key")).join(components, "key", "left").select(*bucket, F.coalesce("now", "key").alias("now"))
        open_ = left.groupBy(*bucket).agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a < b").select(*bucket)
        left = written(left.join(hubs.join(open_, bucket), bucket).withColumn("done", F.col("component") == F.col("now")).drop("now"), "buckets")
    tops, scored = first
    blocks = left.groupBy(*bucket).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    left = left.join(tops.join(blocks, bucket), bucket).join(scored, ["key", "hub"], "left").withColumn("s", F.when(F.col("key") == F.col("hub"), 1.0).otherwise(F.col("s")))
    left = left.withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    left = written(left.join(classes, "key").select("key", *bucket, "bands", "size", "shared", "s", "component", "blocks", "own"), "members")
    one = left.withColumn("to", F.explode(F.sequence("own", F.col("blocks") - 1))).withColumnRenamed("own", "from").drop("blocks")
    two = left.withColumn("from", F.explode(F.sequence(F.lit(0), "own"))).withColumnRenamed("own", "to").drop("blocks")
    two = two.select(*bucket, "from", "to", *[F.col(c).alias(f"hub_{c}") for c in ("key", "bands", "size", "shared", "s", "component")])
    most = F.least("shared", "hub_shared")
    possible = most >= similarity * (F.col("size") + F.col("hub_size") - most) - 1e-9
    near = F.coalesce(F.abs(F.col("s") - F.col("hub_s")) <= reach, F.lit(True))
    once = F.expr("not exists(sequence(0, band), b -> b < band and bands[b] = hub_bands[b])")
    apart = (F.col("component") != F.col("hub_component")) & ((F.col("from") != F.col("to")) | (F.col("key") < F.col("hub_key")))
    pairs = one.join(two, [*bucket, "from", "to"]).filter(apart & possible & near & once).select("key", F.col("hub_key").alias("hub"))
    rest = compared(pairs).filter(F.col("s") >= similarity).select(F.col("key").alias("a"), F.col("hub").alias("b"))
    return found.union(rest)


def alike_paragraphs(df: DataFrame, paragraphs: DataFrame, similarity: float, shingle: int, key: str, text: str) -> DataFrame:
    """(doc_id, start, n, first): near-duplicate paragraphs that several documents hold, with the least of these."""
    classes = written(paragraphs.groupBy("key").agg(F.first("bands").alias("bands")), "paragraph-classes")
    buckets = written(band_buckets(classes), "band-buckets")
    met = paragraphs.join(buckets.select("key").distinct(), "key", "left_semi")
    wanted = met.groupBy("key").agg(F.min(F.struct("doc_id", "start")).alias("at")).select("key", "at.doc_id", "at.start")
    shingles = written(paragraph_shingles(df, wanted, shingle, key, text), "paragraph-shingles")
    components = connected_components(paragraph_links(classes, buckets, shingles, similarity))
    # Equal paragraphs share a key and need no link.
    named = paragraphs.select("key", "doc_id", "start", "n").join(components.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    firsts = named.groupBy("component").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last")
    return named.join(firsts, "component").select("doc_id", "start", "n", "first")


def equal_pieces(pieces: DataFrame) -> DataFrame:
    """(doc_id, start, n, first): content-defined pieces that several documents hold, with the least of these."""
    shared = pieces.groupBy("key", "n").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    return pieces.join(shared.select("key", "n", "first"), ["key", "n"]).select("doc_id", "start", "n", "first")


def repeated_passages(
    df: DataFrame, min_words: int = 20, radius: int = 5, shingle: int = 5, min_paragraph: int = 20, similarity: float = 0.8, rows: int = 5, recall: float = 0.99, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Spans of at least min_words words that another document has too, in word offsets.

    Gives (key, start, n_words, component_id, removed): component_id is the least key among the documents
    that hold the passage or a near-duplicate paragraph of it, and the document of that key keeps it.
    Paragraphs of at least min_paragraph words are banded; shorter ones than min_words could not be
    reported.  Words part at white space and are compared in lower case.  Null keys and texts, texts
    without words and empty tables give no rows; rows that repeat a key count as one document; other
    columns are ignored; very long texts are taken whole, one at a time.
    """
    found = written(units(df, radius, shingle, max(min_paragraph, shingle), band_count(similarity, rows, recall), rows, key, text), "passage-units")
    equal = equal_pieces(found.filter("not paragraph").select("key", "doc_id", "start", "n"))
    alike = alike_paragraphs(df, found.filter("paragraph"), similarity, shingle, key, text)
    return merge_spans(equal.union(alike), min_words).withColumnRenamed("doc_id", key)


def merge_spans(spans: DataFrame, min_words: int, bridge: int = 4) -> DataFrame:
    """Join spans of a document that touch, overlap or leave at most bridge words, if all stay or all go.

    Pieces overlap, and copies may be cut in different ways at a passage's ends; so a span that stays
    counts only where it reaches beyond those that go, as an earlier document holds the rest.
    """
    own = spans.select("doc_id", "start", (F.col("start") + F.col("n")).alias("stop"), "first", (F.col("doc_id") != F.col("first")).alias("removed"))
    order = Window.partitionBy("doc_id", "removed").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = own.withColumn("island", F.sum(F.when(F.col("start") <= F.coalesce(reach + bridge, F.lit(-1)), 0).otherwise(1)).over(order))
    merged = islands.groupBy("doc_id", "removed", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("first").alias("component_id"))
    long = merged.filter(F.col("stop") - F.col("start") >= min_words)
    gone = F.max(F.when(F.col("removed"), F.col("stop"))).over(Window.partitionBy("doc_id").orderBy("start"))
    whole = long.withColumn("gone", gone).filter(F.col("removed") | F.col("gone").isNull() | (F.col("gone") < F.col("stop")))
    return whole.select("doc_id", "start", (F.col("stop") - F.col("start")).alias("n_words"), "component_id", "removed")


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without these (start, n) word spans; what stays keeps its white space."""
    import re

    gone = set()
    for start, n in spans:
        gone.update(range(start, start + n))
    at, count = [], 0
    for m in re.finditer(r"[^\S\n]*\S+|\n", text):
        if m.group() == "\n":
            at.append("\n")
            continue
        if count not in gone:
            at.append(m.group())
        count += 1
    lines = "".join(at).split("\n")
    had = text.split("\n")
    return "\n".join(line.strip() if line != old else line for line, old in zip(lines, had, strict=True) if line.strip() or not old.strip())


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Every row with its later copies of repeated passages taken out of the text; other columns stay.

    Rows whose text has words but loses all of them go; null and empty texts stay.
    """
    spans = repeated_passages(df.select(key, text), key=key, text=text, **options).filter("removed")
    lists = written(spans.groupBy(F.col(key).alias("_key")).agg(F.collect_list(F.struct("start", "n_words")).alias("_spans")), "spans")

    @F.pandas_udf("string")
    def kept(texts, spans_):
        import pandas as pd

        return pd.Series([t if s is None or t is None else without_spans(t, [(x["start"], x["n_words"]) for x in s]) for t, s in zip(texts, spans_, strict=True)], dtype="object")

    whole = df.select(F.struct("*").alias("_row"), F.col(key).cast("long").alias("_id"), F.col(text).alias("_text"))
    joined = whole.join(bounded(lists), F.col("_id") == F.col("_key"), "left")
    joined = joined.withColumn("_left", F.coalesce(kept(F.when(F.col("_spans").isNotNull(), F.col("_text")), F.col("_spans")), F.col("_text")))
    stays = F.col("_spans").isNull() | (F.length(F.trim("_left")) > 0)
    return joined.filter(stays).select(*[F.col("_left").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in df.columns])
