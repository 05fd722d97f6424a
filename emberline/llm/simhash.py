"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most 2r bits have a common neighbour within r bits of both.
Every distinct fingerprint emits all variants within r bits; variants are shuffled, and what meets at
a variant is linked.  A variant has at most as many visitors as a ball has points (65 for r = 1), so
no key is hot, whatever the data; copies are folded into one fingerprint first.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, written
from .graph import connected_components

SEED, BITS = 42, 64


def fingerprint(text: str, shingle_words: int = 3) -> int:
    """Unsigned SimHash of the XXH64 of word shingles: words part at ASCII white space, A-Z is lowered."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle_words:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(shingle_words)), strict=False))
    hashes = np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
    set_bits = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)]
        set_bits += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(set_bits * 2 > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = 3) -> DataFrame:
    """(key, fp) with the fingerprint as a signed long; null texts count as empty, whose fingerprint is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py() or "", shingle_words) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=[key, "fp"])

    return df.select(F.col(key).cast("long").alias(key), F.col(text).alias(text)).mapInArrow(lean(run), f"`{key}` long, fp long")


def ball(radius: int) -> list[int]:
    """Signed masks of all bit sets of up to radius bits."""
    masks = [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(BITS), k)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def links(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect all pairs within max_bits bits.

    max_bits must be even: all that meet at a variant are then within max_bits of each other, so a
    star to the least of them connects exactly what the pairs would.
    """
    if max_bits % 2:
        raise ValueError("max_bits must be even")
    variants = distinct.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(m).cast("long")) for m in ball(max_bits // 2)])).alias("variant"))
    met = variants.withColumn("least", F.min("fp").over(Window.partitionBy("variant"))).filter("fp <> least")
    pairs = met.select(F.col("least").alias("a"), F.col("fp").alias("b")).distinct()
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", max_bits: int = 2, shingle_words: int = 3) -> DataFrame:
    """(key, fingerprint, component_id) for every row; component_id is the least key reachable by links.

    Null and empty texts share fingerprint zero and are linked like any other; rows with a null key
    keep it and never name a component that has another key; repeated rows stay; other columns are
    ignored; an empty table gives no rows.
    """
    own = written(fingerprints(df, key, text, shingle_words), "fingerprints")
    distinct = own.groupBy("fp").agg(F.min(key).alias("least_key"))
    found = connected_components(links(distinct.select("fp"), max_bits))
    rooted = distinct.join(found, distinct.fp == found.node, "left").select("fp", "least_key", F.coalesce("component", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_key").alias("component_id"))
    named = rooted.join(least, "root").select(F.col("fp").alias("_fp"), "component_id")
    joined = own.join(named, F.col("fp") == F.col("_fp"))
    return joined.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
