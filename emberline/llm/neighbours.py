"""Approximate nearest neighbours: an NN-descent graph built by Spark joins, searched greedily.

Equal vectors are folded into one node.  The graph starts from brute force within small blocks of
random-hyperplane buckets; each round then joins every node with its neighbours (both ways), compares
these with each other where one of the two is new, and keeps each node's best, until few edges change.
A query walks the graph: in each round its best candidates not yet visited bring their neighbours,
until none of its best is left unvisited; how many are its best grows with the logarithm of the table.  All scores are in double precision on the original
vectors, as near copies differ by less than coarser numbers can tell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

EDGES = "v long, u long, score double"


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a binary column as doubles; the first byte of each names its number type, all are equally long."""
    rows = column.to_pylist()
    flat = np.frombuffer(b"".join(r[1:] for r in rows), rows[0][:1].decode())
    return flat.astype(np.float64).reshape(len(rows), -1)


def _unit(column: pa.Array) -> np.ndarray:
    rows = _matrix(column)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vec) of the rows whose vector has no null or non-finite component and is not zero."""
    v = F.col(vector)
    fine = F.col(key).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(F.coalesce(fine, F.lit(False))).select(F.col(key).cast("long").alias("id"), F.transform(v, lambda x: x.cast("double") + 0.0).alias("vec"))


def nodes(rows: DataFrame, kind: str = "d") -> DataFrame:
    """(node, vec): one node per distinct vector, named by its least id; shorter vectors are padded with zeros.

    kind is the number type in which vectors travel: "f" loses nothing if the components came as floats.
    """
    width = rows.agg(F.max(F.size("vec"))).first()[0] or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            full = np.zeros((len(batch), width), kind)
            for row, value in zip(full, batch.column(1).to_pylist(), strict=True):
                row[: len(value)] = value
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([kind.encode() + r.tobytes() for r in full], pa.binary())], names=["node", "vec"])

    return rows.groupBy("vec").agg(F.min("id").alias("node")).select("node", "vec").mapInArrow(run, "node long, vec binary")


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables that hold whole runs of equal leading key columns, from sorted batches."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([held, t]) if held is not None else t
        if not len(t):
            continue
        last = [t.column(k)[-1].as_py() for k in range(keys)]
        size = len(t)
        while size and all(t.column(k)[size - 1].as_py() == last[k] for k in range(keys)):
            size -= 1
        if size:
            yield t.slice(0, size).combine_chunks()
        held = t.slice(size)
    if held is not None and len(held):
        yield held.combine_chunks()


def _best(edges: DataFrame, k: int) -> DataFrame:
    """Each node's k best distinct neighbours, ties to the smaller one."""
    best = edges.groupBy("v", "u").agg(F.max("score").alias("score"), F.min("fresh").alias("fresh"))
    place = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("score"), "u"))
    return best.withColumn("_place", place).filter(F.col("_place") <= k).select("v", "u", "score", "fresh")


def start_graph(points: DataFrame, count: int, k: int, tables: int, block: int, seed: int) -> DataFrame:
    """Neighbours found within blocks of random-hyperplane buckets; a large bucket is cut into more blocks."""
    bits = max(0, math.ceil(math.log2(max(1, count) / block)))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            unit = _unit(batch.column(1))
            planes = np.random.default_rng(seed).standard_normal((tables, bits + 1, unit.shape[1]))
            for t in range(tables):
                side = unit @ planes[t].T
                bucket = (side[:, :bits] > 0) @ (1 << np.arange(bits)) if bits else np.zeros(len(unit), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(unit), t)), pa.array(bucket.astype(np.int64)), pa.array(side[:, bits]), batch.column(0), batch.column(1)], names=["t", "bucket", "along", "node", "vec"])

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, bucket, ids = (batch.column(c).to_numpy() for c in (0, 1, 3))
            unit = _unit(batch.column(4))
            cuts = np.flatnonzero(np.diff(t) | np.diff(bucket)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(ids)], strict=True):
                parts = max(1, math.ceil((b - a) / (2 * block)))
                for at in np.array_split(np.arange(a, b), parts):
                    if len(at) < 2:
                        continue
                    sims = unit[at] @ unit[at].T
                    np.fill_diagonal(sims, -2)
                    n = min(k, len(at) - 1)
                    top = np.argpartition(-sims, n - 1, axis=1)[:, :n]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[at], n)), pa.array(ids[at][top].ravel()), pa.array(np.take_along_axis(sims, top, 1).ravel())], names=["v", "u", "score"])

    dealt = points.select("node", "vec").mapInArrow(spread, "t long, bucket long, along double, node long, vec binary")
    dealt = dealt.repartition("t", "bucket").sortWithinPartitions("t", "bucket", "along", "node")
    return _best(dealt.mapInArrow(brute, EDGES).withColumn("fresh", F.lit(True)), k)


def both_ways(graph: DataFrame, k: int) -> DataFrame:
    """Neighbours of each node and its k best reverse neighbours."""
    back = graph.select(F.col("u").alias("v"), F.col("v").alias("u"), "score", "fresh")
    return graph.unionByName(_best(back, k)).groupBy("v", "u").agg(F.max("score").alias("score"), F.max("fresh").alias("fresh"))


def improve(graph: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """One NN-descent round: neighbours of a node are compared with each other; edges found now are fresh."""

    def local_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, 1):
            v, ids, least, fresh = (t.column(c).to_numpy() for c in (0, 1, 3, 4))
            unit = _unit(t.column(2).combine_chunks())
            cuts = np.flatnonzero(np.diff(v)) + 1
            out = []
            for a, b in zip([0, *cuts], [*cuts, len(ids)], strict=True):
                if not fresh[a:b].any():
                    continue
                sims = unit[a:b] @ unit[a:b].T
                np.fill_diagonal(sims, -3)
                row, col = np.nonzero((sims > least[a:b, None]) & (fresh[a:b, None] | fresh[None, a:b]))
                out.append((ids[a:b][row], ids[a:b][col], sims[row, col]))
            if out:
                x, y, s = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(s)], names=["v", "u", "score"])

    worst = graph.groupBy(F.col("v").alias("w")).agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(-2.0)).alias("least"))
    sides = points.select(F.col("node").alias("u"), "vec").join(worst, F.col("u") == F.col("w")).drop("w")
    around = both_ways(graph, k).select("v", "u", "fresh").join(sides, "u").select("v", "u", "vec", "least", "fresh")
    found = around.repartition("v").sortWithinPartitions("v").mapInArrow(local_join, EDGES)
    return _best(graph.withColumn("fresh", F.lit(False)).unionByName(found.withColumn("fresh", F.lit(True))), k)


def build_graph(points: DataFrame, k: int = 24, tables: int = 6, block: int = 400, settled: float = 0.01, seed: int = 11) -> DataFrame:
    """(v, u, score, fresh): an approximate graph of each node's k nearest nodes; every round is a written table.

    Rounds end when at most this share of the edges is new.
    """
    graph = written(start_graph(points, points.count(), k, tables, block, seed), "graph")
    while True:
        graph = written(improve(graph, points, k), "graph")
        edges, changed = graph.agg(F.count("*"), F.count_if("fresh")).first()
        if changed <= settled * edges:
            return graph


def _scores(pairs: DataFrame) -> DataFrame:
    """Cosine of (q, c, own, other) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            a, b = (_matrix(batch.column(c)) for c in (2, 3))
            score = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=["q", "c", "score"])

    return pairs.mapInArrow(run, "q long, c long, score double")


def greedy_search(asked: DataFrame, points: DataFrame, graph: DataFrame, count: int, breadth: int = 32, k: int = 24) -> DataFrame:
    """(q, c, score): each asked node's best candidates after a walk over the graph of `count` nodes.

    The beam holds breadth candidates for each doubling of the node count, as paths grow so.  In each
    step up to a third of it, those not yet visited first, bring their neighbours, until all of it have been visited.
    """
    beam = breadth * max(1, math.ceil(math.log2(max(2, count))))
    around = written(both_ways(graph, k), "adjacency")
    own = asked.join(points, asked.q == points.node).select("q", F.col("vec").alias("own"))
    near = around.select(F.col("v").alias("q"), F.col("u").alias("c"), "score").join(asked, "q", "left_semi")
    state = near.withColumn("open", F.lit(True))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    while True:
        state = state.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= beam)
        turn = F.sum(F.col("open").cast("int")).over(order)
        state = written(state.withColumn("go", F.col("open") & (turn <= beam // 3)).drop("_place"), "beam")
        if state.filter("go").isEmpty():
            return state.select("q", "c", "score")
        reached = state.filter("go").join(around.select("v", "u"), F.col("c") == F.col("v")).select("q", F.col("u").alias("c")).distinct()
        fresh = reached.filter("q <> c").join(state.select("q", "c"), ["q", "c"], "left_anti")
        pairs = fresh.join(points.select(F.col("node").alias("c"), F.col("vec").alias("other")), "c").join(own, "q").select("q", "c", "own", "other")
        scored = _scores(pairs).withColumn("open", F.lit(True))
        state = state.select("q", "c", "score", (F.col("open") & ~F.col("go")).alias("open")).unionByName(scored)


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, key: str = "vec_id", vector: str = "embedding", **options) -> DataFrame:
    """The k nearest other rows of every row whose key is divisible by `every`, by cosine.

    Gives (query_id, rank, vec_id, score).  Vectors that are null, zero, or hold null or non-finite
    components take no part, nor do null keys; shorter vectors count as padded with zeros; equal
    vectors are equally near and ties go to the smaller key; fewer candidates give fewer rows;
    repeated rows of a key stand as candidates once.
    """
    rows = written(usable(vectors, key, vector), "vectors")
    single = vectors.schema[vector].dataType.elementType.typeName() == "float"
    points = written(nodes(rows, "f" if single else "d"), "nodes")
    graph = build_graph(points, **options)
    named = rows.groupBy("vec").agg(F.min("id").alias("node"))
    owner = written(rows.join(named, "vec").select("id", "node").distinct(), "owners")
    queries = owner.filter(F.col("id") % every == 0)
    asked = queries.select(F.col("node").alias("q")).distinct()
    found = greedy_search(asked, points, graph, points.count())
    best = found.select("q", "c").union(asked.select("q", F.col("q").alias("c")))
    pairs = best.join(points.select(F.col("node").alias("c"), F.col("vec").alias("other")), "c").join(points.select(F.col("node").alias("q"), F.col("vec").alias("own")), "q")
    exact = _scores(pairs.select("q", "c", "own", "other"))
    member = F.row_number().over(Window.partitionBy("node").orderBy("id"))
    members = owner.withColumn("_n", member).filter(F.col("_n") <= k + 1).select(F.col("node").alias("c"), "id")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    top = exact.join(members, "c").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k + 1).select("q", "id", "score")
    answers = queries.select(F.col("id").alias("query_id"), F.col("node").alias("q")).join(top, "q").filter("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return answers.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
