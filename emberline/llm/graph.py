"""Connected components by alternating star contraction, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the least node of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    joined = both.filter("v > u").join(least, F.col("u") == F.col("w"))
    return joined.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the least of them."""
    least = edges.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    joined = edges.join(least, F.col("u") == F.col("w"))
    linked = joined.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component is the least node reachable.

    Loops, repeated edges, either direction and null ends (ignored) are allowed; no edges, no rows.
    Rounds end when the edges are a forest of stars that no longer changes.  Nothing is collected but
    one row of counts a round, and every round is a written table, so lost executors cost one round.
    """
    ends = edges.filter(F.col(a) != F.col(b))
    stars = written(ends.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    state = _fingerprint(stars)
    for _ in range(max_rounds):
        if not state[0]:
            break
        stars = written(_small_star(_large_star(stars)), "edges")
        before, state = state, _fingerprint(stars)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(stars.select(F.col("v"), F.col("v"))).distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)
