"""Connected components of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.plans.tables import even_join, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node that has an edge, with the least node that it reaches.

    Every round hangs each node's larger neighbours, and then each node with its smaller ones, on the
    least node known near it; after a number of rounds logarithmic in the graph's size the edges are
    stars.  Each round is a written table, hot nodes are spread over tasks, and only a count and a
    checksum come to the driver.  Loops, repeated edges and null ends do not matter.
    """
    ends = edges.filter(F.col(a) != F.col(b))
    links = written(ends.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).distinct(), "links")
    seen = None
    while (now := links.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()) != seen and now[0]:
        seen = now
        links = written(_to_smaller(_to_least(links)), "links")
    stars = links.select(F.col("high").alias("node"), F.col("low").alias("component"))
    return stars.union(links.select("low", "low").distinct())


def _to_least(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours linked to the least of the node and all its neighbours."""
    least_low = links.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("least"))
    nodes = links.select(F.col("low").alias("node")).distinct().join(least_low, "node", "left")
    hung = even_join(links.withColumnRenamed("low", "node"), nodes, ["node"], "high")
    return hung.select("high", F.coalesce("least", "node").alias("low")).distinct()


def _to_smaller(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours linked to the least of those."""
    least = links.groupBy("high").agg(F.min("low").alias("least"))
    moved = even_join(links, least, ["high"], "low").filter("low > least").select(F.col("low").alias("high"), F.col("least").alias("low"))
    return moved.union(least.select("high", F.col("least").alias("low"))).distinct()
