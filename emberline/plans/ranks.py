"""Exact ranks and quantiles of groups of any size: no task holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.plans.tables import bounded, even_join, written


def positions(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, n, before, total): how many rows have a value, how many of the group a lesser one, and how many the group has.

    Equal values are counted first; distinct ones are put in ranges, whose sums give each range what lies before it.
    A range is the most that a task puts in order, also of a group with a third of all rows.  Null values (and null
    groups) take no part; NaN is the greatest value; an empty table gives an empty one.
    """
    counts = df.select(F.col(group).alias("g"), F.col(value).alias("v")).dropna(subset=["g"]).filter("v is not null").groupBy("g", "v").agg(F.count("*").alias("n"))
    ranged = written(written(counts, "counts").repartitionByRange("g", "v").withColumn("part", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("g", "part").agg(F.sum("n").alias("s"))
    # Ranges follow each other, so there are at most as many rows as groups and ranges together.
    own = Window.partitionBy("g")
    upto = own.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    starts = sums.select("g", "part", (F.sum("s").over(upto) - F.col("s")).alias("start"), F.sum("s").over(own).alias("total"))
    within = Window.partitionBy("g", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    run = ranged.withColumn("run", F.sum("n").over(within)).join(bounded(written(starts, "starts")), ["g", "part"])
    return run.select(F.col("g").alias(group), F.col("v").alias(value), "n", (F.col("start") + F.col("run") - F.col("n")).alias("before"), "total")


def with_average_rank(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """The rows with the share of their group below them, from 0 to 1: equal values share the mean of their ranks, a group of one has 1.

    Rows with a null group or value get null.  `df` is read twice.
    """
    share = F.when(F.col("total") == 1, F.lit(1.0)).otherwise((F.col("before") + (F.col("n") - 1) / 2) / (F.col("total") - 1))
    found = written(positions(df, group, value).select(group, value, share.alias(name)), "shares")
    spread = [c for c in df.columns if c not in (group, value)]
    return even_join(df, found, [group, value], spread[0] if spread else value, "left").select(*[F.col(f"`{c}`") for c in df.columns], name)


def quantiles(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(group, total, and one column for each name): quantiles interpolated between the two nearest rows, .5 being the median."""
    found = written(positions(df, group, value), "positions")
    low, high = F.col("before"), F.col("before") + F.col("n") - 1

    def at(place: Column) -> Column:
        return F.max(F.when((low <= place) & (place <= high), F.col(value).cast("double")))

    ends = [c for name, share in shares.items() for c in (at(F.floor((F.col("total") - 1) * share)).alias(f"_low_{name}"), at(F.ceil((F.col("total") - 1) * share)).alias(f"_high_{name}"))]
    place = {name: (F.col("total") - 1) * share for name, share in shares.items()}
    between = [(F.col(f"_low_{name}") + (F.col(f"_high_{name}") - F.col(f"_low_{name}")) * (p - F.floor(p))).alias(name) for name, p in place.items()]
    return found.groupBy(group, "total").agg(*ends).select(group, "total", *between)
