"""A channel's feed: questions in order of fit, volume and freshness, open ones first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.plans.ranks import quantiles, with_average_rank
from emberline.plans.tables import written
from emberline.registry import query

# Least fit, days in which freshness halves, entries of a feed, weights of the three ranks.
LEAST_FIT, HALF_LIFE_DAYS, MOST = 0.343, 14.0, 20
WEIGHTS = {"fit": 0.60, "volume": 0.25, "freshness": 0.15}


def rounded(share: Column) -> Column:
    """A number from 0 on to six places, from its binary value, as the SQL does; Spark's round goes by the decimal digits that are shown."""
    scaled = share * 1e6
    return (F.floor(scaled) + F.when(scaled - F.floor(scaled) >= 0.5, 1).otherwise(0)) / 1e6


def feed(entries: DataFrame, most: int = MOST) -> DataFrame:
    """(channel, position, item, actionable, rank) of each channel's first entries, from (channel, item, fit, volume, age_days, covered, answered).

    An entry too far from the channel is left out first.  fit, volume and freshness count as average ranks within the
    channel, so no scale outweighs another.  Entries that the channel has covered or that are answered come last; then rank
    decides, then the lesser item.  Null covered and answered mean no; a null in another column leaves a row out;
    repeated rows are entries of their own.
    """
    known = entries.dropna(subset=["channel", "item", "fit", "volume", "age_days"]).filter(F.col("fit") >= LEAST_FIT)
    shut = F.coalesce("covered", F.lit(False)) | F.coalesce("answered", F.lit(False))
    held = written(known.select("item", "channel", "fit", "volume", F.round(F.pow(F.lit(0.5), F.col("age_days") / HALF_LIFE_DAYS), 6).alias("freshness"), (~shut).alias("actionable")), "entries")
    for name in WEIGHTS:
        held = written(with_average_rank(held, "channel", name, f"{name}_rank"), "ranked")
    held = held.withColumn("rank", rounded(sum((w * F.col(f"{n}_rank") for n, w in list(WEIGHTS.items())[1:]), WEIGHTS["fit"] * F.col("fit_rank"))))
    # Spark cuts each task's rows to `most` a channel before they meet.
    order = Window.partitionBy("channel").orderBy(F.desc("actionable"), F.desc("rank"), "item")
    return held.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= most).select("channel", "position", "item", "actionable", "rank")


@query(
    """WITH e AS (SELECT doc_id AS item, source AS channel, (doc_id * 7919 % 1000) / 1000e0 AS fit, n_chars AS volume, round(pow(.5e0, doc_id % 90 / 14e0), 6) AS freshness, doc_id % 5 <> 0 AND NOT contains(text, '@') AS actionable FROM documents WHERE source IS NOT NULL AND n_chars IS NOT NULL AND text IS NOT NULL),
k AS (SELECT * FROM e WHERE fit >= .343e0),
r AS (SELECT *, count(*) OVER c AS n, rank() OVER (c ORDER BY fit) + (count(*) OVER (PARTITION BY channel, fit) - 1) / 2e0 - 1 AS a, rank() OVER (c ORDER BY volume) + (count(*) OVER (PARTITION BY channel, volume) - 1) / 2e0 - 1 AS b,
    rank() OVER (c ORDER BY freshness) + (count(*) OVER (PARTITION BY channel, freshness) - 1) / 2e0 - 1 AS d FROM k WINDOW c AS (PARTITION BY channel)),
s AS (SELECT *, CASE WHEN n = 1 THEN 1e0 ELSE round(.6e0 * (a / (n - 1)) + .25e0 * (b / (n - 1)) + .15e0 * (d / (n - 1)), 6) END AS rank FROM r),
o AS (SELECT channel, row_number() OVER (PARTITION BY channel ORDER BY actionable DESC, rank DESC, item) AS position, item, actionable, rank FROM s)
SELECT * FROM o WHERE position <= 20"""
)
def channel_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory row F5: sources stand for channels, documents for questions, their ids for fit and age, addresses for answers."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text is not null")
    return feed(rows.select(F.col("source").alias("channel"), F.col("doc_id").alias("item"), (F.col("doc_id") * 7919 % 1000 / 1000).alias("fit"), F.col("n_chars").alias("volume"), (F.col("doc_id") % 90).alias("age_days"), (F.col("doc_id") % 5 == 0).alias("covered"), F.contains("text", F.lit("@")).alias("answered")))


@query("SELECT source, count(*) AS total, round(quantile_cont(n_chars, .2), 4) AS p20, round(median(n_chars), 4) AS p50, round(quantile_cont(n_chars, .8), 4) AS p80 FROM documents WHERE source IS NOT NULL AND n_chars IS NOT NULL GROUP BY source")
def length_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory rows D3, D4 for groups of any size: exact quantiles of lengths by source."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "n_chars")
    found = quantiles(rows, "source", "n_chars", {"p20": 0.2, "p50": 0.5, "p80": 0.8})
    return found.select("source", "total", *[F.round(c, 4).alias(c) for c in ("p20", "p50", "p80")])
