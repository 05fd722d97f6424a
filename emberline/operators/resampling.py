"""Bootstrap intervals as data: a seeded hash gives every unit its weight in every replicate."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.plans.tables import bounded, written
from emberline.registry import query

#: Replicates, seeds of the two intervals, bounds of an interval.
REPLICATES, SEED, TOPIC_SEED = 500, 17, 20260813
LOWER, UPPER = 0.025, 0.975
#: Score ranges that are summed up before any row is put in order.
RANGES = 200


def poisson_steps() -> list[int]:
    """The least of 2^32 equally likely numbers that give a weight of 1, 2, ...: a Poisson variable of mean one."""
    steps, below, term = [], 0.0, math.exp(-1)
    for k in range(1, 13):
        below += term
        term /= k
        steps.append(int(below * 2**32))
    return [s for s in steps if s < 2**32]


def weight(seed: int, replicate: Column, unit: Column) -> Column:
    """How often a replicate holds a unit; the same for the same names on any partitioning."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), replicate.cast("string"), unit.cast("string")), 256)
    drawn = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return sum(((drawn >= s).cast("int") for s in poisson_steps()), F.lit(0))


def lifts(rows: DataFrame, seed: int, selected, replicates: int = REPLICATES) -> DataFrame:
    """(replicate, n, positives, hits, lift): how much likelier the best-scored rows of each replicate are positive than all of them.

    rows: (id, unit, score, label); all rows of a unit are drawn together.  `selected` gives how many of n rows (a column) are chosen,
    best score first, ties to the lesser id.  Rows are summed up by score range first; only the range
    in which a replicate's choice ends is put in order.  Rows with a null in any of the four are left out;
    a replicate without a positive row has no lift and is left out.
    """
    held = written(rows.select("id", "unit", F.col("score").cast("double").alias("score"), F.col("label").cast("int").alias("label")).dropna(), "episodes")
    cuts = held.agg(F.percentile_approx("score", [k / RANGES for k in range(1, RANGES)], 10_000)).first()[0] or []
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c > F.col("score"))) if cuts else F.lit(0)
    held = held.withColumn("bucket", bucket)
    # A unit's rows of one range count together, so each unit is hashed once for each of its ranges and replicates.
    units = written(held.groupBy("unit", "bucket").agg(F.count("*").alias("c"), F.sum("label").alias("l")), "units")
    each = F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")
    # Rows of weight 0 stay: a filter would hash each of them once for every possible weight.
    drawn = units.select("*", each).withColumn("w", weight(seed, F.col("replicate"), F.col("unit")))
    sums = written(drawn.groupBy("replicate", "bucket").agg(F.sum(F.col("w") * F.col("c")).alias("w"), F.sum(F.col("w") * F.col("l")).alias("p")), "ranges")
    # At most RANGES rows for each replicate.
    own = Window.partitionBy("replicate")
    upto = own.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    run = sums.withColumns({"n": F.sum("w").over(own), "positives": F.sum("p").over(own), "through": F.sum("w").over(upto), "hits_through": F.sum("p").over(upto)})
    chosen = run.filter("w > 0").withColumn("count", selected(F.col("n"))).filter((F.col("through") >= F.col("count")) & (F.col("through") - F.col("w") < F.col("count")))
    ends = written(chosen.select("replicate", "bucket", "n", "positives", (F.col("count") - F.col("through") + F.col("w")).alias("rest"), (F.col("hits_through") - F.col("p")).alias("hits")), "ends")
    order = Window.partitionBy("replicate").orderBy(F.desc("score"), "id").rowsBetween(Window.unboundedPreceding, 0)
    # Only rows of the range in which a replicate ends are hashed for it.
    last = held.join(bounded(ends), "bucket").withColumn("w", weight(seed, F.col("replicate"), F.col("unit"))).withColumn("before", F.sum("w").over(order) - F.col("w"))
    taken = F.greatest(F.lit(0), F.least(F.col("w"), F.col("rest") - F.col("before"))) * F.col("label")
    found = last.groupBy("replicate", "n", "positives", "rest", "hits").agg(F.sum(taken).alias("more"))
    count, hits = selected(F.col("n")), F.col("hits") + F.col("more")
    return found.filter("positives > 0").select("replicate", "n", "positives", hits.alias("hits"), (hits / count / (F.col("positives") / F.col("n"))).alias("lift"))


def interval(found: DataFrame, places) -> DataFrame:
    """(resamples, lower, median, upper) of lifts, one for each replicate; `places` gives the three places of a number of lifts."""
    ordered = found.agg(F.array_sort(F.collect_list("lift")).alias("all"))
    size = F.size("all")
    at = places(size)
    return ordered.select(size.alias("resamples"), *[F.round(F.get("all", place.cast("int")), 6).alias(name) for name, place in zip(("lower", "median", "upper"), at)])


def fifth(n: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(n / 5))


def fifth_up(n: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(n * 0.2))


def cut_places(size: Column) -> list[Column]:
    return [F.floor(LOWER * size), F.floor(size / 2), F.least(size - 1, F.floor(UPPER * size))]


def even_places(size: Column) -> list[Column]:
    return [F.least(size - 1, F.bround((size - 1) * f)) for f in (LOWER, 0.5, UPPER)]


#: Labelled documents stand for episodes: length for the score, quality for the outcome, source for the topic.
EPISODES = "SELECT l.doc_id AS id, d.source AS unit, least(1e0, d.n_chars / 8000e0) AS score, l.quality AS label FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE d.source IS NOT NULL"


def _sql(seed: int, unit: str, count: str, places: tuple[str, str, str]) -> str:
    weights = " + ".join(f"(h >= {s})::int" for s in poisson_steps())
    return f"""WITH e AS ({EPISODES}), r AS (SELECT unnest(range(1, {REPLICATES + 1})) AS replicate),
u AS (SELECT replicate, unit, cast('0x' || substr(sha256(concat_ws(':', '{seed}', replicate, unit)), 1, 8) AS bigint) AS h FROM r, (SELECT DISTINCT {unit} AS unit FROM e)),
x AS (SELECT replicate, id, score, label, {weights} AS w FROM e JOIN u ON u.unit = e.{unit}),
y AS (SELECT *, sum(w) OVER (PARTITION BY replicate ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) - w AS before, sum(w) OVER (PARTITION BY replicate) AS n, sum(w * label) OVER (PARTITION BY replicate) AS p FROM x WHERE w > 0),
z AS (SELECT replicate, any_value({count}) AS c, any_value(n) AS n, any_value(p) AS p, sum(label * greatest(0, least(w, {count} - before))) AS hits FROM y GROUP BY replicate),
l AS (SELECT list_sort(list(hits / c / (p / n))) AS a FROM z WHERE p > 0), s AS (SELECT a, len(a) AS m FROM l)
SELECT m AS resamples, {", ".join(f"round(a[1 + cast({p} AS bigint)], 6) AS {name}" for name, p in zip(("lower", "median", "upper"), places))} FROM s"""


@query(_sql(SEED, "id", "greatest(1, n // 5)", ("floor(.025 * m)", "floor(m / 2)", "least(m - 1, floor(.975 * m))")))
def bootstrap_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory row J12: every episode is drawn by itself (Poisson weights for draws with replacement)."""
    rows = _episodes(spark, sf_dir)
    return interval(lifts(rows.withColumn("unit", F.col("id")), SEED, fifth), cut_places)


@query(_sql(TOPIC_SEED, "unit", "greatest(1, ceil(n * 2e-1))", ("round_even((m - 1) * .025e0, 0)", "round_even((m - 1) * .5e0, 0)", "least(m - 1, round_even((m - 1) * .975e0, 0))")))
def cluster_bootstrap_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory row J12b: all episodes of a topic are drawn together."""
    return interval(lifts(_episodes(spark, sf_dir), TOPIC_SEED, fifth_up), even_places)


def _episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberline.plans.dialect import spark_sql

    return spark_sql(spark, sf_dir, EPISODES)
