"""Burst states, as-of snapshots, outcome cooldown and the guard against look-ahead."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.plans.dialect import render, spark_sql
from emberline.registry import query
from emberline.sources.roles import AS_OF, TOPIC_EVENTS, VIDEOS

DAY = 86_400
# The two-state burst model and the outcome window.
BURST_DAYS, RECENT_DAYS, BURST_SCALE, TRANSITION_COST = 28, 7, 2.0, 1.0
OUTCOME_DAYS = 42
#: Lower bounds of the channel sizes.
SIZES = {"large": 1_000_000, "medium": 100_000, "small": 10_000, "micro": None}


class SeenTooLate(ValueError):
    """A feature's input was observed after the checkpoint."""


def visible_only(df: DataFrame, observed_at: str, as_of: datetime) -> DataFrame:
    """The rows themselves; raises if any was observed after the checkpoint (nulls were never observed and pass)."""
    if not df.filter(F.col(observed_at) > F.lit(as_of)).isEmpty():
        raise SeenTooLate(f"{observed_at} holds times after {as_of}")
    return df


def _elevated_share(counts: Column) -> Column:
    """Share of the last days that the cheapest two-state path spends in the elevated state."""
    base = F.greatest(F.aggregate(counts, F.lit(0.0), lambda total, n: total + n) / F.size(counts), F.lit(1e-6))

    def emission(state: int, n: Column) -> Column:
        rate = base * (BURST_SCALE if state else 1.0)
        return rate - n * F.log(rate)

    def step(held: Column, n: Column) -> Column:
        fields = []
        for state in (0, 1):
            calm, loud = (held[f"cost{origin}"] + (0.0 if origin == state else TRANSITION_COST) + emission(state, n) for origin in (0, 1))
            fields.append(F.least(calm, loud).alias(f"cost{state}"))
            came = F.when(calm <= loud, held["path0"]).otherwise(held["path1"])
            fields.append(F.concat(came, F.array(F.lit(state))).alias(f"path{state}"))
        return F.struct(*fields)

    none = F.array().cast("array<int>")
    begin = F.struct(F.lit(0.0).alias("cost0"), none.alias("path0"), F.lit(0.0).alias("cost1"), none.alias("path1"))
    path = F.aggregate(counts, begin, step, lambda held: F.when(held["cost0"] <= held["cost1"], held["path0"]).otherwise(held["path1"]))
    recent = F.slice(path, -RECENT_DAYS, RECENT_DAYS)
    return F.round(F.aggregate(recent, F.lit(0.0), lambda total, state: total + state) / RECENT_DAYS, 6)


def burst_states(uploads: DataFrame, as_of: datetime, key: str = "topic", at: str = "published_at") -> DataFrame:
    """(key, burst): each key's burst share as of the checkpoint; 0 for keys with no upload in the window.

    Only one count a day and key leaves the grouped pre-aggregate, so a key's array has 29 entries
    however many uploads it has.  Null times count as outside the window; null keys form a group.
    """
    back = F.unix_timestamp(F.lit(as_of)) - F.unix_timestamp(F.col(at).cast("timestamp"))
    inside = F.coalesce((back >= 0) & (back <= BURST_DAYS * DAY), F.lit(False))
    daily = uploads.select(F.col(key), F.when(inside, F.floor(back / DAY)).alias("_ago")).groupBy(key, "_ago").count()
    held = daily.groupBy(key).agg(F.map_from_entries(F.collect_list(F.when(F.col("_ago").isNotNull(), F.struct("_ago", "count")))).alias("_days"))
    counts = F.transform(F.sequence(F.lit(BURST_DAYS), F.lit(0)), lambda ago: F.coalesce(F.col("_days")[ago.cast("long")], F.lit(0)))
    return held.select(key, F.when(F.size("_days") > 0, _elevated_share(counts)).otherwise(F.lit(0.0)).alias("burst"))


def after_cooldown(candidates: DataFrame, key: str, on: str, days: int = OUTCOME_DAYS) -> DataFrame:
    """(key, on): a key's dates that lie at least so many days after its last kept date, the first one always.

    Dates are made distinct before they meet, so a key's array is bounded by the calendar; null dates are left out.
    """
    dates = candidates.filter(F.col(on).isNotNull()).select(key, F.col(on).cast("date").alias(on)).distinct()
    ordered = dates.groupBy(key).agg(F.sort_array(F.collect_list(on)).alias("_dates"))

    def keep(kept: Column, day: Column) -> Column:
        soon = (F.size(kept) > 0) & (F.date_diff(day, F.try_element_at(kept, F.lit(-1))) < days)
        return F.when(soon, kept).otherwise(F.concat(kept, F.array(day)))

    kept = F.aggregate("_dates", F.array().cast("array<date>"), keep)
    return ordered.select(key, F.explode(kept).alias(on))


def as_of_join(asked: DataFrame, known: DataFrame, key: str, at: str, values: list[str], tie: str) -> DataFrame:
    """Each asked row with the values of the latest known row of its key at or before its time, else nulls.

    Of known rows with one time the one with the largest tie counts.  Both sides are split by key
    and day: a day's rows look back within the day, and otherwise to the key's last earlier day with
    a known row, so a hot key is spread over its days.  Asked rows with a null key or time get nulls.
    """
    held = F.struct(*[F.col(v) for v in values])
    sides = asked.withColumn("_tie", F.lit(None).cast(known.schema[tie].dataType)).withColumn("_value", F.lit(None).cast(known.select(held).schema[0].dataType))
    facts = known.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, at, F.col(tie).alias("_tie"), held.alias("_value"))
    rows = sides.withColumn("_asked", F.lit(1)).unionByName(facts.withColumn("_asked", F.lit(0)), allowMissingColumns=True).withColumn("_day", F.to_date(at))
    within = Window.partitionBy(key, "_day").orderBy(at, "_asked", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    today = rows.withColumn("_today", F.last("_value", True).over(within)).filter("_asked = 1")
    closing = facts.groupBy(key, F.to_date(at).alias("_day")).agg(F.max_by("_value", F.struct(at, "_tie")).alias("_last"))
    days = closing.unionByName(today.select(key, "_day").distinct(), allowMissingColumns=True).groupBy(key, "_day").agg(F.max("_last").alias("_last"))
    before = Window.partitionBy(key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select(key, "_day", F.last("_last", True).over(before).alias("_before"))
    found = today.join(carried, [key, "_day"], "left").withColumn("_value", F.coalesce("_today", "_before"))
    return found.select(*asked.columns, *[F.col("_value")[v].alias(v) for v in values])


def size_bucket(subscribers: Column) -> Column:
    """Channel size by subscribers; null where they are unknown."""
    steps = F.when(subscribers.isNull(), F.lit(None))
    for name, least in SIZES.items():
        steps = steps.otherwise(F.lit(name)) if least is None else steps.when(subscribers >= least, name)
    return steps


@query(
    render(
        f"""WITH RECURSIVE e AS ({TOPIC_EVENTS}), w AS (SELECT topic, ({BURST_DAYS} - cast(floor(epoch({AS_OF} - ts) / {DAY}) AS integer)) AS i FROM e),
c AS (SELECT topic, i, count(*) AS n FROM w WHERE i >= 0 GROUP BY topic, i),
t AS (SELECT topic, sum(n) / {BURST_DAYS + 1}e0 AS r FROM c GROUP BY topic),
o AS (SELECT t.topic, t.r, d.i, coalesce(c.n, 0) AS n, r - coalesce(c.n, 0) * ln(r) AS a, 2 * r - coalesce(c.n, 0) * ln(2 * r) AS b
  FROM t CROSS JOIN (SELECT unnest(range({BURST_DAYS + 1})) AS i) d LEFT JOIN c ON c.topic = t.topic AND c.i = d.i),
v AS (SELECT topic, i, a AS x, b AS y, '0' AS p, '1' AS q FROM o WHERE i = 0
  UNION ALL SELECT o.topic, o.i, least(v.x + o.a, v.y + 1 + o.a), least(v.x + 1 + o.b, v.y + o.b),
    CASE WHEN v.x + o.a <= v.y + 1 + o.a THEN v.p ELSE v.q END || '0', CASE WHEN v.x + 1 + o.b <= v.y + o.b THEN v.p ELSE v.q END || '1'
  FROM v JOIN o ON o.topic = v.topic AND o.i = v.i + 1),
z AS (SELECT topic, CASE WHEN x <= y THEN p ELSE q END AS path FROM v WHERE i = {BURST_DAYS})
SELECT topic, round(len(replace(right(path, {RECENT_DAYS}), '0', '')) / {RECENT_DAYS}e0, 6) AS burst FROM z""",
        1,
    )
)
def burst_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory rows J5 and B4: the events pass the guard against look-ahead first."""
    as_of = datetime.fromisoformat(AS_OF.split("'")[1] + "+00:00")
    return burst_states(visible_only(spark_sql(spark, sf_dir, render(TOPIC_EVENTS, 0)), "ts", as_of), as_of, at="ts")


@query(
    render(
        f"""WITH RECURSIVE d AS (SELECT DISTINCT channel_id, cast(published_at AS date) AS checkpoint FROM ({VIDEOS}) v),
k AS (SELECT channel_id, min(checkpoint) AS checkpoint FROM d GROUP BY channel_id
  UNION ALL SELECT channel_id, checkpoint FROM (SELECT d.channel_id, d.checkpoint, row_number() OVER (PARTITION BY d.channel_id ORDER BY d.checkpoint) AS n
    FROM k JOIN d ON d.channel_id = k.channel_id AND d.checkpoint - k.checkpoint >= {OUTCOME_DAYS}) x WHERE n = 1)
SELECT channel_id, checkpoint FROM k""",
        1,
    )
)
def episode_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory row E15: a channel's uploads stand for a topic's candidates."""
    videos = spark_sql(spark, sf_dir, render(VIDEOS, 0)).withColumnRenamed("published_at", "checkpoint")
    return after_cooldown(videos, "channel_id", "checkpoint")


@query(
    """SELECT e.event_id, e.user_id, arg_max(s.value, (s.ts, s.event_id)) AS subscribers,
  CASE WHEN subscribers IS NULL THEN NULL WHEN subscribers * 1000 >= 1000000 THEN 'large' WHEN subscribers * 1000 >= 100000 THEN 'medium'
    WHEN subscribers * 1000 >= 10000 THEN 'small' ELSE 'micro' END AS size
FROM events e LEFT JOIN events s ON s.event_type = 'signup' AND s.user_id = e.user_id AND s.ts <= e.ts
WHERE e.event_type <> 'signup' GROUP BY e.event_id, e.user_id"""
)
def asof_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory row C9: a signup's value stands for thousands of subscribers."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    known = events.filter("event_type = 'signup'").select("user_id", "ts", "event_id", F.col("value").alias("subscribers"))
    asked = events.filter("event_type <> 'signup'").select("event_id", "user_id", "ts")
    found = as_of_join(asked, known, "user_id", "ts", ["subscribers"], "event_id")
    return found.select("event_id", "user_id", "subscribers", size_bucket(F.col("subscribers") * 1000).alias("size"))
