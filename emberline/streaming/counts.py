"""Overlapping trailing counts and first and last sightings over a stream of topic events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberline.registry import query

#: Lengths of the trailing windows (fixed values).
WINDOWS = {"n24": "24 hours", "n72": "72 hours", "n7": "7 days"}


def trailing_counts(events: DataFrame, length: str, key: str = "topic", at: str = "ts", lateness: str = "1 hour", slide: str = "1 hour") -> DataFrame:
    """(key, as_of, n): a key's events in the window of this length that ends at as_of, for every slide.

    Events are counted by slide first, so the long windows add up counts instead of holding each
    event in every window that covers it.  Windows come out once the watermark has passed them;
    events later than the lateness, and those with a null time, are not counted.  Works on batches too.
    """
    timed = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", lateness)
    small = timed.groupBy(F.window("_at", slide).alias("_slide"), key).count()
    whole = small.groupBy(F.window("_slide", length, slide).alias("_whole"), key).agg(F.sum("count").alias("n"))
    return whole.select(key, F.col("_whole.end").alias("as_of"), "n")


def once_each(events: DataFrame, key: str = "event_id", at: str = "ts", lateness: str = "1 hour") -> DataFrame:
    """Events without those whose key has been seen within the lateness; state is dropped after it."""
    return events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", lateness).dropDuplicatesWithinWatermark([key]).drop("_at")


def punctual_and_late(events: DataFrame, at: str, received: str, grace_seconds: int) -> tuple[DataFrame, DataFrame]:
    """(events that came within the grace of their time, the others with a reason): `no_time` or `late`.

    An event whose time of receipt is unknown counts as punctual.  The decision takes the row alone, so it is
    the same on a stream and on a table, and no state is kept for it.
    """
    waited = F.unix_seconds(F.col(received).cast("timestamp")) - F.unix_seconds(F.col(at).cast("timestamp"))
    reason = F.when(F.col(at).isNull(), "no_time").when(waited > grace_seconds, "late")
    judged = events.withColumn("reason", reason)
    return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null")


def counts_with_late_rows(events: DataFrame, target: str, late_target: str, checkpoint: str, key: str = "topic", at: str = "ts", lateness: str = "1 hour", slide: str = "1 hour") -> StreamingQuery:
    """Start a stream that writes counts by key and slide to `target`, and what came behind the watermark to `late_target`.

    Every batch is split by the time that earlier batches had reached: rows before it less the lateness, and those without a
    time, go to the side with a reason and the number of the batch; the rest is merged into the counts.
    Only keys that a batch holds are touched.  Both targets are versioned tables (`VersionedTable`) that
    know the batches they hold, so a batch that is run again after a failure changes nothing.
    """
    from emberline.operators.versions import Field, VersionedTable

    spark = events.sparkSession
    patience = F.expr(f"INTERVAL {lateness}")
    added = Field(F.count("*"), lambda old, new: old + new)
    counts = VersionedTable(spark, target, ["slide", key], {"n": added})
    late = VersionedTable(spark, late_target, [key, at, "reason", "batch"], {"n": added})
    reached = VersionedTable(spark, f"{target}-reached", ["one"], {"seen": Field(F.max(at), lambda old, new: F.greatest(old, new))})

    def take(batch: DataFrame, number: int) -> None:
        name = str(number)
        past = reached.read(batch.select(F.lit(1).alias("one"), F.col(at).alias("seen"))).first()
        behind = F.lit(False) if past is None or past.seen is None else F.coalesce(F.col(at) < F.lit(past.seen) - patience, F.lit(False))
        reason = F.when(F.col(at).isNull(), "no_time").when(behind, "late")
        rows = batch.select(key, at, reason.alias("reason"))
        late.merge(rows.filter("reason is not null").withColumn("batch", F.lit(number)), name)
        counts.merge(rows.filter("reason is null").select(F.window(at, slide).start.alias("slide"), key), name)
        # Last, so that a batch that is run again is split as before.
        reached.merge(batch.select(F.lit(1).alias("one"), at), name)

    return events.withColumn(at, F.col(at).cast("timestamp")).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@query(
    """WITH s AS (SELECT event_type AS topic, date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1, 2),
w AS (SELECT * FROM (VALUES ('n24', 24), ('n72', 72), ('n7', 168)) v(name, hours))
SELECT name, topic, h + to_hours(cast(i + 1 AS integer)) AS as_of, cast(sum(n) AS bigint) AS n FROM s, w, range(168) r(i) WHERE i < hours GROUP BY ALL"""
)
def overlapping_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory row K4 over a table: the three trailing counts of every event type, for every hour that has one."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumnRenamed("event_type", "topic")
    found = [trailing_counts(events, length).select(F.lit(name).alias("name"), "topic", F.col("as_of").cast("timestamp_ntz").alias("as_of"), "n") for name, length in WINDOWS.items()]
    return found[0].union(found[1]).union(found[2])
