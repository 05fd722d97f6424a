"""Readers of the exported files: discovery times, cohorts, embedding caches and view snapshots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of a description that a cohort keeps (fixed value).
DESCRIPTION = 800


def instant(text: Column) -> Column:
    """A timestamp from ISO text; without a zone it is UTC, malformed text fails the read."""
    zoned = text.rlike(r"[T ].*(Z|[+-]\d{2}(:?\d{2})?)$")
    dated = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit("T00:00:00Z"))).otherwise(F.concat(text, F.lit("Z")))
    return F.when(zoned, text).otherwise(dated).cast("timestamp")


def _columns(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A headerless CSV (plain or gzip) with these leading columns; shorter rows have nulls, further columns are left out."""
    return spark.read.schema(", ".join(f"{n} string" for n in names)).csv(path, header=False, quote='"', escape='"', mode="PERMISSIVE")


def read_discovery(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, discovered_at) from a CSV whose fourth column is the time; rows without one are left out.

    Of a video's repeated rows the earliest time counts.
    """
    rows = _columns(spark, path, ["video_id", "_b", "_c", "at"]).filter("at <> ''")
    return rows.groupBy("video_id").agg(F.min(instant(F.col("at"))).alias("discovered_at"))


def read_cohort(spark: SparkSession, path: str, discovery: DataFrame | None) -> DataFrame:
    """(video_id, channel_id, title, published_at, discovered_at, description) from JSON lines, plain or gzip.

    With a discovery table only its videos stay.  With None every video counts as discovered when it
    was published, earlier than anybody can have seen it, so use that only to compare methods.
    """
    rows = spark.read.schema("video_id string, channel_id string, title string, upload_date string, description string").json(path, mode="FAILFAST")
    videos = rows.select("video_id", "channel_id", "title", instant(F.col("upload_date")).alias("published_at"), F.substring(F.coalesce("description", F.lit("")), 1, DESCRIPTION).alias("description"))
    seen = videos.withColumn("discovered_at", F.col("published_at")) if discovery is None else videos.join(discovery.select("video_id", "discovered_at"), "video_id")
    return seen.select("video_id", "channel_id", "title", "published_at", "discovered_at", "description")


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, embedding) from JSON lines with base64 little-endian floats; a wrong number of bytes fails the read."""
    rows = spark.read.schema("video_id string, dimensions int, embedding_base64 string").json(path, mode="FAILFAST")
    raw = F.unbase64("embedding_base64")
    checked = F.when(F.length(raw) == F.col("dimensions") * 4, raw).otherwise(F.raise_error(F.concat(F.lit("embedding of another length: "), F.col("video_id"))).cast("binary"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"video_id": batch["video_id"], "embedding": [np.frombuffer(b, "<f4") for b in batch["raw"]]})

    return rows.select("video_id", checked.alias("raw")).mapInPandas(decode, "video_id string, embedding array<float>")


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, observed_at, age_days, views) from a CSV of id, time, age in seconds and views; rows without views are left out."""
    rows = _columns(spark, path, ["video_id", "at", "age", "views"]).filter("views <> ''")
    return rows.select("video_id", instant(F.col("at")).alias("observed_at"), (F.col("age").cast("long") / 86_400).alias("age_days"), F.col("views").cast("long").alias("views"))
