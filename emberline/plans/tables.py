"""Written intermediate tables, measured broadcasts and joins that spread hot keys."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key that a task of an even join takes.
AT_MOST = 50_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where none is set and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows from a table in the shared folder: computed once, and safe from lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _width(name: str, kind: str) -> Column:
    column = F.col(f"`{name}`")
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if kind.startswith(("struct", "map")):
        return F.octet_length(F.to_json(F.struct(column))) + 16
    if kind.startswith("array"):
        return F.greatest(F.size(column), F.lit(0)) * 16 + 16
    return F.lit(16)


def bounded(df: DataFrame, max_bytes: int = 64 << 20) -> DataFrame:
    """The side of a join, with a broadcast hint if it is measured to hold at most max_bytes."""
    width = sum((_width(*c) for c in df.dtypes), F.lit(0))
    size = df.agg(F.sum(width.cast("bigint"))).first()[0] or 0
    return F.broadcast(df) if size <= max_bytes else df


def even_join(many: DataFrame, few: DataFrame, keys: list[str], by: str, how: str = "inner") -> DataFrame:
    """Join a side whose keys may be hot with one that has few rows a key; how: inner, left, left_semi or left_anti.

    Unless the other side is small enough to broadcast, keys with over AT_MOST rows are counted first;
    their rows are dealt out by the column `by`, and their rows on the other side are repeated as
    often.  `many` is read twice.
    """
    side = bounded(few)
    if side is not few:
        return many.join(side, keys, how)
    hot = many.groupBy(*keys).count().filter(F.col("count") > AT_MOST).select(*keys, F.ceil(F.col("count") / AT_MOST).alias("_n"))
    hot = bounded(written(hot, "hot"))
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    dealt = many.join(hot, keys, "left").withColumn("_deal", F.coalesce(F.pmod(F.xxhash64(by), "_n"), zero)).drop("_n")
    copies = few.join(hot, keys, "left").withColumn("_deal", F.explode(F.sequence(zero, F.coalesce("_n", one) - 1))).drop("_n")
    return dealt.join(copies, [*keys, "_deal"], how).drop("_deal")
