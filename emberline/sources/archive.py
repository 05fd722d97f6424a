"""Archive records under either of two key names, exports, and ledgers that take each key once."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from emberline.operators.versions import Field, VersionedTable
from emberline.plans.tables import shared_folder
from emberline.registry import query

#: Fields and the key names that may hold them, the first one that is filled counts.
TEXTS = {"video_id": ("display_id", "video_id"), "channel_id": ("channel_id",), "title": ("title",), "description": ("description",), "category": ("categories", "category")}
DATES = ("upload_date", "crawl_date")
NUMBERS = {"final_view_count": ("view_count", "final_view_count"), "final_like_count": ("like_count", "final_like_count"), "final_dislike_count": ("dislike_count", "final_dislike_count")}
CANDIDATE = ("video_id", "channel_id", "title", "description", "category", "upload_date")
OUTCOME = ("video_id", "channel_id", "upload_date", "crawl_date", "final_view_count")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row for each JSON line of an archive (plain or .gz): TEXTS, DATES and NUMBERS, and the line itself if it cannot be parsed.

    Texts are trimmed, missing ones are empty.  Times without a zone are UTC; times and numbers that cannot be read are null.
    Blank lines are left out.  Only the named keys are parsed.
    """
    keys = sorted({k for names in [*TEXTS.values(), *NUMBERS.values()] for k in names} | set(DATES))
    schema = ", ".join(f"{k} string" for k in keys) + ", _broken string"
    lines = spark.read.text(path).filter("trim(value) <> ''")
    held = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("r"))

    def filled(name: str) -> Column:
        return F.nullif(F.trim(F.col(f"r.{name}")), F.lit(""))

    texts = [F.coalesce(*map(filled, names), F.lit("")).alias(field) for field, names in TEXTS.items()]
    dates = [F.try_to_timestamp(filled(name)).alias(name) for name in DATES]
    numbers = [F.coalesce(*map(filled, names)).try_cast("double").try_cast("bigint").alias(field) for field, names in NUMBERS.items()]
    return held.select(*texts, *dates, *numbers, F.col("r._broken").alias("broken"))


def candidate_and_outcome(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What was known at upload, and what came of it; no column of the second but the keys is in the first."""
    return records.select(*CANDIDATE), records.select(*OUTCOME)


def export(df: DataFrame, folder: str, kind: str = "json", by: list[str] | None = None) -> int:
    """Write rows as gzipped JSON lines or CSV with a header, in folders by the columns `by`; the number of rows, counted in the same pass.

    Nulls are left out of JSON lines and are empty in CSV, where empty texts are quoted.
    """
    seen = Observation()
    writer = df.observe(seen, F.count("*").alias("rows")).write.option("compression", "gzip")
    writer = writer.partitionBy(*by) if by else writer
    if kind == "csv":
        writer.options(header=True, escape='"', emptyValue='""', nullValue="").csv(folder)
    else:
        writer.json(folder)
    return seen.get["rows"]


def ledger(spark: SparkSession, folder: str, keys: list[str], value: str) -> VersionedTable:
    """A table that takes a key's first value, the largest of a batch, and never changes it."""
    return VersionedTable(spark, folder, keys, {value: Field(F.max(value), lambda old, new: old)})


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    """SELECT cast(o_orderkey AS varchar) AS video_id, 'c' || o_custkey AS channel_id, o_orderpriority AS title, o_orderstatus AS category, o_orderdate AS upload_date,
  CASE WHEN o_orderkey % 3 > 0 THEN cast(floor(o_totalprice) AS bigint) END AS final_view_count FROM orders"""
)
def archive_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory rows A8, A9 and A17: orders written as JSON lines under both sets of key names, read back and split."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    old = F.col("o_orderkey") % 2 == 0
    key, views = F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 3 > 0, F.floor("o_totalprice").cast("string"))
    rows = orders.select(
        F.when(old, key).alias("display_id"), F.when(~old, key).alias("video_id"), F.concat(F.lit("c"), "o_custkey").alias("channel_id"), F.concat(F.lit("  "), "o_orderpriority", F.lit(" ")).alias("title"),
        F.when(old, F.col("o_orderstatus")).alias("categories"), F.when(~old, F.col("o_orderstatus")).alias("category"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("upload_date"), F.when(old, views).alias("view_count"), F.when(~old, views).alias("final_view_count"),
    )
    folder = _folder(spark, "archive")
    export(rows, folder)
    candidate, outcome = candidate_and_outcome(read_records(spark, folder))
    both = candidate.select("video_id", "channel_id", "title", "category").join(outcome, ["video_id", "channel_id"])
    return both.select("video_id", "channel_id", "title", "category", F.col("upload_date").cast("timestamp_ntz").alias("upload_date"), "final_view_count")


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag, l_shipdate FROM lineitem")
def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory row A17: lines written as CSV in a folder for each flag and read back."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")
    folder = _folder(spark, "lines")
    wrote = export(lines, folder, "csv", ["l_returnflag"])
    found = spark.read.schema(lines.schema).options(header=True, escape='"').csv(folder)
    if found.count() != wrote:
        raise RuntimeError("an export lost rows")
    return found.select(*lines.columns)


@query("SELECT l_partkey, l_shipdate, max(l_quantity) AS value FROM lineitem WHERE l_linenumber <= 2 GROUP BY ALL UNION ALL SELECT l_partkey, l_shipdate, max(l_quantity) FROM lineitem a WHERE l_linenumber > 2 AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_linenumber <= 2 AND b.l_partkey = a.l_partkey AND b.l_shipdate = a.l_shipdate) GROUP BY ALL")
def ledger_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory row A16: points of a ledger by part and day, first lines first, then all of them twice."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_shipdate", "l_linenumber", F.col("l_quantity").alias("value"))
    points = ledger(spark, _folder(spark, "ledger"), ["l_partkey", "l_shipdate"], "value")
    for name, batch in (("first", lines.filter("l_linenumber <= 2")), ("all", lines.filter("l_linenumber > 2")), ("all", lines)):
        points.merge(batch, name)
    points.merge(lines, "again")
    return points.read()


@query(
    """WITH d AS (SELECT c_custkey, min(o_orderdate) AS seen FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)
SELECT 'v' || c_custkey AS video_id, 'n' || c_nationkey AS channel_id, c_name AS title, TIMESTAMP '1990-01-01' AS published_at, seen AS discovered_at, c_mktsegment AS description
FROM customer JOIN d USING (c_custkey)"""
)
def cohort_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory rows A1 and A2: customers written as a gzipped cohort, their orders as discovery lines, and read back."""
    from emberline.sources.files import read_cohort, read_discovery

    customers, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "orders"))
    video = F.concat(F.lit("v"), F.col("c_custkey")).alias("video_id")
    cohort, discovery = _folder(spark, "cohort"), _folder(spark, "discovery")
    export(customers.select(video, F.concat(F.lit("n"), F.col("c_nationkey")).alias("channel_id"), F.col("c_name").alias("title"), F.lit("1990-01-01").alias("upload_date"), F.col("c_mktsegment").alias("description")), cohort)
    at = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    orders.select(F.concat(F.lit("v"), F.col("o_custkey")), F.lit("x"), F.lit("y"), at).write.csv(discovery)
    found = read_cohort(spark, cohort, read_discovery(spark, discovery))
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("published_at", "discovered_at")})


@query("SELECT 'v' || l_orderkey AS video_id, l_shipdate AS observed_at, l_linenumber / 2e0 AS age_days, cast(floor(l_extendedprice) AS bigint) AS views FROM lineitem WHERE l_linenumber <> 3")
def snapshot_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory row A4: lines written as gzipped snapshots, those of one number without views, and read back."""
    from emberline.sources.files import read_snapshots

    lines, folder = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), _folder(spark, "snapshots")
    views = F.when(F.col("l_linenumber") != 3, F.floor("l_extendedprice"))
    at = F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    lines.select(F.concat(F.lit("v"), F.col("l_orderkey")), at, F.col("l_linenumber") * 43_200, views).write.option("compression", "gzip").csv(folder)
    return read_snapshots(spark, folder).withColumn("observed_at", F.col("observed_at").cast("timestamp_ntz"))


@query("SELECT 'v' || vec_id AS video_id, len(embedding) AS dimensions, round(list_sum(list_transform(embedding, lambda x: cast(x AS double))), 5) AS total FROM embeddings")
def embedding_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory row A3: vectors written as base64 in JSON lines and read back."""
    from emberline.sources.files import read_embeddings

    vectors, folder = spark.read.parquet(f"{sf_dir}/embeddings.parquet"), _folder(spark, "vectors")

    def encode(batches):
        for batch in batches:
            import base64

            import numpy as np

            texts = [base64.b64encode(np.asarray(v, "<f4").tobytes()).decode() for v in batch["embedding"]]
            yield batch[["video_id"]].assign(dimensions=[len(v) for v in batch["embedding"]], embedding_base64=texts)

    named = vectors.select(F.concat(F.lit("v"), F.col("vec_id")).alias("video_id"), "embedding")
    export(named.mapInPandas(encode, "video_id string, dimensions int, embedding_base64 string"), folder)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return read_embeddings(spark, folder).select("video_id", F.size("embedding").cast("bigint").alias("dimensions"), F.round(total, 5).alias("total"))
