"""Tables that change: merging batches into a versioned target, and folding joins and departures into intervals."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.plans.tables import shared_folder
from emberline.registry import query


@dataclass(frozen=True)
class Field:
    """A column of a target: what a batch's rows of one key give, and what that makes of the stored value."""

    of_batch: Column
    merged: Callable[[Column, Column], Column]


class VersionedTable:
    """A table in a shared folder of which every merged batch makes a new version.

    Readers see the version that the manifest with the largest number names.  A merge writes
    the new version beside the old ones and then puts the next manifest in place by one rename, which
    fails if another writer was first; what a lost driver leaves behind is never named.  A manifest lists the
    batches that its version holds, so a repeated batch changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], fields: dict[str, Field]):
        self.spark, self.folder, self.keys, self.fields = spark, folder, keys, fields
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """The newest manifest: number, folder of the version (null if there is none) and batches."""
        if not self._files.exists(self._path(self.folder)):
            return {"number": 0, "table": None, "batches": []}
        names = [f.getPath().getName() for f in self._files.listStatus(self._path(self.folder))]
        newest = max((n for n in names if n.startswith("manifest-")), default=None)
        if newest is None:
            return {"number": 0, "table": None, "batches": []}
        return json.loads(self.spark.read.text(f"{self.folder}/{newest}", wholetext=True).first()[0])

    def read(self, like: DataFrame | None = None) -> DataFrame:
        """The rows of the newest version; before the first one an empty table with the columns of `like`."""
        table = self.manifest()["table"]
        if table is None:
            if like is None:
                raise LookupError(f"{self.folder} holds no version")
            return like.limit(0)
        return self.spark.read.parquet(f"{self.folder}/{table}")

    def merge(self, batch: DataFrame, batch_id: str) -> bool:
        """Merge a batch by the keys; False if the table holds it already.

        Rows of one key are brought together before they meet the target, so a repeated or hot key is one row
        there.  Keys are compared as equal where both are null.
        """
        now = self.manifest()
        if batch_id in now["batches"]:
            return False
        fresh = batch.groupBy(*self.keys).agg(*[f.of_batch.alias(name) for name, f in self.fields.items()])
        old = self.read(fresh)
        same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in self.keys]
        met = old.withColumn("_old", F.lit(True)).alias("o").join(fresh.withColumn("_new", F.lit(True)).alias("n"), same, "full")

        def value(name: str, merged: Column) -> Column:
            return F.when(F.col("_old").isNull(), F.col(f"n.{name}")).when(F.col("_new").isNull(), F.col(f"o.{name}")).otherwise(merged).alias(name)

        columns = [value(k, F.col(f"o.{k}")) for k in self.keys] + [value(n, f.merged(F.col(f"o.{n}"), F.col(f"n.{n}"))) for n, f in self.fields.items()]
        table = f"version-{uuid.uuid4().hex}"
        met.select(*columns).write.parquet(f"{self.folder}/{table}")
        self._publish({"number": now["number"] + 1, "table": table, "batches": [*now["batches"], batch_id]})
        return True

    def _publish(self, manifest: dict) -> None:
        draft = self._path(f"{self.folder}/draft-{uuid.uuid4().hex}")
        stream = self._files.create(draft, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        final = self._path(f"{self.folder}/manifest-{manifest['number']:09d}.json")
        if self._files.exists(final) or not self._files.rename(draft, final):
            self._files.delete(draft, False)
            raise RuntimeError(f"another writer published version {manifest['number']} of {self.folder}")


def observed(at: str) -> dict[str, Field]:
    """First and last time that a key was seen, and how often."""
    return {
        "first_seen": Field(F.min(at), F.least),
        "last_seen": Field(F.max(at), F.greatest),
        "observation_count": Field(F.count("*"), lambda old, new: old + new),
    }


def fold_changes(memberships: DataFrame, changes: DataFrame, key: str = "channel_id") -> DataFrame:
    """(key, joined_at, reason, left_at, left_reason): memberships with changes (key, changed_at, joining, reason) applied in order of time.

    A join opens an interval; a departure closes all that are open then, and nothing if none is.  At
    one time departures come before joins, and repeated changes count each time.  Closed rows stay as they are.
    Changes without a key, a time or a direction are left out.
    """
    valid = changes.filter(F.col(key).isNotNull() & F.col("changed_at").isNotNull() & F.col("joining").isNotNull())
    left = F.when(~F.col("joining"), F.struct("changed_at", "reason"))
    events = valid.select(key, "changed_at", F.col("joining").cast("int").alias("_order"), F.col("changed_at").alias("joined_at"), "reason", left.alias("_leave"))
    open_rows = memberships.filter("left_at is null").select(key, F.lit(None).cast(changes.schema["changed_at"].dataType).alias("changed_at"), F.lit(1).alias("_order"), "joined_at", "reason", F.lit(None).cast(events.schema["_leave"].dataType).alias("_leave"))
    # Departures of one time and reason close the same rows, so a null time (already open) goes first.
    after = Window.partitionBy(key).orderBy(F.col("changed_at").asc_nulls_first(), "_order", "reason").rowsBetween(1, Window.unboundedFollowing)
    found = open_rows.unionByName(events).withColumn("_closed", F.first("_leave", True).over(after)).filter("_leave is null")
    opened = found.select(key, "joined_at", "reason", F.col("_closed.changed_at").alias("left_at"), F.col("_closed.reason").alias("left_reason"))
    return memberships.filter("left_at is not null").select(*opened.columns).unionByName(opened)


@query("SELECT user_id, event_type, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS observation_count FROM events GROUP BY user_id, event_type")
def observation_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory rows G11 and K6: three batches of events, of which the second comes twice, merged into one target."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    target = VersionedTable(spark, f"{shared_folder(spark)}/upsert-{uuid.uuid4().hex}", ["user_id", "event_type"], observed("ts"))
    batches = ("ts < '2024-01-11'", "ts >= '2024-01-11' AND ts < '2024-01-21'", "ts >= '2024-01-21'")
    for n in (0, 1, 1, 2):
        target.merge(events.filter(batches[n]), f"batch-{n}")
    return target.read()


#: Customers stand for channels, of which the even ones are members; their orders stand for changes.
CHANGES = "SELECT o_custkey AS channel_id, o_orderdate AS changed_at, o_orderkey % 3 > 0 AS joining, o_orderpriority AS reason FROM orders"
MEMBERS = "SELECT c_custkey AS channel_id, TIMESTAMP '1990-01-01 00:00:00' AS joined_at, 'seed' AS reason, CASE WHEN c_custkey % 4 = 0 THEN TIMESTAMP '1994-01-01 00:00:00' END AS left_at, CASE WHEN c_custkey % 4 = 0 THEN 'dormant' END AS left_reason FROM customer WHERE c_custkey % 2 = 0"


@query(
    f"""WITH c AS ({CHANGES}), m AS ({MEMBERS}), j AS (SELECT row_number() OVER () AS n, channel_id, joined_at, reason, TIMESTAMP '1900-01-01' AS since FROM m WHERE left_at IS NULL
  UNION ALL SELECT -row_number() OVER (), channel_id, changed_at, reason, changed_at FROM c WHERE joining),
x AS (SELECT j.n, min((c.changed_at, c.reason)) AS l FROM j JOIN c ON c.channel_id = j.channel_id AND NOT c.joining AND c.changed_at > j.since GROUP BY j.n)
SELECT channel_id, joined_at, reason, l[1] AS left_at, l[2] AS left_reason FROM j LEFT JOIN x USING (n) UNION ALL SELECT * FROM m WHERE left_at IS NOT NULL"""
)
def membership_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory row G12."""
    from emberline.plans.dialect import spark_sql

    return fold_changes(spark_sql(spark, sf_dir, MEMBERS), spark_sql(spark, sf_dir, CHANGES))
