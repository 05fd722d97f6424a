"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fold that is never learnt from: crc32(id as text) mod FOLDS == HELD_OUT.
FOLDS, HELD_OUT = 4, 2


#: Rows and bytes in one Arrow batch; whole texts can be long, and two tasks share an executor's memory.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 250, "spark.sql.execution.arrow.maxBytesPerBatch": 2 << 20}


#: Rows that a Parquet reader holds at once and bytes of a writer's row group (a reader takes such a group whole): what is
#: allocated there in one piece makes an executor's heap grow, which its JVM does not give back to later stages.
FILES = {"spark.sql.parquet.columnarReaderBatchSize": 250, "parquet.block.size": 8 << 20}


def small_batches(spark: SparkSession, settings: dict[str, int] = BATCH) -> None:
    """Keep batches of whole texts small in this session (queries and the pipeline do so; operators leave settings alone)."""
    for name, most in settings.items():
        now = int((spark.conf.get(name, None) or "0").removesuffix("b"))
        if not 0 < now <= most:
            spark.conf.set(name, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and the master is local."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for one written table in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write once to the shared folder and read it again: several consumers, no recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lean(run):
    """Wrap a batch function so that a reused worker gives freed memory back after each task."""

    def wrapped(batches):
        import gc

        import pyarrow as pa

        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            import ctypes

            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # not glibc

    return wrapped


class Remembered:
    """Values of keys, computed for many keys at a time and kept in two generations of at most `limit` keys each.

    What is asked for again moves to the recent generation; when that is full it becomes the older
    one, so frequent keys stay.  compute takes a list of distinct keys and gives a dictionary.
    """

    def __init__(self, compute, limit: int, longest: int = 64):
        self.compute, self.limit, self.longest = compute, limit, longest
        self.recent, self.older = {}, {}

    def values(self, keys: list[str]) -> list:
        """The values of distinct keys."""
        values = list(map(self.recent.get, keys))
        missing = [i for i, x in enumerate(values) if x is None]
        if missing:
            found = {k: x for i in missing if (x := self.older.get(k := keys[i])) is not None}
            found |= self.compute([k for i in missing if (k := keys[i]) not in found])
            for i in missing:
                values[i] = found[keys[i]]
            if len(self.recent) + len(found) > self.limit:
                self.older, self.recent = self.recent, {}
            self.recent.update((k, x) for k, x in found.items() if len(k) <= self.longest)
        return values


def slices(batch, column: int, most_bytes: int = 2 << 20):
    """The batch in slices whose texts in this column have at most so many bytes together (a longer text is alone)."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to


def gathered(batches, column: int, least_bytes: int = 4 << 20):
    """Neighbouring batches joined until the texts of this column have at least so many bytes together."""
    import pyarrow as pa

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= least_bytes:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod FOLDS; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """Whether a side has been counted to hold at most max_rows rows (the check before a broadcast)."""
    return df.limit(max_rows + 1).count() <= max_rows


def bounded(df: DataFrame, max_bytes: int = 64 << 20) -> DataFrame:
    """The side of a join with a broadcast hint if its values hold at most max_bytes; else as it is."""
    sizes = []
    for name, kind in df.dtypes:
        held = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            sizes.append(F.coalesce(F.octet_length(held), F.lit(0)) + 16)
        elif kind.startswith(("array", "map", "struct")):
            sizes.append(F.octet_length(F.to_json(F.struct(held))) + 16)
        else:
            sizes.append(F.lit(16))
    size = df.agg(F.sum(sum(sizes[1:], sizes[0]).cast("long"))).first()[0]
    return F.broadcast(df) if (size or 0) <= max_bytes else df


#: Rows of a key that one task of a spread join takes.
AT_MOST = 50_000


def spread_join(large: DataFrame, small: DataFrame, keys: list[str], by: str, how: str = "inner") -> DataFrame:
    """Join a side whose keys may be hot with one that has few rows a key (how: inner, left or left_semi).

    The small side is broadcast if it is measured to be small.  Else the large side's keys are counted;
    the rows of a key with more than AT_MOST are dealt out by their column `by` and the key's rows on
    the small side repeated as often.  At most one key for every AT_MOST rows is such a key.  The large
    side is read twice, so it should be cheap to read.
    """
    side = bounded(small)
    if side is not small:
        return large.join(side, keys, how)
    often = large.groupBy(*keys).count().filter(F.col("count") > AT_MOST)
    often = bounded(written(often.select(*keys, F.ceil(F.col("count") / AT_MOST).alias("_shares")), "often"))
    share = F.coalesce(F.pmod(F.xxhash64(by), F.col("_shares")), F.lit(0).cast("bigint"))
    dealt = large.join(often, keys, "left").withColumn("_share", share).drop("_shares")
    shares = F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("_shares"), F.lit(1).cast("bigint")) - 1)
    copies = small.join(often, keys, "left").withColumn("_share", F.explode(shares)).drop("_shares")
    return dealt.join(copies, [*keys, "_share"], how).drop("_share")


def without(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows whose key is not among ids (one column); rows with a null key stay."""
    gone = written(ids.toDF("_gone").filter("_gone is not null").distinct(), "gone")
    side = bounded(gone)
    return df.join(side, df[key] == side["_gone"], "left_anti")
