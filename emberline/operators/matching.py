"""Short texts inside long ones, and nearest vectors, without comparing every two rows as rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import small_batches
from emberline.plans.tables import bounded, even_join, written

TOKEN = "[a-zà-ÿ0-9]+"
#: A token that has something else on both sides, so that a text that holds the quote holds it as a whole token.
INNER = f"(?<=[^a-zà-ÿ0-9]){TOKEN}(?=[^a-zà-ÿ0-9])"
#: Vectors in a block, of whose products with another block a task holds 16 MB, and bytes of vectors that a block of queries meets in one task.
BLOCK, PART = 2048, 64 << 20


def tokens(text: Column, pattern: str = TOKEN) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)))


def contained_pairs(documents: DataFrame, items: DataFrame, share: int = 92) -> DataFrame:
    """(doc_id, item_id, containment) of all pairs whose common tokens are `share` per cent of the smaller set at least.

    documents: (doc_id, toks), items: (item_id, toks), ids being keys and tokens distinct; items are the smaller table.  Of two such sets the
    smaller one has a shared token among any tokens that are more than it may miss.  For an item these are its rarest in the documents;
    for a document those that no item holds come first.  Only these tokens meet, then the pairs are compared exactly.
    """

    def rest(n: str) -> Column:
        return F.col(n) - F.floor((F.col(n) * share + 99) / 100) + 1

    held = written(documents.select("doc_id", "toks"), "tokens")  # tokens are found once
    held = held.filter("doc_id is not null and size(toks) > 0").withColumn("n", F.size("toks"))
    known = items.filter("item_id is not null and size(toks) > 0").withColumn("m", F.size("toks"))
    postings = known.select("item_id", "m", F.explode("toks").alias("token"))
    words = bounded(postings.select("token").distinct())
    df = held.select(F.explode("toks").alias("token")).join(words, "token").groupBy("token").agg(F.count("*").alias("df"))
    df = written(words.join(df, "token", "left").select("token", F.coalesce("df", F.lit(0)).alias("df")), "frequencies")
    # Items that are not larger than the document.
    ranked = postings.join(bounded(df), "token").groupBy("item_id", "m").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ranked"))
    first = ranked.select("item_id", "m", F.explode(F.slice("ranked", F.lit(1), rest("m").cast("int"))).alias("t")).select("item_id", "m", "t.token")
    large = held.select("doc_id", "n", F.explode("toks").alias("token")).join(bounded(first), "token").filter("m <= n").select("doc_id", "item_id")
    # Documents that are smaller than some item.
    most = known.agg(F.max("m")).first()[0] or 0
    small = held.filter(F.col("n") < most).select("doc_id", "n", F.explode("toks").alias("token")).join(bounded(df), "token")
    small = small.groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ranked"))
    taken = rest("n") - (F.col("n") - F.size("ranked"))
    small = small.filter(taken > 0).select("doc_id", "n", F.explode(F.slice("ranked", F.lit(1), taken.cast("int"))).alias("t")).select("doc_id", "n", "t.token")
    small = even_join(small, postings, ["token"], "doc_id").filter("n < m").select("doc_id", "item_id")
    pairs = written(large.union(small).distinct(), "candidates")
    both = even_join(pairs, held.select("doc_id", "toks"), ["doc_id"], "item_id") if bounded(pairs) is pairs else held.select("doc_id", "toks").join(F.broadcast(pairs), "doc_id")
    both = even_join(both, known.select("item_id", F.col("toks").alias("other")), ["item_id"], "doc_id")
    sizes = F.least(F.size("toks"), F.size("other"))
    both = both.withColumn("overlap", F.size(F.array_intersect("toks", "other"))).filter(F.col("overlap") * 100 >= sizes * share)
    return both.select("doc_id", "item_id", F.round(F.col("overlap") * 1.0 / sizes, 6).alias("containment"))


def carriers(documents: DataFrame, quotes: DataFrame) -> DataFrame:
    """(quote, n): the documents (text) that hold each of the distinct quotes (quote, in lower case), in lower case; quotes without any are left out.

    A quote is only sought in texts that hold the rarest of its inner tokens; one without an inner token is sought in all.
    """
    asked = written(quotes.filter("quote is not null").select("quote", tokens(F.col("quote"), INNER).alias("inner")).distinct(), "quotes")
    lowered = documents.select(F.lower("text").alias("text")).filter("text is not null")
    listed = lowered.select("text", tokens(F.col("text")).alias("toks"))
    postings = asked.select("quote", F.explode("inner").alias("token"))
    words = bounded(postings.select("token").distinct())
    df = written(listed.select(F.explode("toks").alias("token")).join(words, "token").groupBy("token").agg(F.count("*").alias("df")), "frequencies")
    anchor = postings.join(bounded(df), "token", "left").groupBy("quote").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token")).alias("t")).select("quote", "t.token")
    near = listed.select("text", F.explode("toks").alias("token")).join(bounded(anchor), "token").select("text", "quote")
    plain = lowered.crossJoin(bounded(asked.filter("size(inner) = 0").select("quote")))
    return near.union(plain).filter(F.contains("text", "quote")).groupBy("quote").agg(F.count("*").alias("n"))


def _packed(kind: str, most: int):
    """Blocks of up to `most` vectors of one length, their parts as numbers of a numpy type."""
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), ("dim", pa.int32()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, labels, data = zip(*held.pop(dim))
            return pa.RecordBatch.from_arrays([pa.array([list(ids)], schema[0].type), pa.array([list(labels)], schema[1].type), pa.array([dim], pa.int32()), pa.array([np.stack(data).tobytes()], pa.binary())], schema=schema)

        for batch in batches:
            for vec_id, label, vector in zip(batch.column("id").to_pylist(), batch.column("label").to_pylist(), batch.column("vector")):
                values = vector.values.to_numpy(zero_copy_only=False).astype(kind)
                own = held.setdefault(len(values), [])
                own.append((vec_id, label, values))
                if len(own) == most:
                    yield block(len(values))
        for dim in list(held):
            yield block(dim)

    return run


class _Best:
    """What may be among each query's best of the blocks that one block of queries has met; products are summed up part by part."""

    def __init__(self, row: dict, kind: str, most: int, least: float | None, apart: bool):
        self.name, self.kind, self.most, self.least, self.apart = row["q_block"], kind, most, least, apart
        self.x, self.norm, self.ids, self.labels = self._vectors(row["q_data"], row["q_ids"], row["q_labels"], row["dim"])
        self.at, self.other, self.total = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        #: The product of each query's `most`-th best other vector so far.
        self.floor = np.full(len(self.ids), -np.inf)

    def _vectors(self, data: bytes, ids: list, labels: list, dim: int) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
        x = np.frombuffer(data, self.kind).reshape(-1, dim)
        with np.errstate(all="ignore"):
            norm = float(np.sqrt((x.astype(np.float64) ** 2).sum(1).max(initial=0)))
        return x, norm, np.array(ids), np.array(labels, object)

    def meet(self, row: dict) -> None:
        held, norm, ids, labels = self._vectors(row["data"], row["ids"], row["labels"], row["dim"])
        with np.errstate(all="ignore"):
            # Single precision finds what may count; its error is at most this, and six decimals are another 1e-6.
            spread = 2e-6 + 2 * (self.x.shape[1] + 4) * 1.2e-7 * self.norm * norm
            spread = spread if spread < 1e30 else np.inf
            near = self.x.astype(np.float32, copy=False) @ held.astype(np.float32, copy=False).T
            if spread == np.inf:
                near[np.isnan(near)] = np.inf
            floor = self.floor if self.least is None else np.maximum(self.floor, self.least)
            if (self.floor == -np.inf).any() and near.shape[1] > self.most:
                open_ = np.where(self._barred(np.arange(len(self.ids))[:, None], ids[None, :], labels[None, :]), -np.inf, near)
                floor = np.maximum(floor, np.partition(open_, -self.most, axis=1)[:, -self.most])
            floor = np.where(floor > -np.inf, floor - spread, -np.inf)
            at, to = np.nonzero(near >= floor[:, None].astype(np.float32) - np.float32(1e-6))
            kept = ~self._barred(at, ids[to], labels[to])
            at, to = at[kept], to[kept]
            total, x, y = np.zeros(len(at)), self.x.T.astype(np.float64), held.T.astype(np.float64)
            for a, b in zip(x, y):
                total += a[at] * b[to]
        self._add(at, ids[to], total)

    def _barred(self, at: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> np.ndarray:
        barred = self.ids[at] == ids
        if self.apart:
            mine = self.labels[at]
            barred = barred | np.equal(mine, labels).astype(bool) | np.equal(mine, None).astype(bool) | np.equal(labels, None).astype(bool)
        return barred

    def _add(self, at: np.ndarray, other: np.ndarray, total: np.ndarray) -> None:
        at, other, total = np.concatenate([self.at, at]), np.concatenate([self.other, other]), np.concatenate([self.total, total])
        worth = np.where(np.isnan(total), np.inf, total)
        order = np.lexsort((other, -worth, at))
        at, other, total, worth = at[order], other[order], total[order], worth[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        last = np.flatnonzero(place == self.most - 1)
        self.floor[at[last]] = worth[last]
        # Products that six decimals may make equal to the last one stay, but of equal products no more than the lesser ids can count.
        first = np.ones(len(at), bool)
        first[1:] = (at[1:] != at[:-1]) | (worth[1:] != worth[:-1])
        run = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        with np.errstate(all="ignore"):
            kept = ((worth >= self.floor[at] - 2e-6) | (place < self.most)) & (run < self.most)
        self.at, self.other, self.total = at[kept], other[kept], total[kept]

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in ((self.ids[self.at], pa.int64()), (self.other, pa.int64()), (self.total, pa.float64()))], names=["q", "other", "s"])


def _best(kind: str, most: int, least: float | None, apart: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if held is None or held.name != row["q_block"]:
                    if held is not None:
                        yield held.rows()
                    held = _Best(row, kind, most, least, apart)
                held.meet(row)
        if held is not None:
            yield held.rows()

    return run


def best_products(vectors: DataFrame, queries: DataFrame, most: int, least: float | None = None, apart: bool = False) -> DataFrame:
    """(q, other, s, place): the `most` other vectors of each query with the largest products to six places, ties to the lesser id.

    vectors and queries: (id, label, vector), which may be one table.  least: products under it have no place; apart: only vectors of another label count.
    Vectors that are null or hold null have no product, nor have two of unlike lengths.  A block of queries goes through the blocks of a part of
    the vectors, PART bytes, in one task and keeps what can be among the best of all that it has met; blocks are read again by each task, so none
    is shuffled.  Every query meets every vector, by matrix products; the products that are returned are those of a loop over the parts.
    """
    session = vectors.sparkSession
    small_batches(session)  # a row is a matrix of 1 MB and more
    kind = "float32" if vectors.schema["vector"].dataType.elementType.typeName() == "float" and queries.schema["vector"].dataType.elementType.typeName() == "float" else "float64"

    def blocks(df: DataFrame, name: str) -> DataFrame:
        whole = df.filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull()))
        held = whole.select("id", F.col("label").cast("string").alias("label"), F.col("vector").cast("array<double>").alias("vector"))
        packed = held.mapInArrow(_packed(kind, BLOCK), "ids array<bigint>, labels array<string>, dim int, data binary")
        return written(packed.repartition(int(session.conf.get("spark.sql.shuffle.partitions"))), name)

    held = blocks(vectors, "blocks")
    asked = (held if queries is vectors else blocks(queries, "queries")).toDF("q_ids", "q_labels", "dim", "q_data").withColumn("q_block", F.monotonically_increasing_id())
    size = held.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    met = asked.join(held.coalesce(-(-size // PART) or 1).hint("shuffle_replicate_nl"), "dim")
    found = met.mapInArrow(_best(kind, most, least, apart), "q bigint, other bigint, s double")
    if least is not None:
        found = found.filter(F.col("s") >= least)
    return found.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.round("s", 6)), "other"))).filter(F.col("place") <= most)
