"""Density clusters of vectors: spanning forests of near pairs in blocks, leaves of the cluster tree by rounds of joins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.plans.graph import components
from emberline.plans.tables import even_join, written
from emberline.registry import query

# Cluster gates for uploads, and for questions.
NICHE_STRENGTH, EXEMPLARS = 0.30, 5
UPLOADS = {"least": 2, "most": 60, "mean": 0.72, "lowest": 0.62}
QUESTIONS = {"least": 3, "most": 60, "mean": 0.62, "lowest": -1.0}
LEAST_CHANNELS, LEAST_ASKERS, LEAST_VIDEOS = 2, 3, 2
#: Vectors in a block; a task holds those of two blocks and the distances of CHUNK of them to the others, 32 MB.
BLOCK, CHUNK = 1 << 14, 256
#: Edges that a task holds before it keeps a spanning forest of them, and edges of the parts that one task joins.
EDGES, ENDS = 1 << 20, 400_000


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _once(value: Column, body) -> Column:
    """body(value) with a value that is computed once a row, not for each element of an array in body."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _unit(vector: Column) -> Column:
    return _once(vector, lambda v: _once(F.sqrt(_dot(v, v)), lambda norm: F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))))


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(id, raw): vectors (id, vector) of length one; the zero vector stays.

    Null vectors, those with a null or non-finite part and those shorter than the longest are left
    out, as are null ids; of rows with one id that with the least vector counts.
    """
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vectors.select("id", F.col("vector").cast("array<double>").alias("vector")).filter(F.col("id").isNotNull() & (F.size("vector") > 0) & whole)
    one = good.groupBy("id").agg(F.max(F.size("vector")).alias("n"), F.min("vector").alias("vector"))
    longest = good.agg(F.max(F.size("vector"))).first()[0] or 0
    return one.filter(F.size("vector") == longest).select("id", _unit(F.col("vector")).alias("raw"))


def without_niche(units: DataFrame, strength: float = NICHE_STRENGTH) -> DataFrame:
    """(id, raw, vector): raw less `strength` times its part along the mean of all, of length one again.

    The mean is one row of as many numbers as a vector has.
    """
    mean = units.select(F.posexplode("raw").alias("at", "x")).groupBy("at").agg((F.sum("x") / F.count("*")).alias("x")).orderBy("at").collect()
    niche = np.array([r.x for r in mean])
    niche = niche / (np.linalg.norm(niche) or 1.0)
    along = F.array(*[F.lit(float(x)) for x in niche]) if len(niche) else F.col("raw")
    if strength <= 0 or not len(niche):
        return units.withColumn("vector", F.col("raw"))
    rest = _once(_dot(F.col("raw"), along) * strength, lambda part: F.zip_with("raw", along, lambda x, n: x - part * n))
    return units.select("id", "raw", _unit(rest).alias("vector"))


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x and y, but for rounding errors that `_slack` covers."""
    one = np.ones
    return np.hstack([x, one((len(x), 1)), (x * x).sum(1)[:, None]]) @ np.hstack([-2 * y, (y * y).sum(1)[:, None], one((len(y), 1))]).T


def _slack(*vectors: np.ndarray) -> float:
    return 1e-9 * (1 + max((x * x).sum(1).max() for x in vectors))


def _bounded(rows: pd.DataFrame, most: int) -> pd.DataFrame:
    """Each row with a square that its `most` nearest rows do not exceed, from those of its own block."""
    x = np.stack(rows["vector"])
    rows = rows[["id", "vector", "block"]].assign(bound=np.inf)
    if len(x) > most:
        # A row is among its own nearest ones.
        nearest = [np.partition(_squares(x[at : at + CHUNK], x), most, axis=1)[:, most] for at in range(0, len(x), CHUNK)]
        rows["bound"] = np.concatenate(nearest) + _slack(x)
    return rows


def _spanning(nodes: int, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The edges (as places in x, y, w) of a least spanning forest; all parts' shortest edges are taken at once, edges of one length in one order."""
    order = np.argsort(w, kind="stable")
    x, y, kept = x[order], y[order], []
    place = np.arange(len(order))
    while len(x):
        best = np.full(nodes, len(order))
        for ends in (x, y):  # of several values for one place the last one stays, so the shortest edge
            mine = np.full(nodes, len(order))
            mine[ends[::-1]] = place[::-1]
            best = np.minimum(best, mine)
        parts = np.flatnonzero(best < len(order))
        edges = np.searchsorted(place, best[parts])
        kept.append(np.unique(best[parts]))
        to = np.arange(nodes)
        to[parts] = np.where(x[edges] == parts, y[edges], x[edges])
        both = (to[to] == np.arange(nodes)) & (np.arange(nodes) < to)
        to[both] = np.flatnonzero(both)
        while (to[to] != to).any():
            to = to[to]
        x, y = to[x], to[y]
        apart = x != y
        x, y, place = x[apart], y[apart], place[apart]
    return order[np.concatenate(kept)] if kept else order


def _forest(rows: pd.DataFrame) -> pd.DataFrame:
    """A least spanning forest of the near pairs of one block, or of near pairs between two: no farther apart than the bound of either."""
    rows = rows.sort_values("block", kind="stable")
    x, bound, ids = np.stack(rows["vector"]), rows["bound"].to_numpy(), rows["id"].to_numpy()
    split = int((rows["block"] == rows["block"].iloc[0]).sum())
    alone = split == len(x)
    if alone and rows["_i"].iloc[0] != rows["_j"].iloc[0]:  # the other block is empty
        return pd.DataFrame({"x": ids[:0], "y": ids[:0], "w": bound[:0]})
    start, more = (0, 0.0) if alone else (split, _slack(x))
    others, held, many = x[start:], [np.zeros((3, 0))], 0
    for at in range(0, split, CHUNK):
        to = min(at + CHUNK, split)
        squares = _squares(x[at:to], others)
        a, b = np.nonzero((squares <= bound[at:to, None] + more) | (squares <= bound[None, start:] + more))
        a, b = a + at, b + start
        a, b = (a[a < b], b[a < b]) if alone else (a, b)
        # Differences, to 12 decimals, so that one pair has one distance everywhere.
        w = np.concatenate([np.zeros(0), *[np.round(np.sqrt(((x[a[k : k + 50_000]] - x[b[k : k + 50_000]]) ** 2).sum(1)), 12) for k in range(0, len(a), 50_000)]])
        held.append(np.stack([a, b, w]))
        many += len(a)
        if many > EDGES or to == split:
            a, b, w = np.concatenate(held, axis=1)
            tree = _spanning(len(x), a.astype(np.int64), b.astype(np.int64), w)
            held, many = [np.stack([a[tree], b[tree], w[tree]])], 0
    a, b, w = held[0]
    return pd.DataFrame({"x": ids[a.astype(np.int64)], "y": ids[b.astype(np.int64)], "w": w})


def near_edges(points: DataFrame, most: int) -> DataFrame:
    """(x, y, w): edges among points (id, vector) that join the same points at every distance as all pairs do, as long as a part has at most `most` points.

    The mutual reachability of two points is their distance here, as it is at least that of each to its nearest
    other row.  A part of at most `most` points leaves each of its points one of its `most` nearest ones to be
    reached, so pairs that are farther apart for both never join a part before it is too large to be followed.

    Blocks first give each point a bound for these.  Then every two blocks meet in one task, which keeps a least spanning forest of
    the pairs within a bound: an edge that is no part of it is the longest of some circle and joins nothing.  All pairs are
    compared by matrix products, which is what exact density clusters cost; what is kept is linear in points and blocks.
    """
    blocks = max(1, -(-points.count() // BLOCK))
    dealt = points.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"))
    held = written(dealt.groupBy("block").applyInPandas(lambda rows: _bounded(rows, most), "id bigint, vector array<double>, block bigint, bound double"), "bounds")
    met = held.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    pairs = met.withColumns({"_i": F.least("block", "_other"), "_j": F.greatest("block", "_other")}).drop("_other")
    return pairs.groupBy("_i", "_j").applyInPandas(_forest, "x bigint, y bigint, w double")


def _settled(parts: pd.DataFrame, ends: pd.DataFrame, least: int, most: int) -> pd.DataFrame:
    """Raise the distance over the edges of these parts as far as no part elsewhere matters: leaves found and parts left.

    A part whose next edge leads elsewhere, or to a part that waits, waits itself.
    """
    n = len(parts)
    names = pd.Index(parts["part"].to_numpy())
    x, y, w = names.get_indexer(ends["x"].to_numpy()), names.get_indexer(ends["y"].to_numpy()), ends["w"].to_numpy()
    y = np.where(x == y, n, y)  # an edge to a large part comes with its own end twice
    wait = np.full(n + 1, np.inf)
    np.minimum.at(wait, x[y < 0], w[y < 0])
    inner = np.flatnonzero(x < y)
    inner = inner[np.argsort(w[inner], kind="stable")]
    x, y, w, wait = x[inner].tolist(), y[inner].tolist(), w[inner].tolist(), wait.tolist()
    size, simple, members = parts["n"].tolist() + [0], parts["simple"].tolist() + [False], [list(m) for m in parts["members"]] + [[]]
    olds, gone, above, found = [[p] for p in names] + [[]], [False] * n + [True], list(range(n + 1)), []

    def root(i: int) -> int:
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    at = 0
    while at < len(w):
        to, groups = at, {}
        while to < len(w) and w[to] == w[at]:  # parts that meet at one distance, all at once
            a, b = root(x[to]), root(y[to])
            if a != b:
                left, right = groups.setdefault(a, {a}), groups.setdefault(b, {b})
                if left is not right:
                    left, right = (left, right) if len(left) >= len(right) else (right, left)
                    left |= right
                    groups.update(dict.fromkeys(right, left))
            to += 1
        for joined in {id(g): g for g in groups.values()}.values():
            small = [i for i in joined if not gone[i]]
            beside = len(small) < len(joined)
            if any(wait[i] <= w[at] for i in small):
                for i in small:
                    wait[i] = min(wait[i], w[at])
                continue
            bigs, total = [i for i in small if size[i] >= least], sum(size[i] for i in small)
            if len(bigs) + beside >= 2:
                found += [(True, parts["part"].iloc[i], size[i], True, members[i].copy(), []) for i in bigs if simple[i]]
            into = min(joined, key=lambda i: (not gone[i], -len(members[i]), i))
            gone[into] = beside or total > most
            if not gone[into]:
                whole = False if len(bigs) > 1 else simple[bigs[0]] if bigs else total >= least
                size[into], simple[into], wait[into] = total, whole, min(wait[i] for i in small)
            for i in joined:
                above[i] = into
                if i != into:
                    if not gone[into]:
                        members[into] += members[i]
                        olds[into] += olds[i]
                    members[i] = olds[i] = None
        at = to
    left = [(False, parts["part"].iloc[i], size[i], simple[i], members[i], olds[i]) for i in range(n) if above[i] == i and not gone[i]]
    return pd.DataFrame(found + left, columns=["leaf", "part", "n", "simple", "members", "olds"])


def leaves(copies: DataFrame, edges: DataFrame, least: int, most: int) -> DataFrame:
    """(cluster, members): the leaves of the density tree that have `least` to `most` rows, as lists of points.

    copies: (id, n) points with their number of rows; edges: (x, y, w) as from `near_edges`.  Raising the distance joins parts; a join of
    two or more parts of at least `least` rows is a split of the tree, and such a part is a leaf if it
    holds no split itself.  Parts that meet at one distance join at once, so ties have no order.  The
    whole is no leaf.

    A round deals parts out so that those which are linked by their nearest ones come to one task, of about ENDS edges.  The task joins all
    that it can without the others.  A part of over `most` rows is no longer followed, as no leaf can come of it, and whatever
    is nearest to it is settled; so a part's list of points is bounded.  What is left fits one task at last.
    """
    active = copies.filter(F.col("n") <= most)
    parts = active.select(F.col("id").alias("part"), F.col("n").cast("bigint").alias("n"), (F.col("n") >= least).alias("simple"), F.array("id").alias("members"))
    known = active.select(F.col("id").alias("x"))
    ends = edges.select("x", "y", "w").union(edges.select("y", "x", "w"))
    # A large part has no name: y is null.
    ends = written(ends.join(known, "x").join(known.select(F.col("x").alias("y"), F.col("x").alias("_y")), "y", "left").select("x", F.col("_y").alias("y"), "w"), "ends")
    found: list[DataFrame] = []
    schema = "leaf boolean, part bigint, n bigint, simple boolean, members array<bigint>, olds array<bigint>"
    while many := ends.count():
        tasks = -(-many // ENDS)
        if tasks == 1:
            label = parts.select("part", F.lit(0).cast("bigint").alias("task"))
        else:
            nearest = ends.join(ends.groupBy("x").agg(F.min("w").alias("w")), ["x", "w"]).filter("y is not null").select("x", "y")
            near = components(nearest, "x", "y").withColumnsRenamed({"node": "part", "component": "near"})
            label = written(parts.select("part").join(near, "part", "left").select("part", F.pmod(F.xxhash64(F.coalesce("near", "part")), F.lit(tasks)).alias("task")), "tasks")
        left, right = parts.join(label, "part").groupBy("task"), ends.join(label.select(F.col("part").alias("x"), F.col("task").alias("_task")), "x").select("x", F.coalesce("y", "x").alias("y"), "w", "_task").groupBy("_task")
        settled = written(left.cogroup(right).applyInPandas(lambda p, e: _settled(p, e, least, most), schema), "settled")
        found.append(settled.filter("leaf").select("part", "members"))
        if tasks == 1:
            break
        parts = settled.filter("not leaf").select("part", "n", "simple", "members")
        moved = settled.filter("not leaf").select(F.col("part").alias("_to"), F.explode("olds").alias("x"))
        ends = ends.join(moved, "x").select(F.col("_to").alias("x"), "y", "w")
        ends = ends.join(moved.select(F.col("x").alias("y"), F.col("_to").alias("_y")), "y", "left").select("x", F.col("_y").alias("y"), "w")
        ends = written(ends.filter("y is null or x <> y").groupBy("x", "y").agg(F.min("w").alias("w")), "ends")
    every = parts.select("part", "members").limit(0)
    for more in found:
        every = every.union(more)
    return every.toDF("cluster", "members")


def density_clusters(vectors: DataFrame, least: int, most: int) -> DataFrame:
    """(cluster, id): the rows of every leaf of the density tree over vectors (id, vector) of one length; noise is left out.

    A cluster is named by its least id.  Equal vectors, to 12 decimals, are one point with several rows.
    """
    same = written(vectors.select("id", F.transform("vector", lambda x: F.round(x, 12) + 0.0).alias("vector")), "vectors")
    points = written(same.groupBy("vector").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "points")
    found = written(leaves(points.select("id", F.col("copies").alias("n")), near_edges(points.select("id", "vector"), most), least, most), "leaves")
    named = found.select(F.array_min("members").alias("cluster"), F.explode("members").alias("point"))
    rows = even_join(same, points.select("vector", F.col("id").alias("point")), ["vector"], "id").select("id", "point")
    return even_join(rows, named, ["point"], "id").select("cluster", "id")


def _measured(groups: pd.DataFrame) -> pd.DataFrame:
    """One row of measures for the members of one cluster, at most `most` of them."""
    groups = groups.sort_values("id")
    raw = np.stack(groups["raw"])
    centre = raw.mean(0)
    centre = centre / (np.linalg.norm(centre) or 1.0)
    like = raw @ centre
    best = np.argsort(-np.round(like, 12), kind="stable")[:EXEMPLARS]
    row = {"cluster": groups["cluster"].iloc[0], "members": groups["id"].tolist(), "centroid": centre.tolist(), "exemplars": groups["id"].iloc[best].tolist(), "mean_similarity": round(float(like.mean()), 6), "minimum_similarity": round(float(like.min()), 6)}
    return pd.DataFrame([row])


def cohesive_clusters(vectors: DataFrame, gates: dict[str, float], niche_strength: float = NICHE_STRENGTH) -> DataFrame:
    """(cluster, members, centroid, exemplars, mean_similarity, minimum_similarity) of the density clusters of vectors (id, vector) that pass the gates.

    Clusters are sought after the common direction is taken out, and measured without that: mean and
    lowest cosine to the centroid.  exemplars are the ids nearest to it, ties to the lesser id.  See
    `unit_vectors` for rows that take no part.
    """
    units = written(without_niche(unit_vectors(vectors), niche_strength), "units")
    found = density_clusters(units.select("id", "vector"), int(gates["least"]), int(gates["most"]))
    schema = "cluster bigint, members array<bigint>, centroid array<double>, exemplars array<bigint>, mean_similarity double, minimum_similarity double"
    held = found.join(units.select("id", "raw"), "id")
    return held.groupBy("cluster").applyInPandas(_measured, schema).filter((F.col("mean_similarity") >= gates["mean"]) & (F.col("minimum_similarity") >= gates["lowest"]))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@query()
def topic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory row J1: vectors stand for uploads, the last digit of an id for the channel; the tests hold a plain tree."""
    found = cohesive_clusters(_vectors(spark, sf_dir), UPLOADS)
    channels = F.size(F.array_distinct(F.transform("members", lambda m: m % 10)))
    return found.select("cluster", F.size("members").alias("n"), channels.alias("channels"), F.array_join("members", ",").alias("members"), F.array_join("exemplars", ",").alias("exemplars"), "mean_similarity", "minimum_similarity").filter(F.col("channels") >= LEAST_CHANNELS)


@query()
def question_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory row J2: vectors stand for questions, remainders of their ids for askers (40), videos (20) and channels (10)."""
    found = cohesive_clusters(_vectors(spark, sf_dir), QUESTIONS, 0.0)

    def kinds(n: int) -> Column:
        return F.size(F.array_distinct(F.transform("members", lambda m: m % n)))

    counts = {"askers": kinds(40), "videos": kinds(20), "channels": kinds(10)}
    named = F.concat(F.lit("d_"), F.substring(F.sha2(F.array_join(F.array_sort(F.col("members").cast("array<string>")), "|"), 256), 1, 16))
    gated = found.withColumns(counts).filter((F.col("askers") >= LEAST_ASKERS) & (F.col("videos") >= LEAST_VIDEOS) & (F.col("channels") >= LEAST_CHANNELS))
    return gated.select(named.alias("item_id"), F.size("members").alias("n"), *counts, F.get("exemplars", F.lit(0)).alias("representative"), "mean_similarity")
