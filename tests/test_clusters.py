"""Density clusters against a plain tree over all pairs."""

import numpy as np
import pytest

from emberline.operators import clusters
from emberline.operators.clusters import QUESTIONS, UPLOADS, cohesive_clusters, density_clusters, unit_vectors


def plain_leaves(x, least, most):
    """Leaves by raising the distance step by step over all mutual-reachability distances."""
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 12)
    np.fill_diagonal(d, np.inf)
    core = d.min(1)
    reach = np.maximum(np.maximum(core[:, None], core[None]), d)
    part = {i: frozenset([i]) for i in range(len(x))}
    simple = {frozenset([i]): False for i in range(len(x))}
    found = []
    for w in np.unique(reach[np.isfinite(reach)]):
        # Parts that meet at this distance, all at once.
        group = {p: {p} for p in set(part.values())}
        for a, b in np.argwhere(reach == w):
            left, right = group[part[a]], group[part[b]]
            if left is not right:
                left |= right
                for p in right:
                    group[p] = left
        for joined in {id(g): g for g in group.values()}.values():
            if len(joined) < 2:
                continue
            bigs = [p for p in joined if len(p) >= least]
            if len(bigs) > 1:
                found += [p for p in bigs if simple[p]]
            whole = frozenset().union(*joined)
            simple[whole] = False if len(bigs) > 1 else simple[bigs[0]] if bigs else len(whole) >= least
            for i in whole:
                part[i] = whole
    return {p for p in found if len(p) <= most}


def spark_clusters(spark, x, least, most):
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, vector array<double>")
    groups = {}
    for r in density_clusters(rows, least, most).collect():
        groups.setdefault(r.cluster, set()).add(r.id)
    assert all(name == min(g) for name, g in groups.items())
    return {frozenset(g) for g in groups.values()}


def grid_and_copies(seed):
    """Points on a grid (many equal distances), blobs, and vectors repeated up to 30 times."""
    rng = np.random.default_rng(seed)
    grid = rng.integers(0, 7, (90, 2)).astype(float)
    blobs = np.concatenate([rng.normal(c, 0.05 * (1 + k), (22, 2)) for k, c in enumerate(rng.uniform(10, 40, (7, 2)))])
    copies = np.repeat(rng.uniform(50, 60, (6, 2)), [1, 2, 3, 4, 16, 30], axis=0)
    x = np.concatenate([grid, blobs, copies])
    return x[rng.permutation(len(x))]


@pytest.mark.parametrize("seed,least,most,block", [(1, 2, 60, 1024), (2, 3, 60, 64), (3, 2, 12, 40)])
def test_leaves_equal_the_plain_tree(spark, monkeypatch, seed, least, most, block):
    monkeypatch.setattr(clusters, "BLOCK", block)
    x = grid_and_copies(seed)
    assert len(x) == 300
    assert spark_clusters(spark, x, least, most) == plain_leaves(x, least, most)


def test_directions_equal_the_plain_tree(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(250, 16)) + np.repeat(rng.normal(size=(25, 16)) * 2, 10, axis=0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert spark_clusters(spark, x, 2, 60) == plain_leaves(np.round(x, 12), 2, 60)


def test_small_inputs(spark):
    assert spark_clusters(spark, np.array([[1.0, 0.0]] * 5), 2, 60) == set()
    assert spark_clusters(spark, np.array([[1.0, 0.0]] * 5 + [[5.0, 1.0]] * 3 + [[9.0, 9.0]]), 2, 60) == {frozenset(range(5)), frozenset((5, 6, 7))}
    empty = spark.createDataFrame([], "id bigint, vector array<double>")
    assert density_clusters(empty, 2, 60).count() == 0 and cohesive_clusters(empty, UPLOADS).count() == 0


def test_gates_and_bad_vectors(spark):
    near = [[1.0, 0.01 * i, 0.0] for i in range(4)]
    far = [[0.0, 1.0, 0.02 * i] for i in range(3)]
    rows = [(i, v) for i, v in enumerate(near + far)] + [(50, [-1.0, -1.0, -1.0]), (51, None), (52, [1.0, None, 0.0]), (53, [float("nan"), 1.0, 0.0]), (54, [1.0]), (None, [1.0, 0.0, 0.0]), (0, near[0]), (56, [0.0, 0.0, 0.0])]
    frame = spark.createDataFrame([(i, v, 0.0, "x") for i, v in rows], "id bigint, vector array<double>, raw double, cluster string")
    assert {r.id for r in unit_vectors(frame).collect()} == {0, 1, 2, 3, 4, 5, 6, 50, 56}
    got = {tuple(r.members): r for r in cohesive_clusters(frame, UPLOADS, 0.0).collect()}
    assert (4, 5, 6) in got and got[4, 5, 6].mean_similarity > 0.99
    assert all(r.mean_similarity >= 0.72 and r.minimum_similarity >= 0.62 for r in got.values())
    assert all(len(r.members) >= 3 for r in cohesive_clusters(frame, QUESTIONS, 0.0).collect())
