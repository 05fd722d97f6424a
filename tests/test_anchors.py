"""Anchor terms against the formulas, one cluster worked by hand."""

import math

import pytest

from emberline.operators.anchors import anchors, terms_of


def test_terms_are_tokens_and_neighbours(spark):
    rows = [(1, "A big Big cat, x sat"), (2, ""), (3, None), (4, "one"), (5, "né né né")]
    got = {r.id: r.t for r in spark.createDataFrame(rows, "id int, text string").select("id", terms_of("text").alias("t")).collect()}
    assert got == {1: ["big", "cat", "sat", "big big", "big cat", "cat sat"], 2: [], 3: [], 4: ["one"], 5: ["né", "né né"]}


def test_one_cluster_by_hand(spark):
    # 100 documents of background; the cluster's two hold "zeta nova" and "the", one of them is 40 days old.
    rows = [("other", f"s{i}", f"the filler{i} words{i}", 300.0, "x") for i in range(98)]
    rows += [("c", "k1", "the zeta nova", 40.0, "x"), ("c", "k2", "zeta nova the", 3.0, "x"), ("c", "k2", None, 1000.0, "x"), (None, "k", "zeta", None, "x")]
    got = {r.term: r for r in anchors(spark.createDataFrame(rows, "cluster string, support_key string, text string, age_days double, term string")).filter("cluster = 'c'").collect()}
    # "the" is in every document; "zeta" and "nova" alone are held by the better or equal pair that comes first by name or score.
    n, df = 100, 2
    idf, share = math.log((n + 1) / (df + 1)) + 1, (df + 0.5) / (n + 0.5)
    lift, novelty = (2 / 3) / share, 1 / math.log(math.e + 40)
    score = math.log1p(lift) * idf * (1 + novelty)
    best = got["nova"]
    assert (best.rank, best.support) == (1, 2)
    assert (best.score, best.lift, best.idf, best.novelty) == pytest.approx((score, lift, idf, novelty), abs=1e-6)
    assert set(got) == {"nova", "zeta", "zeta nova"}  # one score: names decide, and "nova" comes before the pair, as does "zeta"
    assert [got[t].rank for t in ("nova", "zeta", "zeta nova")] == [1, 2, 3]


def test_a_better_pair_takes_its_tokens(spark):
    rows = [("o", f"s{i}", f"zeta filler{i} extra{i}", 300.0) for i in range(3)] + [("o", f"t{i}", f"gg{i} hh{i}", 300.0) for i in range(395)]
    rows += [("c", "k1", "zeta nova", 1.0), ("c", "k2", "zeta nova", 2.0)]
    got = [r.term for r in anchors(spark.createDataFrame(rows, "cluster string, support_key string, text string, age_days double")).filter("cluster = 'c'").orderBy("rank").collect()]
    assert got == ["nova", "zeta nova"]  # "zeta" is commoner than the pair that holds it
    assert anchors(spark.createDataFrame([], "cluster string, support_key string, text string, age_days double")).count() == 0
