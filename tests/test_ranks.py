"""Ranks and quantiles over ranges against plain lists, and a feed by hand."""

import random
from statistics import median

import pytest

from emberline.operators.feeds import feed
from emberline.plans.ranks import positions, quantiles, with_average_rank


def some_rows(n=600):
    draw = random.Random(2)
    # One group holds most rows; values tie; one group has a single row.
    rows = [(draw.choice(["hot"] * 8 + ["a", "b"]), float(draw.randint(0, 40)), i) for i in range(n)]
    return rows + [("one", 3.0, n), (None, 1.0, n + 1), ("a", None, n + 2)]


def test_equal_plain_lists(spark):
    rows = some_rows()
    df = spark.createDataFrame(rows, "k string, x double, id int").repartition(5)
    groups = {}
    for k, x, _ in rows:
        if k is not None and x is not None:
            groups.setdefault(k, []).append(x)
    for r in positions(df, "k", "x").collect():
        own = groups[r.k]
        assert (r.n, r.before, r.total) == (own.count(r.x), sum(v < r.x for v in own), len(own))
    found = with_average_rank(df, "k", "x", "share").collect()
    assert len(found) == len(rows)
    for r in found:
        if r.k is None or r.x is None:
            assert r.share is None
            continue
        own = groups[r.k]
        want = 1.0 if len(own) == 1 else (sum(v < r.x for v in own) + (own.count(r.x) - 1) / 2) / (len(own) - 1)
        assert r.share == pytest.approx(want, abs=1e-12)
    halves = {r.k: (r.total, r.half, r.top) for r in quantiles(df, "k", "x", {"half": 0.5, "top": 1.0}).collect()}
    assert halves == {k: (len(own), median(own), max(own)) for k, own in groups.items()}
    empty = df.filter("false")
    assert positions(empty, "k", "x").count() == 0 and quantiles(empty, "k", "x", {"half": 0.5}).count() == 0


def test_feed_by_hand(spark):
    rows = [
        ("c", 1, 0.9, 5.0, 0, False, False), ("c", 2, 0.5, 5.0, 14, None, None), ("c", 3, 0.9, 9.0, 0, True, False), ("c", 4, 0.3, 99.0, 0, False, False),
        ("c", 5, None, 1.0, 0, False, False), ("d", 6, 0.4, 1.0, 3, False, True), (None, 7, 0.9, 1.0, 0, False, False),
    ]
    df = spark.createDataFrame(rows, "channel string, item int, fit double, volume double, age_days int, covered boolean, answered boolean")
    got = [tuple(r) for r in feed(df).orderBy("channel", "position").collect()]
    # c keeps 1, 2, 3: ranks of fit .75, 0, .75; of volume .25, .25, 1; of freshness .75, 0, .75
    assert got == [("c", 1, 1, True, 0.625), ("c", 2, 2, True, 0.0625), ("c", 3, 3, False, 0.8125), ("d", 1, 6, False, 1.0)]
    assert feed(df, 1).count() == 2 and feed(df.filter("false")).count() == 0
