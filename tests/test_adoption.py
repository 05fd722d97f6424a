"""Burst, cooldown, as-of join and look-ahead guard on small hand-made cases."""

import math
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberline.operators.adoption import SeenTooLate, after_cooldown, as_of_join, burst_states, size_bucket, visible_only

AS_OF = datetime(2024, 3, 1)


def cheapest(counts):
    """Every one of the two-state paths over a few days, by brute force."""
    base = max(sum(counts) / len(counts), 1e-6)
    best = None
    for bits in range(1 << len(counts)):
        path = [bits >> i & 1 for i in range(len(counts))]
        cost = sum(abs(a - b) for a, b in zip(path, path[1:])) + sum(r - n * math.log(r) for n, s in zip(counts, path) for r in [base * (1 + s)])
        best = min(best or (cost, path), (cost, path))
    return best[1]


def test_burst_follows_the_cheapest_path(spark, monkeypatch):
    from emberline.operators import adoption

    monkeypatch.setattr(adoption, "BURST_DAYS", 11)
    cases = {"flat": [2] * 12, "late": [0] * 7 + [1, 8, 9, 9, 7], "one": [0] * 11 + [3], "early": [9, 9, 9, 0, 0, 0, 0, 1, 0, 1, 0, 0]}
    rows = [(name, AS_OF - timedelta(days=11 - i, minutes=5 if i < 11 else 0)) for name, counts in cases.items() for i, n in enumerate(counts) for _ in range(n)]
    rows = [(name, at + timedelta(minutes=10) if at < AS_OF else at) for name, at in rows]
    rows += [("none", AS_OF + timedelta(days=1)), ("none", None)]
    got = dict(burst_states(spark.createDataFrame(rows, "topic string, published_at timestamp"), AS_OF).collect())
    # Times lie five minutes after the start of their day counted back from the checkpoint, so day i is 10 - i days back, as is the checkpoint's own.
    for name, counts in cases.items():
        shifted = [0, *counts[:10], counts[10] + counts[11]]
        assert got[name] == round(sum(cheapest(shifted)[-7:]) / 7, 6), name
    assert got["none"] == 0 and got["late"] > 0


def test_empty_tables(spark):
    assert burst_states(spark.createDataFrame([], "topic string, published_at timestamp"), AS_OF).collect() == []
    assert after_cooldown(spark.createDataFrame([], "topic string, day date"), "topic", "day").collect() == []


def test_cooldown_counts_from_the_last_kept_date(spark):
    first = date(2024, 1, 1)
    rows = [("a", first + timedelta(days=d)) for d in (0, 0, 41, 42, 60, 83, 84, 200)] + [("b", first), ("b", None)]
    got = after_cooldown(spark.createDataFrame(rows, "topic string, day date"), "topic", "day").collect()
    assert sorted((r.topic, (r.day - first).days) for r in got) == [("a", 0), ("a", 42), ("a", 84), ("a", 200), ("b", 0)]


def test_as_of_join_takes_the_latest_known_row(spark):
    t = lambda d, h: datetime(2024, 1, d, h)
    known = spark.createDataFrame([("x", t(1, 5), 1, 10), ("x", t(1, 5), 2, 11), ("x", t(4, 9), 3, 20), (None, t(1, 1), 4, 99), ("y", t(9, 0), 5, None), ("y", t(8, 0), 6, 7)], "k string, at timestamp, n int, v int")
    asked = spark.createDataFrame([(1, "x", t(1, 4)), (2, "x", t(1, 5)), (3, "x", t(3, 0)), (4, "x", t(4, 8)), (5, "x", t(4, 10)), (6, "z", t(1, 1)), (7, None, t(1, 2)), (8, "x", None), (9, "y", t(10, 0))], "id int, k string, at timestamp")
    got = {r.id: r.v for r in as_of_join(asked, known, "k", "at", ["v"], "n").collect()}
    assert got == {1: None, 2: 11, 3: 11, 4: 11, 5: 20, 6: None, 7: None, 8: None, 9: None}


def test_sizes_and_guard(spark):
    df = spark.createDataFrame([(9_999,), (10_000,), (999_999,), (1_000_000,), (None,)], "n long")
    assert [r[0] for r in df.select(size_bucket(F.col("n"))).collect()] == ["micro", "small", "medium", "large", None]
    times = spark.createDataFrame([(AS_OF,), (None,)], "at timestamp")
    assert visible_only(times, "at", AS_OF).count() == 2
    with pytest.raises(SeenTooLate):
        visible_only(times, "at", AS_OF - timedelta(seconds=1))
