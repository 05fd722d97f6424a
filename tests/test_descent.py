"""Gradient descent over blocks of rows against the recurrence in plain loops."""

import math
import random

import pytest

from emberline.operators.descent import CannotLearn, Schedule, fit

SHORT = Schedule(steps=20, slope_steps=12)


def sigmoid(z):
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def plain(train, later, schedule):
    """(means, scales, weights, offset, slope, shift) of rows ((x, ...), y), one row after the other."""
    n, width = len(train), len(train[0][0])
    means = [sum(x[i] for x, _ in train) / n for i in range(width)]
    scales = [max(math.sqrt(sum((x[i] - means[i]) ** 2 for x, _ in train) / n), 1e-6) for i in range(width)]

    def scaled(x):
        return [(v - m) / s for v, m, s in zip(x, means, scales)]

    share = sum(y for _, y in train) / n
    w, b = [0.0] * width, math.log(share / (1 - share))
    for step in range(schedule.steps):
        errors = [(sigmoid(b + sum(c * v for c, v in zip(w, scaled(x)))) - y, scaled(x)) for x, y in train]
        rate = schedule.rate / math.sqrt(1 + step / 100)
        b, w = b - rate * sum(e for e, _ in errors) / n, [c - rate * (sum(e * z[i] for e, z in errors) / n + schedule.l2 * c) for i, c in enumerate(w)]
    w, b, slope, shift = [round(c, 10) for c in w], round(b, 10), 1.0, 0.0
    odds = [(b + sum(c * v for c, v in zip(w, scaled(x))), y) for x, y in later]
    for step in range(schedule.slope_steps):
        errors = [(sigmoid(slope * q + shift) - y, q) for q, y in odds]
        rate = schedule.slope_rate / math.sqrt(1 + step / 100)
        slope, shift = slope - rate * (sum(e * q for e, q in errors) / len(odds) + schedule.slope_pull * (slope - 1)), shift - rate * sum(e for e, _ in errors) / len(odds)
        slope = min(5.0, max(0.05, slope))
    return means, scales, w, b, round(slope, 10), round(shift, 10)


def some_rows(seed, n):
    draw = random.Random(seed)
    rows = []
    for _ in range(n):
        x = (draw.gauss(0, 1), draw.choice([0.0, 1.0, 1.0]), 7.0)  # ties, and a feature that never changes
        rows.append((x, float(x[0] + draw.gauss(0, 1) > 0.2)))
    return rows + rows[:5]  # repeated rows count


def frame(spark, rows, parts):
    return spark.createDataFrame([(*x, y, "kept") for x, y in rows], "a double, b double, c double, label double, matrix string").repartition(parts)


@pytest.mark.parametrize("parts, part_rows", [(1, 1000), (5, 1000), (5, 20)])
def test_equals_the_recurrence(spark, parts, part_rows):
    """In one task, and with one job a step."""
    train, later = some_rows(3, 70), some_rows(4, 40)
    head = fit(frame(spark, train, parts), ["c", "a", "b"], frame(spark, later, parts), schedule=SHORT, part_rows=part_rows)
    means, scales, weights, offset, slope, shift = plain(train, later, SHORT)
    assert head.features == ("a", "b", "c") and head.calibrated and (head.rows, head.positives) == (75, int(sum(y for _, y in train)))
    for got, want in [*zip(head.means, means), *zip(head.scales, scales), *zip(head.weights, weights), (head.offset, offset), (head.slope, slope), (head.shift, shift)]:
        assert got == pytest.approx(want, abs=1e-8)
    found = head.score(frame(spark, later, parts)).select("a", "b", "c", "matrix", "probability").collect()
    for r in found:
        odds = offset + sum(c * (v - m) / s for c, v, m, s in zip(weights, (r.a, r.b, r.c), means, scales))
        assert r.matrix == "kept" and r.probability == pytest.approx(sigmoid(slope * odds + shift), abs=2e-6)


def test_null_features_are_zero_and_null_labels_take_no_part(spark):
    rows = [((float(i % 4), 1.0, 7.0), float(i % 3 == 0)) for i in range(24)]
    holes = spark.createDataFrame([(None if x[0] == 0 else x[0], y) for x, y in rows] + [(9.0, None), (None, None)], "a double, label double")
    head = fit(holes, ["a", "missing"], schedule=SHORT)
    _, _, weights, offset, *_ = plain([((x[0], 0.0), y) for x, y in rows], [((0.0, 0.0), 0.0)], SHORT)
    assert head.weights == pytest.approx(weights, abs=1e-8) and head.offset == pytest.approx(offset, abs=1e-8)
    assert not head.calibrated and (head.slope, head.shift, head.rows) == (1.0, 0.0, 24)
    assert head.score(holes.filter("false")).count() == 0
    assert head.score(spark.createDataFrame([(None,)], "a double")).first().probability == head.score(spark.createDataFrame([(0.0,)], "a double")).first().probability


def test_too_few_rows_or_one_label(spark):
    rows = some_rows(5, 30)
    with pytest.raises(CannotLearn):
        fit(frame(spark, rows, 1).filter("false"), ["a"], schedule=SHORT)
    with pytest.raises(CannotLearn):
        fit(frame(spark, rows[:19], 2), ["a"], schedule=SHORT)
    with pytest.raises(CannotLearn):
        fit(frame(spark, [(x, 1.0) for x, _ in rows], 2), ["a"], schedule=SHORT)
    with pytest.raises(CannotLearn):
        fit(frame(spark, rows, 1), [], schedule=SHORT)
    few = frame(spark, rows[:10], 1)
    assert not fit(frame(spark, rows, 2), ["a"], few, schedule=SHORT).calibrated
    assert not fit(frame(spark, rows, 2), ["a"], frame(spark, [(x, 0.0) for x, _ in rows], 1), schedule=SHORT).calibrated
