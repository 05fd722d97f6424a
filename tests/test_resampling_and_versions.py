"""Bootstrap replicates against a loop, versioned merges and membership folds against sequential rules."""

import hashlib
import random
from datetime import datetime

import pytest

from emberline.operators.resampling import cut_places, even_places, fifth, fifth_up, interval, lifts, poisson_steps
from emberline.operators.versions import Field, VersionedTable, fold_changes, observed


def plain_lifts(rows, seed, count, replicates):
    steps, found = poisson_steps(), {}
    for r in range(1, replicates + 1):
        sample = []
        for i, unit, score, label in rows:
            drawn = int(hashlib.sha256(f"{seed}:{r}:{unit}".encode()).hexdigest()[:8], 16)
            sample += [(-score, i, label)] * sum(drawn >= s for s in steps)
        if sum(x[2] for x in sample):
            best = sorted(sample)[: count(len(sample))]
            found[r] = sum(x[2] for x in best) / len(best) / (sum(x[2] for x in sample) / len(sample))
    return found


@pytest.mark.parametrize("by_unit", [False, True])
def test_lifts_equal_the_loop(spark, by_unit):
    rng = random.Random(4)
    rows = [(i, f"u{i % 13}" if by_unit else str(i), rng.choice([0.1, 0.5, 0.5, rng.random()]), int(rng.random() < 0.2)) for i in range(150)]
    frame = spark.createDataFrame([*rows, (900, None, 0.5, 1), (901, "u1", None, 1), (902, "u1", 0.5, None)], "id int, unit string, score double, label int")
    for parts in (1, 5):
        got = {r.replicate: r.lift for r in lifts(frame.repartition(parts), 17, fifth_up if by_unit else fifth, 60).collect()}
        assert got == pytest.approx(plain_lifts(rows, 17, (lambda n: max(1, -(-n // 5))) if by_unit else (lambda n: max(1, n // 5)), 60))


def test_places_and_no_positive_rows(spark):
    rows = spark.createDataFrame([(float(i),) for i in range(40)], "lift double")
    assert tuple(interval(rows, cut_places).first()) == (40, 1.0, 20.0, 39.0)
    assert tuple(interval(rows, even_places).first()) == (40, 1.0, 20.0, 38.0)
    none = spark.createDataFrame([(1, "a", 0.5, 0)], "id int, unit string, score double, label int")
    for frame in (none, none.limit(0)):
        assert tuple(interval(lifts(frame, 1, fifth, 5), cut_places).first()) == (0, None, None, None)


def test_weights_have_mean_one():
    steps = poisson_steps()
    assert sum(2**32 - s for s in steps) / 2**32 == pytest.approx(1, abs=1e-6)


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, x int")


def test_merges_once_and_reads_the_newest_version(spark, tmp_path):
    at = [datetime(2024, 1, d) for d in range(1, 9)]
    fields = observed("ts") | {"x": Field(__import__("pyspark.sql.functions", fromlist=["max"]).max("x"), lambda old, new: new)}
    table = VersionedTable(spark, f"file://{tmp_path}/t", ["k"], fields)
    with pytest.raises(LookupError):
        table.read()
    first = rows_of(spark, [("a", at[1], 1), ("a", at[3], 2), (None, at[2], 3)])
    second = rows_of(spark, [("a", at[0], 7), ("b", at[5], 8), (None, at[6], 9), ("b", None, 5)])
    assert table.merge(first, "one") and not table.merge(first, "one")
    held = table.read()
    assert table.merge(second, "two") and not table.merge(second, "two")
    assert VersionedTable(spark, table.folder, ["k"], fields).manifest()["batches"] == ["one", "two"]
    got = {r.k: tuple(r)[1:] for r in table.read().collect()}
    assert got == {"a": (at[0], at[3], 3, 7), None: (at[2], at[6], 2, 9), "b": (at[5], at[5], 2, 8)}
    assert {r.k: r.observation_count for r in held.collect()} == {"a": 2, None: 1}  # readers of the old version keep it
    assert table.merge(first.limit(0), "none") and table.read().count() == 3


def test_a_second_writer_of_one_version_fails(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", ["k"], observed("ts"))
    table.merge(rows_of(spark, [("a", datetime(2024, 1, 1), 1)]), "one")
    stale = table.manifest()
    table.merge(rows_of(spark, [("b", datetime(2024, 1, 1), 1)]), "two")
    with pytest.raises(RuntimeError):
        table._publish({"number": stale["number"] + 1, "table": "version-lost", "batches": []})
    assert table.manifest()["batches"] == ["one", "two"] and table.read().count() == 2


def test_fold_equals_the_rule_in_order(spark):
    rng = random.Random(8)
    days = [datetime(2024, 1, d) for d in range(1, 15)]
    changes = [(rng.choice("abcd"), rng.choice(days), rng.random() < 0.5, rng.choice(["r1", "r2"])) for _ in range(70)]
    changes += changes[:3] + [(None, days[0], True, "x"), ("a", None, True, "x"), ("a", days[0], None, "x")]
    members = [("a", datetime(2023, 1, 1), "seed", None, None), ("b", datetime(2022, 1, 1), "seed", datetime(2022, 6, 1), "dormant"), ("z", datetime(2022, 1, 1), "seed", None, None)]
    expected = [list(m) for m in members]
    for key, at, joining, reason in sorted((c for c in changes if None not in c), key=lambda c: (c[1], c[2], c[3])):
        if joining:
            expected.append([key, at, reason, None, None])
        else:
            for m in expected:
                if m[0] == key and m[3] is None:
                    m[3:] = [at, reason]
    got = fold_changes(spark.createDataFrame(members, "channel_id string, joined_at timestamp_ntz, reason string, left_at timestamp_ntz, left_reason string"), spark.createDataFrame(changes, "channel_id string, changed_at timestamp_ntz, joining boolean, reason string"))
    order = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.collect()), key=order) == sorted(map(tuple, expected), key=order)
