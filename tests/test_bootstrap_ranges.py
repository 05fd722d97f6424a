"""Replicates are drawn for units and ranges, not for all rows once more."""

from emberline.operators.resampling import fifth, lifts


def test_rows_are_not_drawn_twice(spark):
    rows = spark.createDataFrame([(i, f"u{i % 3}", i / 100, int(i % 4 == 0)) for i in range(100)], "id int, unit string, score double, label int")
    found = lifts(rows, 17, fifth, 20)
    # Before, every row was repeated for every replicate in this last step too.
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.replicate: (r.n, r.positives) for r in found.collect()}
    single = {r.replicate: (r.n, r.positives) for r in lifts(rows.repartition(7), 17, fifth, 20).collect()}
    assert got == single and got
