"""Ranks of a feed are rounded by their binary value."""

from math import floor

from pyspark.sql import functions as F

from emberline.operators.feeds import rounded


def test_ties_go_by_the_binary_value(spark):
    values = [k / 10_000_000 for k in range(5_046_005, 5_048_005, 10)]
    got = [r.x for r in spark.createDataFrame([(v,) for v in values], "v double").select(rounded(F.col("v")).alias("x")).collect()]
    want = [(floor(v * 1e6) + (v * 1e6 - floor(v * 1e6) >= 0.5)) / 1e6 for v in values]
    assert got == want
    assert any(w != k for w, k in zip(want, [(int(v * 10_000_000 + 0.5) // 10 + 1) / 1e6 for v in values]))
