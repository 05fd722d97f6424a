"""Rules against small hand-computed cases, not against a second rendering of the same text."""

import pytest

from emberline.operators import uploads
from emberline.plans.dialect import render, spark_sql

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folds(spark):
    from emberline import registry

    return {r.fold: r for r in registry.queries()["purged_splits"](spark, SF).collect()}


def test_four_folds_of_a_fifth_each(spark, folds):
    total = spark_sql(spark, SF, render(f"WITH {uploads.WEEKLY} SELECT count(*) AS n FROM st", 0)).first().n
    assert set(folds) <= {1, 2, 3, 4} and max(folds) == 4
    assert {r.validation for r in folds.values()} == {total // 5}
    assert all(r.train <= fold * (total // 5) for fold, r in folds.items())


def plan(spark, text, **tables):
    text = render(text, 0).replace("FROM orders", "FROM {orders}").replace("FROM lineitem", "FROM {lineitem}").replace("FROM customer", "FROM {customer}")
    return spark.sql(text, **tables).collect()


def test_projection_ignores_the_future_and_takes_factor_one_without_a_curve(spark):
    orders = spark.sql("SELECT * FROM VALUES (1L, 10L, DATE'1999-05-01', 100D, 'a'), (2L, 10L, DATE'1999-05-31', 100D, 'a') AS t(o_orderkey, o_custkey, o_orderdate, o_totalprice, o_orderpriority)")
    # Ages by the stand-in rule (key * 7 + part * 31 + line * 13) % 30 + .5: video 1 at 20.5 and 3.5 days, video 2 at 27.5 (after the checkpoint).
    lineitem = spark.sql("SELECT * FROM VALUES (1L, 0L, 1L, 50D), (1L, 1L, 5L, 40D), (2L, 0L, 1L, 70D) AS t(l_orderkey, l_partkey, l_linenumber, l_extendedprice)")
    rows = plan(spark, f"WITH {uploads.CURVE} SELECT video_id, ref_views FROM rv", orders=orders, lineitem=lineitem)
    assert [(r.video_id, r.ref_views) for r in rows] == [(1, 40.0)]
