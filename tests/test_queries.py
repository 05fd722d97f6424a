"""Every registered query against its DuckDB text at sf0.001."""

import math

import duckdb
import pytest

from emberline import registry
from emberline.plans.dialect import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "-"
        return f"{float(v):.4f}" if isinstance(v, (int, float)) else str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_duckdb(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    names = sorted(df.columns)
    want = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == names
    order = [columns.index(n) for n in names]
    assert plain(df.select(*names).collect()) == plain([[r[i] for i in order] for r in want.fetchall()])


def test_truncation_does_not_change_topic_scores(spark):
    """Dropping what happened after the checkpoint leaves all as-of results as they were."""
    from emberline.operators.topics import SCORE
    from emberline.plans.dialect import render

    events = spark.read.parquet(f"{SF}/events.parquet")
    text = render(SCORE + " SELECT topic, score, stage FROM scored", 0).replace("FROM events", "FROM {events}")
    full = spark.sql(text, events=events).collect()
    cut = spark.sql(text, events=events.filter("ts <= timestamp_ntz'2024-01-24 00:00:00'")).collect()
    assert sorted(full) == sorted(cut) and full
