"""Operators that SQL can express, against DuckDB at sf0.001."""

import duckdb
import pytest

from emberline.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = con.execute(f"select {', '.join(names)} from ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.select(names).collect()))) == sorted(map(str, want)) and want
