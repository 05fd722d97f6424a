"""Query name -> (Spark plan, DuckDB SQL); operators register themselves where they are defined."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES: tuple[str, ...] = (
    "operators.topics", "operators.uploads", "operators.texts", "operators.adoption", "operators.ranker", "operators.families", "operators.clusters",
    "operators.lineage", "operators.resampling", "operators.versions", "operators.folds", "operators.anchors", "operators.candidates", "operators.descent", "operators.rules", "operators.feeds", "streaming.counts", "streaming.registry", "sources.archive",
)
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with the SQL its rows are checked against."""

    def add(function: Query) -> Query:
        key = name or function.__name__
        if key in _QUERIES:
            raise ValueError(f"two queries are named {key}")
        _QUERIES[key] = function
        if sql:
            _SQL[key] = sql
        return function

    return add


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"emberline.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
