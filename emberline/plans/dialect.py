"""One SQL text for two engines: fragments that differ are written <<name:argument>>."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from emberline.registry import query

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: fragment -> (Spark SQL, DuckDB SQL); {} is the argument.
FRAGMENTS = {
    "secs": ("unix_timestamp(cast({} as timestamp))", "cast(floor(epoch({})) as bigint)"),
    "json_k": ("get_json_object({}, '$.k')", "json_extract_string({}, '$.k')"),
    "sha": ("sha2({}, 256)", "sha256({})"),
    "tokens": ("regexp_extract_all(lower({}), '[a-zà-ÿ0-9]+', 0)", "regexp_extract_all(lower({}), '[a-zà-ÿ0-9]+')"),
    "explode": ("explode({})", "unnest({})"),
    "size": ("size({})", "len({})"),
    "distinct": ("array_distinct({})", "list_distinct({})"),
    "both": ("array_intersect({})", "list_intersect({})"),
    "targets": ("array(1, 3, 7, 14, 21)", "[1, 3, 7, 14, 21]"),
    "hours": ("array(1, 2, 6, 12, 24, 48, 72, 120, 168, 336, 720)", "[1, 2, 6, 12, 24, 48, 72, 120, 168, 336, 720]"),
    "seq": ("sequence({})", "range({} + 1)"),
    "anti": ("LEFT ANTI {}", "ANTI {}"),
    "hex8": ("cast(conv(substr({}, 1, 8), 16, 10) as bigint)", "cast(('0x' || substr({}, 1, 8)) as bigint)"),
    "list": ("array_agg({})", "list({})"),
    "day": ("date_trunc('DAY', {})", "cast(date_trunc('day', {}) as timestamp)"),
    "from_secs": ("cast(timestamp_seconds({}) as timestamp_ntz)", "make_timestamp(({}) * 1000000)"),
    "extract1": ("regexp_extract({}, 1)", "regexp_extract({}, 1)"),
    "days": ("make_dt_interval(cast({} as int))", "to_days(cast({} as integer))"),
    "run": ("cast(floor({} / 20) AS bigint)", "({} // 20)"),
    "text": ("string", "varchar"),
    "word2": ("split({}, ' ')[1]", "split_part({}, ' ', 2)"),
    "pair": ("array({})", "[{}]"),
    "dvec": ("{}", "cast({} as double[])"),
    "dot": ("aggregate(zip_with({}, (x, y) -> cast(x as double) * cast(y as double)), 0D, (s, z) -> s + z)", "list_dot_product({})"),
}
_MARK = re.compile(r"<<(\w+):((?:(?!<<|>>).)*)>>", re.S)


def render(text: str, engine: int) -> str:
    """The text for Spark (0) or DuckDB (1)."""
    if not engine:
        text = text.replace(", 'g')", ")")  # Spark's regexp_replace replaces all anyway
    while True:
        new = _MARK.sub(lambda m: FRAGMENTS[m[1]][engine].replace("{}", m[2].strip()), text)
        if new == text:
            return text
        text = new


def spark_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run a text with the parquet tables that it names."""
    own = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"(?i)\b(from|join)\s+{t}\b", text)}
    braced = re.sub(r"(?i)\b(from|join)(\s+)(\w+)\b", lambda m: f"{m[1]}{m[2]}{{{m[3]}}}" if m[3] in own else m[0], text.replace("{", "{{").replace("}", "}}"))
    return spark.sql(braced, **own)


def sql_query(name: str, text: str, row: str) -> None:
    """Register one text as a query and its own DuckDB check; row is its place in the inventory."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark_sql(spark, sf_dir, render(text, 0))

    run.__doc__ = f"Inventory row {row}."
    query(render(text, 1), name)(run)
