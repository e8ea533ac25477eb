"""Run registered queries and their SQL side by side and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from checks import registry

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
)


# Spark type names and what the SQL side calls them.
_KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5) + 0.0
    if isinstance(value, dict):
        return tuple(sorted((key, _cell(item)) for key, item in value.items()))
    if isinstance(value, list):
        return tuple(_cell(item) for item in value)
    return value


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda at: columns[at])
    return sorted((tuple(_cell(row[at]) for at in order) for row in rows), key=repr)


def difference(spark: SparkSession, connection, name: str, sf_dir: str) -> str | None:
    """None if both sides agree in names and rows, else what differs."""
    df = registry.queries()[name](spark, sf_dir)
    sql = registry.oracle_sql()[name]
    relation = connection.sql(sql)
    names = relation.columns
    expected = _sorted_rows(names, relation.fetchall())
    found = _sorted_rows(df.columns, [tuple(row) for row in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} instead of {sorted(names)}"
    kinds = {name: str(kind) for name, kind in zip(names, relation.types)}
    wrong_kinds = [
        f"{name} {kind} instead of {kinds[name]}" for name, kind in df.dtypes if _KINDS.get(kind, kind) != kinds[name]
    ]
    if wrong_kinds:
        return f"types: {wrong_kinds}"
    if len(found) != len(expected):
        return f"{len(found)} rows instead of {len(expected)}"
    wrong = [(a, b) for a, b in zip(found, expected) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(found)} rows differ, first: {wrong[0][0]} instead of {wrong[0][1]}"
    if not found:
        return "no rows on either side"
    return None


def main(sf_dir: str, *names: str) -> int:
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config(
        "spark.ui.enabled", "false"
    ).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    failures = 0
    for name in names or registry.oracle_sql():
        started = time.time()
        try:
            problem = difference(spark, connection, name, sf_dir)
        except Exception as error:  # report every query, then fail
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failures += problem is not None
        print(f"{time.time() - started:7.2f}s  {name}: {problem or 'same rows'}", flush=True)
    return failures


if __name__ == "__main__":
    sys.exit(min(main(*sys.argv[1:]), 1))
