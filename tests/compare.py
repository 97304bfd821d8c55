"""Run queries and their SQL side by side and compare schemas and values."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS FROM '{sf_dir}/{table}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted([_plain(row[i]) for i in order] for row in rows)


def differences(spark_df, connection, sql: str) -> list[str]:
    """Empty if both sides agree."""
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    expected = _rows(names, result.fetchall())
    actual = _rows(spark_df.columns, spark_df.collect())
    found = []
    if sorted(names) != sorted(spark_df.columns):
        found.append(f"columns {sorted(spark_df.columns)} instead of {sorted(names)}")
    if len(actual) != len(expected):
        found.append(f"{len(actual)} rows instead of {len(expected)}")
    wrong = [(a, e) for a, e in zip(actual, expected) if a != e]
    if wrong:
        found.append(f"{len(wrong)} rows differ, first {wrong[0]}")
    return found
