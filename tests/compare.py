"""Run a query in Spark and its SQL in DuckDB and compare columns and rows, order aside."""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')"
        )
    return connection


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    if isinstance(value, (list, tuple)) and not hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def normalised(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return names, sorted(out, key=repr)


def spark_rows(df):
    return normalised(df.columns, df.collect())


def duck_rows(connection, sql: str):
    cursor = connection.execute(sql)
    return normalised([d[0] for d in cursor.description], cursor.fetchall())


def difference(ours, theirs) -> str | None:
    """None when equal, else a short account of the first differences."""
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        only = [r for r in ours[1] if r not in theirs[1]][:2]
        other = [r for r in theirs[1] if r not in ours[1]][:2]
        return f"rows {len(ours[1])} != {len(theirs[1])}\n only here {only}\n only there {other}"
    for mine, other in zip(ours[1], theirs[1]):
        if mine != other:
            return f"first difference\n  {str(mine)[:600]}\n  {str(other)[:600]}"
    return None
