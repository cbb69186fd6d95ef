"""Stored tables and vectors. Filters and column lists reach the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import TABLES


def read_table(spark: SparkSession, name: str, path: str | None = None, **jdbc) -> DataFrame:
    """A table from Parquet, or from a database when JDBC options are given."""
    if path is None:
        return spark.read.format("jdbc").options(dbtable=name, **jdbc).load()
    reader = spark.read
    return (reader.schema(TABLES[name]) if name in TABLES else reader).parquet(path)


def key_filter(df: DataFrame, **equal) -> DataFrame:
    """Equality on columns; pushed into the scan."""
    tests = [F.col(column) == value for column, value in equal.items()]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def read_vectors(spark: SparkSession, path: str, with_vectors: bool = True,
                 with_payload: bool = True, **equal) -> DataFrame:
    """The vector table; leaving out vectors or payload leaves those columns unread."""
    points = key_filter(spark.read.schema(TABLES["points"]).parquet(path), **equal)
    payload = [c for c in points.columns if c not in ("point_id", "embedding")]
    columns = ["point_id"] + (["embedding"] if with_vectors else [])
    return points.select(*columns, *(payload if with_payload else []))
