"""Latest, first and top rows per key, ordered unions and differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, keys, order, n: int, rank: str | None = None) -> DataFrame:
    """First ``n`` rows of every group.

    ``row_number <= n`` lets Spark cut each group to ``n`` rows before the shuffle, so a group
    holding a third of the table still arrives as ``n`` rows per map task.
    """
    window = Window.partitionBy(*_as_list(keys)).orderBy(*_as_list(order))
    name = rank or "__row"
    kept = df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def latest_by_key(df: DataFrame, keys, order) -> DataFrame:
    """Last writer wins; ``order`` is ascending."""
    newest = [F.desc(o) if isinstance(o, str) else o.desc() for o in _as_list(order)]
    return top_per_group(df, keys, newest, 1)


def keep_first(df: DataFrame, key: str, order) -> DataFrame:
    """First row per key; rows with a NULL or empty key are dropped."""
    present = df.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
    return top_per_group(present, key, order, 1)


def rank_within(df: DataFrame, part, order, name: str = "rank") -> DataFrame:
    """1-based rank. Meant for groups bounded by their meaning, such as one answer's citations."""
    window = Window.partitionBy(*_as_list(part)).orderBy(*_as_list(order))
    return df.withColumn(name, F.row_number().over(window))


def top_sources(results: DataFrame, part, order, n: int) -> DataFrame:
    """The first ``n`` results per question: 8 for summaries, 5 as sources, 3 as links."""
    return top_per_group(results, part, order, n)


def union_sources(*sources: DataFrame) -> DataFrame:
    """Stack sources in the given order; ``source_order`` keeps that order for later steps."""
    tagged = [s.withColumn("source_order", F.lit(i)) for i, s in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def set_difference(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """Rows of ``left`` whose key is not in ``right``."""
    return left.join(right.select(*_as_list(keys)), _as_list(keys), "left_anti")


def newest(*columns) -> list[Column]:
    return [F.desc(c) for c in columns]


def _as_list(value) -> list:
    return list(value) if isinstance(value, (list, tuple)) else [value]
