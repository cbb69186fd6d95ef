"""Exact nearest-rank percentiles of large groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import pin


def nearest_rank(df: DataFrame, value: str, percents: list[int], groups=(),
                 ranges: int | None = None) -> DataFrame:
    """``sorted[min(floor(n * p / 100), n - 1)]`` per group, one row per group and percent.

    Equal values of a group collapse to one row with their count, which are written out in ranges
    of (group, value). The counts per range, a row per group and range it touches, add up to the
    offset at which each range starts; so the range that holds a rank is known, and only that one
    is put in order. ``ranges`` is their number, by default that of the shuffle partitions. Returns
    ``groups, percent, value``; a null is a group like any other, empty groups give no row.
    """
    groups = list(groups)
    counted = df.where(F.col(value).isNotNull()).groupBy(
        *groups, F.col(value).alias("__v")
    ).agg(F.count(F.lit(1)).alias("__c"))
    keys = [*([ranges] if ranges else []), *groups, "__v"]
    ordered = counted.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id())
    ordered = pin(ordered, "percentile-ranges")

    sizes = ordered.groupBy(*groups, "__range").agg(F.sum("__c").alias("__rows"))
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    sizes = sizes.withColumns({
        "__n": F.sum("__rows").over(whole),
        "__end": F.sum("__rows").over(whole.orderBy("__range")),
    })
    rank = F.least(F.floor(F.col("__n") * F.col("percent") / 100), F.col("__n") - 1)
    offset = rank - (F.col("__end") - F.col("__rows"))
    asked = sizes.withColumn("percent", F.explode(F.array(*map(F.lit, percents)))).withColumn(
        "__offset", offset
    ).where((F.col("__offset") >= 0) & (F.col("__offset") < F.col("__rows")))
    asked = asked.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)],
                         F.col("__range").alias("__at"), "percent", "__offset")

    same = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(groups)]
    held = ordered.join(asked, reduce(lambda a, b: a & b, same, F.col("__range") == F.col("__at")))
    inside = Window.partitionBy(*groups, "percent").orderBy("__v")
    reached = held.withColumn("__upto", F.sum("__c").over(inside)).where("__upto > __offset")
    return reached.groupBy(*groups, "percent").agg(F.min("__v").alias("value"))


def nearest_ranks(df: DataFrame, values: list[str], percents: list[int], groups=(),
                  ranges: int | None = None) -> DataFrame:
    """The same for several columns over one set of ranges: ``groups, column, percent, value``."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(v).alias("column"), F.col(v).cast("double").alias("__x")) for v in values
    ]))
    long = df.select(*groups, pairs.alias("__p")).select(*groups, "__p.column", "__p.__x")
    return nearest_rank(long, "__x", percents, [*groups, "column"], ranges)


def widen(percentiles: DataFrame, percents: list[int], groups=(), prefix: str = "p") -> DataFrame:
    """One column per percent."""
    columns = [
        F.max(F.when(F.col("percent") == p, F.col("value"))).alias(f"{prefix}{p}")
        for p in percents
    ]
    return percentiles.groupBy(*groups).agg(*columns)
