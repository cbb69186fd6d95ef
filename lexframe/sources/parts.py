"""Tables that change by groups of rows, such as the articles of a law: Parquet dealt into parts by the group's hash.

Only the parts of the groups at hand are read and replaced, by Spark's dynamic partition overwrite; other parts are
neither read nor written.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = 64


def part_of(key: Column | str, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def read_parts(spark: SparkSession, path: str, schema: str, wanted: list[int] | None = None) -> DataFrame:
    """The rows of a table, or of its ``wanted`` parts; an empty table where nothing was written yet."""
    try:
        table = spark.read.schema(f"{schema}, part int").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        # a filter that keeps nothing is seen when a job is planned, which then shuffles nothing to meet an empty table
        return spark.createDataFrame([], schema).where(F.lit(False))
    table = table if wanted is None else table.where(F.col("part").isin(wanted))
    return table.drop("part")


def replace_parts(df: DataFrame, path: str, key: str, parts: int = PARTS) -> None:
    """Write ``df`` in place of the parts that its rows belong to.

    ``df`` may read the parts it replaces: new files are written beside them and take their place when all are whole.
    """
    dealt = df.withColumn("part", part_of(key, parts))
    writer = dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
    writer.partitionBy("part").parquet(path)
