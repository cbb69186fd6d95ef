"""Golden cases, runs and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import GOLDEN_CASE, RUN


def read_golden(spark: SparkSession, path: str, sample: int | None = None,
                with_article: bool = False, lines: bool = False) -> DataFrame:
    """Golden cases; ``sample`` keeps the first N.

    A file is one document whose ``dataset`` array is the table, or with ``lines`` a case per line that has its
    ``position``, which many tasks read and write together.
    """
    if lines:
        cases = spark.read.schema(f"position int, {GOLDEN_CASE}").json(path)
    else:
        document = spark.read.schema(f"dataset array<struct<{_struct(GOLDEN_CASE)}>>")
        rows = document.json(path, multiLine=True)
        cases = rows.select(F.posexplode("dataset").alias("position", "c")).select("position", "c.*")
    if with_article:
        cases = cases.where(F.coalesce("article_number", F.lit("")) != "")
    return cases.orderBy("position").limit(sample) if sample else cases


def _struct(ddl: str) -> str:
    fields, depth, current = [], 0, ""
    for char in ddl:
        depth += {"<": 1, ">": -1}.get(char, 0)
        if char == "," and depth == 0:
            fields.append(current)
            current = ""
        else:
            current += char
    return ",".join(f.strip().replace(" ", ":", 1) for f in [*fields, current])


def run_row(cases: DataFrame, metrics: DataFrame, run_ts, tag: str) -> DataFrame:
    """One run: sizes counted from the case results, metrics from a one-row table."""
    sizes = cases.agg(
        F.count(F.lit(1)).alias("dataset_size"),
        F.count_if(F.col("status") == "success").alias("success_count"),
    )
    pairs = [v for c in metrics.columns for v in (F.lit(c), F.col(c).cast("double"))]
    scored = metrics.select(F.create_map(*pairs).alias("metrics"))
    return sizes.select(
        F.lit(run_ts).cast("timestamp").alias("run_ts"), F.lit(tag).alias("tag"),
        "dataset_size", "success_count", scored.scalar().alias("metrics"),
    )


def write_run(run: DataFrame, cases: DataFrame, path: str) -> None:
    """Append a run and its case rows."""
    run.write.mode("append").parquet(f"{path}/runs")
    tagged = cases.withColumn("run_ts", run.select("run_ts").scalar()).withColumn(
        "tag", run.select("tag").scalar()
    )
    tagged.write.mode("append").partitionBy("run_ts", "tag").parquet(f"{path}/cases")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All runs, newest first."""
    runs = spark.read.schema(RUN).parquet(f"{path}/runs")
    return runs.orderBy(F.desc("run_ts"), F.desc("tag"))


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """A report table; written by all tasks, replaced as a whole."""
    df.write.mode("overwrite").format(fmt).save(path)
