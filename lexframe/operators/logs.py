"""Reports over the request log: ``ts, tool, query, query_type, selected_source,
selected_articles, fallback_used, confidence_score``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import failure_reason, is_failure
from .percentiles import nearest_rank, widen

SCORE_PERCENTS = [25, 50, 75, 95]


def rate(part: Column, whole: Column, digits: int = 4) -> Column:
    """Share rounded half-even; a zero whole counts as one."""
    return F.bround(part / F.greatest(whole, F.lit(1)), digits)


def flag_failures(log: DataFrame) -> DataFrame:
    """Every log row with ``is_failure`` and its ``failure_reason``."""
    fields = (F.col("fallback_used"), F.col("confidence_score"), F.col("selected_articles"))
    return log.withColumns({
        "is_failure": is_failure(*fields), "failure_reason": failure_reason(*fields),
    })


def collect_failures(log: DataFrame) -> DataFrame:
    """The failing rows with their reason."""
    return flag_failures(log).where("is_failure").drop("is_failure")


def qa_report(log: DataFrame) -> DataFrame:
    """One row of totals, rates and score statistics; no row for an empty log."""
    n = F.count(F.lit(1))
    articles = F.col("selected_articles")
    fallback = F.count_if(F.coalesce("fallback_used", F.lit(False)))
    no_article = F.count_if(articles.isNull() | (F.size(articles) <= 0))
    errors = F.count_if(F.col("selected_source") == "none")
    totals = log.agg(
        n.alias("total_requests"),
        fallback.alias("fallback_count"), rate(fallback, n).alias("fallback_rate"),
        no_article.alias("no_article_count"), rate(no_article, n).alias("no_article_rate"),
        errors.alias("error_count"), rate(errors, n).alias("error_rate"),
        F.count("confidence_score").alias("score_count"),
        F.bround(F.avg("confidence_score"), 4).alias("score_mean"),
        F.bround(F.min("confidence_score"), 4).alias("score_min"),
        F.bround(F.max("confidence_score"), 4).alias("score_max"),
    ).where(F.col("total_requests") > 0)
    ranks = widen(nearest_rank(log, "confidence_score", SCORE_PERCENTS), SCORE_PERCENTS)
    columns = [f"p{p}" for p in SCORE_PERCENTS]
    totals = totals.withColumn("__ranks", ranks.select(F.struct(*columns)).scalar())
    return totals.select(
        "*", *[F.bround(F.col("__ranks")[c], 4).alias(f"score_{c}") for c in columns]
    ).drop("__ranks")


def distribution(df: DataFrame, column: str, missing: str = "unknown") -> DataFrame:
    """Rows per value with their share in percent; NULL and empty count as ``missing``."""
    value = F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit(missing))
    counts = df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total")).scalar()
    share = F.bround(F.col("n") * 100 / F.greatest(total, F.lit(1)), 1)
    return counts.withColumn("percent", share).orderBy(F.desc("n"), "value")


def failure_rollup(log: DataFrame) -> DataFrame:
    """Failures in total, per source and per query type: ``dimension, value, n, rate``."""
    flagged = flag_failures(log)
    unknown = F.lit("unknown")
    dimensions = F.array(
        F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("value")),
        F.struct(F.lit("source").alias("dimension"),
                 F.coalesce("selected_source", unknown).alias("value")),
        F.struct(F.lit("query_type").alias("dimension"),
                 F.coalesce("query_type", unknown).alias("value")),
    )
    exploded = flagged.select("is_failure", F.explode(dimensions).alias("d"))
    failures = F.count_if("is_failure")
    return exploded.groupBy("d.dimension", "d.value").agg(
        failures.alias("failures"), F.count(F.lit(1)).alias("entries"),
        rate(failures, F.count(F.lit(1))).alias("failure_rate"),
    ).where((F.col("failures") > 0) | (F.col("dimension") == "total"))
