"""Evaluation runs: means, coverage, verdicts, comparison and sampling of cases.

Runs have ``run_ts, tag, dataset_size, success_count, metrics`` (map of name to value).
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rules
from .keyed import top_per_group
from .logs import rate


def valid_cases(results: DataFrame, need_answer: bool = False) -> DataFrame:
    """Successful cases with at least one context, and an answer where that is needed."""
    kept = results.where((F.col("status") == "success") & (F.size("contexts") > 0))
    return kept.where(F.coalesce("answer", F.lit("")) != "") if need_answer else kept


def context_coverage(results: DataFrame) -> DataFrame:
    """Share of successful cases with contexts per question type."""
    covered, cases = F.count_if(F.size("contexts") > 0), F.count(F.lit(1))
    return results.where(F.col("status") == "success").groupBy("question_type").agg(
        covered.alias("with_contexts"), cases.alias("cases"), rate(covered, cases).alias("coverage")
    )


def metric_means(scores: DataFrame, exclude=()) -> DataFrame:
    """Mean of every numeric column, NULLs skipped."""
    numeric = [
        f.name for f in scores.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]
    return scores.agg(*[F.avg(c).alias(c) for c in numeric])


def verdict_rollup(verdicts: DataFrame) -> DataFrame:
    """Verdict counts, rates over the valid ones, and citation misses
    (``verdict, citation_verdict``)."""
    def count(name: str):
        return F.count_if(F.col("verdict") == name)

    total = F.count(F.lit(1))
    valid = total - count("ERROR")
    return verdicts.agg(
        total.alias("total"),
        count("GROUNDED").alias("grounded"),
        count("PARTIAL").alias("partial"),
        count("HALLUCINATION").alias("hallucination"),
        count("ERROR").alias("errors"),
        valid.alias("valid"),
        rate(count("HALLUCINATION"), valid).alias("hallucination_rate"),
        rate(count("GROUNDED") + count("PARTIAL"), valid).alias("safe_rate"),
        F.count_if(F.col("citation_verdict") == "CITATION_MISS").alias("citation_misses"),
    )


def latest_runs(runs: DataFrame, n: int = 2, exclude=None) -> DataFrame:
    """The newest ``n`` runs, without one given time stamp."""
    if exclude is not None:
        runs = runs.where(F.col("run_ts") != F.lit(exclude))
    return runs.orderBy(F.desc("run_ts"), F.desc("tag")).limit(n)


def compare_metrics(pairs: DataFrame, thresholds=None,
                    default: float = rules.REGRESSION_THRESHOLD) -> DataFrame:
    """Relative change and status per ``metric, before_value, after_value``."""
    limits = rules.METRIC_THRESHOLDS if thresholds is None else thresholds
    limit = F.lit(default)
    if limits:
        lookup = F.create_map(*[F.lit(v) for v in chain.from_iterable(limits.items())])
        limit = F.coalesce(F.try_element_at(lookup, F.col("metric")), F.lit(default))
    before, after = F.col("before_value"), F.col("after_value")
    usable = before.isNotNull() & after.isNotNull() & (before != 0)
    delta = F.when(usable, (after - before) / before)
    status = (
        F.when(before.isNull() | after.isNull(), "N/A")
        .when(before == 0, "stable")
        .when(delta > limit, "improved")
        .when(delta < -limit, "regression")
        .otherwise("stable")
    )
    return pairs.withColumn("delta", delta).withColumn("status", status)


def compare_runs(before: DataFrame, after: DataFrame, **options) -> DataFrame:
    """Metric-wise comparison of two runs (one row each, with a ``metrics`` map)."""
    left = before.select(F.explode("metrics").alias("metric", "before_value"))
    right = after.select(F.explode("metrics").alias("metric", "after_value"))
    return compare_metrics(left.join(right, "metric", "full_outer"), **options)


def regression_gate(runs: DataFrame, **options) -> DataFrame:
    """The newest run against the one before it, metric by metric, with the overall flag."""
    place = F.struct("run_ts", "tag")
    two = latest_runs(runs, 2).agg(
        F.min_by("metrics", place).alias("before"), F.max_by("metrics", place).alias("after"),
        F.count(F.lit(1)).alias("n"),
    ).where(F.col("n") == 2)
    zipped = F.map_zip_with(
        "before", "after",
        lambda _, b, a: F.struct(b.alias("before_value"), a.alias("after_value")),
    )
    pairs = two.select(F.explode(zipped).alias("metric", "v")).select("metric", "v.*")
    compared = compare_metrics(pairs, **options)
    flag = compared.agg(F.coalesce(F.bool_or(F.col("status") == "regression"), F.lit(False)))
    return compared.withColumn("has_regression", flag.scalar())


def diverse_sample(cases: DataFrame, kind: str, n: int = 5, order: str = "position") -> DataFrame:
    """The first case of each kind, filled up with the earliest other cases."""
    kinds = F.coalesce(F.col(kind), F.lit("unknown"))
    typed = cases.withColumn("__kind", kinds)
    firsts = top_per_group(typed, "__kind", F.asc(order), 1).orderBy(order).limit(n)
    early = typed.orderBy(order).limit(2 * n).join(firsts.select(order), order, "left_anti")
    picked = firsts.withColumn("filled", F.lit(False)).unionByName(
        early.withColumn("filled", F.lit(True))
    )
    return picked.orderBy("filled", order).limit(n).drop("__kind")
