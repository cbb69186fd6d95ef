"""Accuracy of retrieval, ranking variants and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalize_name, strip_space
from .keyed import top_per_group


def expected_labels(golden: DataFrame) -> DataFrame:
    """Accepted labels per case: the main article and every accepted alternative.

    ``golden`` has ``case_id, law_name, article_number, accepted`` (array of law/article structs).
    """
    main = F.array(F.struct(
        F.col("law_name").alias("law"), F.col("article_number").alias("article")
    ))
    alternatives = F.coalesce("accepted", F.array().cast("array<struct<law:string,article:string>>"))
    pairs = golden.select("case_id", F.explode(F.concat(main, alternatives)).alias("a"))
    label = F.concat(
        normalize_name(F.col("a.law")), F.lit("제"), strip_space(F.col("a.article")), F.lit("조")
    )
    return pairs.select("case_id", label.alias("label")).distinct()


def hit_flags(results: DataFrame, accepted: DataFrame, ks=(3, 5, 10)) -> DataFrame:
    """Hits at 1, 3 and k for every case and every k.

    ``accepted`` has every golden case (:func:`expected_labels`) and ``results`` has ``case_id, rank,
    label, score``; labels match exactly after normalisation. A case without a result row, or
    without a right one, is a miss.
    """
    flagged = results.withColumn("label", normalize_name(F.col("label")))
    right = accepted.withColumn("__hit", F.lit(True))
    flagged = flagged.join(right, ["case_id", "label"], "left")
    hit_rank = F.min(F.when(F.col("__hit"), F.col("rank")))
    cases = flagged.groupBy("case_id").agg(
        hit_rank.alias("hit_rank"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top1_score"),
    )
    cases = accepted.select("case_id").distinct().join(cases, "case_id", "left")
    first = F.coalesce("hit_rank", F.lit(1 << 30))
    return cases.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).select(
        "case_id", "k",
        (first <= 1).alias("top1_hit"),
        (first <= F.least(F.lit(3), F.col("k"))).alias("top3_hit"),
        (first <= F.col("k")).alias("topk_hit"),
        "top1_score",
    )


def retrieval_metrics(flags: DataFrame) -> DataFrame:
    """Accuracy and recall per k; scores that are NULL or zero stay out of the mean."""
    def share(column: str):
        return F.bround(F.avg(F.col(column).cast("int")), 4)

    score = F.avg(F.when(F.col("top1_score") != 0, F.col("top1_score")))
    return flags.groupBy("k").agg(
        F.count(F.lit(1)).alias("cases"),
        share("top1_hit").alias("top1_accuracy"),
        share("top3_hit").alias("top3_recall"),
        share("topk_hit").alias("topk_recall"),
        F.coalesce(F.bround(score, 4), F.lit(0.0)).alias("avg_top1_score"),
    )


def ranking_ablation(candidates: DataFrame, pipelines: dict[str, str]) -> DataFrame:
    """Top-1 and top-3 rate of several score columns over the same candidates.

    ``candidates`` has ``case_id, candidate_id, label, expected_law, expected_article`` and the
    score columns named in ``pipelines`` (name -> column). A label matches when it contains both
    the law and ``제N조``; that is looser than :func:`hit_flags`.
    """
    label = normalize_name(F.col("label"))
    match = label.contains(normalize_name(F.col("expected_law"))) & label.contains(
        F.concat(F.lit("제"), strip_space(F.col("expected_article")), F.lit("조"))
    )
    scores = F.explode(F.array(*[
        F.struct(F.lit(name).alias("pipeline"), F.col(column).cast("double").alias("score"))
        for name, column in pipelines.items()
    ]))
    long = candidates.select("case_id", "candidate_id", match.alias("hit"), scores.alias("s"))
    long = long.select("case_id", "candidate_id", "hit", "s.*")
    order = [F.desc("score"), F.asc("candidate_id")]
    top = top_per_group(long, ["case_id", "pipeline"], order, 3, rank="rank")
    cases = top.groupBy("case_id", "pipeline").agg(
        F.max((F.col("hit") & (F.col("rank") == 1)).cast("int")).alias("top1"),
        F.max(F.col("hit").cast("int")).alias("top3"),
    )
    return cases.groupBy("pipeline").agg(
        F.count(F.lit(1)).alias("cases"),
        F.bround(F.avg("top1"), 4).alias("top1_rate"),
        F.bround(F.avg("top3"), 4).alias("top3_rate"),
    )


def router_accuracy(predictions: DataFrame) -> DataFrame:
    """Accuracy of two predictors (``label, rule_label, model_label``)."""
    rule = F.col("rule_label") == F.col("label")
    model = F.col("model_label") == F.col("label")
    return predictions.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(rule).alias("rule_correct"),
        F.count_if(model).alias("model_correct"),
        F.bround(F.avg(rule.cast("int")), 4).alias("rule_accuracy"),
        F.bround(F.avg(model.cast("int")), 4).alias("model_accuracy"),
    )


def confusion(predictions: DataFrame, predicted: str = "rule_label") -> DataFrame:
    """Cases per true and predicted label."""
    return predictions.groupBy("label", F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def wrong_cases(predictions: DataFrame, predicted: str = "rule_label") -> DataFrame:
    """The cases a predictor got wrong, with all their columns."""
    return predictions.where(~F.col(predicted).eqNullSafe(F.col("label")))
