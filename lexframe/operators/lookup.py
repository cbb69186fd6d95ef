"""Joins of questions and cases to keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import handler_of, normalize_article, normalize_name, strip_space
from .corpus import KEYS
from .keyed import keep_first, top_per_group


def exact_lookup(questions: DataFrame, articles: DataFrame) -> DataFrame:
    """Article of each (name, article) request: one row per request.

    ``questions`` has ``question_id, name, article``. ``status`` is ``found``, ``not_found`` or, for
    a blank or missing name or number, ``invalid``. Articles are cut to one row per key before the
    join, so their texts meet each request once; a much-asked article is left to adaptive execution.
    """
    blank = F.lit("")
    valid = (strip_space(F.coalesce("name", blank)) != "") & (strip_space(F.coalesce("article", blank)) != "")
    asked = questions.select(
        "question_id", valid.alias("__valid"),
        F.when(valid, normalize_name(F.col("name"))).alias(KEYS[0]),
        F.when(valid, normalize_article(F.col("article"))).alias(KEYS[1]),
    )
    single = top_per_group(
        articles.select(*KEYS, "law_name", "text", "enforcement_date").where(F.col("text").isNotNull()),
        KEYS, [F.asc("text")], 1,
    )
    # requests that cannot match anything do not meet in one key
    joined = asked.where("__valid").join(single, KEYS, "left").unionByName(
        asked.where("not __valid"), allowMissingColumns=True
    )
    status = F.when(~F.col("__valid"), "invalid").when(F.col("text").isNull(), "not_found").otherwise("found")
    return joined.withColumn("status", status).drop("__valid")


def seed_golden(cases: DataFrame, articles: DataFrame) -> DataFrame:
    """Case list joined to article text.

    ``cases`` has ``position`` (1-based place in the full list), ``law_name_norm,
    article_number_norm, question, question_type``. Unmatched cases keep a NULL ground truth and
    ``matched`` false; ids count all cases.
    """
    text = top_per_group(
        articles.select(*KEYS, "law_name", F.col("text").alias("article_text")), KEYS,
        [F.col("article_text").asc()], 1,
    )
    joined = keep_first(cases.join(text, KEYS, "left"), "position", F.col("article_text").asc())
    return joined.select(
        F.format_string("GS-%03d", F.col("position")).alias("id"),
        "question_type",
        F.coalesce("law_name", F.col(KEYS[0])).alias("law_name"),
        *KEYS,
        "question",
        strip_space(F.col("article_text")).alias("ground_truth"),
        F.coalesce(F.col("article_text") != "", F.lit(False)).alias("matched"),
    )


def join_case_responses(cases: DataFrame, responses: DataFrame) -> DataFrame:
    """Expectations with the response observed for them, by ``case_id``."""
    return cases.join(responses, "case_id")


def route_lookup(routed: DataFrame, handlers=None) -> DataFrame:
    """Handler of each routed question; unknown tools go to the general one."""
    return routed.withColumn("handler", handler_of(F.col("tool"), handlers))


def resolve_routes(questions: DataFrame, routed: str, labels: DataFrame | None,
                   default: str) -> DataFrame:
    """Fill open routes from a label table (``query, tool``), else with the default.

    Both sides are trimmed and a repeated question keeps its first label, so no row is multiplied.
    Only open questions join by their text; the others are dealt out by their own hash.
    """
    if labels is None:
        return questions.withColumn("tool", F.coalesce(routed, F.lit(default)))
    trimmed = labels.select(strip_space(F.col("query")).alias("__q"), F.col("tool").alias("__label"))
    known = trimmed.groupBy("__q").agg(F.min("__label").alias("__label"))
    open_key = F.when(F.col(routed).isNull(), strip_space(F.col("query")))
    spread = F.coalesce(open_key, F.concat(F.lit("\u0000"), F.xxhash64("query").cast("string")))
    joined = questions.withColumn("__k", spread).join(known, F.col("__k") == F.col("__q"), "left")
    return joined.withColumns({
        "resolved": F.coalesce(routed, "__label").isNotNull(),
        "tool": F.coalesce(routed, "__label", F.lit(default)),
    }).drop("__k", "__q", "__label")


def rejected_requests(questions: DataFrame) -> DataFrame:
    """``reject_reason`` of lookup requests: ``name`` or ``article`` is blank; NULL for valid ones."""
    def blank(column: str):
        return strip_space(F.coalesce(column, F.lit(""))) == ""

    return questions.withColumn(
        "reject_reason", F.when(blank("name"), "name").when(blank("article"), "article")
    )
