"""Verdicts, failure flags and the source of an answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .articles import any_word

_VERDICTS = {
    "grounding": (["GROUNDED", "PARTIAL", "HALLUCINATION"], "GROUNDED"),
    "relevance": (["RELEVANT", "NOT_RELEVANT"], "RELEVANT"),
}


def coerce_verdict(column: Column, kind: str = "grounding", offline: bool = False) -> Column:
    """Verdict of a judge's JSON reply.

    Online, a reply that cannot be used counts as the accepting verdict. Offline, a reply that
    is no JSON is an ERROR and any verdict is kept as given.
    """
    allowed, accepting = _VERDICTS[kind]
    verdict = F.get_json_object(column, "$.verdict")
    if offline:
        return F.coalesce(verdict, F.lit("ERROR"))
    return F.when(verdict.isin(allowed), verdict).otherwise(F.lit(accepting))


def next_action(verdict: Column, relevance: Column, retries: Column) -> Column:
    """Next step of an attempt: end, retrieve again, or fall back to web search."""
    grounded = F.coalesce(verdict, F.lit("GROUNDED")).isin("GROUNDED", "PARTIAL")
    return (
        F.when(grounded & relevance.isNull(), "grade_relevance")
        .when(grounded & (relevance == "RELEVANT"), "end")
        .when(~grounded & (retries < 2), "retrieve")
        .otherwise("websearch_fallback")
    )


def _no_articles(articles: Column) -> Column:
    return F.coalesce(F.size(articles) <= 0, F.lit(True)) | articles.isNull()


def is_failure(fallback: Column, score: Column, articles: Column,
               minimum: float = rules.CONFIDENCE_MIN) -> Column:
    low = score.isNull() | (score < minimum)
    return F.coalesce(fallback, F.lit(False)) | low | _no_articles(articles)


def failure_reason(fallback: Column, score: Column, articles: Column,
                   minimum: float = rules.CONFIDENCE_MIN) -> Column:
    reasons = F.array(
        F.when(F.coalesce(fallback, F.lit(False)), F.lit("fallback_used")),
        F.when(score.isNull(), F.lit("confidence_null")).when(
            score < minimum, F.format_string("low_confidence(%s)", three_digits(score))
        ),
        F.when(_no_articles(articles), F.lit("no_articles")),
    )
    text = F.array_join(F.array_compact(reasons), " | ")
    return F.when(text == "", "unknown").otherwise(text)


def three_digits(score: Column) -> Column:
    """Half-even rounding to three digits, as text."""
    return F.bround(score, 3).cast("decimal(20,3)").cast("string")


def source_of_event(payload: Column) -> Column:
    """Store named by one ``source`` payload; NULL where it names none."""
    is_object = payload.startswith("{")
    url = F.get_json_object(payload, "$.law_url")
    laws = F.get_json_object(payload, "$.retrieved_laws")
    return (
        F.when(is_object & (F.coalesce(url, F.lit("")) != ""), "pg")
        .when(is_object & ~F.coalesce(laws, F.lit("[]")).isin("[]", "", "{}"), "qdrant")
        .when(~is_object & F.lower(payload).contains("web"), "web")
    )


def infer_source(stated: Column, answer: Column) -> Column:
    """The stated source, else web when the answer reads like a web answer, else pg."""
    guessed = F.when(any_word(answer, rules.WEB_ANSWER_WORDS), "web").otherwise("pg")
    return F.coalesce(stated, guessed)
