"""Rule checks of observed responses, failure classes, retests and scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.articles import any_word
from .conversations import last_tool
from .logs import rate


def _behaviour_holds(text, behaviour):
    chain = F.when(
        behaviour == "scope_explanation",
        F.char_length(text) > rules.SCOPE_EXPLANATION_MIN_CHARS,
    )
    for name, words in rules.BEHAVIOURS.items():
        chain = chain.when(behaviour == name, any_word(text, words))
    return chain.otherwise(F.lit(False))


def check_responses(cases: DataFrame) -> DataFrame:
    """Adds ``failed_checks`` and ``passed``.

    ``cases`` has ``must_contain`` and ``expected_article`` (string arrays), ``expected_source``,
    ``expected_behaviour`` (each NULL when not asked for), ``response_text`` and
    ``response_source``. A case without checks passes.
    """
    text = F.coalesce("response_text", F.lit(""))
    behaviour = F.col("expected_behaviour")
    contained = F.forall("must_contain", lambda w: text.contains(w))
    same_source = F.col("response_source").eqNullSafe(F.col("expected_source"))
    cited = F.exists("expected_article", lambda w: text.contains(w))
    failed = F.array_compact(F.array(
        F.when(F.col("must_contain").isNotNull() & ~contained, "must_contain"),
        F.when(F.col("expected_source").isNotNull() & ~same_source, "expected_source"),
        F.when(F.col("expected_article").isNotNull() & ~cited, "expected_article"),
        F.when(behaviour.isNotNull() & ~_behaviour_holds(text, behaviour),
               F.concat(F.lit("behavior:"), behaviour)),
    ))
    return cases.withColumn("failed_checks", failed).withColumn(
        "passed", F.size("failed_checks") == 0
    )


def classify_failures(checked: DataFrame) -> DataFrame:
    """Adds ``failure_class``; NULL for passed cases."""
    failed = F.col("failed_checks")
    got, wanted = F.col("response_source"), F.col("expected_source")
    web_mixed_up = (wanted == "web") | got.eqNullSafe(F.lit("web"))
    conditional = F.array(*[F.lit(f"behavior:{b}") for b in rules.CONDITIONAL_BEHAVIOURS])
    label = (
        F.when(F.col("passed"), F.lit(None).cast("string"))
        .when(F.array_contains(failed, "expected_source") & web_mixed_up, "fallback_error")
        .when(F.array_contains(failed, "behavior:not_exist"), "hallucination")
        .when(F.array_contains(failed, "expected_article"), "wrong_law_selection")
        .when(F.arrays_overlap(failed, conditional), "intent_error")
        .otherwise("output_error")
    )
    return checked.withColumn("failure_class", label)


def pass_rate_by_type(checked: DataFrame) -> DataFrame:
    """Passed, total and percent per question type."""
    passed, total = F.count_if("passed"), F.count(F.lit(1))
    return checked.groupBy("type").agg(
        passed.alias("passed"), total.alias("total"),
        F.bround(passed / total * 100, 0).alias("percent"),
    )


def failure_classes(classified: DataFrame) -> DataFrame:
    """Failures per class, most frequent first."""
    failed = classified.where(~F.col("passed"))
    return failed.groupBy("failure_class").agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), "failure_class"
    )


def retest(failures: DataFrame, responses: DataFrame) -> DataFrame:
    """Earlier failures against new responses.

    ``failures`` has ``case_id, query, failure_reason``; ``responses`` has ``case_id, text,
    fallback, articles, error``. Failures with an empty query are not retested: ``improved`` is
    NULL for them.
    """
    joined = failures.join(responses, "case_id", "left")
    length = F.char_length(F.coalesce("text", F.lit("")))
    fallback = F.coalesce("fallback", F.lit(False))
    reason = F.coalesce("failure_reason", F.lit(""))
    has_articles = F.coalesce(F.size("articles") > 0, F.lit(False))
    tried = (F.coalesce("query", F.lit("")) != "") & F.col("text").isNotNull()
    improved = (
        F.when(~tried, F.lit(None).cast("boolean"))
        .when(F.coalesce("error", F.lit("")) != "", False)
        .when(length < 50, False)
        .when(reason.contains("fallback_used") & ~fallback, True)
        .when(reason.contains("no_articles") & has_articles, True)
        .otherwise((length > 200) & ~fallback)
    )
    return joined.withColumn("improved", improved)


def improvement_rate(retested: DataFrame) -> DataFrame:
    """Improved share of all failures, those without a query included."""
    total, improved = F.count(F.lit(1)), F.count_if("improved")
    return retested.agg(
        total.alias("total_retested"), improved.alias("improved"),
        F.count_if(~F.col("improved")).alias("still_failing"),
        rate(improved, total).alias("improvement_rate"),
    )


def check_scenarios(scenarios: DataFrame, turns: DataFrame,
                    preview_chars: int | None = None) -> DataFrame:
    """Last answer and last tool of each scenario's session against its expectations.

    ``scenarios`` has ``scenario_id, session_id, expect_any`` (array), ``expect_tool``,
    ``forbid_tool``; each expectation may be NULL. ``answer_preview`` is the answer, cut to
    ``preview_chars`` characters where that is given.
    """
    answers = turns.groupBy("session_id").agg(
        F.max_by("content", F.when(F.col("role") == "assistant", F.col("id"))).alias("answer")
    )
    joined = scenarios.join(answers, "session_id", "left").join(
        last_tool(turns), "session_id", "left"
    )
    answer, tool = F.coalesce("answer", F.lit("")), F.coalesce("tool", F.lit(""))
    said = F.exists("expect_any", lambda w: answer.contains(w))
    wanted = F.coalesce("expect_tool", F.lit(""))
    failures = F.array_compact(F.array(
        F.when(F.col("expect_any").isNotNull() & ~said, "expect_any"),
        F.when((wanted != "") & (tool != wanted), "expect_tool"),
        F.when(F.coalesce(F.nullif("forbid_tool", F.lit("")) == tool, F.lit(False)), "forbid_tool"),
    ))
    return joined.select(
        "scenario_id", failures.alias("failures"), (F.size(failures) == 0).alias("ok"),
        (answer if preview_chars is None else F.substring(answer, 1, preview_chars)).alias(
            "answer_preview"),
    )
