"""Routing of a table of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import route_question, squeeze
from ..operators.lookup import resolve_routes, route_lookup


def route_questions(questions: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Adds ``rule_tool`` (NULL where no rule decides), ``tool`` and ``handler`` to questions.

    Open questions take their tool from ``labels`` (``query, tool``), else the default. Only the
    question itself is read; earlier turns are passed on as context, never tested.
    """
    ruled = apply_rules(questions)
    return route_lookup(resolve_routes(ruled, "rule_tool", labels, rules.DEFAULT_TOOL))


def apply_rules(questions: DataFrame) -> DataFrame:
    """Adds ``rule_tool``. The squeezed text is a column, so it is computed once per question."""
    squeezed = questions.withColumn("__squeezed", squeeze(F.col("query")))
    rule = route_question(F.col("query"), F.col("__squeezed"))
    return squeezed.withColumn("rule_tool", rule).drop("__squeezed")
