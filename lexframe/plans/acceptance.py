"""Acceptance of graded answer attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import coerce_verdict, next_action


def acceptance_gate(attempts: DataFrame) -> DataFrame:
    """Outcome per question from its attempts (``question_id, attempt, grounding_reply,
    relevance_reply``): action of the last attempt, tool of the final answer, attempts made."""
    graded = attempts.select(
        "question_id", "attempt",
        next_action(
            coerce_verdict(F.col("grounding_reply")),
            coerce_verdict(F.col("relevance_reply"), "relevance"),
            F.col("attempt"),
        ).alias("action"),
    )
    last = graded.groupBy("question_id").agg(
        F.max_by("action", "attempt").alias("action"), F.max("attempt").alias("retry_count")
    )
    tool = F.when(F.col("action") == "websearch_fallback", "websearch_tool")
    return last.withColumn("final_tool", tool.otherwise("law_rag_tool"))
