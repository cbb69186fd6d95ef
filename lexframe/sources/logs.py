"""Request logs and streamed event lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strip_space
from .schemas import QA_LOG


def parse_log_lines(lines: DataFrame) -> DataFrame:
    """Log rows from text lines (``value``); blank and malformed lines are dropped."""
    text = strip_space(F.col("value"))
    valid = text.startswith("{") & F.try_parse_json(text).isNotNull()
    return lines.where(valid).select(F.from_json("value", QA_LOG).alias("r")).select("r.*")


def read_qa_log(spark: SparkSession, path: str) -> DataFrame:
    """All log files under a path or glob."""
    return parse_log_lines(spark.read.text(path, recursiveFileLookup=True))


def log_rows(requests: DataFrame, query_chars: int | None = None, keep=()) -> DataFrame:
    """Requests as they are logged: score rounded, 0 as NULL, the query cut to ``query_chars``
    characters where that is given (300 in the service). The columns named in ``keep`` are passed on."""
    asked = F.col("query") if query_chars is None else F.substring("query", 1, query_chars)
    score = F.col("confidence_score")
    return requests.select(
        *keep,
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"),
        "tool",
        asked.alias("query"),
        "query_type", "selected_source", "selected_articles", "fallback_used",
        F.when(score != 0, F.bround(score, 4)).alias("confidence_score"),
        F.date_format("ts", "yyyyMMdd").alias("day"),
    )


def write_qa_log(requests: DataFrame, path: str, query_chars: int | None = None) -> None:
    """Append to the log, one set of files per day."""
    log_rows(requests, query_chars).write.partitionBy("day").mode("append").json(path)


def parse_event_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Adds ``event`` and ``payload`` to wire lines (``data: {...}``); noise lines are dropped.

    A payload that is an object or a list is kept as its JSON text; a missing one is empty.
    """
    text = strip_space(F.col(column))
    body = strip_space(F.regexp_replace(text, "^data:", ""))
    parsed = lines.withColumn("__body", body).where(
        F.col("__body").startswith("{") & F.try_parse_json("__body").isNotNull()
    )
    return parsed.withColumns({"event": _event_name(), "payload": _payload()}).drop("__body")


def _event_name() -> Column:
    event = F.nullif(F.get_json_object("__body", "$.event"), F.lit(""))
    return F.coalesce(event, F.get_json_object("__body", "$.type"), F.lit(""))


def _payload() -> Column:
    return F.coalesce(F.get_json_object("__body", "$.payload"), F.lit(""))
