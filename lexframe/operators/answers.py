"""Streamed answers: cutting texts into chunks and putting chunks back together.

Chunks have ``request_id, seq, event, payload, at``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import source_of_event

BLOCK = 1024


def chunk_text(df: DataFrame, column: str = "text", size: int = 20) -> DataFrame:
    """Consecutive slices of ``size`` characters with their number; empty texts give none."""
    slices = F.regexp_extract_all(column, F.lit(f"(?s).{{1,{size}}}"), 0)
    kept = [c for c in df.columns if c != column]
    return df.select(*kept, F.posexplode(slices).alias("seq", "chunk"))


def _fallback(event, payload):
    web_status = (event == "status") & payload.contains("Web") & F.lower(payload).contains(
        "fallback"
    )
    web_source = (event == "source") & source_of_event(payload).eqNullSafe(F.lit("web"))
    return F.coalesce(web_status | web_source, F.lit(False))


def assemble_answer(chunks: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per request: text in order, last sources, stored id, fallback flag, event counts.

    Texts are joined per block of ``block`` chunks first, so a very long answer is put together
    by many tasks before its few blocks meet.
    """
    event, payload, seq = F.col("event"), F.col("payload"), F.col("seq")
    laws = F.get_json_object(payload, "$.retrieved_laws")
    stated = source_of_event(payload)
    pieces = F.sort_array(F.collect_list(F.when(event == "text", F.struct("seq", "payload"))))
    partial = chunks.groupBy("request_id", F.floor(seq / block).alias("block")).agg(
        F.array_join(F.transform(pieces, lambda p: p["payload"]), "").alias("text"),
        F.count(F.lit(1)).alias("events"),
        F.count_if(event == "text").alias("text_events"),
        F.count_if(event == "error").alias("errors"),
        F.bool_or(_fallback(event, payload)).alias("fallback"),
        _last(laws, event == "source", seq).alias("laws"),
        _last(stated, event == "source", seq).alias("source"),
        _last(payload, event == "saved", seq).alias("saved_id"),
    )
    blocks = F.sort_array(F.collect_list(F.struct("block", "text")))
    return partial.groupBy("request_id").agg(
        F.array_join(F.transform(blocks, lambda b: b["text"]), "").alias("answer"),
        F.sum("events").alias("events"),
        F.sum("text_events").alias("text_events"),
        F.sum("errors").alias("errors"),
        F.bool_or("fallback").alias("fallback"),
        F.max_by("laws", F.when(F.col("laws").isNotNull(), F.col("block"))).alias("sources"),
        F.max_by("source", F.when(F.col("source").isNotNull(), F.col("block"))).alias("source"),
        F.max_by("saved_id", F.when(F.col("saved_id").isNotNull(), F.col("block"))).alias(
            "saved_id"
        ),
    )


def _last(value, where, seq):
    return F.max_by(value, F.when(where & value.isNotNull(), seq))
