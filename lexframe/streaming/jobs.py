"""Structured Streaming jobs over logs, requests, chunks, questions, documents and results."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from .. import rules
from ..functions import normalize_name
from ..operators.conversations import append_turns, citation_rows, drop_empty_answers
from ..operators.corpus import KEYS
from ..operators.logs import flag_failures
from ..operators.lookup import resolve_routes
from ..plans.routing import apply_rules
from ..plans.sync import sync_corpus
from ..session import discard, pin, pin_at, scratch, scratch_path
from ..sources.logs import log_rows, parse_log_lines
from ..sources.parts import PARTS, part_of, read_parts, replace_parts
from ..sources.schemas import ARTICLES, POINTS


def append_to(stream: DataFrame, path: str, checkpoint: str, once: bool = True,
              partition_by=()) -> StreamingQuery:
    """Append a stream to Parquet files; ``once`` takes what is there and stops."""
    writer = stream.writeStream.format("parquet").outputMode("append").option(
        "checkpointLocation", checkpoint
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer = writer.trigger(availableNow=True) if once else writer
    return writer.start(path)


def stream_qa_log(spark: SparkSession, path: str) -> DataFrame:
    """Log rows as they arrive, with failure flag and reason."""
    return flag_failures(parse_log_lines(spark.readStream.text(path)))


def stream_metrics(requests: DataFrame, window: str = "1 minute",
                   delay: str = "10 minutes") -> DataFrame:
    """Request counters and latency buckets per event-time window; rows later than ``delay`` are
    dropped."""
    buckets = [
        F.count_if(F.col("duration") <= b).alias("le_" + str(b).replace(".", "_"))
        for b in rules.LATENCY_BUCKETS
    ]
    grouped = requests.withWatermark("started_at", delay).groupBy(
        F.window("started_at", window).alias("w"), "endpoint", "agent_type"
    )
    return grouped.agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.sum("duration").alias("duration_sum"),
        *buckets,
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
             "endpoint", "agent_type", "requests", "errors", "duration_sum",
             *["le_" + str(b).replace(".", "_") for b in rules.LATENCY_BUCKETS])


_ANSWER = (
    "request_id string, answer string, status string, sources string, saved_id string, "
    "fallback boolean, events bigint, meta string"
)
_META = (
    "tool string, query_type string, selected_source string, selected_articles array<string>, fallback_used boolean, "
    "confidence_score double, citations array<struct<law_name string, article_number string, score double, rank int>>"
)
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STORE_KEY = "spark.sql.streaming.stateStore.providerClass"


def _assembled(request_id: str, chunks: list, status: str) -> dict:
    chunks = sorted(chunks)
    fallback = any(
        event == "status" and "Web" in p and "fallback" in p.lower() for _, event, p in chunks
    )
    sources = saved = meta = None
    for _, event, payload in chunks:
        if event == "saved":
            saved = payload
        elif event == "meta":
            meta = payload
        elif event == "source" and payload.startswith("{"):
            try:
                laws = json.loads(payload).get("retrieved_laws")
            except ValueError:  # a payload that is no JSON names no sources
                laws = None
            if laws is not None:
                sources = json.dumps(laws, ensure_ascii=False, separators=(",", ":"))
        elif event == "source" and "web" in payload.lower():
            fallback = True
    return {
        "request_id": request_id, "answer": "".join(p for _, event, p in chunks if event == "text"),
        "status": status, "sources": sources, "saved_id": saved, "fallback": fallback,
        "events": len(chunks), "meta": meta,
    }


def _whole(chunks: list, end: int) -> bool:
    """Nothing numbered up to the terminal event is missing."""
    return {seq for seq, _, _ in chunks}.issuperset(range(end + 1))


class _Assembler(StatefulProcessor):
    """Chunks of a request as list state, appended to and read once they can be whole; an event-time timer ends it.

    Every call on the state is a round trip of its own, so a request that one batch brings whole makes three: its progress
    is asked for and set, and its timer registered. The time of the timer is part of the progress, as listing timers costs
    far more than any other call.
    """

    def __init__(self, timeout_ms: int, terminal: str):
        self.timeout_ms, self.terminal = timeout_ms, terminal

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getListState("chunks", "seq bigint, event string, payload string")
        self.progress = handle.getValueState("progress", "held bigint, ends bigint, done boolean, timer bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held, ends, done, timer = self.progress.get() or (0, -1, False, None)
        stored, latest, new = held > 0 and not done, 0, []
        for row in rows:
            latest = max(latest, row["at_ms"])
            if not done:
                new.append((row["seq"], row["event"], row["payload"]))
                if row["event"] == self.terminal and (ends < 0 or row["seq"] < ends):
                    ends = row["seq"]
        held += len(new)
        if not done and 0 <= ends < held:
            chunks = [tuple(c) for c in self.chunks.get()] + new if stored else new
            if _whole(chunks, ends):
                yield Row(**_assembled(key[0], chunks, "complete"))
                done = True
                if stored:
                    self.chunks.clear()
        if new and not done:
            self.chunks.appendList(new)
        due = max(latest, timerValues.getCurrentWatermarkInMs()) + self.timeout_ms
        if timer != due:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.progress.update((held, ends, done, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        progress = self.progress.get()
        done = progress is None or progress[2]
        chunks = [] if done else [tuple(c) for c in self.chunks.get()]
        self.chunks.clear()
        self.progress.clear()
        if not done:
            yield Row(**_assembled(key[0], chunks, "incomplete"))

    def close(self) -> None:
        pass


def ended_requests(chunks: DataFrame, delay: str = "1 minute", timeout_ms: int = 300_000,
                   terminal: str = "saved") -> DataFrame:
    """One row per request that has ended: ``complete`` when the terminal event and all chunks before it
    (``seq`` counts from 0) are there, ``incomplete`` when ``timeout_ms`` of event time pass without that.

    Chunks without request, number or time are dropped. The list state and timers need Spark's RocksDB state
    store, which is set here where the session still has the default one.
    """
    spark = chunks.sparkSession
    if "RocksDB" not in spark.conf.get(_STORE_KEY):
        spark.conf.set(_STORE_KEY, _STORE)
    usable = F.col("request_id").isNotNull() & F.col("seq").isNotNull() & F.col("at").isNotNull()
    kept = chunks.where(usable).select(
        "request_id", "seq", F.coalesce("event", F.lit("")).alias("event"),
        F.coalesce("payload", F.lit("")).alias("payload"), "at", F.unix_millis("at").alias("at_ms"),
    ).withWatermark("at", delay)
    return kept.groupBy("request_id").transformWithState(
        statefulProcessor=_Assembler(timeout_ms, terminal), outputStructType=_ANSWER,
        outputMode="Append", timeMode="EventTime",
    )


def stream_answers(chunks: DataFrame, delay: str = "1 minute", timeout_ms: int = 300_000,
                   terminal: str = "saved") -> DataFrame:
    """Answers put together from chunks, once per request (see :func:`ended_requests`). Empty answers are skipped."""
    return drop_empty_answers(ended_requests(chunks, delay, timeout_ms, terminal)).drop("meta")


def store_answers(ended: DataFrame, requests: DataFrame, root: str, checkpoint: str,
                  default_session: str = "default_session", query_chars: int | None = None) -> StreamingQuery:
    """Store ended requests as turns, citations and log rows, all in one ``foreachBatch``.

    ``ended`` comes from :func:`ended_requests`, ``requests`` is a table of ``request_id, session_id, user_id, question,
    asked_at``. An answer's two turns and the citations of its meta chunk are stored unless it is empty; every
    request with a meta chunk is logged. A batch writes folders of its own under ``root/turns``, ``root/citations`` and
    ``root/log``; repeated after a failure it replaces them, so nothing is stored twice.
    """
    def take(batch: DataFrame, batch_id: int) -> None:
        known = pin(batch.join(requests, "request_id").withColumn("m", F.from_json("meta", _META)), "ended")
        answered = known.withColumn("tool", F.coalesce("m.tool", F.lit(rules.DEFAULT_TOOL)))
        cited = drop_empty_answers(answered).select(
            F.col("request_id").alias("chat_history_id"), F.col("m.citations").alias("citations"))
        logged = answered.where(F.col("m").isNotNull()).select(
            "request_id", F.col("asked_at").alias("ts"), "tool", F.col("question").alias("query"),
            *[F.col(f"m.{c}").alias(c) for c in ("query_type", "selected_source", "selected_articles")],
            F.coalesce("m.fallback_used", F.lit(False)).alias("fallback_used"), "m.confidence_score",
        )
        for name, rows in (
            ("turns", append_turns(answered, default_session, keep=("request_id",))),
            ("citations", citation_rows(cited)), ("log", log_rows(logged, query_chars, keep=("request_id",))),
        ):
            rows.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")

    writer = ended.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def stream_route(questions: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Route arriving questions by rule, then by a static label table. ``resolved`` is false for
    those that neither decides; they carry the default tool and can be set aside."""
    ruled = apply_rules(questions)
    if labels is None:
        ruled = ruled.withColumn("resolved", F.col("rule_tool").isNotNull())
    return resolve_routes(ruled, "rule_tool", labels, rules.DEFAULT_TOOL)


def unresolved(routed: DataFrame) -> DataFrame:
    """Questions that neither a rule nor a label decided, for a side table."""
    return routed.where(~F.col("resolved")).drop("tool")


def stream_dedup(results: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """First result per key within the watermark; empty keys are dropped."""
    present = results.where(F.coalesce(F.col(key), F.lit("")) != "")
    return present.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def stream_sync(documents: DataFrame, root: str, checkpoint: str, now: Column, embed=None,
                parts: int = PARTS) -> StreamingQuery:
    """Take arriving documents into the article table under ``root/articles``.

    The table is dealt into ``parts`` by the hash of the law; a batch reads and replaces the parts of its laws only. With
    ``embed`` (see :func:`sync_corpus`) the vector table under ``root/points`` follows, and a reconciliation of those parts
    is kept under ``root/report``. Taking the same documents in again gives the same rows, so a batch that is repeated
    after a failure changes nothing; ``parts`` must not change over the life of a table. What a batch writes on its way is
    deleted as soon as it is not read any more.
    """
    law = KEYS[0]

    def take(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with scratch(spark):
            path = scratch_path(spark, "arrived")
            batch = pin_at(batch, path, "zstd")
            numbers = batch.select(part_of(normalize_name(F.col("law_name")), parts).alias("part")).distinct()
            wanted = sorted(r["part"] for r in numbers.collect())  # ``parts`` numbers at most

            def stored(name: str, schema: str) -> DataFrame:
                return read_parts(spark, f"{root}/{name}", schema, wanted)

            points = stored("points", POINTS) if embed else None
            result = sync_corpus(stored("articles", ARTICLES), batch, now, points, embed)
            result.quarantine.write.mode("overwrite").parquet(f"{root}/quarantine/batch={batch_id}")
            discard(spark, path)  # the articles were taken out of it and are written
            if embed:
                result.report.write.mode("overwrite").parquet(f"{root}/report/batch={batch_id}")
                replace_parts(result.points, f"{root}/points", law, parts)
            replace_parts(result.articles, f"{root}/articles", law, parts)

    writer = documents.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
