"""Streaming jobs run over the test tables until nothing is left, read back from their sink."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexframe import rules
from lexframe.session import scratch_path
from lexframe.operators.vectors import vectorize
from lexframe.sources.parts import read_parts
from lexframe.sources.schemas import ARTICLES, POINTS
from lexframe.streaming import jobs

from .answers import chunks
from .common import load
from .documents import ORACLES as DOCUMENT_SQL
from .documents import statutes
from .logs import REQUESTS_SQL, requests
from .registry import registry
from .routing import ORACLES as ROUTING_SQL
from .routing import questions

QUERIES, ORACLES, query = registry()


def _stream(spark, df, name):
    """The rows of a table as a file stream."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def _drained(spark, stream, name):
    """Run a stream to its end into files and read them back."""
    path = scratch_path(spark, name)
    jobs.append_to(stream, path, scratch_path(spark, name + "-checkpoint")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


_BUCKETS = ", ".join(
    f"count(*) FILTER (WHERE duration <= {b}) AS le_{str(b).replace('.', '_')}"
    for b in rules.LATENCY_BUCKETS
)


@query(f"""WITH {REQUESTS_SQL}, windows AS (SELECT *, date_trunc('hour', started_at) AS window_start
  FROM requests)
SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, endpoint, agent_type,
  count(*) AS requests, count(*) FILTER (WHERE status = 'error') AS errors,
  round_even(sum(duration), 4) AS duration_sum, {_BUCKETS} FROM windows
GROUP BY window_start, endpoint, agent_type""")
def stream_metrics(spark, sf_dir):
    arriving = requests(spark, sf_dir).withColumn("started_at", F.col("started_at").cast("timestamp"))
    # a later row closes the last windows; its own stays open
    later = arriving.groupBy().agg(F.max("started_at").alias("last")).select(
        *[(F.col("last") + F.expr("INTERVAL 1 DAY") if c == "started_at" else F.lit(None).cast(t)).alias(c)
          for c, t in arriving.dtypes]
    )
    ended = _stream(spark, arriving.unionByName(later), "requests")
    metrics = jobs.stream_metrics(ended, "1 hour", "10 minutes")
    rows = _drained(spark, metrics, "metrics")
    return rows.drop("window_end").withColumns({
        "window_start": F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"),
        "duration_sum": F.bround("duration_sum", 4),
    })


@query("""SELECT event_id, event_type = 'error' OR value / 500 < 0.7 AS is_failure,
  coalesce(nullif(concat_ws(' | ', CASE WHEN event_type = 'error' THEN 'fallback_used' END,
    CASE WHEN round_even(value / 500, 4) < 0.7 THEN printf('low_confidence(%.3f)',
      round_even(round_even(value / 500, 4), 3)) END), ''), 'unknown') AS failure_reason
FROM events""")
def stream_qa_log(spark, sf_dir):
    log = load(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("query"), F.col("event_type").alias("tool"),
        F.array("props").alias("selected_articles"),
        (F.col("event_type") == "error").alias("fallback_used"),
        F.bround(F.col("value") / 500, 4).alias("confidence_score"),
    )
    lines = log.select(F.to_json(F.struct("*")).alias("value"))
    noise = load(spark, sf_dir, "events").select(F.lit("{broken").alias("value"))
    path = scratch_path(spark, "qa-log")
    lines.unionByName(noise).write.text(path)
    flagged = _drained(spark, jobs.stream_qa_log(spark, path), "flagged")
    return flagged.select(F.col("query").cast("bigint").alias("event_id"), "is_failure",
                          "failure_reason")


_BLANK = "trim(text, ' ' || chr(9) || chr(10) || chr(13)) = ''"


def _chunk_stream(spark, sf_dir):
    """Every document as a streamed answer of 500 characters a chunk; a meta chunk names its source as citation."""
    cited = F.struct(F.col("source").alias("law_name"), F.col("doc_id").cast("string").alias("article_number"),
                     F.lit(0.5).alias("score"), F.lit(1).alias("rank"))
    meta = F.to_json(F.struct(
        F.concat("lang", F.lit("_tool")).alias("tool"), F.lit("semantic").alias("query_type"), F.col("source").alias("selected_source"),
        F.array("source", "lang").alias("selected_articles"), (F.col("lang") == "de").alias("fallback_used"),
        (F.col("doc_id") % 100 / 100).alias("confidence_score"), F.array(cited, cited).alias("citations"),
    ))
    metas = load(spark, sf_dir, "documents").where("lang <> 'es'").select(
        F.col("doc_id").alias("request_id"), F.lit(999_999).alias("seq"), F.lit("meta").alias("event"), meta.alias("payload"))
    number = F.row_number().over(Window.partitionBy("request_id").orderBy("seq")) - 1
    parts = chunks(spark, sf_dir, 500).unionByName(metas).withColumn("seq", number)
    at = F.timestamp_millis(F.lit(1704067200000) + F.col("seq") % 1000)
    timed = parts.select(
        F.col("request_id").cast("string").alias("request_id"),
        F.col("seq").cast("bigint").alias("seq"), "event", "payload", at.alias("at"),
    )
    noise = timed.select("request_id", F.lit(None).cast("bigint").alias("seq"), "event", F.lit("?").alias("payload"), "at")
    return _stream(spark, timed.unionByName(noise), "chunks")


@query(f"""SELECT CAST(doc_id AS VARCHAR) AS request_id, text AS answer, 'complete' AS status,
  CAST(ceil(length(text) / 500) AS BIGINT) + CASE WHEN lang <> 'es' THEN 4 ELSE 3 END AS events, lang IN ('de', 'fr') AS fallback,
  CASE WHEN lang <> 'fr' THEN '[{{"law_name":"' || source || '"}}]' END AS sources,
  CAST(doc_id AS VARCHAR) AS saved_id FROM documents WHERE NOT {_BLANK}""")
def stream_answers(spark, sf_dir):
    return _drained(spark, jobs.stream_answers(_chunk_stream(spark, sf_dir)), "answers")


def _stored(spark, sf_dir, name):
    """One of the tables that streamed answers are stored in."""
    asked = load(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("request_id"), F.concat(F.lit("s"), F.col("doc_id") % 10).alias("session_id"),
        F.lit("u").alias("user_id"), F.concat(F.lit("질문 "), "doc_id").alias("question"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 10).alias("asked_at"),
    )
    root = scratch_path(spark, "stored")
    ended = jobs.ended_requests(_chunk_stream(spark, sf_dir))
    jobs.store_answers(ended, asked, root, scratch_path(spark, "stored-checkpoint")).awaitTermination()
    return spark.read.parquet(f"{root}/{name}")


@query(f"""WITH stored AS (SELECT CAST(doc_id AS VARCHAR) AS request_id, 's' || doc_id % 10 AS session_id,
    '{{"tool":"' || CASE WHEN lang = 'es' THEN 'law' ELSE lang END || '"}}' AS metadata, CAST(least(10 * len(regexp_extract_all(text, '「.*?」'))
    + 5 * len(regexp_extract_all(text, '제[0-9]+조')) + 35, 100) AS INTEGER) AS score, 1704067200 + doc_id * 10 AS asked, doc_id, text
  FROM documents WHERE NOT {_BLANK})
SELECT request_id, session_id, metadata, score, asked AS turn_index, 'user' AS role, '질문 ' || doc_id AS content FROM stored
UNION ALL SELECT request_id, session_id, metadata, score, asked + 1, 'assistant', text FROM stored""")
def stream_stored_turns(spark, sf_dir):
    return _stored(spark, sf_dir, "turns").select(
        "request_id", "session_id", "metadata", "score", "turn_index", "role", "content")


@query(f"""SELECT CAST(doc_id AS VARCHAR) AS request_id, source AS law_name, CAST(doc_id AS VARCHAR) AS article_number,
  CAST(0.5 AS DOUBLE) AS score, 1 AS rank FROM documents, range(2) WHERE lang <> 'es' AND NOT {_BLANK}""")
def stream_stored_citations(spark, sf_dir):
    rows = _stored(spark, sf_dir, "citations")
    return rows.select(F.col("chat_history_id").alias("request_id"), "law_name", "article_number", "score", "rank")


@query("""SELECT CAST(doc_id AS VARCHAR) AS request_id, lang || '_tool' AS tool, '질문 ' || doc_id AS query, 'semantic' AS query_type,
  source AS selected_source, source || ',' || lang AS articles, lang = 'de' AS fallback_used,
  nullif(round_even(doc_id % 100 / 100, 4), 0) AS confidence_score FROM documents WHERE lang <> 'es'""")
def stream_stored_log(spark, sf_dir):
    return _stored(spark, sf_dir, "log").select(
        "request_id", "tool", "query", "query_type", "selected_source", F.array_join("selected_articles", ",").alias("articles"),
        "fallback_used", "confidence_score")


@query(ROUTING_SQL["route_questions"].rsplit("SELECT conv_id", 1)[0] + """
SELECT conv_id, turn, coalesce(rule_tool, 'law_rag_tool') AS tool,
  rule_tool IS NOT NULL AS resolved FROM ruled""")
def stream_route(spark, sf_dir):
    arriving = _stream(spark, questions(spark, sf_dir), "questions")
    routed = _drained(spark, jobs.stream_route(arriving), "routed")
    return routed.select("conv_id", "turn", "tool", "resolved")


@query("""SELECT DISTINCT regexp_replace(url, '[?#].*$', '') AS link FROM pages""")
def stream_dedup(spark, sf_dir):
    twice = load(spark, sf_dir, "pages").select(
        F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"),
        F.regexp_replace("url", "[?#].*$", "").alias("link"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("page_id")).alias("seen_at"),
    )
    results = _stream(spark, twice, "results")
    kept = jobs.stream_dedup(results, "link", "seen_at", "30 days")
    return _drained(spark, kept, "links").select("link")


@query(DOCUMENT_SQL["extract_articles"].rsplit("SELECT law_name_norm", 1)[0]
       + "SELECT law_name_norm, article_number_norm, text FROM articles")
def stream_sync(spark, sf_dir):
    """Articles after statutes arrived as files in one folder."""
    root, inbox = scratch_path(spark, "corpus"), scratch_path(spark, "inbox")
    statutes(spark, sf_dir).write.parquet(inbox)
    arriving = spark.readStream.schema("law_name string, doc string").parquet(inbox)
    now = F.lit("2026-01-01").cast("timestamp_ntz")
    jobs.stream_sync(arriving, root, scratch_path(spark, "sync-checkpoint"), now).awaitTermination()
    synced = read_parts(spark, f"{root}/articles", ARTICLES)
    return synced.select("law_name_norm", "article_number_norm", "text")


@query(ROUTING_SQL["route_questions"].rsplit("SELECT conv_id", 1)[0] + """
SELECT conv_id, turn, query FROM ruled WHERE rule_tool IS NULL""")
def stream_unresolved(spark, sf_dir):
    """The side table of questions that no rule decides."""
    arriving = _stream(spark, questions(spark, sf_dir), "questions")
    open_ones = _drained(spark, jobs.unresolved(jobs.stream_route(arriving)), "unresolved")
    return open_ones.select("conv_id", "turn", "query")


@query(DOCUMENT_SQL["extract_articles"].rsplit("SELECT law_name_norm", 1)[0]
       + """SELECT law_name_norm, article_number_norm, text, 32 AS dims, true AS unit FROM articles""")
def stream_sync_vectors(spark, sf_dir):
    """The vector table that follows the articles: unit term vectors of their texts."""
    root, inbox = scratch_path(spark, "corpus"), scratch_path(spark, "inbox")
    statutes(spark, sf_dir).write.option("compression", "zstd").parquet(inbox)
    arriving = spark.readStream.schema("law_name string, doc string").parquet(inbox)
    now = F.lit("2026-01-01").cast("timestamp_ntz")

    def embed(articles):
        return vectorize(articles, "text", 32)

    jobs.stream_sync(arriving, root, scratch_path(spark, "sync-checkpoint"), now, embed).awaitTermination()
    points = read_parts(spark, f"{root}/points", POINTS)
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    unit = (F.abs(norm - 1) < 1e-3) | (norm == 0)
    return points.select("law_name_norm", "article_number_norm", "text", F.size("embedding").alias("dims"), unit.alias("unit"))
