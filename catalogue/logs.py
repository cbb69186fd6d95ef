"""Log reports, percentiles and service metrics over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexframe import rules
from lexframe.operators import logs as ops
from lexframe.operators import metrics
from lexframe.operators import percentiles as ranks
from lexframe.session import scratch_path
from lexframe.sources import logs as files

from .common import load
from .registry import registry

QUERIES, ORACLES, query = registry()


def qa_log(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    source = (
        F.when(F.col("event_type") == "click", "pg").when(F.col("event_type") == "view", "qdrant")
        .when(F.col("event_type") == "purchase", "web").when(F.col("event_type") == "error", "none")
    )
    return load(spark, sf_dir, "events").select(
        F.col("event_id"),
        source.alias("selected_source"),
        F.when(k < 60, "semantic").when(k < 90, "direct_article").alias("query_type"),
        F.when(k >= 20, F.array(F.concat(F.lit("a"), k))).otherwise(
            F.array().cast("array<string>")).alias("selected_articles"),
        (F.col("event_type") == "error").alias("fallback_used"),
        F.when(k % 10 != 0, F.bround(F.col("value") / 50, 4)).alias("confidence_score"),
    )


_LOG_SQL = """k_events AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
log AS (
  SELECT event_id, CASE event_type WHEN 'click' THEN 'pg' WHEN 'view' THEN 'qdrant'
           WHEN 'purchase' THEN 'web' WHEN 'error' THEN 'none' END AS selected_source,
         CASE WHEN k < 60 THEN 'semantic' WHEN k < 90 THEN 'direct_article' END AS query_type,
         CASE WHEN k >= 20 THEN ['a' || k] ELSE [] END AS selected_articles,
         event_type = 'error' AS fallback_used,
         CASE WHEN k % 10 <> 0 THEN round_even(value / 50, 4) END AS confidence_score
  FROM k_events),
flagged AS (
  SELECT *, fallback_used OR confidence_score IS NULL OR confidence_score < 0.7
           OR len(selected_articles) = 0 AS is_failure,
         coalesce(nullif(concat_ws(' | ', CASE WHEN fallback_used THEN 'fallback_used' END,
           CASE WHEN confidence_score IS NULL THEN 'confidence_null' WHEN confidence_score < 0.7
             THEN printf('low_confidence(%.3f)', round_even(confidence_score, 3)) END,
           CASE WHEN len(selected_articles) = 0 THEN 'no_articles' END), ''), 'unknown')
           AS failure_reason FROM log)"""


@query(f"WITH {_LOG_SQL} SELECT event_id, is_failure, failure_reason FROM flagged")
def flag_failures(spark, sf_dir):
    flagged = ops.flag_failures(qa_log(spark, sf_dir))
    return flagged.select("event_id", "is_failure", "failure_reason")


@query(f"""WITH {_LOG_SQL} SELECT CAST(event_id AS VARCHAR) AS query,
  strftime(DATE '2024-01-01' + CAST(event_id % 5 AS INTEGER), '%Y-%m-%dT00:00:00') AS ts,
  selected_source, selected_articles, fallback_used, nullif(confidence_score, 0) AS confidence_score
FROM log""")
def qa_log_round_trip(spark, sf_dir):
    """The log written as files per day and read back."""
    day = F.date_add(F.lit("2024-01-01"), F.pmod("event_id", F.lit(5)).cast("int"))
    requests_ = qa_log(spark, sf_dir).withColumns({
        "ts": day.cast("timestamp"), "query": F.col("event_id").cast("string"),
        "tool": F.lit("law_rag_tool"),
    })
    path = scratch_path(spark, "qa-log")
    files.write_qa_log(requests_, path, query_chars=300)
    return files.read_qa_log(spark, path).select(
        "query", "ts", "selected_source", "selected_articles", "fallback_used", "confidence_score"
    )


def _rank_sql(value: str, percent: int) -> str:
    """Item at floor(n * p / 100) of the sorted list, the last one at most."""
    return (f"list_sort(list({value}) FILTER (WHERE {value} IS NOT NULL))[CAST(least("
            f"floor(count({value}) * {percent} / 100.0), count({value}) - 1) AS BIGINT) + 1]")


@query(f"""WITH {_LOG_SQL} SELECT count(*) AS total_requests,
  count(*) FILTER (WHERE fallback_used) AS fallback_count,
  round_even(count(*) FILTER (WHERE fallback_used) / count(*), 4) AS fallback_rate,
  count(*) FILTER (WHERE len(selected_articles) = 0) AS no_article_count,
  round_even(count(*) FILTER (WHERE len(selected_articles) = 0) / count(*), 4) AS no_article_rate,
  count(*) FILTER (WHERE selected_source = 'none') AS error_count,
  round_even(count(*) FILTER (WHERE selected_source = 'none') / count(*), 4) AS error_rate,
  count(confidence_score) AS score_count, round_even(avg(confidence_score), 4) AS score_mean,
  round_even(min(confidence_score), 4) AS score_min,
  round_even(max(confidence_score), 4) AS score_max,
  {", ".join(f"round_even({_rank_sql('confidence_score', p)}, 4) AS score_p{p}"
             for p in ops.SCORE_PERCENTS)} FROM log""")
def qa_report(spark, sf_dir):
    return ops.qa_report(qa_log(spark, sf_dir))


@query(f"""WITH {_LOG_SQL}, counted AS (SELECT coalesce(query_type, 'unknown') AS value,
  count(*) AS n FROM log GROUP BY 1)
SELECT value, n, round_even(n * 100 / (SELECT count(*) FROM log), 1) AS percent FROM counted""")
def distribution(spark, sf_dir):
    return ops.distribution(qa_log(spark, sf_dir), "query_type")


@query(f"""WITH {_LOG_SQL}, sides AS (
  SELECT 'total' AS dimension, 'all' AS value, is_failure FROM flagged UNION ALL
  SELECT 'source', coalesce(selected_source, 'unknown'), is_failure FROM flagged UNION ALL
  SELECT 'query_type', coalesce(query_type, 'unknown'), is_failure FROM flagged)
SELECT dimension, value, count(*) FILTER (WHERE is_failure) AS failures, count(*) AS entries,
  round_even(count(*) FILTER (WHERE is_failure) / count(*), 4) AS failure_rate
FROM sides GROUP BY ALL""")
def failure_rollup(spark, sf_dir):
    return ops.failure_rollup(qa_log(spark, sf_dir))


_PERCENTS = [1, 25, 50, 75, 90, 95, 100]
_PERCENT_ROWS = ", ".join(f"({p})" for p in _PERCENTS)


def _nearest_sql(table: str, value: str, group: str) -> str:
    return f"""WITH placed AS (
  SELECT {group}, {value} AS v, row_number() OVER (PARTITION BY {group} ORDER BY {value}) AS r,
         count(*) OVER (PARTITION BY {group}) AS n FROM {table})
SELECT {group}, percent, v AS value FROM placed, (VALUES {_PERCENT_ROWS}) AS p(percent)
WHERE r = CAST(least(floor(n * percent / 100.0), n - 1) AS BIGINT) + 1"""


@query(_nearest_sql("events", "value", "event_type"))
def nearest_rank(spark, sf_dir):
    return ranks.nearest_rank(load(spark, sf_dir, "events"), "value", _PERCENTS, ["event_type"])


@query(_nearest_sql("lineitem", "l_extendedprice", "l_returnflag"))
def nearest_rank_bracketed(spark, sf_dir):
    items = load(spark, sf_dir, "lineitem")
    return ranks.nearest_rank(items, "l_extendedprice", _PERCENTS, ["l_returnflag"], ranges=32)


def requests(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    seconds = F.make_dt_interval(secs=F.col("value").cast("decimal(18,6)"))
    failed = F.col("event_type") == "error"
    return load(spark, sf_dir, "events").select(
        F.col("event_type").alias("endpoint"),
        F.concat(F.lit("agent"), F.col("user_id") % 5).alias("agent_type"),
        F.when(failed, "error").otherwise("success").alias("status"),
        F.when(failed & (k < 50), "Timeout").when(failed, "HTTPError").alias("error_type"),
        F.when(k < 30, "small").otherwise("large").alias("model"),
        F.when(k % 4 != 0, k).cast("bigint").alias("tokens"),
        F.bround(F.col("value") / 20, 4).alias("duration"),
        F.col("ts").alias("started_at"), (F.col("ts") + seconds).alias("ended_at"),
        F.pmod("user_id", F.lit(3)).cast("int").alias("round"),
    )


REQUESTS_SQL = """requests AS (
  SELECT event_type AS endpoint, 'agent' || (user_id % 5) AS agent_type,
    CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
    CASE WHEN event_type = 'error' AND k < 50 THEN 'Timeout' WHEN event_type = 'error'
      THEN 'HTTPError' END AS error_type, CASE WHEN k < 30 THEN 'small' ELSE 'large' END AS model,
    CASE WHEN k % 4 <> 0 THEN CAST(k AS BIGINT) END AS tokens,
    round_even(value / 20, 4) AS duration, ts AS started_at,
    ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT)) AS ended_at,
    CAST(user_id % 3 AS INTEGER) AS round
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""


@query(f"""WITH {REQUESTS_SQL}
SELECT 'requests' AS counter, endpoint, agent_type, status, CAST(NULL AS VARCHAR) AS error_type,
  CAST(NULL AS VARCHAR) AS model, count(*) AS value FROM requests GROUP BY ALL UNION ALL
SELECT 'errors', endpoint, NULL, NULL, error_type, NULL, count(*) FROM requests
  WHERE error_type IS NOT NULL GROUP BY ALL UNION ALL
SELECT 'agent_usage', NULL, agent_type, NULL, NULL, NULL, count(*) FROM requests
  GROUP BY ALL UNION ALL
SELECT 'tokens', NULL, agent_type, NULL, NULL, model, CAST(sum(tokens) AS BIGINT) FROM requests
  GROUP BY ALL""")
def request_counters(spark, sf_dir):
    return metrics.request_counters(requests(spark, sf_dir))


_BOUNDS = ", ".join(f"('{b}', {b})" for b in rules.LATENCY_BUCKETS)


@query(f"""WITH {REQUESTS_SQL} SELECT endpoint, agent_type, le,
  count(*) FILTER (WHERE duration <= bound) AS n, count(*) AS count,
  round_even(sum(duration), 4) AS sum
FROM requests, (VALUES {_BOUNDS}, ('+Inf', 'inf'::DOUBLE)) AS b(le, bound) GROUP BY ALL""")
def latency_histogram(spark, sf_dir):
    return metrics.latency_histogram(requests(spark, sf_dir)).withColumn("sum", F.bround("sum", 4))


@query(f"""WITH {REQUESTS_SQL} SELECT
  round_even(date_diff('microsecond', min(started_at), max(started_at)) / 1000000, 3)
    AS uptime_seconds, count(*) AS total_requests,
  count(*) FILTER (WHERE status = 'error') AS total_errors,
  round_even(count(*) FILTER (WHERE status = 'error') / count(*), 6) AS error_rate FROM requests""")
def service_summary(spark, sf_dir):
    return metrics.service_summary(requests(spark, sf_dir))


@query(f"""WITH {REQUESTS_SQL}, steps AS (
  SELECT endpoint, started_at AS moment, 1 AS d FROM requests UNION ALL
  SELECT endpoint, ended_at, -1 FROM requests),
netted AS (SELECT endpoint, moment, sum(d) AS d FROM steps GROUP BY ALL)
SELECT endpoint, moment AS "at",
  CAST(sum(d) OVER (PARTITION BY endpoint ORDER BY moment) AS BIGINT) AS active FROM netted""")
def active_requests(spark, sf_dir):
    return metrics.active_requests(requests(spark, sf_dir))


@query(f"""WITH {REQUESTS_SQL}, samples AS (
  SELECT CAST(round AS VARCHAR) AS round, status = 'success' AS ok,
         CASE WHEN tokens IS NOT NULL THEN duration / 10 END AS ttfb, duration AS total_time
  FROM requests),
labelled AS (SELECT * FROM samples UNION ALL SELECT 'all', ok, ttfb, total_time FROM samples)
SELECT round, count(*) AS total, count(*) FILTER (WHERE ok) AS succeeded,
  min(ttfb) FILTER (WHERE ok) AS ttfb_min, max(ttfb) FILTER (WHERE ok) AS ttfb_max,
  min(total_time) FILTER (WHERE ok) AS total_time_min,
  max(total_time) FILTER (WHERE ok) AS total_time_max, g.*
FROM labelled JOIN (SELECT round AS g_round,
  {", ".join(f"{_rank_sql(c, p)} AS {c}_p{p}" for c in ('ttfb', 'total_time') for p in (50, 90))}
  FROM labelled WHERE ok GROUP BY round) g ON g.g_round = round GROUP BY ALL""".replace(
    "g.*", "ttfb_p50, ttfb_p90, total_time_p50, total_time_p90"))
def load_summary(spark, sf_dir):
    samples = requests(spark, sf_dir).select(
        "round", (F.col("status") == "success").alias("ok"),
        F.when(F.col("tokens").isNotNull(), F.col("duration") / 10).alias("ttfb"),
        F.col("duration").alias("total_time"),
    )
    return metrics.load_summary(samples)
