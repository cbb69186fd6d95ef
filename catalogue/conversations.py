"""Turn pairing, context, history, statistics, search and maintenance of turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexframe.operators import conversations as ops

from .common import EVENT_TURNS_SQL, TURN_ID_STEP, TURNS_SQL, event_turns, load, turns
from .registry import registry

QUERIES, ORACLES, query = registry()


_PAIRS_SQL = f"""WITH {TURNS_SQL}, pairs AS (
  SELECT u.session_id, u.turn_index, u.content AS question, a.content AS answer, u.created_at
  FROM turns u JOIN turns a ON a.session_id = u.session_id
   AND a.turn_index = u.turn_index + 1 AND a.role = 'assistant'
  WHERE u.role = 'user')"""


@query(f"{_PAIRS_SQL} SELECT session_id, turn_index, question, answer FROM pairs")
def pair_turns(spark, sf_dir):
    pairs = ops.pair_turns(turns(spark, sf_dir))
    return pairs.select("session_id", "turn_index", "question", "answer")


@query(f"""{_PAIRS_SQL} SELECT session_id, turn_index, question, answer FROM pairs
ORDER BY created_at DESC LIMIT 5""")
def recent_pairs(spark, sf_dir):
    pairs = ops.recent_pairs(turns(spark, sf_dir), 5)
    return pairs.select("session_id", "turn_index", "question", "answer")


_SEARCH_SQL = f"""{_PAIRS_SQL}, queries AS (
  SELECT item_id * 1000 + i AS query_id, w[i] AS term FROM (
    SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM (
      SELECT item_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM benchmark))),
ranked AS (
  SELECT q.query_id, p.session_id, p.turn_index, p.question, p.answer,
         row_number() OVER (PARTITION BY q.query_id ORDER BY p.created_at DESC) AS rn
  FROM queries q JOIN pairs p ON q.term <> '' AND p.question ILIKE '%' || q.term || '%'),
hits AS (SELECT * EXCLUDE rn, true AS matched FROM ranked WHERE rn <= 5),
recent AS (SELECT session_id, turn_index, question, answer FROM pairs
           ORDER BY created_at DESC LIMIT 5)
SELECT * FROM hits UNION ALL
SELECT q.query_id, r.session_id, r.turn_index, r.question, r.answer, false AS matched
FROM queries q CROSS JOIN recent r WHERE q.query_id NOT IN (SELECT query_id FROM hits)"""


def _searched(spark, sf_dir, **options):
    words = F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)).alias("place", "word")
    asked = load(spark, sf_dir, "benchmark").select("item_id", words).select(
        (F.col("item_id") * 1000 + F.col("place") + 1).alias("query_id"),
        F.concat("word", F.lit(" 기록에서 찾아줘")).alias("query"),
    )
    found = ops.search_history(asked, turns(spark, sf_dir), 5, **options)
    return found.select("query_id", "session_id", "turn_index", "question", "answer", "matched")


@query(_SEARCH_SQL)
def search_history(spark, sf_dir):
    return _searched(spark, sf_dir)


@query(_SEARCH_SQL)
def search_history_blocks(spark, sf_dir):
    """Terms in many blocks."""
    return _searched(spark, sf_dir, block_terms=300)


@query(f"""WITH {TURNS_SQL} SELECT id, content FROM turns
WHERE content ILIKE '%' || CASE WHEN role = 'user' THEN 'the' ELSE 'e_th' END || '%'""")
def keyword_filter(spark, sf_dir):
    term = F.when(F.col("role") == "user", "the").otherwise("e_th")
    return ops.keyword_filter(turns(spark, sf_dir), "content", term).select("id", "content")


@query(f"""WITH {TURNS_SQL}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC) AS rn FROM turns)
SELECT session_id, string_agg(CASE WHEN role = 'user' THEN '사용자' ELSE 'assistant' END
       || ': ' || content, chr(10) ORDER BY created_at) AS context
FROM ranked WHERE rn <= 10 GROUP BY session_id""")
def session_context(spark, sf_dir):
    return ops.session_context(turns(spark, sf_dir), 5)


@query(f"""WITH {TURNS_SQL}, recent AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC) AS rn FROM turns),
kept AS (SELECT * FROM recent WHERE rn <= 200)
SELECT user_id, CAST(session_id AS VARCHAR) AS session_id,
       left(arg_min(content, created_at) FILTER (WHERE role = 'user'), 60) AS title,
       max(created_at) AS last_active
FROM kept GROUP BY user_id, session_id HAVING count(*) FILTER (WHERE role = 'user') > 0""")
def session_summary(spark, sf_dir):
    return ops.session_summary(turns(spark, sf_dir), 200)


@query(f"""WITH {EVENT_TURNS_SQL}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rn
  FROM turns)
SELECT user_id, id, role, content, tool, score, created_at FROM ranked WHERE rn <= 50""")
def history(spark, sf_dir):
    rows = ops.history(event_turns(spark, sf_dir), limit=50)
    return rows.select("user_id", "id", "role", "content", "tool", "score", "created_at")


@query(f"""WITH {EVENT_TURNS_SQL}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) AS rn FROM turns)
SELECT session_id, id, role, content, created_at FROM ranked WHERE rn <= 50""")
def session_turns(spark, sf_dir):
    rows = ops.session_turns(event_turns(spark, sf_dir), limit=50)
    return rows.select("session_id", "id", "role", "content", "created_at")


@query(f"""WITH {EVENT_TURNS_SQL}
SELECT tool, count(*) AS count, coalesce(round_even(avg(score), 1), 0.0) AS avg_score,
       max(created_at) AS last_used
FROM turns WHERE role = 'assistant' GROUP BY tool ORDER BY count DESC, tool""")
def tool_stats(spark, sf_dir):
    return ops.tool_stats(event_turns(spark, sf_dir))


@query(f"""WITH {EVENT_TURNS_SQL}
SELECT tool AS tool_name, count(*) AS usage_count, round_even(avg(score), 6) AS avg_score,
       max(created_at) AS last_used, count(DISTINCT user_id) AS unique_users
FROM turns WHERE role = 'assistant' GROUP BY tool""")
def chat_statistics(spark, sf_dir):
    stats = ops.chat_statistics(event_turns(spark, sf_dir))
    return stats.withColumn("avg_score", F.bround("avg_score", 6))


@query(f"""WITH {EVENT_TURNS_SQL}
SELECT session_id, coalesce(arg_max(tool, id) FILTER (WHERE role = 'assistant'), '') AS tool
FROM turns GROUP BY session_id""")
def last_tool(spark, sf_dir):
    return ops.last_tool(event_turns(spark, sf_dir))


@query(f"""WITH {TURNS_SQL}, voted AS (
  SELECT t.id, t.role, CASE WHEN l.toxic = 1 THEN 0 WHEN l.quality = 1 THEN 1
                            WHEN l.quality = 0 THEN -1 END AS feedback
  FROM turns t LEFT JOIN labels l ON l.doc_id = t.session_id)
SELECT id, role, feedback, CASE WHEN role NOT IN ('user', 'assistant') THEN 'role'
       WHEN feedback NOT IN (1, -1) THEN 'feedback' END AS reject_reason FROM voted""")
def turn_validation(spark, sf_dir):
    labels = load(spark, sf_dir, "labels").withColumnRenamed("doc_id", "session_id")
    feedback = (
        F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 1)
        .when(F.col("quality") == 0, -1)
    )
    voted = turns(spark, sf_dir).join(labels, "session_id", "left")
    checked = ops.validate_turns(voted.withColumn("feedback", feedback))
    return checked.select("id", "role", "feedback", "reject_reason")


@query(f"""WITH {TURNS_SQL}, votes AS (
  SELECT doc_id * {TURN_ID_STEP} + 1 AS id, CASE WHEN quality = 1 THEN 1 ELSE -1 END AS value,
         1 AS position FROM labels UNION ALL
  SELECT doc_id * {TURN_ID_STEP} + 1, -toxic, 2 FROM labels),
last AS (SELECT id, arg_max(value, position) AS value FROM votes WHERE value IN (1, -1) GROUP BY id)
SELECT t.id, t.role, CASE WHEN t.role = 'assistant' THEN l.value END AS feedback,
       CASE WHEN t.role = 'assistant' AND l.value IS NOT NULL THEN CAST(7 AS BIGINT)
            ELSE t.created_at END AS updated_at
FROM turns t LEFT JOIN last l USING (id)""")
def apply_feedback(spark, sf_dir):
    labels = load(spark, sf_dir, "labels")
    answer_id = (F.col("doc_id") * TURN_ID_STEP + 1).alias("id")
    votes = labels.select(
        answer_id, F.when(F.col("quality") == 1, 1).otherwise(-1).alias("value"),
        F.lit(1).alias("position"),
    ).unionByName(labels.select(answer_id, (-F.col("toxic")).alias("value"),
                                F.lit(2).alias("position")))
    base = turns(spark, sf_dir).withColumns({
        "feedback": F.lit(None).cast("int"), "updated_at": F.col("created_at"),
    })
    voted = ops.apply_feedback(base, votes, F.lit(7).cast("bigint"))
    return voted.select("id", "role", "feedback", "updated_at")


def _gone(spark, sf_dir):
    return load(spark, sf_dir, "labels").where("toxic = 1").select(
        F.col("doc_id").alias("session_id")
    )


_LEFT_SQL = f"""WITH {TURNS_SQL}, kept AS (SELECT * FROM turns WHERE session_id NOT IN
  (SELECT doc_id FROM labels WHERE toxic = 1))"""


@query(f"{_LEFT_SQL} SELECT id, session_id, role, content FROM kept")
def delete_sessions(spark, sf_dir):
    kept = ops.delete_sessions(turns(spark, sf_dir), _gone(spark, sf_dir))
    return kept.select("id", "session_id", "role", "content")


@query(f"""{_LEFT_SQL} SELECT doc_id AS id, doc_id * {TURN_ID_STEP} + 1 AS chat_history_id, source
FROM documents WHERE doc_id * {TURN_ID_STEP} + 1 IN (SELECT id FROM kept)""")
def cascade_citations(spark, sf_dir):
    cited = load(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        (F.col("doc_id") * TURN_ID_STEP + 1).alias("chat_history_id"), "source",
    )
    kept = ops.delete_sessions(turns(spark, sf_dir), _gone(spark, sf_dir))
    return ops.cascade_citations(cited, kept)


@query(f"""{_PAIRS_SQL}, answered AS (
  SELECT session_id, question, answer || ' 「산업안전보건법」 제' || turn_index || '조' AS answer,
         1704067200 + session_id * 1000 + turn_index AS asked FROM pairs),
stored AS (SELECT *, least(10 * len(regexp_extract_all(answer, '「.*?」'))
  + 5 * len(regexp_extract_all(answer, '제[0-9]+조')) + 35, 100) AS score FROM answered)
SELECT CAST(session_id AS VARCHAR) AS session_id, '{{"tool":"law"}}' AS metadata,
       CAST(score AS INTEGER) AS score, asked AS turn_index, 'user' AS role, question AS content
FROM stored UNION ALL
SELECT CAST(session_id AS VARCHAR), '{{"tool":"law"}}', CAST(score AS INTEGER), asked + 1,
       'assistant', answer FROM stored""")
def append_turns(spark, sf_dir):
    pairs = ops.pair_turns(turns(spark, sf_dir))
    seconds = F.lit(1704067200) + F.col("session_id") * 1000 + F.col("turn_index")
    answered = pairs.select(
        F.col("session_id").cast("string").alias("session_id"),
        F.lit("u").alias("user_id"), "question",
        F.concat("answer", F.lit(" 「산업안전보건법」 제"), "turn_index", F.lit("조")).alias("answer"),
        F.lit("law_rag_tool").alias("tool"),
        F.timestamp_seconds(seconds).alias("asked_at"),
    )
    rows = ops.append_turns(answered)
    return rows.select("session_id", "metadata", "score", "turn_index", "role", "content")
