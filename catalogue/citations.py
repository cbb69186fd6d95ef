"""Citations over whole documents with citations in every accepted notation appended."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexframe import functions as fx
from lexframe import rules
from lexframe.operators import citations as ops
from lexframe.operators.keyed import rank_within

from .common import ARTICLES_SQL, LABELLED_SQL, articles, labelled, load, load_dealt, turns
from .common import TURN_ID_STEP, TURNS_SQL
from .registry import registry
from .vectors import leave_one_out, topk_sql

QUERIES, ORACLES, query = registry()


def answers(spark, sf_dir):
    docs, number = load_dealt(spark, sf_dir, "documents"), F.col("doc_id")
    return docs.select(
        F.col("doc_id").alias("answer_id"),
        F.concat(
            "text", F.lit(" ["), "source", F.lit("] 제"), number, F.lit("조, **"), "lang",
            F.lit(" 규정** 제"), number % 7, F.lit("의2조 그리고 ["), "source", F.lit(" 제"), number,
            F.lit("조 제1항] ["), "source", F.lit(" 제"), number, F.lit("조] ["), "lang",
            F.lit(" 제"), number % 5, F.lit("조] ["), "source", F.lit("] 제"), number + 1,
            F.lit("조 [마지막 제9조] 「"), "source", F.lit("」"),
        ).alias("answer"),
    )


ANSWERS_SQL = """answers AS (SELECT doc_id AS answer_id, text || ' [' || source || '] 제' || doc_id
  || '조, **' || lang || ' 규정** 제' || (doc_id % 7) || '의2조 그리고 [' || source || ' 제' || doc_id
  || '조 제1항] [' || source || ' 제' || doc_id || '조] [' || lang || ' 제' || (doc_id % 5)
  || '조] [' || source || '] 제' || (doc_id + 1) || '조 [마지막 제9조] 「' || source || '」' AS answer
  FROM documents)"""

_OUTSIDE = rules.CITATION_OUTSIDE.replace(r"\d", "[0-9]")
_INSIDE = rules.CITATION_INSIDE.replace(r"\d", "[0-9]")


def _found_sql(name: str, pattern: str, law: str, article: int) -> str:
    """Matches with their start: each is taken together with the text in front of it, so the
    lengths of all earlier pieces add up to the position."""
    lead = f"'(?s)(.*?)(?:{pattern})'"
    return f"""{name}_pieces AS (
  SELECT answer_id, unnest(regexp_extract_all(answer, {lead}, 0)) AS piece FROM answers),
{name}_placed AS (
  SELECT answer_id, piece, row_number() OVER () AS n FROM {name}_pieces),
{name} AS (
  SELECT answer_id, sum(length(piece)) OVER (PARTITION BY answer_id ORDER BY n) - length(piece)
           + length(regexp_extract(piece, {lead}, 1)) AS start,
         trim({law.format(lead=lead)}) AS law, regexp_extract(piece, {lead}, {article}) AS art
  FROM {name}_placed)"""


_CITED_SQL = f"""{_found_sql('outside', _OUTSIDE,
    "coalesce(nullif(regexp_extract(piece, {lead}, 2), ''), regexp_extract(piece, {lead}, 3))", 4)},
{_found_sql('inside', _INSIDE, "regexp_extract(piece, {lead}, 2)", 3)},
firsts AS (
  SELECT answer_id, law, art, min(start) AS start FROM
    (SELECT * FROM outside UNION ALL SELECT * FROM inside) GROUP BY ALL),
cited AS (
  SELECT answer_id, law AS law_name, art AS article_number, CAST(row_number() OVER (
    PARTITION BY answer_id ORDER BY start, law, art) AS INTEGER) AS rank FROM firsts)"""


@query(f"""WITH {ANSWERS_SQL}, {_CITED_SQL}
SELECT answer_id, law_name, article_number, rank, CAST(NULL AS DOUBLE) AS score
FROM cited""")
def extract_citations(spark, sf_dir):
    return ops.extract_citations(answers(spark, sf_dir))


_STRICT = "'\\[([^\\]]+?)\\s+제([0-9]+(?:의[0-9]+)?)조\\]'"
_STRICT_SQL = f"""strict AS (
  SELECT answer_id, unnest(list_zip(regexp_extract_all(answer, {_STRICT}, 1),
         regexp_extract_all(answer, {_STRICT}, 2), range(len(regexp_extract_all(answer, {_STRICT},
         1))))) AS c FROM answers),
strict_cited AS (SELECT answer_id, CAST(c[3] AS INTEGER) AS position, c[1] AS law_name,
  c[2] AS article_number FROM strict)"""


@query(f"WITH {ANSWERS_SQL}, {_STRICT_SQL} SELECT * FROM strict_cited")
def extract_strict_citations(spark, sf_dir):
    return ops.extract_strict_citations(answers(spark, sf_dir))


@query(f"""WITH {ANSWERS_SQL}, {_STRICT_SQL} SELECT answer_id, law_name, article_number,
  position + 1 AS rank FROM strict_cited""")
def citation_ranks(spark, sf_dir):
    cited = ops.extract_strict_citations(answers(spark, sf_dir))
    return rank_within(cited, "answer_id", "position").drop("position")


@query(f"""WITH {ANSWERS_SQL}, {_STRICT_SQL}, {LABELLED_SQL}, missing AS (
  SELECT answer_id, list(law_name || ' 제' || article_number || '조' ORDER BY position) AS missing
  FROM strict_cited WHERE (regexp_replace(law_name, '[\\s·]', '', 'g'), article_number) NOT IN
    (SELECT (source, CAST(doc_id AS VARCHAR)) FROM labelled) GROUP BY answer_id)
SELECT answer_id, CASE WHEN m.missing IS NULL THEN 'OK' ELSE 'CITATION_MISS' END AS verdict,
       coalesce(m.missing, []) AS missing FROM answers LEFT JOIN missing m USING (answer_id)""")
def verify_citations(spark, sf_dir):
    corpus = labelled(spark, sf_dir).select(
        F.col("source").alias("law_name_norm"),
        F.col("doc_id").cast("string").alias("article_number_norm"),
    )
    return ops.verify_citations(answers(spark, sf_dir), corpus)


@query(f"""WITH {ANSWERS_SQL} SELECT answer_id,
  CAST(len(regexp_extract_all(answer, '「.*?」')) AS INTEGER) AS law_ref_count,
  CAST(least(10 * len(regexp_extract_all(answer, '「.*?」'))
    + 5 * len(regexp_extract_all(answer, '제[0-9]+조')) + 35, 100) AS INTEGER) AS score
FROM answers""")
def quality_score(spark, sf_dir):
    text = F.col("answer")
    return answers(spark, sf_dir).select(
        "answer_id", fx.reference_count(text).alias("law_ref_count"),
        fx.quality_score(text).alias("score"),
    )


_CLAIMS = ("list_distinct(list_concat(regexp_extract_all({0}, '[0-9]+(?:\\.[0-9]+)?'), "
           "regexp_extract_all({0}, '제[0-9]+조(?:의[0-9]+)?')))")


@query(f"""WITH {ANSWERS_SQL}, claimed AS (
  SELECT a.answer_id, {_CLAIMS.format('a.answer')} AS claims,
         list_concat({_CLAIMS.format('d.text')}, {_CLAIMS.format("'제' || d.doc_id || '조 9'")})
           AS known
  FROM answers a JOIN documents d ON d.doc_id = a.answer_id),
screened AS (SELECT answer_id, len(claims) AS n,
  list_sort(list_filter(claims, lambda c: NOT list_contains(known, c))) AS missing FROM claimed)
SELECT answer_id, CAST(n AS INTEGER) AS claims, CAST(len(missing) AS INTEGER) AS missing,
       missing AS missing_claims, CASE WHEN len(missing) = 0 THEN 'GROUNDED'
       WHEN len(missing) < n THEN 'PARTIAL' ELSE 'HALLUCINATION' END AS verdict FROM screened""")
def screen_grounding(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("answer_id"),
        F.array("text", F.concat(F.lit("제"), "doc_id", F.lit("조 9"))).alias("contexts"),
    )
    return ops.screen_grounding(answers(spark, sf_dir).join(docs, "answer_id"))


@query(f"""WITH {topk_sql()}, texts AS (SELECT h.query_id AS question_id, h.rank, d.source, d.doc_id,
    d.text, q.lang FROM hits h JOIN documents d ON d.doc_id = h.candidate_id
    JOIN documents q ON q.doc_id = h.query_id)
SELECT question_id, '[이전 대화]' || chr(10) || any_value(lang) || chr(10) || chr(10) ||
  string_agg('[' || source || ' 제' || doc_id || '조]' || chr(10) || text, chr(10) || chr(10)
             ORDER BY rank) AS context FROM texts GROUP BY question_id""")
def assemble_context(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("candidate_id"), F.col("source").alias("law_name"),
        F.col("doc_id").cast("string").alias("article_number"), "text",
    )
    said = load(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("query_id"), F.col("lang").alias("said")
    )
    hits = leave_one_out(spark, sf_dir).join(docs, "candidate_id").join(said, "query_id")
    return ops.assemble_context(
        hits.withColumnRenamed("query_id", "question_id"), history="said"
    )


@query(f"""WITH {TURNS_SQL}, {ARTICLES_SQL}, citations AS (
  SELECT doc_id * {TURN_ID_STEP} + 1 AS chat_history_id, source AS law_name,
         '제' || (doc_id + CASE WHEN lang = 'en' THEN 0 ELSE 1 END) || '조' AS article_number
  FROM documents)
SELECT t.id AS chat_history_id, t.session_id, c.law_name, c.article_number,
       a.text IS NOT NULL AS in_corpus
FROM turns t LEFT JOIN citations c ON c.chat_history_id = t.id
LEFT JOIN articles a ON a.law_name_norm = c.law_name AND a.article_number = c.article_number
WHERE t.role = 'assistant'""")
def citations_of(spark, sf_dir):
    shift = F.when(F.col("lang") == "en", 0).otherwise(1)
    cited = load(spark, sf_dir, "documents").select(
        (F.col("doc_id") * TURN_ID_STEP + 1).alias("chat_history_id"),
        F.col("source").alias("law_name"),
        F.concat(F.lit("제"), F.col("doc_id") + shift, F.lit("조")).alias("article_number"),
    )
    found = ops.citations_of(turns(spark, sf_dir), cited, articles(spark, sf_dir))
    return found.select("chat_history_id", "session_id", "law_name", "article_number", "in_corpus")
