"""Stored documents, tables, golden cases and reports, and the context styles of answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexframe.operators import citations, conversations
from lexframe.operators.corpus import extract_articles as extract
from lexframe.operators.vectors import payload_filter as filtered
from lexframe.session import scratch_path
from lexframe.sources import evaluation
from lexframe.sources.statutes import read_statute_json as read_statutes
from lexframe.sources.statutes import write_statute_json
from lexframe.sources.tables import read_table as read_stored

from .common import TURNS_SQL, load, turns
from .documents import shaped_sql, shaped_statutes
from .registry import registry
from .vectors import leave_one_out, topk_sql

QUERIES, ORACLES, query = registry()


@query(f"SELECT {shaped_sql('page_id', 'url', 'html', 'url')} FROM pages")
def read_statute_json(spark, sf_dir):
    """One file per law, as the source delivers them, in every shape, read as a whole."""
    path = scratch_path(spark, "statutes")
    pages = load(spark, sf_dir, "pages")
    laws = shaped_statutes(pages, F.col("page_id"), *map(F.col, ("url", "html", "url")))
    write_statute_json(laws, path)
    number = F.regexp_extract("doc", '"조문번호":"([0-9]+)"', 1)
    read = read_statutes(spark, path).select(F.concat(F.lit("법 "), number).alias("law_name"), "doc")
    return extract(read).select("law_name_norm", "article_number_norm", "text", "enforcement_date")


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def read_table(spark, sf_dir):
    return read_stored(spark, "documents", f"{sf_dir}/documents.parquet")


@query("""SELECT CAST(item_id AS INTEGER) AS position, 'GS-' || item_id AS id, text AS question,
  CAST(item_id % 7 AS VARCHAR) AS article_number FROM benchmark""")
def read_golden(spark, sf_dir):
    """The benchmark as golden cases, one per line."""
    cases = load(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("int").alias("position"), F.concat(F.lit("GS-"), "item_id").alias("id"),
        F.col("text").alias("question"), (F.col("item_id") % 7).cast("string").alias("article_number"),
    )
    path = scratch_path(spark, "golden")
    cases.write.json(path)
    return evaluation.read_golden(spark, path, lines=True).select("position", "id", "question", "article_number")


@query("""SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ALL""")
def write_report(spark, sf_dir):
    path = scratch_path(spark, "report")
    report = load(spark, sf_dir, "documents").groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")
    )
    evaluation.write_report(report, path)
    return spark.read.schema("lang string, source string, n bigint, chars bigint").json(path)


@query("SELECT vec_id, label FROM embeddings WHERE label = 3")
def payload_filter(spark, sf_dir):
    return filtered(load(spark, sf_dir, "embeddings"), label=3, vec_id=None).select("vec_id", "label")


@query(f"""WITH {TURNS_SQL} SELECT id, CAST(session_id AS VARCHAR) AS session_id FROM turns
WHERE NOT starts_with(CAST(session_id AS VARCHAR), '1')""")
def delete_sessions_by_prefix(spark, sf_dir):
    named = turns(spark, sf_dir).withColumn("session_id", F.col("session_id").cast("string"))
    return conversations.delete_sessions(named, prefix="1").select("id", "session_id")


@query("""SELECT doc_id AS chat_history_id, coalesce(law, '') AS law_name, coalesce(art, '') AS article_number,
  score, rank FROM (
    SELECT doc_id, source AS law, CAST(doc_id AS VARCHAR) AS art, 0.5 AS score, 1 AS rank FROM documents
    UNION ALL SELECT doc_id, NULL, lang, NULL, 2 FROM documents)""")
def citation_rows(spark, sf_dir):
    none = F.lit(None)
    cited = F.array(
        F.struct(F.col("source").alias("law_name"), F.col("doc_id").cast("string").alias("article_number"),
                 F.lit(0.5).alias("score"), F.lit(1).alias("rank")),
        F.struct(none.cast("string").alias("law_name"), F.col("lang").alias("article_number"),
                 none.cast("double").alias("score"), F.lit(2).alias("rank")),
    )
    answered = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("chat_history_id"), cited.alias("citations"))
    return conversations.citation_rows(answered)


_HITS_SQL = f"""{topk_sql()}, texts AS (
  SELECT h.query_id AS question_id, h.rank, d.text, d.source, d.lang, 'http://x/' || d.doc_id AS link
  FROM hits h JOIN documents d ON d.doc_id = h.candidate_id)"""


def _styled(spark, sf_dir, style, keep=None):
    docs = load(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("candidate_id"), "text", F.col("source").alias("title"), F.col("text").alias("snippet"),
        "source", F.col("lang").alias("published"), F.concat(F.lit("http://x/"), "doc_id").alias("link"),
    )
    hits = leave_one_out(spark, sf_dir).join(docs, "candidate_id").withColumnRenamed("query_id", "question_id")
    return citations.assemble_context(hits, style, keep=keep)


@query(f"""WITH {_HITS_SQL} SELECT question_id, string_agg('[조문 ' || rank || ']' || chr(10) || text,
  chr(10) || chr(10) ORDER BY rank) AS context FROM texts WHERE rank <= 5 GROUP BY question_id""")
def assemble_numbered(spark, sf_dir):
    return _styled(spark, sf_dir, "numbered", keep=5)


@query(f"""WITH {_HITS_SQL} SELECT question_id, string_agg('[' || rank || '] ' || source || chr(10) || text
  || chr(10) || link, chr(10) || chr(10) ORDER BY rank) AS context FROM texts GROUP BY question_id""")
def assemble_web(spark, sf_dir):
    return _styled(spark, sf_dir, "web")


@query(f"""WITH {_HITS_SQL} SELECT question_id, string_agg('- 제목: ' || source || chr(10) || '  매체: ' || source
  || chr(10) || '  날짜: ' || lang || chr(10) || '  링크: ' || link || chr(10) || '  내용: ' || text,
  chr(10) ORDER BY rank) AS context FROM texts GROUP BY question_id""")
def assemble_items(spark, sf_dir):
    return _styled(spark, sf_dir, "items")
