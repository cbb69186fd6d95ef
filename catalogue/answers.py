"""Documents cut into streamed chunks and put together again."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexframe.functions import infer_source as infer
from lexframe.functions import number_paragraphs, preview
from lexframe.operators import answers as ops
from lexframe.sources.logs import parse_event_lines

from .common import load, load_dealt
from .registry import registry

QUERIES, ORACLES, query = registry()


def chunks(spark, sf_dir, size: int = 20):
    """Every document as one request: a status, its text in slices, a source, a stored id."""
    docs = load_dealt(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    text = ops.chunk_text(docs, "text", size).select(
        "doc_id", F.col("seq") + 1, F.lit("text").alias("event"), F.col("chunk").alias("payload")
    )
    laws = F.to_json(F.struct(F.array(F.struct(F.col("source").alias("law_name"))).alias(
        "retrieved_laws")))
    source = F.when(F.col("lang") == "fr", "web result").otherwise(laws)
    status = F.when(F.col("lang") == "de", "Web fallback 실행").otherwise("검색 중")
    frame = docs.select("doc_id", F.explode(F.array(
        F.struct(F.lit(0).alias("seq"), F.lit("status").alias("event"), status.alias("payload")),
        F.struct(F.lit(1_000_000).alias("seq"), F.lit("source").alias("event"),
                 source.alias("payload")),
        F.struct(F.lit(1_000_001).alias("seq"), F.lit("saved").alias("event"),
                 F.col("doc_id").cast("string").alias("payload")),
    )).alias("c")).select("doc_id", "c.*")
    return text.union(frame).toDF("request_id", "seq", "event", "payload")


@query("""SELECT doc_id, CAST(i AS INTEGER) AS seq, substr(text, CAST(i AS BIGINT) * 20 + 1, 20)
  AS chunk FROM documents, range(0, 100000) AS r(i) WHERE i * 20 < length(text)""")
def chunk_text(spark, sf_dir):
    return ops.chunk_text(load(spark, sf_dir, "documents").select("doc_id", "text"), "text", 20)


@query("""SELECT doc_id AS request_id, text AS answer, CAST(ceil(length(text) / 20) AS BIGINT)
  AS text_events, CAST(ceil(length(text) / 20) AS BIGINT) + 3 AS events, CAST(0 AS BIGINT) AS errors,
  lang IN ('de', 'fr') AS fallback, CASE WHEN lang <> 'fr' THEN '[{"law_name":"' || source || '"}]'
  END AS sources, CASE WHEN lang = 'fr' THEN 'web' ELSE 'qdrant' END AS source,
  CAST(doc_id AS VARCHAR) AS saved_id FROM documents""")
def assemble_answer(spark, sf_dir):
    return ops.assemble_answer(chunks(spark, sf_dir))


@query("""SELECT doc_id AS request_id, CASE WHEN lang = 'fr' THEN 'web' WHEN lang = 'en' THEN 'qdrant'
  WHEN contains(text, 'OSHA') OR contains(text, '검색 결과') OR contains(text, '출처') THEN 'web'
  ELSE 'pg' END AS source FROM documents""")
def infer_source(spark, sf_dir):
    """Sources of answers, guessed from the text where no event stated one."""
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("request_id"), "lang")
    stated = F.when(F.col("lang").isin("fr", "en"), F.col("source"))
    answers = ops.assemble_answer(chunks(spark, sf_dir, 500)).join(docs, "request_id")
    return answers.select("request_id", infer(stated, F.col("answer")).alias("source"))


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'source' ELSE 'status' END
  AS event, CASE page_id % 3 WHEN 0 THEN html WHEN 1 THEN '{"law_url":"' || url || '"}' ELSE '' END
  AS payload FROM pages""")
def parse_event_lines_of_pages(spark, sf_dir):
    kind = F.col("page_id") % 3
    body = (
        F.when(kind == 0, F.to_json(F.struct(F.lit("text").alias("event"),
                                             F.col("html").alias("payload"))))
        .when(kind == 1, F.to_json(F.struct(F.lit("source").alias("type"), F.struct(
            F.col("url").alias("law_url")).alias("payload"))))
        .otherwise('{"event": "", "type": "status"}')
    )
    pages = load(spark, sf_dir, "pages")
    good = pages.select("page_id", F.concat(F.lit("  data:  "), body).alias("value"))
    noise = pages.select("page_id", F.concat(F.lit("data: {broken "), "url").alias("value"))
    return parse_event_lines(good.unionByName(noise)).drop("value")


@query("""SELECT doc_id, CASE WHEN length(text) > 500 THEN left(text, 500) || ' ...' ELSE text END
  AS search_query, left(text, 300) AS logged,
  regexp_replace(doc_id || ' ' || text || chr(10) || '7 끝', '(?m)^([0-9]+) ', '\\1. ', 'g')
  AS numbered FROM documents""")
def text_views(spark, sf_dir):
    text = F.col("text")
    numbered = number_paragraphs(F.concat(F.col("doc_id"), F.lit(" "), text, F.lit("\n7 끝")))
    return load(spark, sf_dir, "documents").select(
        "doc_id", preview(text, 500, " ...").alias("search_query"),
        preview(text, 300).alias("logged"), numbered.alias("numbered"),
    )
