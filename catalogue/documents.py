"""Statute documents made from ``documents``: one law per document, one article per line."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexframe.functions import flatten_text, point_id
from lexframe.operators.corpus import extract_articles as extract
from lexframe.operators.vectors import vectorize
from lexframe.plans.sync import sync_corpus as sync

from .common import load, load_dealt
from .registry import registry

QUERIES, ORACLES, query = registry()


def statutes(spark, sf_dir, step: int = 1):
    """The law of a document has ``step`` times its number. Every line is an article; every third one is a branch of its number. Each law also has a
    heading and a repealed article, which have to disappear."""
    docs = load_dealt(spark, sf_dir, "documents")
    number = F.col("n").cast("string")

    def unit(kind, no, branch, body):
        return F.struct(kind.alias("조문여부"), no.alias("조문번호"), branch.alias("조문가지번호"),
                        body.alias("조문내용"))

    def line_unit(text, i):
        branch = F.when(i % 3 == 2, F.lit("2"))
        return unit(F.lit("조문"), (i + 1).cast("string"), branch, text)

    fixed = F.array(
        unit(F.lit("전문"), F.lit("1"), F.lit(None).cast("string"), F.lit("제1장 총칙")),
        unit(F.lit("조문"), F.lit("999999"), F.lit("2"), F.lit("제999999조의2 삭제 <2013.8.6>")),
    )
    lines = F.transform(F.split("text", "\n"), line_unit)
    law = F.struct(F.lit("20260101").alias("시행일자"),
                   F.struct(F.concat(lines, fixed).alias("조문단위")).alias("조문"))
    return docs.withColumn("n", F.col("doc_id") * step).select(
        F.concat(F.lit("법 "), number).alias("law_name"),
        F.to_json(F.struct(law.alias("법령"))).alias("doc"),
    )


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(12288)"
_LINES_SQL = f"""lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
articles AS (
  SELECT doc_id, '법' || doc_id AS law_name_norm, i || CASE WHEN i % 3 = 0 THEN '의2' ELSE '' END
           AS article_number_norm, '제' || i || '조' || CASE WHEN i % 3 = 0 THEN '의2' ELSE '' END
           AS article_number, trim(line, {_BLANKS}) AS text
  FROM lines WHERE trim(line, {_BLANKS}) <> '')"""


@query(f"""WITH {_LINES_SQL} SELECT law_name_norm, article_number_norm, article_number, text,
  DATE '2026-01-01' AS enforcement_date FROM articles""")
def extract_articles(spark, sf_dir):
    found = extract(statutes(spark, sf_dir))
    return found.select("law_name_norm", "article_number_norm", "article_number", "text",
                        "enforcement_date")


def shaped_statutes(rows, number, *pieces):
    """One law per row in the shapes the source knows, taken in turn by ``number``: a list of units, a
    single unit, a container that is a list, a container that is the unit. Dates stand in the law, in the unit, in a
    list of the unit, in an object of the law; every seventh unit has a title only. ``pieces`` nest as paragraphs."""
    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    kind, key = F.pmod(number, F.lit(4)), number.cast("string")
    nested = F.struct(F.lit("①").alias("항번호"), pieces[0].alias("항내용"), F.array(
        F.struct(F.lit("1.").alias("호번호"), pieces[1].alias("호내용"), F.array(pieces[2]).alias("목"))).alias("호"))
    titled = F.pmod(number, F.lit(7)) == 0
    body = F.when(titled, F.to_json(F.struct(text("제목 ", key).alias("조문제목")))).otherwise(
        F.to_json(F.struct(text("본문 ", key).alias("조문내용"), F.array(nested).alias("항"))))
    dated = F.when(kind == 1, '"조문시행일자":"2024-05-06",').when(
        kind == 2, '"조문시행일자":["20200101","20210203"],').otherwise("")
    unit = text('{"조문여부":"조문","조문번호":"', key, '",', dated, F.substring(body, 2, 1 << 30))
    repealed = text('{"조문여부":"조문","조문번호":"', key, '","조문가지번호":"3","조문내용":"제', key, '조의3 삭제"}')
    holder = F.when(kind == 0, text('{"조문단위":[', unit, ",", repealed, "]}")).when(
        kind == 1, text('{"조문단위":', unit, "}")).when(kind == 2, text("[", repealed, ",", unit, "]")).otherwise(unit)
    dates = F.when(kind == 3, '"시행일":{"@시행일자":"20230405"}').otherwise('"시행일자":"20260101"')
    doc = text('{"법령":{', dates, ',"조문":', holder, "}}")
    return rows.select(text("법 ", key).alias("law_name"), doc.alias("doc"))


def shaped_sql(number: str, *pieces: str) -> str:
    trimmed = " || ".join(
        f"CASE WHEN trim({p}, {_BLANKS}) <> '' THEN chr(10) || trim({p}, {_BLANKS}) ELSE '' END" for p in pieces)
    return f"""'법' || {number} AS law_name_norm, CAST({number} AS VARCHAR) AS article_number_norm,
  CASE WHEN {number} % 7 = 0 THEN '제목 ' || {number} ELSE '본문 ' || {number} || {trimmed} END AS text,
  CASE {number} % 4 WHEN 0 THEN DATE '2026-01-01' WHEN 1 THEN DATE '2024-05-06'
    WHEN 2 THEN DATE '2021-02-03' ELSE DATE '2023-04-05' END AS enforcement_date"""


@query(f"SELECT {shaped_sql('doc_id', 'source', 'text', 'lang')} FROM documents")
def extract_shapes(spark, sf_dir):
    """Every shape of a law's articles, dates of law and article, titles, nested paragraphs."""
    docs = load(spark, sf_dir, "documents")
    found = extract(shaped_statutes(docs, F.col("doc_id"), *map(F.col, ("source", "text", "lang"))))
    return found.select("law_name_norm", "article_number_norm", "text", "enforcement_date")


def _target(spark, sf_dir):
    """The corpus before the sync: every law with its text as article 1 and a gone article 0."""
    return load(spark, sf_dir, "documents").select(
        F.concat(F.lit("c"), F.col("doc_id")).alias("chunk_id"),
        F.concat(F.lit("법 "), F.col("doc_id")).alias("law_name"),
        F.concat(F.lit("법"), F.col("doc_id")).alias("law_name_norm"),
        F.explode(F.array(F.lit("0"), F.lit("1"))).alias("article_number_norm"),
        F.lit("제1조").alias("article_number"), "text",
        F.lit(None).cast("date").alias("enforcement_date"),
        F.lit(1).cast("bigint").alias("created_at"), F.lit(1).cast("bigint").alias("updated_at"),
    )


@query(f"""WITH {_LINES_SQL}, incoming AS (
  SELECT doc_id * 2 AS doc_id, '법' || (doc_id * 2) AS law_name_norm, article_number_norm, text
  FROM articles),
target AS (SELECT doc_id, '법' || doc_id AS law_name_norm, a.n AS article_number_norm, text
  FROM documents, (VALUES ('0'), ('1')) AS a(n)),
merged AS (
  SELECT coalesce(t.doc_id, i.doc_id) AS doc_id, law_name_norm, article_number_norm,
         coalesce(i.text, t.text) AS text, CAST(CASE WHEN t.text IS NULL THEN 2 ELSE 1 END AS BIGINT)
           AS created_at, CAST(CASE WHEN i.text IS NULL THEN 1 ELSE 2 END AS BIGINT) AS updated_at,
         i.text IS NOT NULL AS fresh
  FROM target t FULL OUTER JOIN incoming i USING (law_name_norm, article_number_norm))
SELECT law_name_norm, article_number_norm, text, created_at, updated_at FROM merged
WHERE fresh OR doc_id NOT IN (SELECT doc_id FROM incoming)""")
def sync_corpus(spark, sf_dir):
    result = _sync(spark, sf_dir)
    return result.articles.select("law_name_norm", "article_number_norm", "text", "created_at",
                                  "updated_at")


def _sync(spark, sf_dir, **stores):
    documents = statutes(spark, sf_dir, step=2)  # half of the laws in the corpus, and as many new ones
    broken = load(spark, sf_dir, "pages").select(
        F.concat(F.lit("법 "), F.col("page_id")).alias("law_name"), F.col("html").alias("doc")
    )
    return sync(_target(spark, sf_dir), documents.unionByName(broken), F.lit(2).cast("bigint"), **stores)


_SYNC_SQL = f"""WITH {_LINES_SQL}, incoming AS (
  SELECT DISTINCT doc_id * 2 AS doc_id, '법' || (doc_id * 2) AS law_name_norm, article_number_norm, text
  FROM articles),
stored AS (SELECT doc_id, '법' || doc_id AS law_name_norm, a.n AS article_number_norm, text
  FROM documents, (VALUES ('0'), ('1')) AS a(n)),
merged AS (SELECT law_name_norm, article_number_norm, text FROM incoming UNION ALL
  SELECT law_name_norm, article_number_norm, text FROM stored
  WHERE doc_id NOT IN (SELECT doc_id FROM incoming)),
points AS (SELECT law_name_norm, article_number_norm, text FROM incoming UNION ALL
  SELECT law_name_norm, article_number_norm, text FROM stored
  WHERE article_number_norm = '1' AND doc_id NOT IN (SELECT doc_id FROM incoming)),
report AS (SELECT law_name_norm, coalesce(a.n, 0) AS count_a, coalesce(b.n, 0) AS count_b
  FROM (SELECT law_name_norm, count(*) AS n FROM merged GROUP BY 1) a
  FULL OUTER JOIN (SELECT law_name_norm, count(*) AS n FROM points GROUP BY 1) b USING (law_name_norm))"""


def _synced_stores(spark, sf_dir):
    """The sync with a vector store that lacks the gone articles of the corpus."""
    def embed(articles):
        return vectorize(articles, "text", 64)

    held = _target(spark, sf_dir).where("article_number_norm = '1'")
    keys = [F.col("law_name_norm"), F.col("article_number_norm")]
    points = vectorize(held, "text", 64).select(
        "law_name", *keys, "article_number", "text", "enforcement_date", "embedding",
        point_id(*keys).alias("point_id"))
    return _sync(spark, sf_dir, points=points, embed=embed)


@query(f"""{_SYNC_SQL} SELECT law_name_norm, article_number_norm, text, 64 AS dims,
  CAST('0x' || substr(md5(law_name_norm || ':' || article_number_norm), 1, 12) AS BIGINT) AS point_id FROM points""")
def sync_points(spark, sf_dir):
    return _synced_stores(spark, sf_dir).points.select(
        "law_name_norm", "article_number_norm", "text", F.size("embedding").alias("dims"), "point_id")


@query(f"{_SYNC_SQL} SELECT *, count_a = count_b AS matches FROM report")
def sync_report(spark, sf_dir):
    return _synced_stores(spark, sf_dir).report


@query(f"""{_SYNC_SQL} SELECT count(*) FILTER (WHERE count_a > 0) AS laws,
  CAST(sum(count_a) AS BIGINT) AS total_a, CAST(sum(count_b) AS BIGINT) AS total_b,
  count(*) FILTER (WHERE count_a <> count_b) AS mismatches,
  count(*) FILTER (WHERE count_a > 0 AND count_a <> count_b) = 0 AND sum(count_a) = sum(count_b) AS ok
FROM report""")
def sync_summary(spark, sf_dir):
    return _synced_stores(spark, sf_dir).summary


@query(f"""WITH {_LINES_SQL}, counts AS (SELECT doc_id, count(*) AS n FROM articles GROUP BY 1)
SELECT '법 ' || (d.doc_id * 2) AS law_name, coalesce(n, 0) AS articles,
       CASE WHEN n IS NULL THEN 'no_articles' ELSE 'synced' END AS status
FROM documents d LEFT JOIN counts USING (doc_id)
UNION ALL SELECT '법 ' || page_id, 0, 'failed' FROM pages""")
def sync_per_law(spark, sf_dir):
    return _sync(spark, sf_dir).per_law


@query("""SELECT doc_id, trim(lang) || chr(10) || source || CASE WHEN trim(text, ' ' || chr(9) ||
  chr(10) || chr(13)) <> '' THEN chr(10) || trim(text, ' ' || chr(9) || chr(10) || chr(13)) ELSE ''
  END AS flat FROM documents""")
def flatten_nodes(spark, sf_dir):
    node = F.to_json(F.struct(
        F.concat(F.lit(" "), "lang").alias("항내용"), F.lit("①").alias("항번호"),
        F.array(F.struct(F.col("doc_id").alias("n"), F.col("source").alias("호내용"),
                         F.array("text").alias("목"))).alias("호"),
    ))
    return load(spark, sf_dir, "documents").select("doc_id", flatten_text(node).alias("flat"))
