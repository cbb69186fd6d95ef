"""Tiered retrieval: every vector asks a question, and every vector with its document is a point."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexframe import rules
from lexframe.functions import article_display
from lexframe.plans import retrieval as plans
from lexframe.session import pin, scratch_path
from lexframe.sources.tables import read_vectors as read

from .common import load, sql_first_of, sql_list
from .registry import registry

QUERIES, ORACLES, query = registry()

# The law of a label; the last one is a law the corpus names do not know.
LAWS = rules.KNOWN_NAMES + ["소방기본법"]


def _law(label):
    return F.element_at(F.array(*[F.lit(n) for n in LAWS]), (label + 1).cast("int"))


def points(spark, sf_dir):
    vectors = load(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return vectors.join(docs, "doc_id").select(
        F.col("doc_id").alias("point_id"), "embedding", _law(F.col("label")).alias("law_name"),
        _law(F.col("label")).alias("law_name_norm"),
        article_display(F.col("doc_id").cast("string")).alias("article_number"),
        F.col("doc_id").cast("string").alias("article_number_norm"),
        "text", F.lit(None).cast("date").alias("enforcement_date"),
    )


def questions(spark, sf_dir):
    """Six kinds of question, the kind decided by the vector's number."""
    law, number = _law(F.col("label")), F.col("vec_id").cast("string")
    # every second exact question asks for an article that is not there
    exact = (F.col("vec_id") + F.when(F.col("vec_id") % 12 == 0, 900_000).otherwise(0)).cast("string")
    kinds = [
        F.concat(law, F.lit(" 제"), exact, F.lit("조 내용은?")),
        F.concat(law, F.lit(" 알려줘")),
        F.concat(F.lit("비계 설치 안전 기준 "), number),
        F.concat(F.lit("소방기본법 "), number, F.lit("조")),
        F.concat(F.lit("오늘 점검할 내용은? "), number),
        F.concat(F.lit("안전 조치 위반 처벌 수위 "), number),
    ]
    kind = F.pmod("vec_id", F.lit(len(kinds))).cast("int") + 1
    return load(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("question_id"),
        F.element_at(F.array(*kinds), kind).alias("question"), "embedding",
    )


_NAMES = [([n], n) for n in rules.KNOWN_NAMES]
_BASE_SQL = f"""vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, list_extract([{sql_list(LAWS)}], label + 1) AS law
  FROM embeddings),
points AS (
  SELECT vec_id AS id, v, law, CAST(vec_id AS VARCHAR) AS art, text FROM vectors
  JOIN documents ON doc_id = vec_id),
asked AS (
  SELECT vec_id AS question_id, v, CASE vec_id % 6
    WHEN 0 THEN law || ' 제' || (vec_id + CASE WHEN vec_id % 12 = 0 THEN 900000 ELSE 0 END) || '조 내용은?'
    WHEN 1 THEN law || ' 알려줘'
    WHEN 2 THEN '비계 설치 안전 기준 ' || vec_id
    WHEN 3 THEN '소방기본법 ' || vec_id || '조'
    WHEN 4 THEN '오늘 점검할 내용은? ' || vec_id
    ELSE '안전 조치 위반 처벌 수위 ' || vec_id END AS question FROM vectors),
squeezed AS (SELECT *, replace(question, ' ', '') AS q FROM asked),
understood AS (
  SELECT question_id, v, question, {sql_first_of('q', _NAMES)} AS name,
         regexp_extract(question, '(?:제)?\\s*([0-9]+)\\s*조', 1) AS art,
         {sql_first_of('q', rules.SCOPE_RULES)} AS scope,
         regexp_matches(question, '[가-힣]{{2,15}}(?:법률|법|규칙|시행령)\\s*(?:제)?\\s*[0-9]+\\s*조')
           AS lawlike FROM squeezed),
read AS (SELECT *, name IS NULL AND art <> '' AND lawlike AS unknown FROM understood)"""


def _search_sql(source: str, scope: str) -> str:
    """``searched`` and ``hits``: scoped search, open search where the scope is weak or missing."""
    return f"""searched AS (SELECT question_id, v, {scope} AS scope, {source} AS widen FROM rest),
scored AS (
  SELECT s.question_id, p.id, p.law, p.art, p.text, p.law = s.scope AS inside,
         round_even(list_cosine_similarity(s.v, p.v), 12) AS score
  FROM searched s CROSS JOIN points p),
scoped AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS r
  FROM scored WHERE inside),
opened AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS r FROM scored),
weak AS (
  SELECT question_id FROM searched WHERE scope IS NULL OR (widen AND question_id NOT IN (
    SELECT question_id FROM scoped WHERE r = 1 AND score >= 0.45))),
hits AS (
  SELECT * FROM scoped WHERE r <= 5 AND question_id NOT IN (SELECT question_id FROM weak)
  UNION ALL SELECT * FROM opened WHERE r <= 5 AND question_id IN (SELECT question_id FROM weak))"""


_SERVICE_SQL = f"""WITH {_BASE_SQL},
rest AS (SELECT * FROM read WHERE name IS NULL OR art = ''),
{_search_sql('name IS NULL', 'coalesce(name, scope)')},
rounded AS (SELECT *, round_even(score, 4) AS score4 FROM hits),
best AS (SELECT question_id, max(score) AS top FROM hits GROUP BY question_id),
judged AS (
  SELECT r.question_id, b.top, r.name IS NOT NULL AND coalesce(b.top >= 0.5, false) AS named_ok,
         r.name IS NULL AND coalesce(b.top >= 0.45, false) AND NOT r.unknown AS wide_ok
  FROM rest r LEFT JOIN best b USING (question_id)),
listed AS (
  SELECT h.question_id,
         list(h.law || ' 제' || h.art || '조' ORDER BY h.r) AS labels,
         list(printf('%s:%s:%.4f:%d', h.law, h.art, h.score4, h.r) ORDER BY h.r) AS cited,
         any_value(h.law || '::1.0000:1') AS asked, bool_and(j.named_ok) AS named
  FROM rounded h JOIN judged j USING (question_id)
  WHERE j.wide_ok OR (j.named_ok AND h.r = 1) GROUP BY h.question_id)
SELECT d.question_id, CASE WHEN p.id IS NULL THEN '{{missing}}' ELSE 'answered' END AS status,
       'direct_article' AS query_type, CASE WHEN p.id IS NOT NULL THEN '{{found}}' END AS selected_source,
       CASE WHEN p.id IS NULL THEN [] ELSE [d.name || ' 제' || d.art || '조'] END
         AS selected_articles,
       CASE WHEN p.id IS NULL THEN [] ELSE [printf('%s:%s:1.0000:1', d.name, d.art)] END AS cited,
       false AS fallback_used, CAST(NULL AS DOUBLE) AS confidence_score
FROM read d LEFT JOIN points p ON p.law = d.name AND p.art = d.art
WHERE d.name IS NOT NULL AND d.art <> ''
UNION ALL
SELECT j.question_id, CASE WHEN named_ok OR wide_ok THEN 'answered' ELSE 'web_fallback' END,
       'semantic', CASE WHEN named_ok OR wide_ok THEN 'qdrant' ELSE 'web' END,
       coalesce(l.labels, []), coalesce({{cited}}, []), NOT (named_ok OR wide_ok),
       CASE WHEN wide_ok THEN round_even(top, 6) END
FROM judged j LEFT JOIN listed l USING (question_id)"""


def _service_sql(cited: str = "l.cited", found: str = "pg", missing: str = "not_found") -> str:
    return (_SERVICE_SQL.replace("{cited}", cited).replace("{found}", found)
            .replace("{missing}", missing))


def _service(spark, sf_dir, **options):
    corpus = pin(points(spark, sf_dir), "points")  # a stored collection, as the service has
    found = plans.tiered_retrieve(questions(spark, sf_dir), corpus, corpus, **options)
    cited = F.transform("citations", lambda c: F.concat_ws(
        ":", c["law_name"], c["article_number"], c["score"].cast("decimal(6,4)").cast("string"),
        c["rank"].cast("string"),
    ))
    return found.withColumn("cited", cited).drop("citations").withColumn(
        "confidence_score", F.bround("confidence_score", 6))


@query(_service_sql())
def tiered_retrieve(spark, sf_dir):
    return _service(spark, sf_dir)


@query(_service_sql(cited="CASE WHEN l.named THEN [l.asked] ELSE l.cited END"))
def tiered_retrieve_compat(spark, sf_dir):
    """A named law's hit is cited as the law that was asked for."""
    return _service(spark, sf_dir, compat=True)


@query(_service_sql(found="qdrant", missing="unavailable"))
def tiered_retrieve_unavailable(spark, sf_dir):
    """The article store is down: exact questions are answered from the points."""
    return _service(spark, sf_dir, available=False)


@query(f"""WITH {_BASE_SQL},
direct AS (
  SELECT r.question_id, trim(p.text, ' ' || chr(9) || chr(10) || chr(13)) AS text,
         r.name || ' 제' || r.art || '조' AS label
  FROM read r JOIN points p ON p.law = r.name AND p.art = r.art),
rest AS (SELECT * FROM read WHERE question_id NOT IN (SELECT question_id FROM direct)),
{_search_sql('true', 'scope')},
listed AS (
  SELECT question_id, list(law || ' 제' || art || '조' ORDER BY r) AS labels,
         list(trim(text, ' ' || chr(9) || chr(10) || chr(13)) ORDER BY r) AS texts
  FROM hits WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '' GROUP BY question_id)
SELECT question_id, [text] AS contexts, [label] AS retrieved_articles FROM direct
UNION ALL SELECT r.question_id, coalesce(texts, []), coalesce(labels, [])
FROM rest r LEFT JOIN listed l USING (question_id)""")
def tiered_retrieve_eval(spark, sf_dir):
    corpus = pin(points(spark, sf_dir), "points")  # a stored collection, as the service has
    return plans.tiered_retrieve(questions(spark, sf_dir), corpus, corpus, mode="eval")


@query(f"""WITH {_BASE_SQL} SELECT id AS point_id, law AS law_name, art AS article_number_norm
FROM points WHERE law = '{rules.KNOWN_NAMES[3]}'""")
def read_vectors(spark, sf_dir):
    """Payload of one law's points; neither vectors nor other laws are read."""
    path = scratch_path(spark, "points")
    points(spark, sf_dir).write.parquet(path)
    found = read(spark, path, with_vectors=False, law_name_norm=rules.KNOWN_NAMES[3])
    return found.select("point_id", "law_name", "article_number_norm")
