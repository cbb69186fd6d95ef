"""Merge, stale rows, reconciliation, keys, caches and exact lookup over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexframe.functions import content_hash, point_id
from lexframe.operators import corpus as ops
from lexframe.operators import lookup
from lexframe.operators.keyed import set_difference
from lexframe.session import scratch_path
from lexframe.sources.buckets import store_buckets

from .common import ARTICLES_SQL, LABELLED_SQL, articles, labelled, load
from .registry import registry

QUERIES, ORACLES, query = registry()


def _incoming(spark, sf_dir):
    """Amended labelled documents, a second amendment of the toxic ones, and pages as new law."""
    docs = labelled(spark, sf_dir)

    def amended(df, note, shift):
        return df.select(
            F.concat(F.lit("n"), F.col("doc_id") + shift).alias("chunk_id"),
            F.upper("source").alias("law_name"),
            F.col("source").alias("law_name_norm"),
            F.col("doc_id").cast("string").alias("article_number_norm"),
            F.concat(F.lit("제"), F.col("doc_id"), F.lit("조")).alias("article_number"),
            F.concat("text", F.lit(note)).alias("text"),
            F.lit(None).cast("date").alias("enforcement_date"),
            (F.col("doc_id") + shift).alias("position"),
        )

    pages = load(spark, sf_dir, "pages").select(
        F.concat(F.lit("p"), F.col("page_id")).alias("chunk_id"),
        F.lit("WEB").alias("law_name"), F.lit("web").alias("law_name_norm"),
        F.col("page_id").cast("string").alias("article_number_norm"),
        F.concat(F.lit("제"), F.col("page_id"), F.lit("조")).alias("article_number"),
        F.col("html").alias("text"), F.lit(None).cast("date").alias("enforcement_date"),
        F.col("page_id").alias("position"),
    )
    again = amended(docs.where("toxic = 1"), " (재개정)", 1_000_000_000)
    return amended(docs, " (개정)", 0).unionByName(again).unionByName(pages)


_INCOMING_SQL = f"""{LABELLED_SQL}, incoming AS (
  SELECT 'n' || doc_id AS chunk_id, upper(source) AS law_name, source AS law_name_norm,
         CAST(doc_id AS VARCHAR) AS article_number_norm, '제' || doc_id || '조' AS article_number,
         text || ' (개정)' AS text, CAST(NULL AS DATE) AS enforcement_date, doc_id AS position
  FROM labelled UNION ALL
  SELECT 'n' || (doc_id + 1000000000), upper(source), source, CAST(doc_id AS VARCHAR),
         '제' || doc_id || '조', text || ' (재개정)', NULL, doc_id + 1000000000
  FROM labelled WHERE toxic = 1 UNION ALL
  SELECT 'p' || page_id, 'WEB', 'web', CAST(page_id AS VARCHAR), '제' || page_id || '조', html,
         NULL, page_id FROM pages)"""


@query(f"""WITH {ARTICLES_SQL}, {_INCOMING_SQL}, fresh AS (
  SELECT law_name_norm, article_number_norm, arg_min(chunk_id, position) AS chunk_id,
         arg_min(law_name, position) AS law_name, arg_max(article_number, position) AS number,
         arg_max(text, position) AS text FROM incoming GROUP BY ALL)
SELECT CASE WHEN a.text IS NULL THEN f.chunk_id ELSE a.chunk_id END AS chunk_id,
       CASE WHEN a.text IS NULL THEN f.law_name ELSE a.law_name END AS law_name,
       law_name_norm, article_number_norm,
       CASE WHEN f.text IS NULL THEN a.article_number ELSE f.number END AS article_number,
       coalesce(f.text, a.text) AS text,
       CASE WHEN f.text IS NULL THEN a.enforcement_date END AS enforcement_date,
       CASE WHEN a.text IS NULL THEN CAST(2 AS BIGINT) ELSE a.created_at END AS created_at,
       CASE WHEN f.text IS NULL THEN a.updated_at ELSE CAST(2 AS BIGINT) END AS updated_at
FROM articles a FULL OUTER JOIN fresh f USING (law_name_norm, article_number_norm)""")
def merge_articles(spark, sf_dir):
    return ops.merge_articles(
        articles(spark, sf_dir), _incoming(spark, sf_dir), F.lit(2).cast("bigint")
    )


def _bucketed(df, name):
    return store_buckets(df, scratch_path(df.sparkSession, name))


@query(ORACLES["merge_articles"])
def merge_bucketed(spark, sf_dir):
    """The merge into a table that is stored by key."""
    stored = _bucketed(articles(spark, sf_dir), "articles")
    return ops.merge_articles(stored, _incoming(spark, sf_dir), F.lit(2).cast("bigint"))


def _current(spark, sf_dir):
    base = articles(spark, sf_dir).select("law_name_norm", "article_number_norm", "text")
    pages = load(spark, sf_dir, "pages").select(
        F.lit("web").alias("law_name_norm"),
        F.col("page_id").cast("string").alias("article_number_norm"),
        F.col("html").alias("text"),
    )
    return base.unionByName(pages)


_CURRENT_SQL = """current_rows AS (
  SELECT source AS law_name_norm, CAST(doc_id AS VARCHAR) AS article_number_norm, text FROM documents
  UNION ALL SELECT 'web', CAST(page_id AS VARCHAR), html FROM pages),
kept_rows AS (SELECT source AS law_name_norm, CAST(doc_id AS VARCHAR) AS article_number_norm
  FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))"""
_STALE_SQL = """law_name_norm IN (SELECT law_name_norm FROM kept_rows)
  AND (law_name_norm, article_number_norm) NOT IN
      (SELECT (law_name_norm, article_number_norm) FROM kept_rows)"""


def _kept(spark, sf_dir):
    return labelled(spark, sf_dir).select(
        F.col("source").alias("law_name_norm"),
        F.col("doc_id").cast("string").alias("article_number_norm"), "text",
    )


@query(f"""WITH {_CURRENT_SQL} SELECT law_name_norm, article_number_norm FROM current_rows
WHERE {_STALE_SQL}""")
def stale_articles(spark, sf_dir):
    stale = ops.stale_articles(_current(spark, sf_dir), _kept(spark, sf_dir))
    return stale.select("law_name_norm", "article_number_norm")


@query(f"""WITH {_CURRENT_SQL} SELECT law_name_norm, article_number_norm, text FROM current_rows
WHERE NOT ({_STALE_SQL})""")
def remove_stale(spark, sf_dir):
    return ops.remove_stale(_current(spark, sf_dir), _kept(spark, sf_dir))


@query(ORACLES["remove_stale"])
def remove_stale_bucketed(spark, sf_dir):
    return ops.remove_stale(_bucketed(_current(spark, sf_dir), "current"), _kept(spark, sf_dir))


_RECONCILE_SQL = f"""WITH {_CURRENT_SQL}, b_rows AS (
  SELECT law_name_norm FROM kept_rows UNION ALL SELECT 'web' FROM pages),
a AS (SELECT source AS law_name_norm, count(*) AS n FROM documents GROUP BY 1),
b AS (SELECT law_name_norm, count(*) AS n FROM b_rows GROUP BY 1),
report AS (SELECT law_name_norm, coalesce(a.n, 0) AS count_a, coalesce(b.n, 0) AS count_b
  FROM a FULL OUTER JOIN b USING (law_name_norm))"""


@query(f"""WITH {_CURRENT_SQL}, kept AS (SELECT *, 1 AS one FROM kept_rows UNION ALL
  SELECT 'web', CAST(page_id AS VARCHAR), 1 FROM pages WHERE page_id % 2 = 0 UNION ALL
  SELECT 'web', 'x' || page_id, 1 FROM pages)
SELECT law_name_norm, article_number_norm, CASE WHEN one IS NULL THEN 'a' ELSE 'b' END AS only_in
FROM current_rows FULL OUTER JOIN kept USING (law_name_norm, article_number_norm)
WHERE one IS NULL OR text IS NULL""")
def unmatched_articles(spark, sf_dir):
    """Two stores by key, compared article by article; neither is moved."""
    web = load(spark, sf_dir, "pages").select(
        F.lit("web").alias("law_name_norm"),
        F.explode(F.array(F.when(F.col("page_id") % 2 == 0, F.col("page_id").cast("string")),
                          F.concat(F.lit("x"), "page_id"))).alias("article_number_norm"),
    ).where("article_number_norm IS NOT NULL")
    b = _kept(spark, sf_dir).drop("text").unionByName(web)
    return ops.unmatched(_bucketed(_current(spark, sf_dir), "a"), _bucketed(b, "b"))


def _report(spark, sf_dir):
    web = _current(spark, sf_dir).where("law_name_norm = 'web'")
    return ops.reconcile(articles(spark, sf_dir), _kept(spark, sf_dir).unionByName(web))


@query(f"{_RECONCILE_SQL} SELECT *, count_a = count_b AS matches FROM report")
def reconcile(spark, sf_dir):
    return _report(spark, sf_dir)


@query(f"""{_RECONCILE_SQL} SELECT count(*) FILTER (WHERE count_a > 0) AS laws,
  CAST(sum(count_a) AS BIGINT) AS total_a, CAST(sum(count_b) AS BIGINT) AS total_b,
  count(*) FILTER (WHERE count_a <> count_b) AS mismatches,
  count(*) FILTER (WHERE count_a > 0 AND count_a <> count_b) = 0
    AND sum(count_a) = sum(count_b) AS ok FROM report""")
def reconcile_summary(spark, sf_dir):
    return ops.reconcile_summary(_report(spark, sf_dir))


_POINT_SQL = ("CAST('0x' || substr(md5({0} || ':' || CAST({1} AS VARCHAR)), 1, 12) AS BIGINT)")


@query(f"""SELECT {_POINT_SQL.format('source', 'doc_id')} AS point_id, doc_id FROM documents
WHERE {_POINT_SQL.format('source', 'doc_id')} NOT IN (
  SELECT {_POINT_SQL.format('source', 'doc_id')} FROM documents
  WHERE doc_id IN (SELECT doc_id FROM labels))""")
def stale_points(spark, sf_dir):
    key = point_id(F.col("source"), F.col("doc_id").cast("string")).alias("point_id")
    stored = load(spark, sf_dir, "documents").select(key, "doc_id")
    expected = labelled(spark, sf_dir).select(key)
    return set_difference(stored, expected, "point_id")


@query(f"""WITH points AS (
  SELECT vec_id AS point_id, round_even(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total,
         label FROM embeddings),
fresh AS (SELECT vec_id + 100 AS point_id, round_even(list_sum(CAST(embedding AS DOUBLE[])), 6)
          AS total, label FROM embeddings JOIN labels ON vec_id = doc_id)
SELECT * FROM points WHERE point_id NOT IN (SELECT point_id FROM fresh)
UNION ALL SELECT * FROM fresh""")
def upsert_vectors(spark, sf_dir):
    total = F.bround(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6)
    points = load(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "point_id")
    labels = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("point_id"))
    fresh = points.join(labels, "point_id").withColumn("point_id", F.col("point_id") + 100)
    merged = ops.upsert_vectors(points, fresh)
    return merged.select("point_id", total.alias("total"), "label")


@query(f"""WITH {LABELLED_SQL} SELECT DISTINCT sha256(text) AS query_hash, text AS query_text
FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM labelled)""")
def cache_misses(spark, sf_dir):
    cache = labelled(spark, sf_dir).select(content_hash(F.col("text")).alias("query_hash"))
    return ops.cache_misses(load(spark, sf_dir, "documents"), cache)


@query(f"""WITH {LABELLED_SQL}, rows AS (
  SELECT sha256(text) AS query_hash, doc_id, doc_id AS ts FROM documents UNION ALL
  SELECT sha256(text), -doc_id, doc_id + 1000000 FROM labelled)
SELECT query_hash, arg_max(doc_id, ts) AS doc_id, max(ts) AS ts FROM rows GROUP BY query_hash""")
def cache_merge(spark, sf_dir):
    key = content_hash(F.col("text")).alias("query_hash")
    # a cache holds a hash once
    cache = load(spark, sf_dir, "documents").groupBy(key).agg(
        F.max("doc_id").alias("doc_id"), F.max("doc_id").alias("ts")
    )
    new = labelled(spark, sf_dir).select(
        key, (-F.col("doc_id")).alias("doc_id"), (F.col("doc_id") + 1_000_000).alias("ts")
    )
    return ops.cache_merge(cache, new)


@query(f"""WITH {ARTICLES_SQL}, asked AS (
  SELECT doc_id AS question_id, 'src' || (doc_id % 20) AS law, CAST(doc_id AS VARCHAR) AS art
  FROM labels UNION ALL
  SELECT -1 - (conv_id * 1000 + turn), 'src' || (conv_id % 20),
         conv_id || CASE WHEN role = 'user' THEN '' ELSE '의2' END FROM conversations UNION ALL
  SELECT -1000000000 - page_id, NULL, NULL FROM pages)
SELECT question_id, law AS law_name_norm, art AS article_number_norm, a.text, a.enforcement_date,
       CASE WHEN law IS NULL THEN 'invalid' WHEN a.text IS NULL THEN 'not_found' ELSE 'found' END
         AS status
FROM asked LEFT JOIN articles a ON a.law_name_norm = law AND a.article_number_norm = art""")
def exact_lookup(spark, sf_dir):
    return _looked_up(spark, sf_dir, articles(spark, sf_dir))


def _looked_up(spark, sf_dir, stored):
    by_label = load(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("question_id"),
        F.concat(F.lit(" src "), F.col("doc_id") % 20).alias("name"),
        F.concat(F.lit("제"), F.col("doc_id"), F.lit("조")).alias("article"),
    )
    suffix = F.when(F.col("role") == "user", "조").otherwise("조의 2")
    by_turn = load(spark, sf_dir, "conversations").select(
        (-1 - (F.col("conv_id") * 1000 + F.col("turn"))).alias("question_id"),
        F.concat(F.lit("s·rc"), F.col("conv_id") % 20).alias("name"),
        F.concat(F.col("conv_id"), suffix).alias("article"),
    )
    blank = load(spark, sf_dir, "pages").select(
        (-1_000_000_000 - F.col("page_id")).alias("question_id"),
        F.when(F.col("page_id") % 2 == 0, " ").otherwise("src1").alias("name"),
        F.when(F.col("page_id") % 2 == 1, "").otherwise("제1조").alias("article"),
    )
    asked = by_label.unionByName(by_turn).unionByName(blank)
    found = lookup.exact_lookup(asked, stored)
    return found.select("question_id", "law_name_norm", "article_number_norm", "text",
                        "enforcement_date", "status")


@query(ORACLES["exact_lookup"])
def lookup_bucketed(spark, sf_dir):
    return _looked_up(spark, sf_dir, _bucketed(articles(spark, sf_dir), "articles"))


@query(f"""WITH {ARTICLES_SQL} SELECT printf('GS-%03d', item_id + 1) AS id,
  CASE WHEN length(b.text) > 200 THEN 'concept' ELSE 'standard' END AS question_type,
  'src' || (item_id % 20) AS law_name_norm, CAST(item_id * 7 AS VARCHAR) AS article_number_norm,
  b.text AS question, trim(a.text, ' ' || chr(9) || chr(10) || chr(13)) AS ground_truth,
  a.text IS NOT NULL AS matched
FROM benchmark b LEFT JOIN articles a ON a.law_name_norm = 'src' || (item_id % 20)
  AND a.article_number_norm = CAST(item_id * 7 AS VARCHAR)""")
def seed_golden(spark, sf_dir):
    kind = F.when(F.char_length("text") > 200, "concept").otherwise("standard")
    cases = load(spark, sf_dir, "benchmark").select(
        (F.col("item_id") + 1).alias("position"),
        F.concat(F.lit("src"), F.col("item_id") % 20).alias("law_name_norm"),
        (F.col("item_id") * 7).cast("string").alias("article_number_norm"),
        F.col("text").alias("question"), kind.alias("question_type"),
    )
    seeded = lookup.seed_golden(cases, articles(spark, sf_dir))
    return seeded.drop("law_name")


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'name' WHEN page_id % 3 = 1 THEN 'article' END
  AS reject_reason FROM pages""")
def rejected_requests(spark, sf_dir):
    kind = F.col("page_id") % 3
    asked = load(spark, sf_dir, "pages").select(
        "page_id", F.when(kind != 0, F.col("url")).alias("name"),
        F.when(kind == 1, " ").otherwise(F.col("html")).alias("article"),
    )
    return lookup.rejected_requests(asked).select("page_id", "reject_reason")
