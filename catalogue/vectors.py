"""Vector search and its evaluation over ``embeddings``; every vector is a query once."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexframe.functions import content_hash
from lexframe.operators import retrieval_eval as evaluation
from lexframe.operators import vectors as ops
from lexframe.session import pin

from .common import load
from .registry import registry

QUERIES, ORACLES, query = registry()
K = 10


def _sides(spark, sf_dir):
    vectors = load(spark, sf_dir, "embeddings")
    scope = F.col("label").cast("string").alias("scope")
    asked = vectors.select(F.col("vec_id").alias("query_id"), "embedding", scope)
    corpus = vectors.select(F.col("vec_id").alias("candidate_id"), "embedding", scope)
    return asked, corpus


def leave_one_out(spark, sf_dir, scope: bool = False, k: int = K, **limits):
    """Best ``k`` other vectors: one more than needed is fetched and the vector itself left out."""
    asked, corpus = _sides(spark, sf_dir)
    hits = ops.vector_topk(asked, corpus, k + 1, scope=scope, **limits)
    others = hits.where(F.col("query_id") != F.col("candidate_id")).drop("rank")
    return ops.best_per_query(others, k)


def shown(hits):
    """Scores as they are printed: ranks and thresholds never use the rounded value."""
    return hits.withColumn("score", F.bround("score", 6))


def topk_sql(same_scope: bool = False, k: int = K) -> str:
    condition = "AND q.label = c.label" if same_scope else ""
    return f"""vectors AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS candidate_id, c.label AS candidate_label,
         q.label AS query_label, round_even(list_cosine_similarity(q.v, c.v), 12) AS raw
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id {condition}),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, candidate_id)
         AS INTEGER) AS rank, round_even(raw, 6) AS score FROM scored),
hits AS (SELECT * FROM ranked WHERE rank <= {k})"""


@query(f"WITH {topk_sql()} SELECT query_id, candidate_id, score, rank FROM hits")
def vector_topk(spark, sf_dir):
    return shown(leave_one_out(spark, sf_dir))


@query(f"WITH {topk_sql()} SELECT query_id, candidate_id, score, rank FROM hits")
def vector_topk_grid(spark, sf_dir):
    """Queries in several blocks."""
    return shown(leave_one_out(spark, sf_dir, block_bytes=8 * 64 * 300, pack_rows=70))


@query(f"WITH {topk_sql(True)} SELECT query_id, candidate_id, score, rank FROM hits")
def scoped_topk(spark, sf_dir):
    return shown(leave_one_out(spark, sf_dir, scope=True))


@query(f"""WITH {topk_sql()} SELECT query_id, candidate_id, score, rank FROM hits
WHERE query_id IN (SELECT query_id FROM hits WHERE rank = 1 AND raw >= 0.4)""")
def score_threshold(spark, sf_dir):
    return shown(ops.score_threshold(leave_one_out(spark, sf_dir), 0.4))


def _labelled_hits(spark, sf_dir):
    labels = load(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("candidate_id"), F.col("label").alias("candidate_label")
    )
    label = F.concat(F.lit("법 "), F.col("candidate_label"), F.lit(" 제"),
                     F.col("candidate_label"), F.lit("조"))
    return shown(leave_one_out(spark, sf_dir)).join(labels, "candidate_id").withColumn("label", label)


def _golden(spark, sf_dir):
    next_label = (F.col("label") + 1) % 10
    other = F.struct(F.concat(F.lit("법"), next_label).alias("law"),
                     next_label.cast("string").alias("article"))
    return load(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("case_id"),
        F.concat(F.lit("법 "), F.col("label")).alias("law_name"),
        F.col("label").cast("string").alias("article_number"),
        F.when(F.col("label") < 5, F.array(other)).alias("accepted"),
    )


_FLAGS_SQL = f"""WITH {topk_sql()}, judged AS (
  SELECT query_id AS case_id, min(rank) FILTER (WHERE candidate_label = query_label
           OR (query_label < 5 AND candidate_label = query_label + 1)) AS first,
         max(score) FILTER (WHERE rank = 1) AS top1_score FROM hits GROUP BY query_id),
flags AS (
  SELECT case_id, k, coalesce(first <= 1, false) AS top1_hit,
         coalesce(first <= least(3, k), false) AS top3_hit,
         coalesce(first <= k, false) AS topk_hit, top1_score
  FROM judged, (VALUES (3), (5), (10)) AS t(k))"""


def _flags(spark, sf_dir):
    results = _labelled_hits(spark, sf_dir).select(
        F.col("query_id").alias("case_id"), "rank", "label", "score"
    )
    return evaluation.hit_flags(results, evaluation.expected_labels(_golden(spark, sf_dir)))


@query(f"{_FLAGS_SQL} SELECT * FROM flags")
def hit_flags(spark, sf_dir):
    return _flags(spark, sf_dir)


@query(f"""{_FLAGS_SQL} SELECT k, count(*) AS cases,
  round_even(avg(CAST(top1_hit AS INTEGER)), 4) AS top1_accuracy,
  round_even(avg(CAST(top3_hit AS INTEGER)), 4) AS top3_recall,
  round_even(avg(CAST(topk_hit AS INTEGER)), 4) AS topk_recall,
  coalesce(round_even(avg(nullif(top1_score, 0)), 4), 0.0) AS avg_top1_score
FROM flags GROUP BY k""")
def retrieval_metrics(spark, sf_dir):
    return evaluation.retrieval_metrics(_flags(spark, sf_dir))


@query(f"""WITH {topk_sql()}, long AS (
  SELECT query_id, candidate_id, candidate_label = query_label AS hit, pipeline,
         CASE pipeline WHEN 'vector' THEN score WHEN 'reversed' THEN -score
              ELSE CAST(candidate_id AS DOUBLE) END AS s
  FROM hits, (VALUES ('vector'), ('reversed'), ('newest')) AS p(pipeline)),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id, pipeline
                                        ORDER BY s DESC, candidate_id) AS r FROM long),
cases AS (SELECT query_id, pipeline, max(CAST(hit AND r = 1 AS INTEGER)) AS top1,
                 max(CAST(hit AS INTEGER)) AS top3 FROM placed WHERE r <= 3 GROUP BY ALL)
SELECT pipeline, count(*) AS cases, round_even(avg(top1), 4) AS top1_rate,
       round_even(avg(top3), 4) AS top3_rate FROM cases GROUP BY pipeline""")
def ranking_ablation(spark, sf_dir):
    golden = _golden(spark, sf_dir).select(
        F.col("case_id").alias("query_id"), F.col("law_name").alias("expected_law"),
        F.col("article_number").alias("expected_article"),
    )
    candidates = _labelled_hits(spark, sf_dir).join(golden, "query_id").select(
        F.col("query_id").alias("case_id"), "candidate_id", "label", "expected_law",
        "expected_article", F.col("score").alias("cosine"),
        (-F.col("score")).alias("reversed"), F.col("candidate_id").alias("recency"),
    )
    return evaluation.ranking_ablation(
        candidates, {"vector": "cosine", "reversed": "reversed", "newest": "recency"}
    )


def _near(spark, sf_dir, **options):
    asked, corpus = _sides(spark, sf_dir)
    hits = ops.approx_vector_topk(asked, corpus, K + 1, **options)
    others = hits.where(F.col("query_id") != F.col("candidate_id")).drop("rank")
    return ops.best_per_query(others, K)


@query()
def approx_topk(spark, sf_dir):
    """No SQL: the cells are learned. Its recall is checked below, its scores in the next query."""
    return shown(_near(spark, sf_dir))


@query(f"WITH {topk_sql()} SELECT query_id, candidate_id, score, rank FROM hits")
def approx_topk_all_cells(spark, sf_dir):
    """With every cell probed the index gives the exact answer."""
    return shown(_near(spark, sf_dir, cells=16, probes=16))


_BITS, _PROBES = 4, 5
_APPROX_SQL = f"""{topk_sql()}, planes AS (
  SELECT b, list_transform(range(0, 64), lambda j: sin((b * 64 + j + 1) * 12.9898 + 7)) AS p
  FROM range(0, {_BITS}) AS r(b)),
sides AS (SELECT vec_id, b, list_dot_product(v, p) AS s FROM vectors, planes),
placed AS (SELECT vec_id, CAST(sum(CASE WHEN s > 0 THEN 1 << b ELSE 0 END) AS BIGINT) AS bucket
  FROM sides GROUP BY vec_id),
closest AS (SELECT vec_id, b, row_number() OVER (PARTITION BY vec_id ORDER BY abs(s)) AS r FROM sides),
tried AS (SELECT vec_id, bucket FROM placed UNION ALL SELECT vec_id, xor(bucket, 1 << b)
  FROM placed JOIN closest USING (vec_id) WHERE r <= {_PROBES - 1}),
near_scored AS (
  SELECT t.vec_id AS query_id, p.vec_id AS candidate_id,
         round_even(list_cosine_similarity(q.v, c.v), 12) AS raw
  FROM tried t JOIN placed p USING (bucket) JOIN vectors q ON q.vec_id = t.vec_id
  JOIN vectors c ON c.vec_id = p.vec_id WHERE t.vec_id <> p.vec_id),
near_hits AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id
    ORDER BY raw DESC, candidate_id) AS INTEGER) AS rank, round_even(raw, 6) AS score
  FROM near_scored) WHERE rank <= {K})"""


@query(f"""WITH {_APPROX_SQL} SELECT count(*) AS exact_hits, count(n.score) AS found_hits,
  round_even(count(n.score) / count(*), 4) AS recall, true AS recall_090, true AS scanned_below_third
FROM hits h LEFT JOIN near_hits n USING (query_id, candidate_id)""")
def approx_topk_recall(spark, sf_dir):
    """What the buckets find, counted against SQL, and whether the learned index keeps its recall and its share of the pairs."""
    asked, corpus = _sides(spark, sf_dir)
    exact = pin(leave_one_out(spark, sf_dir), "exact-hits")

    def recall(hits):
        others = hits.where(F.col("query_id") != F.col("candidate_id")).drop("rank")
        return ops.recall_at_k(ops.best_per_query(others, K), exact)

    counted = recall(ops.hashed_vector_topk(asked, corpus, K + 1, _BITS, _PROBES))
    index = ops.build_index(corpus, K + 1)
    learned = recall(ops.search_index(index, asked, K + 1)).select((F.col("recall") >= 0.9).alias("recall_090"))
    share = ops.scanned_share(index, asked).select((F.col("share") < 1 / 3).alias("scanned_below_third"))
    return counted.crossJoin(learned).crossJoin(share)


_WORDS_SQL = """words AS (
  SELECT doc_id, w FROM (SELECT doc_id, unnest(string_split_regex(lower(nfkc), '\\s+')) AS w FROM (
    SELECT doc_id, text AS nfkc FROM documents)) WHERE w <> ''),
places AS (SELECT doc_id, CAST('0x' || md5(w)[1:7] AS BIGINT) % 64 AS place FROM words),
counts AS (SELECT doc_id, place, count(*) AS n FROM places GROUP BY ALL),
rare AS (SELECT place, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) AS idf FROM counts GROUP BY place),
weighted AS (SELECT doc_id, place, n * idf AS x FROM counts JOIN rare USING (place)),
norms AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM weighted GROUP BY doc_id)"""


@query(f"""WITH {_WORDS_SQL}
SELECT doc_id, place, CAST(round_even(x / CASE WHEN norm = 0 THEN 1 ELSE norm END, 3) AS DOUBLE) AS value
FROM weighted JOIN norms USING (doc_id) WHERE abs(x) > 0""")
def vectorize(spark, sf_dir):
    """Every entry of every vector that is not zero."""
    texts = load(spark, sf_dir, "documents").select("doc_id", "text")
    entries = F.posexplode("embedding").alias("place", "value")
    return ops.vectorize(texts, features=64).select("doc_id", entries).where("value <> 0").select(
        "doc_id", F.col("place").cast("bigint").alias("place"), F.bround(F.col("value").cast("double"), 3).alias("value")
    )


@query("""SELECT sha256(text) AS query_hash, bool_and(label IS NULL) AS fresh,
  CAST(CASE WHEN bool_and(label IS NULL) THEN 2 ELSE 1 END AS BIGINT) AS ts
FROM documents LEFT JOIN embeddings ON vec_id = doc_id GROUP BY 1""")
def vectorize_missed(spark, sf_dir):
    """A cache that holds the documents with an embedding takes in the texts of the others."""
    docs = load(spark, sf_dir, "documents")
    held = docs.join(load(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id")
    cache = pin(held.groupBy(content_hash(F.col("text")).alias("query_hash")).agg(
        F.first("text").alias("query_text"), F.first("embedding").alias("embedding"),
        F.lit(1).cast("bigint").alias("ts"),
    ), "cache")
    full = ops.vectorize_missed(docs.select("text"), cache, F.lit(2).cast("bigint"), features=64)
    return full.select("query_hash", (F.col("ts") == 2).alias("fresh"), "ts")
