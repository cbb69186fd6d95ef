"""Vector search against brute force, with one and with many blocks of queries."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

import catalogue
from lexframe.operators import vectors as ops

DIMS = 12


def made(spark, n, seed, prefix, scopes=None):
    rng = np.random.default_rng(seed)
    matrix = rng.standard_normal((n, DIMS)).astype(np.float32)
    matrix[n // 2] = matrix[0]  # an exact copy, so scores tie
    scope = [None if scopes is None else scopes(i) for i in range(n)]
    rows = [(i, matrix[i].tolist(), scope[i]) for i in range(n)]
    return matrix.astype(np.float64), scope, spark.createDataFrame(
        rows, f"{prefix}_id long, embedding array<float>, scope string")


def brute(queries, corpus, k, query_scope=None, corpus_scope=None):
    q = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    c = corpus / np.linalg.norm(corpus, axis=1, keepdims=True)
    scores = np.round(q @ c.T, 12)
    out = set()
    for i in range(len(q)):
        allowed = [j for j in range(len(c)) if query_scope is None
                   or query_scope[i] == corpus_scope[j]]
        best = sorted(allowed, key=lambda j: (-scores[i, j], j))[:k]
        out |= {(i, j, round(float(scores[i, j]), 6) + 0.0, r) for r, j in enumerate(best, 1)}
    return out


def rows(df):
    return {(r.query_id, r.candidate_id, round(r.score, 6) + 0.0, r["rank"]) for r in df.collect()}


WAYS = [{}, {"block_bytes": 8 * DIMS * 16, "pack_rows": 7}, {"block_bytes": 1000, "pack_rows": 1}]


@pytest.mark.parametrize("way", WAYS)
def test_topk(spark, way):
    q, _, queries = made(spark, 40, 1, "query")
    c, _, corpus = made(spark, 150, 2, "candidate")
    assert rows(ops.vector_topk(queries, corpus.repartition(5), 7, **way)) == brute(q, c, 7)


@pytest.mark.parametrize("way", WAYS)
def test_scoped_topk_with_a_hot_scope(spark, way):
    def hot(i):
        return "hot" if i % 3 else f"s{i % 5}"

    q, qs, queries = made(spark, 40, 3, "query", hot)
    c, cs, corpus = made(spark, 150, 4, "candidate", hot)
    found = ops.vector_topk(queries, corpus.repartition(4), 5, scope=True, **way)
    assert rows(found) == brute(q, c, 5, qs, cs)


@pytest.mark.parametrize("way", WAYS)
def test_fewer_candidates_than_k_and_empty_sides(spark, way):
    q, _, queries = made(spark, 3, 5, "query")
    c, _, corpus = made(spark, 4, 6, "candidate")
    assert rows(ops.vector_topk(queries, corpus, 50, **way)) == brute(q, c, 50)
    assert ops.vector_topk(queries, corpus.where("candidate_id < 0"), 5, **way).count() == 0
    assert ops.vector_topk(queries.where("query_id < 0"), corpus, 5, **way).count() == 0


def test_zero_vector_scores_zero(spark):
    queries = spark.createDataFrame([(0, [0.0, 0.0])], "query_id long, embedding array<float>")
    corpus = spark.createDataFrame([(1, [1.0, 0.0])], "candidate_id long, embedding array<float>")
    assert rows(ops.vector_topk(queries, corpus, 1)) == {(0, 1, 0.0, 1)}


def test_approximate_search_with_all_cells_is_exact(spark):
    q, _, queries = made(spark, 60, 7, "query")
    c, _, corpus = made(spark, 300, 8, "candidate")
    found = ops.approx_vector_topk(queries, corpus.repartition(3), 5, cells=20, probes=20)
    assert rows(found) == brute(q, c, 5)
    narrow = ops.recall_at_k(ops.approx_vector_topk(queries, corpus, 5, cells=20, probes=1), ops.vector_topk(queries, corpus, 5))
    assert 0.0 < narrow.first().recall < 1.0


def test_index_has_its_recall_on_a_small_part_of_grouped_vectors(spark):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((40, DIMS))
    matrix = (centres[rng.integers(0, 40, 4000)] + 0.3 * rng.standard_normal((4000, DIMS))).astype(np.float32)
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], "candidate_id long, embedding array<float>")
    queries = corpus.where("candidate_id % 20 = 0").withColumnRenamed("candidate_id", "query_id")
    index = ops.build_index(corpus.repartition(4), k=10, sample_rows=1500)
    exact, found = ops.vector_topk(queries, corpus, 10), ops.search_index(index, queries, 10)
    assert ops.recall_at_k(found, exact).first().recall >= 0.9
    assert ops.scanned_share(index, queries).first().share < 0.15
    assert index.points.count() == 4000 and index.probes < len(index.centres)


def test_blocks_that_cannot_help_are_skipped(spark, monkeypatch):
    near = np.array([[1.0, 0.01 * i] for i in range(50)])
    far = np.array([[-1.0, 0.01 * i] for i in range(50)])
    made_blocks = []
    for side in (near, far):
        batch = pa.RecordBatch.from_arrays([
            pa.array(range(50), pa.int64()), pa.array([None] * 50, pa.list_(pa.string())), pa.array(side.tolist(), pa.list_(pa.float64())),
        ], names=["id", "scopes", "embedding"])
        made_blocks.append(next(ops._pack(100)([batch])).to_pylist()[0])
    first, second = (ops._Block(*b.values()) for b in made_blocks)
    assert first.most(first) >= 1.0 and first.most(second) < -0.5
    scored = []
    add = ops._Best.add
    monkeypatch.setattr(ops._Best, "add", lambda self, *a: (scored.append(1), add(self, *a)))
    rows_in = [[0, *made_blocks[0].values(), n, *made_blocks[k].values()] for n, k in enumerate((0, 1, 1, 1))]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows_in)], names=[f"c{i}" for i in range(12)])
    assert sum(b.num_rows for b in ops._score(5)([batch])) == 250 and len(scored) == 1


def test_empty_index(spark):
    nothing = spark.createDataFrame([], "candidate_id long, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert ops.approx_vector_topk(asked, nothing, 3).count() == 0
    full = asked.withColumnRenamed("query_id", "candidate_id")
    assert ops.approx_vector_topk(asked.limit(0), full, 3).count() == 0


def test_threshold_and_payload_filter(spark):
    hits = spark.createDataFrame(
        [(1, 10, 0.6, 1), (1, 11, 0.2, 2), (2, 10, 0.4, 1)],
        "query_id long, candidate_id long, score double, rank int")
    assert {r.query_id for r in ops.score_threshold(hits, 0.5).collect()} == {1}
    assert ops.payload_filter(hits, query_id=2, rank=None).count() == 1


def test_large_ids_and_full_scores(spark):
    big = 1 << 59
    queries = spark.createDataFrame([(big + 1, [1.0, 0.0]), (big + 3, [0.0, 1.0])],
                                    "query_id long, embedding array<double>")
    near = 0.4499996
    corpus = spark.createDataFrame([(big + 7, [near, (1 - near ** 2) ** 0.5])],
                                   "candidate_id long, embedding array<double>")
    found = ops.approx_vector_topk(queries, corpus, 1).collect()
    assert {r.query_id for r in found} == {big + 1, big + 3} and {r.candidate_id for r in found} == {big + 7}
    hits = ops.vector_topk(queries.limit(1), corpus, 1)
    assert ops.score_threshold(hits, 0.45).count() == 0


def test_mixed_dimensions_are_refused(spark):
    mixed = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0, 4.0, 5.0])],
                                  "candidate_id long, embedding array<double>").coalesce(1)
    asked = mixed.where("candidate_id = 1").withColumnRenamed("candidate_id", "query_id")
    with pytest.raises(Exception, match="different lengths|dimensions"):
        ops.vector_topk(asked, mixed, 1).collect()


def test_small_blocks_need_no_more_jobs(spark):
    q, _, queries = made(spark, 60, 10, "query")
    c, _, corpus = made(spark, 60, 11, "candidate")
    jobs = []
    for n, way in enumerate(({}, {"block_bytes": 1000, "pack_rows": 5})):
        spark.sparkContext.setJobGroup(f"blocks-{n}", "search")
        assert rows(ops.vector_topk(queries, corpus, 5, **way)) == brute(q, c, 5)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"blocks-{n}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] + 2


def test_groups_of_the_grid_are_bounded():
    for queries, corpus in ((1 << 20, 1 << 40), (1 << 40, 1 << 20), (1 << 33, 1 << 33)):
        own, other = ops._grid((queries, 1 << 30), (corpus, 1 << 30), 12)
        assert queries / own <= ops.HELD_BYTES and corpus / other <= 8 * ops.HELD_BYTES
    assert ops._grid((0, 0), (0, 0), 12) == (1, 1)


def test_screening_keeps_what_single_precision_cannot_tell_apart():
    rng = np.random.default_rng(12)
    one = ops._unit(rng.standard_normal((1, 64)))
    corpus = ops._unit(one + 1e-9 * rng.standard_normal((3000, 64)))
    best = ops._Best(1, 7)
    for at in range(0, 3000, 500):
        best.add(np.arange(1), one, corpus[at:at + 500], np.arange(at, at + 500))
        best.settle()
    scores = np.round((corpus @ one.T)[:, 0], ops.NOISE_DIGITS)
    assert best.settle()[1].tolist() == np.lexsort((np.arange(3000), -scores))[:7].tolist()


def test_bucket_search_is_exact_with_all_buckets_and_the_recall_query_counts_what_is_found(spark):
    q, _, queries = made(spark, 40, 13, "query")
    c, _, corpus = made(spark, 200, 14, "candidate")
    near = ops.hashed_vector_topk(queries, corpus, 5, bits=1, probes=2)
    assert rows(near) == brute(q, c, 5)
    few = ops.recall_at_k(ops.hashed_vector_topk(queries, corpus, 5, bits=4, probes=1), ops.vector_topk(queries, corpus, 5))
    assert 0.0 < few.first().recall < 1.0
    sql = catalogue.all_oracles()["approx_topk_recall"]
    assert "count(n.score) AS found_hits" in sql and "AS recall," in sql


def test_words_are_placed_alike_whatever_is_counted_at_once(monkeypatch):
    texts = pa.array(["a b\u3000b\x85c", "", " \x1c", "b"])
    whole, *rest = ops._counts(texts, 8)
    assert not rest and whole.sum(axis=1).tolist() == [4, 0, 0, 1]
    monkeypatch.setattr(ops, "PLACED_CELLS", 9)
    assert np.array_equal(np.vstack(list(ops._counts(texts, 8))), whole)
    assert list(ops._counts(texts.slice(0, 0), 8)) == []


def test_vectorize_places_and_weights(spark):
    texts = ["a b\u3000b\u2028 c ", "", None, " B\x1ca\ta", "\ufb01x d"]
    rows = ops.vectorize(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), features=8).collect()
    split = [["a", "b", "b", "c"], [], [], ["ba", "a"], ["fix", "d"]]
    at = [[int(hashlib.md5(w.encode()).hexdigest()[:7], 16) % 8 for w in ws] for ws in split]
    held = [sum(p in ps for ps in at) for p in range(8)]
    for row in rows:
        want = np.array([at[row.id].count(p) * np.log(6 / (held[p] + 1)) for p in range(8)])
        want /= np.linalg.norm(want) or 1
        assert np.allclose(row.embedding, want, atol=1e-6)


def test_long_texts_are_placed_few_at_a_time():
    texts = pa.array(["가 나 " * 100_000, "다", "", "나 나"] * 8)
    parts = list(ops._counts(texts, 8))
    assert len(parts) > 1 and np.array_equal(np.concatenate(parts), np.concatenate([next(ops._counts(texts[i:i + 1], 8)) for i in range(32)]))
