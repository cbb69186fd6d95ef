import numpy as np
import pytest

from lexframe.llm import quality_classifier as q


def test_held_out_rows_are_told_apart(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = q.classify(docs, labels)
    rows = scored.join(labels, "doc_id").where("held_out").select("score", "quality", "predicted").collect()
    assert scored.count() == docs.count()
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert auc > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_probabilities_are_calibrated_by_temperature():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(12000, 2 * q.DIM))
    y = (rng.random(12000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    model = q.train(x[:2000], y[:2000], epochs=30)
    x, y = x[2000:], y[2000:]  # rows that neither the layers nor the temperature have seen
    p = model.scores(x)
    for low in (0.1, 0.3, 0.5, 0.7):
        near = (p > low) & (p < low + 0.2)
        assert abs(y[near].mean() - p[near].mean()) < 0.12


@pytest.mark.parametrize("labelled", ["none", "one kind", "null"])
def test_odd_rows_and_labels(spark, odd_docs, labelled):
    rows = {"none": [], "one kind": [(1, 1), (5, 1)], "null": [(1, None), (None, 0)]}[labelled]
    labels = spark.createDataFrame(rows, "doc_id bigint, quality int")
    out = q.classify(odd_docs, labels).collect()
    assert len(out) == 9 and {r["score"] for r in out} == ({0.99} if labelled == "one kind" else {0.5})


def test_empty_tables(spark, no_docs):
    assert q.classify(no_docs, spark.createDataFrame([], "doc_id bigint, quality int")).count() == 0


def test_contexts_equal_a_plain_count(spark):
    texts = ["a b c a", "b", None, "", "c c b a d"]
    vectors = {}
    places, signs = q.index_vectors()
    for text in texts:
        slots = q.slots_of(text.encode() if text else None)
        for i, s in enumerate(slots):
            own = vectors.setdefault(int(s), np.zeros(q.DIM, int))
            for j in range(max(0, i - q.REACH), min(len(slots), i + q.REACH + 1)):
                if j != i:
                    np.add.at(own, places[slots[j]], signs[slots[j]])
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([t.encode() if t else None for t in texts], pa.binary())], names=["t"])
    (out,) = list(q._contexts(iter([batch])))
    got = {r["slot"]: np.array([r[f"c{k}"] for k in range(q.DIM)]) for r in out.to_pylist()}
    assert got.keys() == vectors.keys() and all((got[s] == vectors[s]).all() for s in got)


def test_pooling_against_plain_sums(spark, odd_docs):
    vectors = q.learn_vectors(odd_docs)
    for row in q.pool(odd_docs, vectors).collect():
        slots = [int(s) for s in q.slots_of(row["text"].encode() if row["text"] else None)]
        want = np.zeros(2 * q.DIM)
        if slots:
            weights = [float(vectors.weight[s]) for s in slots]
            want[:q.DIM] = sum(w * vectors.context[s].astype(float) for w, s in zip(weights, slots)) / sum(weights)
            want[q.DIM:] = sum(vectors.index[s].astype(float) for s in slots) / len(slots)
        assert np.allclose(row["features"], want, atol=1e-4)


def test_a_labelled_id_on_many_rows_counts_once(spark):
    rows = [(k, [float(k % 2), float(k)]) for k in range(90)] + [(2, [float(j), 9.0]) for j in range(500)]
    pooled = spark.createDataFrame(rows, "doc_id bigint, features array<float>")
    labels = spark.createDataFrame([(k, k % 2) for k in range(90)] + [(2, 0)] * 50, "doc_id bigint, quality int")
    once = spark.createDataFrame(rows[:90], pooled.schema).where("doc_id <> 2").unionByName(
        spark.createDataFrame([(2, [0.0, 2.0])], pooled.schema))
    a, b = q.fit(pooled, labels), q.fit(once, labels)
    assert a.layers and a.temperature == b.temperature
    assert all((x == y).all() for x, y in zip(a.layers, b.layers))


def test_few_labels_give_the_share():
    x = np.random.default_rng(0).normal(size=(19, 2 * q.DIM))
    y = np.arange(19) % 2
    assert set(q.train(x, y).scores(x).round(6)) == {round(9 / 19, 6)}
