"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer numpy network.

Word vectors come from all documents: a token falls into one of ``SLOTS`` slots by its crc32, each slot owns a
sparse random index vector, and a slot's context vector is the sum of the index vectors of its neighbours up to
``REACH`` places away. Tasks sum in memory and pass on one row per slot; the table of slots has a fixed size
(``SLOTS`` x ``DIM`` counts), whatever the corpus. A document is the frequency-damped mean of its tokens' context
vectors beside the mean of their index vectors, and nothing else.

The network is fitted on about ``FIT_ROWS`` labelled ids at most, outside the held-out third, those whose hash is
under a threshold, with one document each (of rows with equal ids the one of least features); a fifth of them sets the
temperature that calibrates the probabilities, against truths that keep one doubtful row per kind, so that perfectly
separated rows do not drive it to zero. Everything else covers all rows.

Defined results: a null or empty text has all-zero features and still gets a score; rows without a label or
with a null one are scored, not learned from; of several labels of an id the largest counts; without labels of
both kinds, or with fewer than ``MIN_ROWS`` labelled ids outside the held-out third, every score is the share of label 1 (0.5 with none at all); repeated rows score alike. Added
columns replace input columns of the same name.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexframe.llm.common import add_columns, held_out
from lexframe.session import pin

SLOTS = 1 << 14
DIM = 32
NONZERO = 4
REACH = 2
FIT_ROWS = 20_000
HIDDEN = 32
SEED = 7
MIN_ROWS = 20
_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x00-\x20]+")
_FLUSH = 1 << 19
_PLACES = 1 << 30


def slots_of(text: bytes | None) -> np.ndarray:
    tokens = _TOKEN.findall(text.lower()) if text else []
    return np.fromiter(map(zlib.crc32, tokens), np.uint32, len(tokens)).astype(np.int64) & (SLOTS - 1)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each slot's nonzero entries; one more slot, all zero, marks text ends."""
    rng = np.random.default_rng(SEED)
    places = rng.integers(0, DIM, (SLOTS + 1, NONZERO))
    signs = rng.choice(np.array([-1, 1]), (SLOTS + 1, NONZERO))
    signs[SLOTS] = 0
    return places, signs


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places, signs = index_vectors()
    sums = np.zeros((SLOTS + 1) * DIM, np.int64)
    seen = np.zeros(SLOTS + 1, np.int64)
    gap = np.full(REACH, SLOTS)
    waiting, size = [], 0

    def fold():
        row = np.concatenate(waiting)
        seen[:] += np.bincount(row, minlength=SLOTS + 1)
        for step in range(1, REACH + 1):
            for own, near in ((row[:-step], row[step:]), (row[step:], row[:-step])):
                for k in range(NONZERO):
                    weight = signs[near, k]
                    sums[:] += np.bincount(
                        own * DIM + places[near, k], weight, minlength=len(sums)
                    ).astype(np.int64)

    for batch in batches:
        for text in batch.column(0).to_pylist():
            waiting += [slots_of(text), gap]
            size += len(waiting[-2])
            if size > _FLUSH:
                fold()
                waiting, size = [], 0
    if waiting:
        fold()
    table = sums.reshape(-1, DIM)
    used = np.flatnonzero(seen[:SLOTS])
    yield pa.RecordBatch.from_arrays(
        [pa.array(used), pa.array(seen[used])] + [pa.array(table[used, k]) for k in range(DIM)],
        names=["slot", "n"] + [f"c{k}" for k in range(DIM)],
    )


@dataclass
class WordVectors:
    context: np.ndarray  # (SLOTS, DIM), unit rows
    index: np.ndarray  # (SLOTS, DIM), unit rows
    weight: np.ndarray  # (SLOTS,)


def learn_vectors(docs: DataFrame, text: str = "text") -> WordVectors:
    """Random-indexing vectors of all texts."""
    ddl = ", ".join(["slot bigint", "n bigint"] + [f"c{k} bigint" for k in range(DIM)])
    sums = docs.select(F.col(text).cast("binary")).mapInArrow(_contexts, ddl).groupBy("slot").agg(
        F.sum("n").alias("n"), *[F.sum(f"c{k}").alias(f"c{k}") for k in range(DIM)]
    )
    rows = sums.toPandas().sort_values("slot").to_numpy()  # at most SLOTS rows
    places, signs = index_vectors()
    index = np.zeros((SLOTS, DIM))
    for k in range(NONZERO):
        np.add.at(index, (np.arange(SLOTS), places[:SLOTS, k]), signs[:SLOTS, k])
    index /= np.maximum(np.linalg.norm(index, axis=1, keepdims=True), 1e-9)
    context, share = index.copy(), np.zeros(SLOTS)
    if len(rows):
        slot, n = rows[:, 0].astype(int), rows[:, 1]
        share[slot] = n / n.sum()
        unit = rows[:, 2:] / np.maximum(np.linalg.norm(rows[:, 2:].astype(float), axis=1, keepdims=True), 1e-9)
        unit = unit - (unit * share[slot, None]).sum(0)
        context[slot] = unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)
    return WordVectors(context.astype(np.float32), index.astype(np.float32), (1e-3 / (1e-3 + share)).astype(np.float32))


def features(text: bytes | None, vectors: WordVectors) -> np.ndarray:
    """Pooled context and index vectors of one text."""
    out = np.zeros(2 * DIM, np.float32)
    slots = slots_of(text)
    if not len(slots):
        return out
    used, n = np.unique(slots, return_counts=True)
    plain = n / len(slots)
    damped = n * vectors.weight[used]
    out[:DIM] = damped @ vectors.context[used] / damped.sum()
    out[DIM:2 * DIM] = plain @ vectors.index[used]
    return out


def pool(docs: DataFrame, vectors: WordVectors, text: str = "text") -> DataFrame:
    """``docs`` with ``features``."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def make():
        return lambda texts: [[features(t, shared.value) for t in texts]]

    return add_columns(docs, [text], "features array<float>", make)


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple
    temperature: float
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(x), np.log(self.prior / (1 - self.prior)))
        w1, b1, w2, b2 = self.layers
        return (np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2)[:, 0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, epochs: int = 120, batch: int = 256, rate: float = 3e-3) -> QualityModel:
    """Two layers by Adam on four fifths of the rows, the temperature on the last fifth."""
    prior = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    size = x.shape[1] if x.ndim == 2 else 2 * DIM
    nothing = QualityModel(np.zeros(size), np.ones(size), (), 1.0, prior)
    if len(set(y.tolist())) < 2 or len(y) < MIN_ROWS:
        return nothing
    mean, scale = x.mean(0), x.std(0) + 1e-3
    rng = np.random.default_rng(SEED)
    fit = np.arange(len(y)) % 5 != 0
    z, t = (x[fit] - mean) / scale, y[fit, None].astype(float)
    weights = [
        rng.normal(0, size ** -0.5, (size, HIDDEN)), np.zeros(HIDDEN),
        rng.normal(0, HIDDEN ** -0.5, (HIDDEN, 1)), np.zeros(1),
    ]
    first, second, step = [0 * w for w in weights], [0 * w for w in weights], 0
    for _ in range(epochs):
        order = rng.permutation(len(t))
        for at in range(0, len(t), batch):
            rows = order[at:at + batch]
            w1, b1, w2, b2 = weights
            hidden = np.tanh(z[rows] @ w1 + b1)
            out = 1 / (1 + np.exp(-np.clip(hidden @ w2 + b2, -40, 40)))
            d2 = (out - t[rows]) / len(rows)
            d1 = d2 @ w2.T * (1 - hidden ** 2)
            slopes = [z[rows].T @ d1 + 1e-4 * w1, d1.sum(0), hidden.T @ d2 + 1e-4 * w2, d2.sum(0)]
            step += 1
            for k, slope in enumerate(slopes):
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.999 * second[k] + 0.001 * slope ** 2
                weights[k] = weights[k] - rate * (first[k] / (1 - 0.9 ** step)) / (
                    np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    model = QualityModel(mean, scale, tuple(weights), 1.0, prior)
    raw, ones = model.logits(x[~fit]), int(y[~fit].sum())
    truth = np.where(y[~fit] == 1, (ones + 1) / (ones + 2), 1 / (len(raw) - ones + 2))
    losses = {}
    for temperature in np.geomspace(0.02, 50, 121):
        p = np.clip(1 / (1 + np.exp(-np.clip(raw / temperature, -40, 40))), 1e-9, 1 - 1e-9)
        losses[float(temperature)] = -(truth * np.log(p) + (1 - truth) * np.log(1 - p)).mean()
    model.temperature = min(losses, key=losses.get)
    return model


def fit(
    pooled: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", rows: int = FIT_ROWS
) -> QualityModel:
    """A model from ``pooled`` (id, features) and ``labels`` (id, label), about ``rows`` ids at most.

    They are chosen by a threshold on the hash of the id, so tasks pass on chosen rows only, and a repeated id counts once.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id))).groupBy(
        F.col(doc_id).alias("i")
    ).agg(F.max(label).cast("int").alias("y"))
    n = known.count()
    place = F.pmod(F.xxhash64("i"), F.lit(_PLACES))
    known = known.where(place < F.lit(_PLACES if n <= rows else rows * _PLACES // n))
    sample = pooled.select(F.col(doc_id).alias("i"), "features").join(known, "i").groupBy("i", "y").agg(
        F.min("features").alias("features")).collect()
    sample.sort(key=lambda r: (zlib.crc32(str(r["i"]).encode()), r["i"]))
    x = np.array([r["features"] for r in sample], np.float64)
    return train(x, np.array([r["y"] for r in sample], np.int64))


def score(pooled: DataFrame, model: QualityModel) -> DataFrame:
    """``pooled`` with ``score`` and ``predicted`` in place of the features."""
    shared = pooled.sparkSession.sparkContext.broadcast(model)

    def make():
        def one(rows):
            if not rows:
                return [[], []]
            p = shared.value.scores(np.array(rows, np.float64))
            return [p.tolist(), (p >= 0.5).astype(int).tolist()]

        return one

    return add_columns(pooled, ["features"], "score double, predicted int", make).drop("features")


def classify(
    docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", doc_id: str = "doc_id",
    rows: int = FIT_ROWS,
) -> DataFrame:
    """One row per document: id, ``held_out``, ``score``, ``predicted``. Texts are read twice; features are written."""
    vectors = learn_vectors(docs, text)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"))
    pooled = pin(pool(slim, vectors, "__text").drop("__text"), "quality-features")
    model = fit(pooled, labels.withColumnRenamed(doc_id, "doc_id"), label, "doc_id", rows)
    return score(pooled, model).select(
        F.col("doc_id").alias(doc_id), held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )
