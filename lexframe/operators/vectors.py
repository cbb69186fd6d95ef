"""Similarity search of a batch of query vectors in a vector table.

Both sides are packed into blocks where they are read and dealt to a grid of tasks: each holds one group of query blocks
of bounded size and lets one group of corpus blocks pass. Size and number of the blocks do not change the number of
jobs or tasks. A task scores tiles of a matrix product, multiplies equal scopes only, skips pairs of blocks that cannot
reach the scores found, and passes on the best ``k`` per query. An approximate search learns cells from a sample, stores
the corpus by cell and probes the nearest ones, which then are the scopes.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean_text
from ..session import pin
from .corpus import cache_merge, cache_misses
from .keyed import top_per_group

BLOCK_BYTES = 64 << 20
#: Packed bytes of the queries that a task holds at most, blocks being whole; the corpus passes in groups of up to eight times that.
HELD_BYTES = 32 << 20
#: Entries of term vectors that are counted at once.
PLACED_CELLS = 1 << 21
PLACED_BYTES = 4 << 20
PACK_ROWS = 2048
TILE = 2048
#: Queries and corpus rows of a screened tile, which stays in a core's cache.
SCREEN = (256, 1024)
#: Rows of a scope in a block up to which a product of its own is not worth it.
SMALL_SCOPE = 16
#: Bounds of what an index learns from, and the share of nearest neighbours its probes are planned for.
MAX_CELLS, SAMPLE_ROWS, RECALL = 4096, 1 << 17, 0.95
#: Rows whose cells are looked for at a time.
ROWS_IN_CELLS = 1024
#: Digits beyond which two sums of the same products differ. Ranks and thresholds use the rest.
NOISE_DIGITS = 12


def _values(column) -> np.ndarray:
    """Rows of an Arrow list column as a matrix; all rows have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.unique(pc.list_value_length(column)).to_pylist()
    if len(lengths) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(lengths)}")
    values = column.flatten().to_numpy(zero_copy_only=False)
    values = values if values.dtype == np.float32 else values.astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 1)


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows at unit length in double precision; zero rows stay."""
    rows = rows.astype(np.float64)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    norms[norms == 0.0] = 1.0
    return rows / norms


def _matrix(column) -> np.ndarray:
    return _unit(_values(column))


class _Best:
    """Running best ``k`` per query: score descending, then id ascending.

    Pairs are scored in tiles, so memory does not depend on how many queries or candidates come
    in. A candidate below the ``k``-th best score of its query so far is dropped at once, by a product
    in single precision less the most that it can be wrong; the others are scored in double precision.
    """

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.floor = np.full(n_queries, -np.inf)
        self.found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float64))]
        self.waiting = 0

    def add(self, places: np.ndarray, queries: np.ndarray, corpus: np.ndarray, ids: np.ndarray,
            allowed: np.ndarray | None = None) -> None:
        """Score all (or all allowed) pairs of a block; ``places`` are the numbers of its queries."""
        if queries.shape[1] != corpus.shape[1]:
            raise ValueError(f"queries have {queries.shape[1]} dimensions, the corpus {corpus.shape[1]}")
        slack = (queries.shape[1] + 4) * 2.0 ** -23 + 10.0 ** -NOISE_DIGITS
        rough, others = queries.astype(np.float32), corpus.astype(np.float32).T
        for q in range(0, len(queries), SCREEN[0]):
            own = places[q:q + SCREEN[0]]
            for c in range(0, len(corpus), SCREEN[1]):
                near = rough[q:q + SCREEN[0]] @ others[:, c:c + SCREEN[1]]
                if allowed is not None:
                    near[~allowed[q:q + SCREEN[0], c:c + SCREEN[1]]] = -np.inf
                least = self.floor[own] - slack
                cut, open_ = near.shape[1] - self.k, np.flatnonzero(np.isneginf(least))
                if cut > 0 and len(open_):
                    least[open_] = np.partition(near[open_], cut, axis=1)[:, cut] - 2 * slack
                at = np.flatnonzero((near >= least.astype(np.float32)[:, None]) & (near > -np.inf))
                if not len(at):
                    continue
                row, pick = np.divmod(at, near.shape[1])
                if len(at) > near.size // 64:
                    score = (queries[q:q + SCREEN[0]] @ corpus[c:c + SCREEN[1]].T).ravel()[at]
                else:
                    score = np.einsum("ij,ij->i", queries[q + row], corpus[c + pick])
                score = np.round(score, NOISE_DIGITS)
                good = score >= self.floor[own[row]]
                self.found.append((own[row[good]], ids[c + pick[good]], score[good]))
                self.waiting += int(good.sum())
        if self.waiting > len(self.floor) * self.k + (1 << 20):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cut what was found to the best ``k`` per query; (query, id, score), which the floors then follow."""
        if len(self.found) > 1:
            query, ids, score = (np.concatenate(parts) for parts in zip(*self.found))
            order = np.lexsort((ids, -score, query))
            place = np.arange(len(order)) - np.searchsorted(query[order], query[order], side="left")
            order, place = order[place < self.k], place[place < self.k]
            query, ids, score = query[order], ids[order], score[order]
            last = place == self.k - 1
            self.floor[query[last]] = score[last]
            self.found, self.waiting = [(query, ids, score)], 0
        return self.found[0]


def _scopes(column) -> dict:
    """Distinct scopes of a block, None for rows without a list, and a bit per scope and row."""
    none = pc.is_null(column).to_numpy(zero_copy_only=False)
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    coded = column.flatten().dictionary_encode()
    names = coded.dictionary.cast(pa.string()).to_pylist()
    code = pc.fill_null(coded.indices, len(names)).to_numpy(zero_copy_only=False)
    held = np.zeros((len(names) + 1, len(column)), bool)
    held[code, np.repeat(np.arange(len(column)), lengths)] = True
    held[-1, none] = True
    names, held = (names + [None], held) if held[-1].any() else (names, held[:-1])
    return {"names": names, "bits": np.packbits(held, axis=1).tobytes()}


def _pack(rows: int, block_bytes: int = BLOCK_BYTES):
    """Rows (id, scope list, embedding) -> blocks of up to ``rows`` and ``block_bytes``: ids, vectors and scopes as bytes, with
    the block's mean direction and the largest angle to it."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            width = len(batch.column(2).flatten()) * 8 // batch.num_rows
            most = max(1, min(rows, block_bytes // max(1, width)))
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                values = _values(part.column(2))
                unit = _unit(values)
                mean = unit.mean(axis=0)
                mean /= np.linalg.norm(mean) or 1.0
                # a zero vector scores zero with everything, a right angle to any mean
                radius = float(np.arccos(np.clip(unit @ mean, -1.0, 1.0)).max())
                yield pa.RecordBatch.from_arrays([
                    pa.array([part.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False).tobytes()], pa.binary()),
                    pa.array([values.tobytes()], pa.binary()),
                    pa.array([_scopes(part.column(1))], pa.struct([("names", pa.list_(pa.string())), ("bits", pa.binary())])),
                    pa.array([mean.tobytes()], pa.binary()), pa.array([radius], pa.float64()),
                ], names=["ids", "rows", "scopes", "mean", "radius"])

    return run


_BLOCK = "ids binary, rows binary, scopes struct<names: array<string>, bits: binary>, mean binary, radius double"
_SCHEMA = "query_id bigint, candidate_id bigint, score double"


class _Block:
    """One packed block, read back."""

    def __init__(self, ids: bytes, rows: bytes, scopes: dict, mean: bytes, radius: float):
        self.ids = np.frombuffer(ids, np.int64)
        self.mean, self.radius = np.frombuffer(mean, np.float64), radius
        single = len(rows) == 4 * len(self.ids) * len(self.mean)
        self.rows = _unit(np.frombuffer(rows, np.float32 if single else np.float64).reshape(len(self.ids), -1))
        self.scopes = {scope: at for at, scope in enumerate(scopes["names"])}
        self.bits = np.frombuffer(scopes["bits"], np.uint8).reshape(len(self.scopes), -1)

    def has(self, scope) -> np.ndarray:
        """Whether each row is in the scope."""
        return np.unpackbits(self.bits[self.scopes[scope]], count=len(self.ids)).view(bool)

    def of(self, scope) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and vectors of the rows in the scope."""
        at = np.flatnonzero(self.has(scope))
        return at, self.rows if len(at) == len(self.ids) else self.rows[at]

    def most(self, other: _Block) -> float:
        """No pair of the two blocks has a higher cosine."""
        if len(self.mean) != len(other.mean):
            raise ValueError(f"queries have {len(self.mean)} dimensions, the corpus {len(other.mean)}")
        apart = float(np.arccos(np.clip(self.mean @ other.mean, -1.0, 1.0))) - self.radius - other.radius
        return math.cos(max(0.0, apart)) + 10.0 ** -(NOISE_DIGITS - 3)


def _meet(block: _Block, best: _Best, chunk: _Block) -> None:
    """Score the pairs of equal scope of a query block and a chunk of the corpus.

    They are skipped when their bound is below the ``k``-th best score of every query of the block.
    """
    if chunk.most(block) < best.floor.min():
        return
    shared = [scope for scope in chunk.scopes if scope in block.scopes]
    if len(shared) * SMALL_SCOPE > len(chunk.ids) and len(shared) > 1:  # many small scopes: one product and a mask
        asks, number_of = np.zeros((len(block.ids), len(shared) + 1), bool), np.full(len(chunk.ids), len(shared))
        for i, scope in enumerate(shared):
            asks[:, i], number_of[chunk.has(scope)] = block.has(scope), i
        best.add(np.arange(len(block.ids)), block.rows, chunk.rows, chunk.ids, asks[:, number_of])
    else:
        for scope in shared:
            (own, queries), (at, rows) = block.of(scope), chunk.of(scope)
            best.add(own, queries, rows, chunk.ids[at])
    if best.waiting > len(best.floor) * best.k // 4:
        best.settle()


def _score(k: int):
    """Rows of a query block, of a chunk of the corpus, or of both -> the best ``k`` per query that this task has seen.

    A chunk meets the block of its row, or else all blocks that came before it.
    """

    def run(batches):
        asked: dict[int, tuple[_Block, _Best]] = {}
        for batch in batches:
            last, chunk = None, None
            for row in range(batch.num_rows):
                number = batch.column(0)[row].as_py()
                if number is not None and number not in asked:
                    block = _Block(*[batch.column(c)[row].as_py() for c in range(1, 6)])
                    asked[number] = block, _Best(len(block.ids), k)
                key = batch.column(6)[row].as_py()
                if key is None:
                    continue
                if key != last:
                    last, chunk = key, _Block(*[batch.column(c)[row].as_py() for c in range(7, 12)])
                for block, best in asked.values() if number is None else [asked[number]]:
                    _meet(block, best, chunk)
        for block, best in asked.values():
            query, ids, score = best.settle()
            yield pa.RecordBatch.from_arrays([
                pa.array(block.ids[query], pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.float64()),
            ], names=["query_id", "candidate_id", "score"])

    return run


def _grid(asked: tuple[int, int], held: tuple[int, int], slots: int) -> tuple[int, int]:
    """Groups of queries and of the corpus, from (bytes, blocks) of each: two tasks per slot, copying as little as possible,
    or as many as keep the groups within their bounds."""
    tasks = 2 * slots
    own = max(math.ceil(asked[0] / HELD_BYTES), min(tasks, round(math.sqrt(tasks * asked[0] / max(1, held[0])))), 1)
    own = min(own, max(1, asked[1]))
    other = max(math.ceil(tasks / own), math.ceil(held[0] / (8 * HELD_BYTES)))
    return own, min(other, max(1, held[1]))


def _search(queries: DataFrame, corpus: DataFrame, k: int, block_bytes: int, pack_rows: int) -> DataFrame:
    """Best ``k`` of every query among the corpus rows that share a scope with it.

    Both sides have (id, ``scopes``, ``embedding``); a null list of scopes meets null lists only.
    """
    spark = corpus.sparkSession

    def packed(df: DataFrame, side: str) -> tuple[DataFrame, tuple[int, int]]:
        # written, as a block that is packed again may hold other rows
        blocks = df.mapInArrow(_pack(pack_rows, block_bytes), _BLOCK)
        blocks = pin(blocks.select(F.monotonically_increasing_id().alias(f"{side}_number"),
                                   *[F.col(c).alias(f"{side}_{c}") for c in blocks.columns]), "vector-blocks")
        size = F.sum(F.octet_length(f"{side}_rows") + F.octet_length(f"{side}_scopes.bits"))
        return blocks, tuple(blocks.agg(F.coalesce(size, F.lit(0)), F.count("*")).first())

    (blocks, asked), (chunks, held) = packed(queries, "q"), packed(corpus, "c")
    own, other = _grid(asked, held, spark.sparkContext.defaultParallelism)

    def place(number: str, groups: int) -> Column:
        # blocks of a partition are numbered from a multiple of 2**33 on; they go round
        number = F.col(number)
        return F.pmod(F.shiftright(number, 33) + number.bitwiseAND(F.lit((1 << 33) - 1)), F.lit(groups)).cast("int")

    one = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(other - 1)))).withColumn(
        "cell", place("q_number", own) * other + F.col("other")).drop("other")
    two = chunks.withColumn("own", F.explode(F.sequence(F.lit(0), F.lit(own - 1)))).withColumn(
        "cell", F.col("own") * other + place("c_number", other)).drop("own")
    dealt = one.unionByName(two, allowMissingColumns=True).repartitionById(own * other, "cell")
    met = dealt.sortWithinPartitions(F.asc_nulls_first("c_number")).select(*blocks.columns, *chunks.columns)
    return best_per_query(met.mapInArrow(_score(k), _SCHEMA), k)


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int, scope: bool = False,
                block_bytes: int = BLOCK_BYTES, pack_rows: int = PACK_ROWS) -> DataFrame:
    """Best ``k`` corpus vectors of every query by cosine, ties by id.

    ``queries`` has ``query_id, embedding`` and ``corpus`` has ``candidate_id, embedding``. With
    ``scope`` both also have a string column ``scope`` and only equal scopes are compared; queries
    with a NULL scope then find nothing, and a query may be asked in several scopes. Vectors of
    different lengths are refused. Returns ``query_id, candidate_id, score, rank``.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        df = df.where(F.col("embedding").isNotNull())
        scopes = F.array("scope") if scope else F.lit(None).cast("array<string>")
        df = df.where(F.col("scope").isNotNull()) if scope else df
        return df.select(name, scopes.alias("scopes"), "embedding")

    return _search(side(queries, "query_id"), side(corpus, "candidate_id"), k, block_bytes, pack_rows)


def best_per_query(scored: DataFrame, k: int) -> DataFrame:
    """Rank candidates per query by score, ties by id, and keep ``k``."""
    order = [F.desc("score"), F.asc("candidate_id")]
    return top_per_group(scored, "query_id", order, k, rank="rank")


def score_threshold(hits: DataFrame, minimum: float) -> DataFrame:
    """Hits of the queries whose best score reaches ``minimum``."""
    passed = hits.where((F.col("rank") == 1) & (F.col("score") >= minimum)).select("query_id")
    return hits.join(passed, "query_id", "left_semi")


def payload_filter(points: DataFrame, **equal) -> DataFrame:
    """Equality on payload columns, applied before anything is scored."""
    for column, value in equal.items():
        if value is not None:
            points = points.where(F.col(column) == value)
    return points


@dataclass
class VectorIndex:
    """A corpus stored by cell: ``points`` (candidate_id, cell, embedding), the cells' centres, and how many to probe."""

    points: DataFrame
    centres: np.ndarray
    probes: int


def _lloyd(rows: np.ndarray, cells: int, rounds: int, seed: int) -> np.ndarray:
    """Centres of ``cells`` cells by cosine; a cell that loses all rows keeps its centre."""
    centres = rows[np.random.default_rng(seed).permutation(len(rows))[:cells]].copy()
    for _ in range(rounds):
        own = np.concatenate([(rows[at:at + TILE] @ centres.T).argmax(axis=1) for at in range(0, len(rows), TILE)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1.0), centres)
    return centres


def _probes_for(rows: np.ndarray, centres: np.ndarray, k: int, recall: float, asked: int = 512) -> int:
    """Cells to probe so that ``recall`` of the ``k`` nearest sample rows of sample rows lie in them."""
    cell = np.concatenate([(rows[at:at + TILE] @ centres.T).argmax(axis=1) for at in range(0, len(rows), TILE)])
    ranks = []
    for i in range(min(asked, len(rows))):
        scores = rows @ rows[i]
        scores[i] = -np.inf
        near = np.argpartition(-scores, min(k, len(rows) - 1))[: min(k, len(rows) - 1)]
        order = np.empty(len(centres), np.int64)
        order[np.argsort(-(centres @ rows[i]))] = np.arange(len(centres))
        ranks.append(order[cell[near]])
    ranks = np.concatenate(ranks)
    return int(np.quantile(ranks, recall)) + 1 if len(ranks) else len(centres)


def _with_cells(centres: np.ndarray, n: int):
    """Rows (id, embedding) with the ``n`` nearest cells, in any order."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_IN_CELLS):
                part = batch.slice(at, ROWS_IN_CELLS)
                side = _matrix(part.column(1)) @ centres.T
                if n == 1:
                    near = side.argmax(axis=1)
                else:
                    near = np.argpartition(-side, min(n, side.shape[1]) - 1, axis=1)[:, :n]
                ends = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * min(n, side.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(ends, pa.array(near.astype(np.int32).ravel())), part.column(1)],
                    names=[batch.schema.names[0], "cells", "embedding"],
                )

    return run


def _in_cells(df: DataFrame, centres: np.ndarray, n: int) -> DataFrame:
    name, kinds = df.columns[0], dict(df.dtypes)
    return df.mapInArrow(_with_cells(centres, n), f"{name} {kinds[name]}, cells array<int>, embedding {kinds['embedding']}")


def build_index(corpus: DataFrame, k: int = 10, cells: int | None = None, recall: float = RECALL,
                sample_rows: int = SAMPLE_ROWS, rounds: int = 8, seed: int = 7) -> VectorIndex:
    """Cells learned from a sample, and every corpus row written under its nearest cell.

    There are 16 cells per square root of the corpus unless given, ``MAX_CELLS`` at most. The sample, about ``sample_rows``
    rows chosen by the hash of their id, is all that reaches the driver. How many cells a search probes is read
    off the sample's own neighbours: as many as hold ``recall`` of the nearest ``k``.
    """
    corpus = corpus.select("candidate_id", "embedding").where(F.col("embedding").isNotNull())
    n = corpus.count()
    place = F.pmod(F.xxhash64("candidate_id"), F.lit(1 << 30))
    some = corpus.where(place < F.lit(1 << 30 if n <= sample_rows else sample_rows * (1 << 30) // n))
    sample = _matrix(some.orderBy("candidate_id").select("embedding").toArrow()["embedding"])
    cells = max(1, min(cells or int(16 * math.sqrt(n)), MAX_CELLS, len(sample)))
    if not len(sample):
        return VectorIndex(corpus.select("candidate_id", F.lit(0).alias("cell"), "embedding"), np.zeros((1, 1)), 1)
    centres = _lloyd(sample, cells, rounds, seed)
    placed = _in_cells(corpus, centres, 1).select("candidate_id", F.col("cells")[0].alias("cell"), "embedding")
    stored = placed.repartitionByRange("cell", "candidate_id").sortWithinPartitions("cell", "candidate_id")
    return VectorIndex(pin(stored, "vector-cells"), centres, min(cells, _probes_for(sample, centres, k, recall)))


def search_index(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None,
                 block_bytes: int = BLOCK_BYTES, pack_rows: int = PACK_ROWS) -> DataFrame:
    """Best ``k`` of every query in its ``probes`` nearest cells, ranked by exact cosine.

    A cell is a scope of the exact search, so only vectors of probed cells are multiplied.
    """
    asked = queries.select("query_id", "embedding").where(F.col("embedding").isNotNull())
    if index.points.isEmpty():
        return best_per_query(asked.sparkSession.createDataFrame([], _SCHEMA), k)
    probes = min(probes or index.probes, len(index.centres))
    asked = _in_cells(asked, index.centres, probes).select("query_id", F.col("cells").alias("scopes"), "embedding")
    points = index.points.select("candidate_id", F.array("cell").alias("scopes"), "embedding")
    return _search(asked, points, k, block_bytes, pack_rows)


def scanned_share(index: VectorIndex, queries: DataFrame, probes: int | None = None) -> DataFrame:
    """One row: ``share``, the part of all pairs of a query and a corpus row that a search multiplies."""
    asked = _in_cells(queries.select("query_id", "embedding").where(F.col("embedding").isNotNull()),
                      index.centres, min(probes or index.probes, len(index.centres)))
    tried = asked.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("q"))
    held = index.points.groupBy("cell").agg(F.count("*").alias("c"))
    pairs = held.join(tried, "cell", "left").agg(F.sum(F.col("c") * F.coalesce("q", F.lit(0))).alias("pairs"), F.sum("c").alias("c"))
    return pairs.crossJoin(asked.agg(F.count("*").alias("q"))).select((F.col("pairs") / (F.col("c") * F.col("q"))).alias("share"))


def approx_vector_topk(queries: DataFrame, corpus: DataFrame, k: int, cells: int | None = None,
                       probes: int | None = None, recall: float = RECALL, **limits) -> DataFrame:
    """Approximate search: the nearest learned cells choose the candidates, cosine ranks them.

    Builds an index for this one search; :func:`build_index` and :func:`search_index` keep it for more.
    :func:`recall_at_k` measures what is missed; with all cells probed nothing is.
    """
    return search_index(build_index(corpus, k, cells, recall), queries, k, probes, **limits)


def _with_buckets(bits: int, probes: int, seed: int):
    """Rows (id, embedding) with the bucket of their projections' signs, then those reached by flipping the least certain ones."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                rows = _values(batch.column(1)).astype(np.float64)
                # directions from a formula, so that any engine gets the same buckets
                place = np.arange(bits * rows.shape[1], dtype=np.float64).reshape(bits, -1) + 1
                side = rows @ np.sin(place * 12.9898 + seed).T
                weights = 1 << np.arange(bits, dtype=np.int64)
                own = ((side > 0) @ weights)[:, None]
                near = np.argsort(np.abs(side), axis=1)[:, :max(probes - 1, 0)]
                buckets = np.concatenate([own, own ^ weights[near]], axis=1).astype(np.int32)
                ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * buckets.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.ListArray.from_arrays(ends, pa.array(buckets.ravel())), batch.column(1)],
                    names=["id", "scopes", "embedding"],
                )

    return run


def hashed_vector_topk(queries: DataFrame, corpus: DataFrame, k: int, bits: int = 10, probes: int = 8, seed: int = 7,
                       block_bytes: int = BLOCK_BYTES, pack_rows: int = PACK_ROWS) -> DataFrame:
    """Approximate search without learning: random-projection buckets choose the candidates, cosine ranks them.

    There are ``2 ** bits`` buckets; raising ``probes`` to ``bits + 1`` widens the search to all one-bit neighbours.
    """
    def side(df: DataFrame, name: str, n: int) -> DataFrame:
        df = df.select(name, "embedding").where(F.col("embedding").isNotNull())
        kinds = dict(df.dtypes)
        return df.mapInArrow(_with_buckets(bits, n, seed), f"id {kinds[name]}, scopes array<int>, embedding {kinds['embedding']}")

    return _search(side(queries, "query_id", probes), side(corpus, "candidate_id", 1), k, block_bytes, pack_rows)


def recall_at_k(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits that the approximate search found."""
    found = approximate.select("query_id", "candidate_id", F.lit(1).alias("found"))
    joined = exact.join(found, ["query_id", "candidate_id"], "left")
    return joined.agg(
        F.count(F.lit(1)).alias("exact_hits"),
        F.count("found").alias("found_hits"),
        F.bround(F.count("found") / F.count(F.lit(1)), 4).alias("recall"),
    )


def _placed(texts: pa.Array, features: int):
    """(row, place) of every word of texts without nulls, as two arrays; a word is hashed once."""
    words = pc.utf8_split_whitespace(texts)
    row, flat = pc.list_parent_indices(words), pc.list_flatten(words)
    some = pc.not_equal(flat, "")
    coded = flat.filter(some).dictionary_encode()
    digests = b"".join(hashlib.md5(word.encode()).digest()[:4] for word in coded.dictionary.to_pylist())
    # four bits less than four bytes are seven hex digits
    places = (np.frombuffer(digests, ">u4") >> 4).astype(np.int64) % features
    return row.filter(some).to_numpy(zero_copy_only=False), places[coded.indices.to_numpy(zero_copy_only=False)]


def _counts(texts: pa.Array, features: int):
    """Words by place, a matrix with a row per text; few texts at a time where vectors or texts are long, as every word takes
    many times its bytes while it is placed."""
    step = max(1, min(PLACED_CELLS // features, len(texts) * PLACED_BYTES // max(1, texts.nbytes)))
    for first in range(0, len(texts), step):
        part = texts.slice(first, step)
        row, place = _placed(part, features)
        yield np.bincount(row * features + place, minlength=len(part) * features).reshape(len(part), features)


def vectorize(texts: DataFrame, text: str = "text", features: int = 256) -> DataFrame:
    """Unit-length term vectors (hashed counts weighted by rarity) for corpora without their own.

    A word's place is given by the first seven hex digits of its md5, its weight by
    ``ln((N + 1) / (n + 1))`` over all texts; a weight per place comes to the driver. A text without
    words, or with common ones only, has a zero vector.
    """
    @F.pandas_udf("array<int>")
    def distinct(rows: pd.Series) -> pd.Series:
        found = [np.flatnonzero(row) for counts in _counts(pa.array(rows, pa.string()), features) for row in counts]
        return pd.Series(found, dtype=object)

    cleaned = texts.withColumn("__cleaned", F.lower(clean_text(F.col(text))))
    total = F.count(F.lit(1)).alias("n")
    n_texts = texts.agg(total).first()[0]
    rare = cleaned.select(F.explode(distinct("__cleaned")).alias("at")).groupBy("at").agg(total)
    weights = np.zeros(features)
    for row in rare.collect():
        weights[row["at"]] = math.log((n_texts + 1) / (row["n"] + 1))

    @F.pandas_udf("array<float>")
    def unit(rows: pd.Series) -> pd.Series:
        made = []
        for counts in _counts(pa.array(rows, pa.string()), features):
            vectors = counts * weights
            norms = np.linalg.norm(vectors, axis=1, keepdims=True)
            made += list((vectors / np.where(norms, norms, 1.0)).astype(np.float32))
        return pd.Series(made, dtype=object)

    return cleaned.withColumn("embedding", unit("__cleaned")).drop("__cleaned")


def vectorize_missed(texts: DataFrame, cache: DataFrame, now: Column, text: str = "text",
                     features: int = 256) -> DataFrame:
    """The cache after the texts it lacked were vectorised: hash, text, vector and time.

    The texts are found once and written, as their words are counted before they are weighted. ``cache`` is read more
    than once; it is meant to be a stored table."""
    missed = vectorize(pin(cache_misses(texts, cache, text), "missed-texts"), "query_text", features)
    return cache_merge(cache, missed.withColumn("ts", now).select(*cache.columns))
