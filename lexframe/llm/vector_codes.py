"""Vector code compression: integer codebooks per part of the vector, entries found through a GNAT.

A component x becomes floor(4096 * x); a vector is cut into ``PARTS`` equal consecutive parts, each with its own
codebook of ``ENTRIES`` entries. The codebooks start as the parts of the vectors with the smallest ids and go
through ``ROUNDS`` rounds of assignment and componentwise floor means. All arithmetic that decides is done on
integers, so the result does not depend on how rows are dealt to tasks.

The nearest entry of a part comes from a geometric near-neighbour access tree over the codebook: a node holds a few
split points, chosen far from each other, the other entries hang below their nearest split point, and for every
split point and every subtree the smallest and largest distance between them is stored. A query that knows its distance ``d``
to a split point and its best distance ``r`` so far skips a subtree when ``d - r`` is above the largest or ``d + r``
below the smallest distance, with a margin for the rounding of the roots; what is skipped is strictly farther,
ties are settled by exact integer distances and the lower index. A batch of rows walks the tree together.

Spark's part: the integer vectors are written once, each round is a scan whose tasks pass on one row per part and
entry (sums as limbs of ``LIMB`` bits, so that no sum overflows), and only those ``PARTS * ENTRIES`` rows reach the driver.

Defined results: a vector that is null, empty, or holds a null or non-finite component is dropped; so is one whose length is not
the table's most frequent one (of equally frequent ones the greater). A length that ``PARTS`` does not divide is
filled up with zeros. With fewer than ``ENTRIES`` vectors the codebooks have as many entries as there are vectors; repeated rows
are coded alike; a null id is no seed unless ids run out; of equal ids the smaller vector comes first. Errors beyond a
long are the greatest long. An empty table gives an empty result and the hash of no entries. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexframe.session import pin

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
ARITY = 4
LEAF = 3
#: Sums travel as limbs of so many bits; floats below 2**128 times ``SCALE`` need four.
LIMB, LIMBS = 40, 4
_MOST = (1 << 63) - 1
#: Relative margin around distances taken as roots of integers.
_MARGIN = 1e-12


def squared(rows: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to one entry."""
    off = rows - entry
    return (off * off).sum(axis=1)


class Gnat:
    """Split points with the distance ranges from each of them to each subtree, over the rows of ``entries``."""

    def __init__(self, entries: np.ndarray, members: list[int] | None = None):
        members = list(range(len(entries))) if members is None else members
        self.entries, self.bucket, self.splits, self.children = entries, [], [], []
        if len(members) <= LEAF:
            self.bucket = members
            return
        apart = {m: self._far(m, members) for m in members}
        self.splits = [members[0]]
        while len(self.splits) < min(ARITY, len(members)):
            rest = [m for m in members if m not in self.splits]
            self.splits.append(max(rest, key=lambda m: (min(apart[s][m] for s in self.splits), -m)))
        below: list[list[int]] = [[] for _ in self.splits]
        for m in members:
            if m not in self.splits:
                below[min(range(len(self.splits)), key=lambda i: (apart[self.splits[i]][m], i))].append(m)
        root = lambda d: float(d) ** 0.5
        # ranges[i][j]: from split i to what hangs below split j, and to split j itself
        self.ranges = [
            [(min(map(root, far)), max(map(root, far))) if (far := [apart[s][m] for m in part]) else None for part in below]
            for s in self.splits
        ]
        self.between = [[root(apart[s][t]) for t in self.splits] for s in self.splits]
        self.children = [Gnat(entries, part) if part else None for part in below]

    def _far(self, m: int, members: list[int]) -> dict[int, int]:
        return {x: int(d) for x, d in zip(members, squared(self.entries[members], self.entries[m]))}

    def search(self, query: np.ndarray, rows: np.ndarray, best: np.ndarray, index: np.ndarray) -> int:
        """Lower ``best`` and ``index`` of the given rows; returns how many distances were computed."""
        done = 0
        for m in self.bucket:
            done += self._meet(m, query, rows, best, index)[1]
        if not self.splits:
            return done
        n, k = len(rows), len(self.splits)
        tried, open_ = np.ones((n, k), bool), np.ones((n, k), bool)  # split points and subtrees still possible
        for i, split in enumerate(self.splits):
            at = np.flatnonzero(tried[:, i])
            if not len(at):
                continue
            near, count = self._meet(split, query, rows[at], best, index)
            done += count
            d, r = np.sqrt(near.astype(np.float64)), np.sqrt(best[rows[at]].astype(np.float64))
            for j in range(k):
                if j > i:
                    t = self.between[i][j]
                    tried[at, j] &= ~self._out(d, r, t, t)
                if self.ranges[i][j]:
                    open_[at, j] &= ~self._out(d, r, *self.ranges[i][j])
        for j, child in enumerate(self.children):
            if child is not None and open_[:, j].any():
                done += child.search(query, rows[open_[:, j]], best, index)
        return done

    def _meet(self, m: int, query, rows, best, index) -> tuple[np.ndarray, int]:
        d = squared(query[rows], self.entries[m])
        won = (d < best[rows]) | ((d == best[rows]) & (m < index[rows]))
        best[rows[won]], index[rows[won]] = d[won], m
        return d, len(rows)

    @staticmethod
    def _out(d: np.ndarray, r: np.ndarray, low: float, high: float) -> np.ndarray:
        margin = _MARGIN * (d + r + high)
        return (d - r > high + margin) | (d + r < low - margin)


def integers(values: np.ndarray) -> np.ndarray:
    """Integral doubles as int64 where squared distances fit, as Python integers otherwise."""
    most = float(np.abs(values).max()) if values.size else 0.0
    if most < 2.0 ** 28 and values.shape[1] <= 1 << 5:
        return values.astype(np.int64)
    return np.array([[int(v) for v in row] for row in values], object).reshape(values.shape)


def nearest(query: np.ndarray, entries: np.ndarray, tree: Gnat | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of every row; ties go to the lower index."""
    if query.dtype == object or entries.dtype == object:
        query, tree, kind = query.astype(object), Gnat(entries.astype(object)), object
    else:
        kind = np.int64
    tree = tree or Gnat(entries)
    best = np.full(len(query), _MOST if kind is np.int64 else 1 << 300, kind)
    index = np.full(len(query), len(entries), np.int64)
    tree.search(query, np.arange(len(query)), best, index)
    return index, best


def _as_lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Which rows are vectors of finite components, and those rows."""
    usable = pc.fill_null(pc.greater(pc.list_value_length(column), 0), False).to_numpy(zero_copy_only=False)
    rows = column.filter(pa.array(usable))
    lengths = pc.list_value_length(rows).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.cast(rows.flatten(), pa.float64())
    finite = pc.fill_null(pc.is_finite(flat), False).to_numpy(zero_copy_only=False)
    if len(lengths):
        ends = np.cumsum(lengths)
        good = np.add.reduceat(finite.astype(np.int64), ends - lengths) == lengths
        usable[np.flatnonzero(usable)] = good
    return usable, column.filter(pa.array(usable))


def _quantise(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable, rows = _as_lists(batch.column(2))
            lengths = pc.list_value_length(rows)
            flat = pc.cast(rows.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
            offsets = np.r_[0, np.cumsum(lengths.to_numpy(zero_copy_only=False))].astype(np.int32)
            keep = pa.array(usable)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(keep), batch.column(1).filter(keep),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.floor(flat * float(scale)))),
                 lengths.cast(pa.int32())],
                names=["vec_id", "label", "q", "n"],
            )

    return run


def quantise(vectors: DataFrame, vec_id: str, vector: str, label: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, q, n) of the usable vectors: integral components as doubles, written; one length only."""
    slim = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("q"))
    kinds = dict(slim.dtypes)
    ddl = f"vec_id {kinds['vec_id']}, label {kinds['label']}, q array<double>, n int"
    whole = pin(slim.mapInArrow(_quantise(scale), ddl), "codes-integers")
    length = whole.groupBy("n").count().orderBy(F.desc("count"), F.desc("n")).first()
    return whole.where(F.col("n") == (length["n"] if length else 0))


def _parts(column: pa.Array, parts: int) -> list[np.ndarray]:
    """One integer matrix per part of the vectors of a batch, all of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    rows = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, parts)
    width = -(-rows.shape[1] // parts)
    if width * parts > rows.shape[1]:
        rows = np.hstack([rows, np.zeros((len(rows), width * parts - rows.shape[1]))])
    return [integers(rows[:, p * width:(p + 1) * width]) for p in range(parts)]


def _limbs(total: int) -> list[int]:
    """``total`` in signed-top limbs, lowest first."""
    out = []
    for _ in range(LIMBS - 1):
        out.append(total & ((1 << LIMB) - 1))
        total >>= LIMB
    return out + [total]


def _sums(codebooks: list[np.ndarray]):
    """Batches (q) -> one row per part and entry that has parts: count and limbs of the component sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(book) for book in codebooks]
        sums: dict[tuple[int, int], list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            for p, query in enumerate(_parts(batch.column(0), len(codebooks))):
                index, _ = nearest(query, codebooks[p], trees[p])
                for entry in np.unique(index):
                    own = query[index == entry]
                    held = sums.setdefault((p, int(entry)), [0, [0] * own.shape[1]])
                    held[0] += len(own)
                    held[1] = [a + int(b) for a, b in zip(held[1], own.sum(axis=0))]
        yield pa.RecordBatch.from_arrays([
            pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.int32()),
            pa.array([v[0] for v in sums.values()], pa.int64()),
            pa.array([[_limbs(t) for t in v[1]] for v in sums.values()], pa.list_(pa.list_(pa.int64()))),
        ], names=["part", "entry", "n", "limbs"])

    return run


def seeds(whole: DataFrame, entries: int, parts: int) -> list[np.ndarray]:
    """The codebooks to start from: the parts of the vectors of the smallest ids."""
    first = whole.orderBy(F.col("vec_id").isNull(), "vec_id", "q").limit(entries).select("q").collect()
    return _parts(pa.array([r["q"] for r in first], pa.list_(pa.float64())), parts)


def improve(whole: DataFrame, codebooks: list[np.ndarray]) -> list[np.ndarray]:
    """One round: assignment of every part, then floor means; entries without parts stay."""
    summed = whole.select("q").mapInArrow(_sums(codebooks), "part int, entry int, n bigint, limbs array<array<bigint>>")
    width, flat = codebooks[0].shape[1], F.posexplode(F.flatten("limbs")).alias("at", "limb")
    rows = summed.select("part", "entry", "n", flat).groupBy("part", "entry", "at").agg(
        F.sum("n").alias("n"), F.sum("limb").alias("limb")
    ).collect()  # parts x entries x components x limbs at most
    totals: dict[tuple[int, int], list[int]] = {}
    counts = {}
    for r in rows:
        key = (r["part"], r["entry"])
        counts[key] = r["n"]
        totals.setdefault(key, [0] * width)[r["at"] // LIMBS] += r["limb"] << (LIMB * (r["at"] % LIMBS))
    new = [book.astype(object) for book in codebooks]
    for (p, e), total in totals.items():
        new[p][e] = [t // counts[p, e] for t in total]
    return [integers(book.astype(np.float64)) if book.size and max(map(abs, book.flat)) < 1 << 28 else book for book in new]


def learn_codebooks(whole: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    codebooks = seeds(whole, entries, parts)
    if len(codebooks[0]):
        for _ in range(rounds):
            codebooks = improve(whole, codebooks)
    return codebooks


def codebooks_digest(codebooks: list[np.ndarray]) -> str:
    """SHA-256 over all entries' components by part, entry and place, as decimal integers with commas."""
    return hashlib.sha256(",".join(str(int(v)) for book in codebooks for v in book.flat).encode()).hexdigest()


def _code(codebooks: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(book) for book in codebooks]
        for batch in batches:
            if not batch.num_rows:
                continue
            indexes, error = [], np.zeros(batch.num_rows, object)
            for p, query in enumerate(_parts(batch.column(2), len(codebooks))):
                index, far = nearest(query, codebooks[p], trees[p])
                indexes.append(index)
                error = error + far.astype(object)
            codes = ["".join(f"{i:02x}" for i in row) for row in np.stack(indexes, axis=1).tolist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(codes, pa.string()),
                pa.array([min(int(e), _MOST) for e in error], pa.int64()),
            ], names=["vec_id", "label", "code", "error"])

    return run


def encode(whole: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error) of the quantised vectors."""
    kinds = dict(whole.dtypes)
    ddl = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint"
    return whole.select("vec_id", "label", "q").mapInArrow(_code(codebooks), ddl)


def decode(codes: DataFrame, codebooks: list[np.ndarray], scale: int = SCALE, code: str = "code") -> DataFrame:
    """``codes`` with ``decoded``, the vector that the code stands for."""
    books = [F.array(*[F.array(*[F.lit(float(v) / scale) for v in entry]) for entry in book]) for book in codebooks]
    at = lambda p: F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("decoded", F.concat(*[F.get(book, at(p)) for p, book in enumerate(books)]))


def compress(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> DataFrame:
    """One row per usable vector: id, ``code``, ``error``, ``label_error``, ``codebooks_sha256``."""
    whole = quantise(vectors, vec_id, vector, label)
    codebooks = learn_codebooks(whole, parts, entries, rounds)
    coded = pin(encode(whole, codebooks), "codes-rows")
    by_label = pin(coded.groupBy(F.col("label").alias("l")).agg(
        F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_MOST).cast("decimal(38,0)")).cast("bigint").alias("label_error")
    ), "codes-labels")
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("l"))).select(
        F.col("vec_id").alias(vec_id), "code", "error", "label_error",
        F.lit(codebooks_digest(codebooks)).alias("codebooks_sha256"),
    )
