"""Near-duplicates among embeddings by sorted projection passes, with exact link counts inside the classes.

A pass gives every vector a key of ``HASHES`` concatenated random hashes (the largest of ``SIDES`` random projections and its sign),
orders all vectors of a label by that key, and compares each with its next ``window`` neighbours. Similar vectors share
long prefixes of the key and so stand close together. Passes differ in their hashes; verified pairs of all passes are united.
The number of passes follows from the largest label, so that a pair exactly at the threshold meets in some window with
probability ``RECALL``, whatever the size of the table: a pass costs the same per row, and one more is taken whenever a longer
prefix has to agree.

Windows work on vectors rounded to bytes, with a bound for the rounding: a pair is linked when the bound allows no other result,
ruled out likewise, and otherwise verified with both whole vectors. Windows cross the limits of Spark's partitions: each
partition passes on its first and last ``window`` rows, which are compared once more around every limit.

Bounded windows unite a class but do not see all pairs of a large one. Links are therefore counted per class afterwards, exactly and
without writing a pair: members are dealt into rings by their angle to a pivot (the mean of about ``BLOCK`` members). Two
rings whose angles add up to less than the threshold's angle are linked as a whole, two that differ by more not at all; only other
rings are compared, block by block of about ``BLOCK`` members, each pair of blocks in one task.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component, and rows without a label, link with nothing;
so do vectors of different lengths. Equal vectors are compared as one and count as links of each other. ``component_id`` is
the smallest id of the class and null only if none has one; ``kept`` compares ids null-safely, so rows that repeat the smallest
id are all kept. An empty table gives an empty result. Other columns are ignored whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexframe.llm.common import add_columns
from lexframe.llm.components import components
from lexframe.llm.simhash import _forest
from lexframe.session import pin

THRESHOLD = 0.93
WINDOW = 64
HASHES, SIDES = 6, 32
RECALL = 0.95
BLOCK = 128
RINGS = 16  # to the angle of the threshold
SEED = 11
_FLUSH = 4096
_SLACK = 1e-9  # of cosines in double precision
_ANGLE_SLACK = 1e-6


def unit_rows(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """Which rows can be compared, and those rows at length one (None elsewhere)."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    out, at = [], 0
    for n in lengths.tolist():
        row, at = flat[at:at + n], at + n
        most = np.abs(row).max() if n else 0.0
        if not n or not np.isfinite(most) or most == 0.0:
            out.append(None)
        else:
            row = row / most
            out.append(row / np.linalg.norm(row))
    return np.array([r is not None for r in out], bool), out


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, vector) -> (vec_id, scope, same, raw): raw holds the vector as it came, in its own width."""
    for batch in batches:
        column, usable = batch.column(2), unit_rows(batch.column(2))[0]
        labels = batch.column(1).to_pylist()
        wide = pa.types.is_float32(column.type.value_type)
        scope, same, raw = [], [], []
        for ok, label, row in zip(usable.tolist(), labels, column):
            if not ok or label is None:
                scope.append(None), same.append(None), raw.append(None)
                continue
            values = row.values.to_numpy(zero_copy_only=False).astype(np.float32 if wide else np.float64) + 0.0
            scope.append(f"{len(values)}:{label}")
            raw.append(values.tobytes())
            same.append(xxhash.xxh3_128_digest(raw[-1]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(scope, pa.string()), pa.array(same, pa.binary()), pa.array(raw, pa.binary())],
            names=["vec_id", "scope", "same", "raw"],
        )


def _units(raws: list, kind) -> np.ndarray:
    """Raw vectors of one length as unit rows."""
    rows = np.stack([np.frombuffer(r, kind) for r in raws]).astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def projections(dims: int, number: int) -> np.ndarray:
    """Directions of pass ``number``, one column each."""
    return np.random.default_rng([SEED, dims, number]).normal(size=(dims, HASHES * SIDES)).astype(np.float32)


def keys(rows: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Concatenated hashes: per ``SIDES`` directions the one of largest projection, with its sign."""
    out = np.zeros(len(rows), np.int64)
    side = (rows.astype(np.float32) @ directions).reshape(len(rows), HASHES, SIDES)
    for h in range(HASHES):
        best = np.abs(side[:, h]).argmax(axis=1)
        sign = np.take_along_axis(side[:, h], best[:, None], 1)[:, 0] > 0
        out = out * (2 * SIDES) + 2 * best + sign
    return out


def plan_passes(rows: int, dims: int, threshold: float, window: int, recall: float) -> int:
    """Passes after which a pair at the threshold has met with probability ``recall``.

    ``rows`` vectors of a label leave ``window`` of them when log(rows / window) / log(2 SIDES) hashes agree; how often one
    hash of such a pair agrees is measured on random pairs.
    """
    rng = np.random.default_rng([SEED, dims])
    x, y = rng.normal(size=(2, 4000, max(2, dims)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = threshold * x + math.sqrt(max(0.0, 1 - threshold ** 2)) * y / np.linalg.norm(y, axis=1, keepdims=True)
    directions = np.random.default_rng([SEED, dims, 1]).normal(size=(max(2, dims), SIDES))
    a, b = x @ directions, y @ directions
    best = np.abs(a).argmax(axis=1)
    at = np.arange(len(a))
    agree = ((best == np.abs(b).argmax(axis=1)) & (a[at, best] * b[at, best] > 0)).mean()
    needed = max(0.0, math.log(max(1.0, rows / window)) / math.log(2 * SIDES))
    meet = min(0.999, max(1e-6, float(agree)) ** needed)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def _sketch(passes: int, kind):
    """raw -> bytes of the rounded vector (scale and residual first), key of every pass."""

    def make():
        directions: dict[int, list[np.ndarray]] = {}

        def one(raws):
            made: list = [None] * len(raws)
            by_size: dict[int, list[int]] = {}
            for i, raw in enumerate(raws):
                by_size.setdefault(len(raw), []).append(i)
            for at in by_size.values():
                rows = _units([raws[i] for i in at], kind)
                scale = np.abs(rows).max(axis=1, keepdims=True) / 127
                codes = np.rint(rows / scale).astype(np.int8)
                off = np.linalg.norm(rows - codes * scale, axis=1) * (1 + 1e-9)
                held = directions.setdefault(rows.shape[1], [])
                if not held:
                    held += [projections(rows.shape[1], p) for p in range(passes)]
                dealt = np.stack([keys(rows, d) for d in held], axis=1)
                for row, i in enumerate(at):
                    head = np.array([scale[row, 0], off[row]]).tobytes()
                    made[i] = (head + codes[row].tobytes(), dealt[row].tolist())
            return [[m[0] for m in made], [m[1] for m in made]]

        return one

    return make


def _pairs(sketch: list, threshold: float, same, window: int) -> tuple[np.ndarray, ...]:
    """(i, j, sure) of the pairs within ``window`` places that may reach the threshold; ``same`` numbers what may be compared."""
    left, right, sure = [], [], []
    n = len(sketch)
    for size in {len(s) for s in sketch}:
        at = np.array([i for i, s in enumerate(sketch) if len(s) == size])
        head = np.stack([np.frombuffer(sketch[i], np.float64, 2) for i in at])
        codes = np.stack([np.frombuffer(sketch[i], np.int8, offset=16) for i in at]).astype(
            np.float32 if size - 16 <= 1024 else np.float64)
        scale, off = head[:, 0], head[:, 1]
        for start in range(0, len(at), window):
            a, b = slice(start, start + window), slice(start, start + 2 * window)
            near = (codes[a] @ codes[b].T).astype(np.float64) * scale[a, None] * scale[None, b]
            margin = off[a, None] + (1 + off[a, None]) * off[None, b] + _SLACK
            step = at[None, b] - at[a, None]
            may = (near + margin >= threshold) & (step > 0) & (step <= window) & (same[at[a]][:, None] == same[at[b]][None, :])
            i, j = np.nonzero(may)
            left.append(at[a][i]), right.append(at[b][j]), sure.append((near - margin >= threshold)[i, j])
    none = np.zeros(0, np.int64)
    return np.concatenate(left or [none]), np.concatenate(right or [none]), np.concatenate(sure or [none]).astype(bool)


_LINK, _DOUBT, _EDGE, _COUNT = range(4)
_FOUND = "kind int, a bigint, b bigint, scope string, sketch binary"


def _found(kind, a, b, scope=None, sketch=None) -> pa.RecordBatch:
    n = len(a)
    return pa.RecordBatch.from_arrays([
        pa.array([kind] * n, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
        pa.array(scope if scope is not None else [None] * n, pa.string()),
        pa.array(sketch if sketch is not None else [None] * n, pa.binary()),
    ], names=["kind", "a", "b", "scope", "sketch"])


def _windows(threshold: float, window: int, edges: bool):
    """Ordered rows (group, scope, n, sketch) -> links and doubtful pairs of neighbours in a group and scope.

    Links are passed on as a forest. With ``edges`` also the partition's first and last rows and its number of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, scope, n, sketch = [], [], [], []
        seen, number, head = 0, None, 0

        def flush(whole: bool):
            names: dict = {}
            same = np.array([names.setdefault(x, len(names)) for x in zip(group, scope)])
            i, j, sure = _pairs(sketch, threshold, same, window)
            if not whole:  # rows kept for the next flush are compared there
                early = i < len(n) - window
                i, j, sure = i[early], j[early], sure[early]
            root = _forest(len(n), i[sure], j[sure])
            ids = np.array(n, np.int64)
            linked = np.flatnonzero(root != np.arange(len(n)))
            yield _found(_LINK, ids[linked], ids[root[linked]])
            doubt = ~sure & (root[i] != root[j])
            yield _found(_DOUBT, ids[i[doubt]], ids[j[doubt]])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(k).to_pylist() for k in range(4)]
            for held, more in zip((group, scope, n, sketch), rows):
                held += more
            number = rows[0][0]
            if edges and head < window:
                more = min(window - head, batch.num_rows)
                yield _found(_EDGE, [(number << 33) + head + k for k in range(more)], rows[2][:more], rows[1][:more], rows[3][:more])
                head += more
            seen += batch.num_rows
            if len(n) >= _FLUSH + window:
                yield from flush(False)
                for held in (group, scope, n, sketch):
                    del held[:-window]
        if n:
            yield from flush(True)
            if edges:
                first = max(head, seen - window)  # rows before it were passed on as the head
                late = seen - first
                if late:
                    yield _found(_EDGE, [(number << 33) + first + k for k in range(late)], n[-late:], scope[-late:], sketch[-late:])
                yield _found(_COUNT, [number], [seen])

    return run


def _around(starts: np.ndarray, first: dict[int, int], window: int):
    """Edge rows (place, n, scope, sketch) -> the same per limit between partitions within reach, with their rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(0).to_numpy(zero_copy_only=False)
            rank = np.array([first[int(p) >> 33] + (int(p) & ((1 << 33) - 1)) for p in place], np.int64)
            low = np.searchsorted(starts, rank - window, side="right")
            high = np.searchsorted(starts, rank + window, side="right")
            at = np.repeat(np.arange(len(rank)), high - low)
            limit = np.concatenate([starts[a:b] for a, b in zip(low, high)] or [starts[:0]])
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(limit, pa.int64()), batch.column(2).take(take), batch.column(1).take(take),
                 batch.column(3).take(take), pa.array(rank[at], pa.int64())],
                names=["limit", "scope", "n", "sketch", "rank"],
            )

    return run


def one_pass(distinct: DataFrame, number: int, threshold: float, window: int) -> DataFrame:
    """(a, b, doubtful) of pass ``number``, windows over the limits of partitions included."""
    keyed = distinct.select("scope", F.col("keys")[number].alias("key"), "n", "sketch")
    ordered = keyed.repartitionByRange("scope", "key", "n").sortWithinPartitions("scope", "key", "n")
    rows = ordered.select(F.spark_partition_id().cast("bigint").alias("part"), "scope", "n", "sketch")
    found = pin(rows.mapInArrow(_windows(threshold, window, True), _FOUND), "dedup-windows")
    counts = sorted((r["a"], r["b"]) for r in found.where(F.col("kind") == _COUNT).select("a", "b").collect())  # a row per partition
    first, total = {}, 0
    for part, rows_in in counts:
        first[part], total = total, total + rows_in
    starts = np.array(sorted(first.values())[1:], np.int64)
    around = found.where(F.col("kind") == _EDGE).select("a", F.col("b").alias("n"), "scope", "sketch").mapInArrow(
        _around(starts, first, window), "limit bigint, scope string, n bigint, sketch binary, rank bigint"
    ).repartition("limit").sortWithinPartitions("limit", "rank").select("limit", "scope", "n", "sketch")
    more = around.mapInArrow(_windows(threshold, window, False), _FOUND)
    pairs = found.where(F.col("kind") <= _DOUBT).unionByName(more)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("kind") == _DOUBT).alias("doubtful"))


def _verified(threshold: float, kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [
                float(_units([x.as_py()], kind)[0] @ _units([y.as_py()], kind)[0]) >= threshold
                for x, y in zip(batch.column(2), batch.column(3))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def link(distinct: DataFrame, passes: int, threshold: float, window: int, kind) -> DataFrame:
    """A forest (a, b) of verified links over all passes."""
    pairs = one_pass(distinct, 0, threshold, window)
    for number in range(1, passes):
        pairs = pairs.unionByName(one_pass(distinct, number, threshold, window))
    pairs = pin(pairs.distinct(), "dedup-pairs")
    one = distinct.select(F.col("n").alias("a"), F.col("raw").alias("one"))
    two = distinct.select(F.col("n").alias("b"), F.col("raw").alias("two"))
    doubtful = pairs.where("doubtful").select("a", "b").join(two, "b").join(one, "a").select("a", "b", "one", "two")
    return pairs.where("not doubtful").select("a", "b").union(doubtful.mapInArrow(_verified(threshold, kind), "a bigint, b bigint"))


def _pivot(kind):
    def run(rows):
        import pandas as pd

        mean = _units(rows["raw"].tolist(), kind).mean(axis=0)
        if not np.linalg.norm(mean) > 1e-9:
            mean = _units(rows["raw"].tolist()[:1], kind)[0]
        return pd.DataFrame({"root": [rows["root"].iloc[0]], "pivot": [(mean / np.linalg.norm(mean)).tobytes()]})

    return run


def _angles(kind):
    def one(raws, pivots):
        return [[
            0.0 if pivot is None else
            float(np.arccos(np.clip(_units([raw], kind)[0] @ np.frombuffer(pivot, np.float64), -1, 1)))
            for raw, pivot in zip(raws, pivots)
        ]]

    return one


def _counts(threshold: float, kind):
    """Rows (u, side, n, copies, raw) ordered by u and side -> links of each member within the unit."""

    def count(side, n, copies, raw):
        side, rows, many = np.array(side), _units(raw, kind), np.array(copies, np.int64)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(right):
            met = rows @ rows.T >= threshold
            np.fill_diagonal(met, False)
            return pa.array(n, pa.int64()), pa.array(met.astype(np.int64) @ many, pa.int64())
        met = (rows[left] @ rows[right].T >= threshold).astype(np.int64)
        out = np.zeros(len(n), np.int64)
        out[left], out[right] = met @ many[right], met.T @ many[left]
        return pa.array(n, pa.int64()), pa.array(out, pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, [[], [], [], []]
        for batch in batches:
            rows = [batch.column(k).to_pylist() for k in range(5)]
            out = []
            for u, *row in zip(*rows):
                if u != unit:
                    if held[0]:
                        out.append(count(*held))
                    unit, held = u, [[], [], [], []]
                for values, value in zip(held, row):
                    values.append(value)
            for n, links in out:
                yield pa.RecordBatch.from_arrays([n, links], names=["n", "links"])
        if held[0]:
            yield pa.RecordBatch.from_arrays(list(count(*held)), names=["n", "links"])

    return run


def count_links(members: DataFrame, threshold: float, kind, block: int = BLOCK) -> DataFrame:
    """(n, links) of every class member: copies of the vectors it links with, its own aside.

    ``members`` (written) has ``root, n, copies, raw``.
    """
    sizes = pin(members.groupBy("root").agg(F.count("*").alias("m")), "dedup-sizes")
    large = sizes.where(F.col("m") > block)
    sample = F.pmod(F.xxhash64("n"), F.floor(F.col("m") / block)) == 0
    pivots = pin(
        members.join(large, "root").where(sample).select("root", "raw").groupBy("root").applyInPandas(_pivot(kind), "root bigint, pivot binary"),
        "dedup-pivots",
    )
    theta = math.acos(threshold)
    ringed = add_columns(members.join(pivots, "root", "left"), ["raw", "pivot"], "angle double", lambda: _angles(kind))
    ringed = pin(ringed.select(
        "root", "n", "copies", "raw", "angle", F.floor(F.col("angle") * (RINGS / theta)).cast("int").alias("ring")
    ), "dedup-rings")
    rings = ringed.groupBy("root", "ring").agg(
        F.count("*").alias("m"), F.sum("copies").alias("c"), F.min("angle").alias("lo"), F.max("angle").alias("hi")
    ).join(large.select("root", F.lit(True).alias("large")), "root", "left")
    rings = pin(rings.withColumn("k", F.ceil(F.col("m") / block)), "dedup-ring-sizes")
    # rings of a class: at most RINGS * pi / theta of them
    other = rings.select("root", *[F.col(c).alias(f"{c}2") for c in ("ring", "m", "c", "lo", "hi", "k")])
    met = rings.join(other, "root")
    sure = F.coalesce("large", F.lit(False)) & (F.col("hi") + F.col("hi2") <= theta - _ANGLE_SLACK)
    apart = F.greatest("lo", "lo2") - F.least("hi", "hi2") >= theta + _ANGLE_SLACK
    by_ring = met.where(sure).groupBy("root", "ring").agg(
        F.sum("c2").alias("sure"), F.max((F.col("ring") == F.col("ring2")).cast("int")).alias("own")
    )
    units = met.where(~sure & ~apart & (F.col("ring") <= F.col("ring2"))).select(
        "root", "ring", "ring2", "k2", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)).alias("h")
    ).select("root", "ring", "ring2", "h", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k2") - 1)).alias("h2"))
    units = units.where("ring < ring2 or h <= h2").withColumn("u", F.monotonically_increasing_id())
    units = pin(units, "dedup-units")
    sides = units.select("u", F.lit(0).alias("side"), "root", "ring", "h").union(
        units.where("ring < ring2 or h < h2").select("u", F.lit(1), "root", "ring2", "h2")
    )
    dealt = ringed.join(rings.select("root", "ring", "k"), ["root", "ring"]).withColumn(
        "h", F.pmod(F.xxhash64("n", F.lit(1)), F.col("k"))
    )
    shipped = dealt.join(sides, ["root", "ring", "h"]).select("u", "side", "n", "copies", "raw")
    counted = shipped.repartition("u").sortWithinPartitions("u", "side").mapInArrow(_counts(threshold, kind), "n bigint, links bigint")
    counted = counted.groupBy("n").agg(F.sum("links").alias("links"))
    return ringed.select("root", "ring", "n", "copies").join(by_ring, ["root", "ring"], "left").join(counted, "n", "left").select(
        "n", (F.coalesce("links", F.lit(0)) + F.coalesce("sure", F.lit(0)) - F.coalesce("own", F.lit(0)) * F.col("copies")).alias("links")
    )


def near_duplicates(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    threshold: float = THRESHOLD, window: int = WINDOW, passes: int | None = None, block: int = BLOCK, recall: float = RECALL,
) -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id``, ``kept``.

    ``passes`` is planned from the largest label unless given.
    """
    slim = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("v"))
    kind = np.float32 if dict(slim.dtypes)["v"] == "array<float>" else np.float64
    id_kind = dict(slim.dtypes)["vec_id"]
    rows = pin(slim.mapInArrow(_prepare, f"vec_id {id_kind}, scope string, same binary, raw binary"), "dedup-rows")
    usable = rows.where(F.col("scope").isNotNull())
    if passes is None:
        top = usable.groupBy("scope").count().orderBy(F.desc("count"), "scope").first()
        passes = plan_passes(top["count"], int(top["scope"].split(":")[0]), threshold, window, recall) if top else 1
    distinct = usable.groupBy("scope", "same", "raw").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    distinct = add_columns(distinct, ["raw"], "sketch binary, keys array<bigint>", _sketch(passes, kind))
    distinct = pin(distinct.withColumn("n", F.monotonically_increasing_id()), "dedup-distinct")
    rooted = components(link(distinct, passes, threshold, window, kind))
    rooted = pin(rooted.union(rooted.select("root", "root").distinct()), "dedup-classes")
    members = pin(distinct.select("n", "raw", "copies", "least").join(rooted.withColumnRenamed("node", "n"), "n"), "dedup-members")
    ids = members.groupBy("root").agg(F.min("least").alias("component_id"))
    links = count_links(members.select("root", "n", "copies", "raw"), threshold, kind, block)
    told = rooted.withColumnRenamed("node", "n").join(ids, "root").join(links, "n").select("n", "component_id", "links")
    told = distinct.select("n", "scope", "same", "copies", "least").join(told, "n", "left").select(
        "scope", "same", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component_id", "least").alias("component_id"),
    )
    told = pin(told, "dedup-told")
    found = rows.select("vec_id", "scope", "same").join(told, ["scope", "same"], "left")
    component = F.when(F.col("scope").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return found.select(
        F.col("vec_id").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
