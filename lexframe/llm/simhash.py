"""SimHash near-duplicates through deletion-variant signatures.

Fingerprints of 64 bits link when at most 3 bits differ. Cut into two segments of 32 bits, a linked pair
has a segment that differs in one bit at most, so both sides share one of that segment's 32 variants with
one bit wiped out. Variants are the index: every distinct fingerprint is dealt by its 64 variants, equal
variants meet, and the meeting pairs are verified by all 64 bits.

A variant shared by more than ``crowd`` distinct fingerprints is not compared in one go: its members are dealt
again by the one-wildcard variants of the other half's two quarters (16 bits), and, where still crowded,
by those of the last quarter's two eighths (8 bits). Members of a third-level variant agree in 53 bits, so at
most 2,048 distinct ones exist and the split is exact. Inside a variant only a spanning forest of the
verified links is passed on. Equal fingerprints collapse before anything is dealt.

Links become classes by alternating large and small stars over written edge tables.

Defined results: a text without words (null, empty, blank) has fingerprint zero and links like any other;
repeated rows share a fingerprint; ``component_id`` is the smallest id of the class and null only if no
row of the class has one; an empty table gives an empty result. Added columns replace input columns of the
same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexframe.llm.common import add_columns, blank_words, set_aside
from lexframe.session import pin

SHINGLE = 3
DISTANCE = 3
CROWD = 2048
SEED = 42
_CHUNK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Signed 64-bit SimHash: a bit is 1 if it is set in over half of the shingle hashes."""
    words = blank_words(text or b"")
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, n, _CHUNK):
        part = words[at:min(at + _CHUNK, n) + shingle - 1]
        runs = zip(*(part[k:] for k in range(shingle))) if n > 1 or len(words) == shingle else [words]
        hashes = np.fromiter((digest(join(run), seed) for run in runs), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def with_fingerprint(
    docs: DataFrame, text: str = "text", shingle: int = SHINGLE, seed: int = SEED
) -> DataFrame:
    """``docs`` with ``fp``, the fingerprint as a signed long."""

    def make():
        return lambda texts: [[fingerprint(t, shingle, seed) for t in texts]]

    return add_columns(docs, [text], "fp bigint", make)


def _verified(group: np.ndarray, fp: np.ndarray, first_level: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of linked rows of equal ``group``; rows are ordered by group."""
    left, right = [], []
    at, step = np.arange(len(fp)), 1
    unsigned = fp.view(np.uint64)
    while True:
        at = at[at + step < len(fp)]
        at = at[group[at] == group[at + step]]
        if not len(at):
            break
        differ = unsigned[at] ^ unsigned[at + step]
        good = np.bitwise_count(differ) <= DISTANCE
        if first_level and good.any():
            # a pair meets in several variants; only its first one counts
            k = group[at] >> 32
            segment, bit = k >> 5, (k & 31).astype(np.uint64)
            low = differ & np.uint64(0xFFFFFFFF)
            own = np.where(segment == 0, low, differ >> np.uint64(32))
            good &= np.where(own == 0, bit == 0, own == np.uint64(1) << bit)
            good &= (segment == 0) | (np.bitwise_count(low) > 1)
        left.append(at[good])
        right.append(at[good] + step)
        step += 1
    none = np.zeros(0, np.int64)
    return np.concatenate(left or [none]), np.concatenate(right or [none])


def _forest(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each position."""
    label = np.arange(size)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(first_level: bool, crowd: int):
    """Rows (g, h, fp) ordered by (g, h) -> links (a, b), or (g, h, fp) again where a group is crowded."""

    def flush(g, h, fp, deferred_key):
        """Links and deferred rows of whole groups."""
        change = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (h[1:] != h[:-1])])
        length = np.diff(np.r_[change, len(g)])
        size = np.repeat(length, length)
        crowded = size > crowd
        if deferred_key is not None:
            crowded |= (g == deferred_key[0]) & (h == deferred_key[1])
        keep = ~crowded & (size > 1)
        number = np.repeat(np.arange(len(change)), length)[keep]
        gk, fk = g[keep], fp[keep]
        # groups are compared by g at the first level, by their number below it
        a, b = _verified(gk if first_level else number, fk, first_level)
        root = _forest(len(fk), a, b)
        linked = np.flatnonzero(root != np.arange(len(fk)))
        return fk[linked], fk[root[linked]], g[crowded], h[crowded], fp[crowded]

    def rows(a, b, g, h, fp):
        n, m = len(a), len(g)
        return pa.RecordBatch.from_arrays([
            pa.array(np.r_[a, np.zeros(m, np.int64)], pa.int64()),
            pa.array(np.r_[b, np.zeros(m, np.int64)], pa.int64()),
            pa.array(np.r_[np.zeros(n, np.int64), g], pa.int64()),
            pa.array(np.r_[np.zeros(n, np.int64), h], pa.int64()),
            pa.array(np.r_[np.zeros(n, np.int64), fp], pa.int64()),
            pa.array(np.r_[np.zeros(n, bool), np.ones(m, bool)], pa.bool_()),
        ], names=["a", "b", "g", "h", "fp", "crowded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.zeros(0, np.int64)
        g, h, fp, key = empty, empty, empty, None
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            g, h, fp = (np.r_[old, more] for old, more in zip((g, h, fp), new))
            if not len(g):
                continue
            last = np.flatnonzero((g != g[-1]) | (h != h[-1]))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                out = flush(g[:cut], h[:cut], fp[:cut], key)
                if len(out[0]) or len(out[2]):
                    yield rows(*out)
                g, h, fp = g[cut:], h[cut:], fp[cut:]
                if key != (g[0], h[0]):
                    key = None
            if len(g) > crowd or key == (g[0], h[0]):
                key = (g[0], h[0])
                yield rows(empty, empty, g, h, fp)
                g, h, fp = g[:0], h[:0], fp[:0]
        if len(g):
            out = flush(g, h, fp, key)
            if len(out[0]) or len(out[2]):
                yield rows(*out)

    return run


def _met(dealt: DataFrame, first_level: bool, crowd: int) -> DataFrame:
    ordered = dealt.repartition("g", "h").sortWithinPartitions("g", "h")
    return ordered.mapInArrow(
        _compare(first_level, crowd),
        "a bigint, b bigint, g bigint, h bigint, fp bigint, crowded boolean",
    )


def link_fingerprints(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp``: a spanning set of every pair within 3 bits."""
    level1 = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k")).select(
        F.expr("shiftleft(cast(k as bigint), 32) | (shiftrightunsigned(fp, (k div 32) * 32)"
               " & 4294967295 & ~shiftleft(1L, k % 32))").alias("g"),
        F.lit(0).cast("bigint").alias("h"), "fp",
    )
    met = pin(_met(level1, True, crowd), "simhash-met")
    links = met.where("not crowded").select("a", "b")
    crowded = met.where("crowded").select("g", "fp")
    # the half that did not meet: its quarters of 16 bits
    level2 = crowded.select(
        "g", F.expr("shiftrightunsigned(fp, cast((1 - shiftright(g, 37)) * 32 as int)) & 4294967295").alias("o"),
        "fp", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("k"),
    ).select(
        F.expr("shiftleft(g, 21) | shiftleft(cast(k as bigint), 16) | (shiftrightunsigned(o, (k div 16) * 16)"
               " & 65535 & ~shiftleft(1L, k % 16))").alias("g"),
        F.lit(0).cast("bigint").alias("h"), "fp",
    )
    met2 = pin(_met(level2, False, crowd), "simhash-met")
    # and the quarter that did not meet: its eighths of 8 bits
    level3 = met2.where("crowded").select(
        "g", F.expr(
            "shiftrightunsigned(fp, cast((1 - shiftright(g, 58)) * 32 + (1 - (shiftright(g, 20) & 1)) * 16 as int))"
            " & 65535").alias("o"),
        "fp", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k"),
    ).select(
        "g", F.expr("shiftleft(cast(k as bigint), 8) | (shiftrightunsigned(o, (k div 8) * 8)"
                    " & 255 & ~shiftleft(1L, k % 8))").alias("h"), "fp",
    )
    # agreeing in 53 bits leaves 2,048 different fingerprints at most: never crowded
    met3 = _met(level3, False, CROWD)
    return links.union(met2.where("not crowded").select("a", "b")).union(met3.select("a", "b"))


def classes(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node that is not its class's root, the smallest node."""
    edges = pin(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "simhash-edges",
    )
    before = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if tuple(state) == before or not state["n"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = tuple(state)
        around = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = pin(large.distinct(), "simhash-edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = pin(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v"))).distinct(),
            "simhash-edges",
        )


def fingerprint_classes(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(fp, root) for every distinct fingerprint of ``fps``."""
    distinct = fps.select("fp").distinct()
    rooted = classes(link_fingerprints(distinct, crowd))
    return distinct.join(rooted.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root")
    )


def near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", crowd: int = CROWD
) -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hex digits) and ``component_id``."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"))
    prints = pin(with_fingerprint(slim, "__text").select("doc_id", "fp"), "simhash-prints")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = pin(fingerprint_classes(prints, crowd), "simhash-classes")
    ids = rooted.join(least, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    component = rooted.join(ids, "root").select("fp", "component_id")
    return prints.join(component, "fp").select(
        F.col("doc_id").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", crowd: int = CROWD
) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest id; rows without an id come last."""
    rows, name, back = set_aside(docs)
    marked = with_fingerprint(rows, name[text]).withColumn("n", F.monotonically_increasing_id())
    marked = pin(marked, "simhash-docs")
    key = F.col(name[doc_id])
    order = F.struct(key.isNull().alias("x"), key.alias("i"), "n")
    first = marked.groupBy("fp").agg(F.min(order).alias("first"))
    rooted = pin(fingerprint_classes(marked, crowd), "simhash-classes")
    kept = rooted.join(first, "fp").groupBy("root").agg(F.min("first").alias("first")).select("first.n")
    return back(marked.join(kept, "n", "left_semi"))
