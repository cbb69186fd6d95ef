"""Near copies by the Jaccard similarity of their word shingles, for stages that ask for similarity and not for bits.

64 bits of SimHash do not carry this: sets of Jaccard 0.8 differ in about 10 bits, up to 17 with their spread, and segments
that are sure to meet within 17 bits are 7 bits short. Candidates come from minhashes instead, ``BANDS`` bands of
``ROWS`` values; sets of similarity s share no band with probability ``(1 - s**ROWS) ** BANDS``: 3e-6 at 0.8, less above.
Every link is verified by the whole sets of 64-bit shingle hashes.

Equal sets collapse first. SimHash comes next: fingerprints within its few bits form classes by the index of deletion variants
(:mod:`lexframe.llm.simhash`), and every member is verified against the least of its class. Each set is verified against the smallest one of every band it shares. What still shares a band
but no class is paired and verified, so classes are the connected components of all verified pairs. Pairs whose
sizes alone rule the similarity out are not verified. In bands of up to ``CROWD`` sets all pairs are tried.

Larger bands form families (sets connected by such bands), whose pairs are found by an index of differences, which is exact:
a family has a centre, the shingles that most of a sample of it have. Sets x and y share |c| - |Dx| - |Dy| + |Fx & Fy| shingles,
where D are the shingles of the centre c that a set lacks and F all in which it differs from c. They are similar enough exactly if
|Fx & Fy| >= k = ceil(s / (1 + s) (|x| + |y|)) - |c| + |Dx| + |Dy|. If k <= 0 for a pair, both are linked with the family's
set of least weight without a look, so a star links all such pairs. Any other linked pair shares a difference among the |F| - k + 1
rarest of each, so sets are dealt by those and only equal differences meet. k depends on a pair's weights; partners
come in at most ``KINDS`` ranges of weight, and k is taken for the least weight of the range, which only adds candidates. The
centre decides how many candidates there are, never which links are found; a family without a common shingle has an empty centre.

Defined results: words are cut at ASCII blanks, A-Z lower-cased; a text shorter than a shingle is one shingle; texts without words
(null, empty, blank) are copies of each other and of nothing else; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexframe.llm import simhash
from lexframe.llm.common import add_columns, blank_words, set_aside
from lexframe.llm.components import components
from lexframe.session import pin

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
SEED = 42
CROWD = 32
KINDS = 8
SAMPLE = 64
_CHUNK = 1 << 14
_RNG = np.random.default_rng(SEED)
_FACTORS = _RNG.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _RNG.integers(0, 1 << 32, BANDS * ROWS, np.uint32)


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    words = blank_words(text or b"")
    if not words:
        return np.zeros(0, np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    runs = zip(*(words[k:] for k in range(shingle))) if len(words) >= shingle else [words]
    return np.unique(np.fromiter((digest(join(run), SEED) for run in runs), np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """One key per band, the number of the band mixed in."""
    if not len(hashes):
        return []
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(low), _CHUNK):
        part = low[at:at + _CHUNK]
        for k in range(BANDS * ROWS):
            least[k] = min(least[k], (part * _FACTORS[k] + _SHIFTS[k]).min())
    return [
        int(np.uint64(xxhash.xxh64_intdigest(least[k * ROWS:(k + 1) * ROWS].tobytes(), k)).view(np.int64))
        for k in range(BANDS)
    ]


def _sketch(shingle: int):
    def one(texts):
        same, size, keys, prints = [], [], [], []
        for text in texts:
            hashes = shingles(text, shingle)
            same.append(xxhash.xxh3_128_digest(hashes.tobytes()))
            size.append(len(hashes))
            keys.append(bands(hashes))
            prints.append(simhash.fingerprint(text))
        return [same, size, keys, prints]

    return one


def _similar(similarity: float):
    """Rows (a, b, one, two) -> (a, b) of the pairs whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for one, two in zip(batch.column(2), batch.column(3)):
                one, two = (np.frombuffer(x.as_buffer(), np.uint64) for x in (one, two))
                both = len(np.intersect1d(one, two, assume_unique=True))
                good.append(both / (len(one) + len(two) - both) >= similarity)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) among ``pairs``, written."""
    one = sets.select(F.col("n").alias("a"), F.col("set").alias("one"))
    two = sets.select(F.col("n").alias("b"), F.col("set").alias("two"))
    met = pairs.join(two, "b").join(one, "a").select("a", "b", "one", "two")
    return pin(met.mapInArrow(_similar(similarity), "a bigint, b bigint"), "copies-links")


def _centre(rows):
    """Members of a family's sample (f, set) -> its centre, and the shingles that several of them have, with how many."""
    import pandas as pd

    sets = [np.frombuffer(x, np.uint64) for x in rows["set"]]
    found, held = np.unique(np.concatenate(sets), return_counts=True)
    often = held > 1
    return pd.DataFrame({
        "f": [rows["f"].iloc[0]], "centre": [found[held * 2 > len(sets)].tobytes()],
        "common": [found[often].tobytes()], "held": [held[often].astype(np.int64).tobytes()],
    })


def _differences(share: float):
    """(set, centre, common, held) -> weight, size of the centre, differences from the centre with the rarest first.

    The weight of a set is its part of k: ``share`` of its size plus what it lacks of the centre.
    """

    def one(sets, centres, commons, helds):
        weight, size, rest = [], [], []
        for x, centre, common, held in zip(sets, centres, commons, helds):
            x, centre, common = (np.frombuffer(b or b"", np.uint64) for b in (x, centre, common))
            differ = np.setxor1d(x, centre, assume_unique=True)
            lacks = (len(differ) + len(centre) - len(x)) // 2
            seen = np.zeros(len(differ), np.int64)
            if len(common):
                at = np.minimum(np.searchsorted(common, differ), len(common) - 1)
                seen = np.where(common[at] == differ, np.frombuffer(held, np.int64)[at], 0)
            weight.append(share * len(x) + lacks)
            size.append(len(centre))
            rest.append(differ[np.lexsort((differ, seen))].view(np.int64).tolist())
        return [weight, size, rest]

    return one


def crowd_pairs(crowded: DataFrame, sets: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) proved by weight, and candidate pairs (a, b), of the sets that share a band of ``crowded`` but no root.

    ``crowded`` has a row (key, n, size, root) per band and set, ``sets`` (n, set).
    """
    least = crowded.groupBy("key").agg(F.min("n").alias("a"))
    family = components(crowded.select("key", F.col("n").alias("b")).join(least, "key").select("a", "b"))
    nodes = crowded.groupBy("n").agg(F.min("size").alias("size"), F.min("root").alias("root"))
    members = nodes.join(family.withColumnRenamed("node", "n").withColumnRenamed("root", "f"), "n", "left").withColumn(
        "f", F.coalesce("f", "n")
    )
    members = pin(members.join(sets, "n").select("f", "n", "size", "root", "set"), "copies-families")
    sizes = members.groupBy("f").agg(F.count("*").alias("g"))
    some = F.pmod(F.xxhash64("n"), F.greatest(F.lit(1), F.floor(F.col("g") / SAMPLE))) == 0
    centres = pin(members.join(sizes, "f").where(some).select("f", "set").groupBy("f").applyInPandas(
        _centre, "f bigint, centre binary, common binary, held binary"), "copies-centres")
    differing = add_columns(
        members.join(centres, "f", "left"), ["set", "centre", "common", "held"], "w double, c int, rest array<bigint>",
        lambda: _differences(similarity / (1 + similarity)),
    ).drop("set", "centre", "common", "held")
    differing = pin(differing, "copies-differences")
    # rounding of the weights may only lower k
    slack = F.lit(1e-6)
    kinds = differing.groupBy("f").agg(
        F.min("w").alias("low"), F.max("w").alias("high"), F.min(F.struct("w", "n", "root")).alias("first"))
    kinds = pin(kinds.withColumn("step", F.greatest(F.lit(1.0), (F.col("high") - F.col("low")) / KINDS * F.lit(1 + 1e-9))), "copies-kinds")
    kind = F.floor((F.col("w") - F.col("low")) / F.col("step")).cast("int")
    placed = differing.join(kinds, "f").withColumn("kind", kind)
    near_first = (F.col("w") + F.col("first.w") + slack <= F.col("c")) & (F.col("n") != F.col("first.n"))
    proved = placed.where(near_first).select(F.col("first.n").alias("a"), F.col("n").alias("b"))
    present = placed.groupBy("f").agg(F.collect_set("kind").alias("present"))  # at most KINDS + 1
    placed = placed.withColumn("root", F.when(near_first, F.col("first.root")).otherwise(F.col("root")))
    other = F.col("low") + F.col("partner") * F.col("step")
    k = F.greatest(F.lit(1), F.ceil(F.col("w") + other - slack) - F.col("c"))
    dealt = placed.join(present, "f").withColumn("partner", F.explode("present")).withColumn(
        "rarest", F.slice("rest", F.lit(1), F.greatest(F.lit(0), F.size("rest") - k + 1).cast("int"))
    ).select(
        "f", F.least("kind", "partner").alias("p"), F.greatest("kind", "partner").alias("q"),
        "kind", "n", "size", "root", F.explode("rarest").alias("e"),
    )
    meet = ["f", "p", "q", "e"]
    one = dealt.where("kind = p").select(*meet, F.col("n").alias("a"), F.col("size").alias("size_a"), F.col("root").alias("root_a"))
    two = dealt.where("kind = q").select(*meet, F.col("n").alias("b"), F.col("size").alias("size_b"), F.col("root").alias("root_b"))
    once = (F.col("l.p") < F.col("r.q")) | (F.col("a") < F.col("b"))
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in meet]
    fits = F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * F.lit(similarity - 1e-9)
    met = one.alias("l").join(two.alias("r"), [*same, once, fits, F.col("root_a") != F.col("root_b")])
    return proved, met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _sized(a: str, b: str, similarity: float):
    """The sizes of two sets allow the similarity."""
    return F.least(a, b) >= F.greatest(a, b) * F.lit(similarity - 1e-9)


def _fingerprint_stars(prints: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) to verify: the least set of each class of fingerprints with its other members; ``prints`` has (n, size, fp)."""
    told = pin(prints.join(simhash.fingerprint_classes(prints), "fp").select("n", "size", "root"), "copies-prints")
    least = told.groupBy("root").agg(F.min(F.struct("n", "size")).alias("least"))
    met = told.join(least, "root").where((F.col("n") != F.col("least.n")) & _sized("size", "least.size", similarity))
    return pin(met.select(F.col("least.n").alias("a"), F.col("n").alias("b")), "copies-pairs")


def drop_near_copies(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, similarity: float = SIMILARITY
) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest id; rows without an id come last."""
    rows, name, back = set_aside(docs)
    marked = add_columns(
        rows, [name[text]], "same binary, size bigint, bands array<bigint>, fp bigint", lambda: _sketch(shingle)
    ).withColumn("n", F.monotonically_increasing_id())
    marked = pin(marked, "copies-docs")
    key = F.col(name[doc_id])
    order = F.struct(key.isNull().alias("x"), key.alias("i"), "n")
    first = pin(marked.groupBy("same").agg(F.min(order).alias("first")).select("first"), "copies-first")
    kept = first.select("first.n")
    banded = marked.select("n", "size", F.explode("bands").alias("key")).join(kept, "n", "left_semi")
    # (the smallest set of each band, with its size; both sides of a pair are told by n)
    least = banded.groupBy("key").agg(F.min(F.struct("n", "size")).alias("least"), F.count("*").alias("c"))
    shared = pin(banded.join(least.where("c > 1").drop("c"), "key"), "copies-bands")
    hashed = _fingerprint_stars(marked.join(kept, "n", "left_semi").select("n", "size", "fp"), similarity)
    either = shared.select("n").union(hashed.select("a")).union(hashed.select("b")).distinct()
    some = marked.join(either, "n", "left_semi").select("n", F.col(name[text]).alias("text"))
    sets = pin(
        add_columns(some, ["text"], "set binary", lambda: lambda texts: [[shingles(t, shingle).tobytes() for t in texts]])
        .select("n", "set"), "copies-sets",
    )

    def sized(a: str, b: str):
        return _sized(a, b, similarity)

    stars = pin(
        shared.where((F.col("n") != F.col("least.n")) & sized("size", "least.size"))
        .select(F.col("least.n").alias("a"), F.col("n").alias("b")).union(hashed).distinct(), "copies-pairs",
    )
    links = _verified(stars, sets, similarity)
    rooted = components(links)
    told = shared.select("key", "n", "size").join(rooted.withColumnRenamed("node", "n"), "n", "left").select(
        "key", "n", "size", F.coalesce("root", "n").alias("root")
    )
    mixed = told.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m")).where("lo <> hi")
    told = pin(told.join(mixed.select("key", "m"), "key"), "copies-mixed")
    few, crowded = told.where(F.col("m") <= CROWD), told.where(F.col("m") > CROWD)
    other = few.select("key", F.col("n").alias("b"), F.col("size").alias("size_b"), F.col("root").alias("root_b"))
    pairs = few.join(other, "key").where((F.col("n") < F.col("b")) & (F.col("root") != F.col("root_b")) & sized("size", "size_b"))
    pairs = pairs.select(F.col("n").alias("a"), "b").distinct()
    proved, more = crowd_pairs(crowded, sets, similarity)
    pairs = pin(pairs.union(more).distinct().join(stars, ["a", "b"], "left_anti"), "copies-pairs")
    rooted = pin(components(links.union(proved).union(_verified(pairs, sets, similarity))), "copies-classes")
    best = first.select("first", F.col("first.n").alias("node")).join(rooted, "node", "left").groupBy(
        F.coalesce("root", "node").alias("root")
    ).agg(F.min("first").alias("first")).select("first.n")
    return back(marked.join(best, "n", "left_semi"))
