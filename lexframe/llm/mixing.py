"""Mixing sources to target weights by hash-threshold histograms.

Sources in order of their names (by code point, null last) weigh 5, 2, 1 and so on in turn, and share as
many words as all documents have. A source's target stops at ``max_repeats`` times its size; the excess goes
to the others by weight until none is above. A target of k sizes and a rest takes every document k times and
those documents once more whose hash is below the source's threshold.

The threshold comes from histograms: words are summed by source and leading hash digit, the digit where
the running sum passes the rest is the boundary, and only the documents in it are summed again by their
next digit, down to one hash value, which is taken if that comes nearer to the target. Documents are never
sorted. Hashes come from md5, so any engine repeats them; they do not depend on partitions, so reruns agree,
and a smaller budget takes a subset of what a larger one takes.

Defined results: a null text has size 0; documents without an id are hashed by their text; equal ids of a source
share a hash and are taken together; a null source is a source; sources without words have target 0; an
empty table gives an empty result. Added columns replace input columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexframe.llm.common import set_aside
from lexframe.session import pin

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
DIGIT_BITS = 12
DIGITS = 5
WORDS = r"[^\x20\x09-\x0D]+"
_TOP = 1 << (DIGIT_BITS * DIGITS)


def _hash(doc_id: str, text: str) -> Column:
    key = F.coalesce(F.col(doc_id).cast("string"), F.col(text), F.lit(""))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("bigint")


def _size(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("bigint")


def source_targets(
    sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS
) -> DataFrame:
    """(source, source_size, target) of a table with ``source`` and ``size``."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # numbered in order without gathering the sources in one task: by range, then by offsets of the ranges
    ranged = pin(
        sums.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()),
        "mix-sources",
    )
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    offsets = counts.withColumn(
        "before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ).select("part", F.coalesce("before", F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    cycle = F.array(*map(F.lit, weights))
    weighted = pin(
        ranged.withColumn("place", place).join(offsets, "part").select(
            "source", "source_size",
            F.get(cycle, ((F.col("place") - 1 + F.col("before")) % len(weights)).cast("int")).cast("bigint").alias("w"),
            (F.col("source_size") * max_repeats).alias("most"),
        ),
        "mix-weights",
    )
    total = weighted.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    per_weight = 0.0
    while True:
        over = F.col("most") < F.lit(per_weight) * F.col("w")
        capped, free = weighted.agg(
            F.sum(F.when(over, F.col("most")).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("w")))
        ).first()
        again = float(total - capped) / float(free) if free else 0.0
        if again <= per_weight:
            break
        per_weight = again
    share = F.lit(per_weight) * F.col("w")
    return weighted.select(
        "source", "source_size", F.least(share, F.col("most").cast("double")).alias("target")
    )


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` with ``copies`` and ``below``: documents with a smaller hash are taken once more."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    wanted = pin(
        targets.withColumn("copies", whole.cast("bigint")).withColumn(
            "rest", F.col("target") - F.col("copies") * F.col("source_size")
        ),
        "mix-thresholds",
    )
    inside = sized.select("source", "size", "h")
    for digit in range(DIGITS):
        shift = DIGIT_BITS * (DIGITS - 1 - digit)
        place = F.shiftright("h", shift)
        histogram = inside.where("size > 0").groupBy("source", place.alias("b")).agg(F.sum("size").alias("s"))
        running = Window.partitionBy("source").orderBy("b")
        histogram = histogram.withColumn("after", F.sum("s").over(running))
        edge = wanted.select("source", "copies", "rest").alias("w").join(
            histogram.alias("g"), F.expr("w.source <=> g.source")
        ).where("after - s <= rest and rest < after").select(
            "w.source", "copies", "b", "s", (F.col("rest") - (F.col("after") - F.col("s"))).alias("rest"),
        )
        wanted = pin(edge, "mix-thresholds")
        if shift:
            inside = pin(
                inside.alias("d").join(
                    wanted.alias("w"), F.expr(f"d.source <=> w.source and shiftright(d.h, {shift}) = w.b")
                ).select("d.*"),
                "mix-boundary",
            )
    # one hash value is left: in, if that is nearer
    last = wanted.select(
        F.col("source").alias("edge_source"),
        (F.col("b") + F.when(F.col("rest") * 2 > F.col("s"), 1).otherwise(0)).alias("below"), F.lit(True).alias("known"),
    )
    return targets.join(last, F.expr("source <=> edge_source"), "left").select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
        .cast("bigint").alias("copies"),
        F.coalesce("below", F.lit(0)).alias("below"),
    )


def plan_mix(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source",
    weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS,
) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, h) of every document, and the thresholds of every source; both written."""
    sized = pin(
        docs.select(
            F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), _size(text).alias("size"),
            _hash(doc_id, text).alias("h"),
        ),
        "mix-sized",
    )
    return sized, pin(thresholds(sized, source_targets(sized, weights, max_repeats)), "mix-plan")


def _taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (source, size, h, ...) with what the plan takes of them."""
    plan = plan.withColumnRenamed("source", "plan_source")
    return rows.join(plan, F.expr("source <=> plan_source")).withColumn(
        "times", F.col("copies") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)
    ).withColumn("taken", F.col("size") * F.col("times"))


def mix_sizes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, times and taken of every document."""
    sized, plan = plan_mix(docs, **options)
    return _taken(sized, plan).select("doc_id", "size", "source_size", "target", "times", "taken")


def take_mix(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", **options
) -> DataFrame:
    """The documents that the mix takes, with ``size``, ``times`` and ``taken``.

    The hash and size of a row follow from the row itself, so texts stay where they are: only the plan, a
    row per source, is joined.
    """
    _, plan = plan_mix(docs, text, doc_id, source, **options)
    rows, name, _ = set_aside(docs)
    rows = rows.withColumns({
        "source": F.col(name[source]), "size": _size(name[text]), "h": _hash(name[doc_id], name[text]),
    })
    kept = [F.col(new).alias(old) for old, new in name.items() if old.lower() not in ("size", "times", "taken")]
    return _taken(rows, plan).where("times > 0").select(*kept, "size", "times", "taken")
