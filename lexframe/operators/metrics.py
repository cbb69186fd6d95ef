"""Service metrics from request rows: ``endpoint, agent_type, status, error_type, model, tokens,
duration, started_at, ended_at``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..session import pin
from .percentiles import nearest_ranks, widen

_LABELS = ["endpoint", "agent_type", "status", "error_type", "model"]


def request_counters(requests: DataFrame) -> DataFrame:
    """Requests, errors, agent use and tokens by their labels, in one pass over the rows."""
    sets = {
        "requests": ["endpoint", "agent_type", "status"],
        "errors": ["endpoint", "error_type"],
        "agent_usage": ["agent_type"],
        "tokens": ["agent_type", "model"],
    }
    grouped = requests.groupingSets(
        [[F.col(c) for c in labels] for labels in sets.values()], *[F.col(c) for c in _LABELS]
    ).agg(
        F.grouping_id().alias("__set"),
        F.count(F.lit(1)).alias("__n"),
        F.sum("tokens").alias("__tokens"),
    )
    ids = {
        name: sum(1 << (len(_LABELS) - 1 - i) for i, c in enumerate(_LABELS) if c not in labels)
        for name, labels in sets.items()
    }
    counter = F.coalesce(*[F.when(F.col("__set") == v, F.lit(k)) for k, v in ids.items()])
    value = F.when(counter == "tokens", F.col("__tokens")).otherwise(F.col("__n"))
    counted = grouped.select(
        counter.alias("counter"), *_LABELS, value.cast("bigint").alias("value")
    )
    no_error = (F.col("counter") == "errors") & F.col("error_type").isNull()
    no_tokens = (F.col("counter") == "tokens") & F.col("value").isNull()
    return counted.where(~no_error & ~no_tokens)


def latency_histogram(requests: DataFrame, buckets=None) -> DataFrame:
    """Cumulative response time buckets with sum and count per endpoint and agent."""
    bounds = buckets or rules.LATENCY_BUCKETS
    grouped = requests.where(F.col("duration").isNotNull()).groupBy("endpoint", "agent_type").agg(
        *[F.count_if(F.col("duration") <= b).alias(f"__b{i}") for i, b in enumerate(bounds)],
        F.count(F.lit(1)).alias("count"),
        F.sum("duration").alias("sum"),
    )
    rows = [
        F.struct(F.lit(str(b)).alias("le"), F.col(f"__b{i}").alias("n"))
        for i, b in enumerate(bounds)
    ]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("n")))
    return grouped.select(
        "endpoint", "agent_type", "count", "sum", F.explode(F.array(*rows)).alias("b")
    ).select("endpoint", "agent_type", "b.le", "b.n", "count", "sum")


def service_summary(requests: DataFrame) -> DataFrame:
    """Observed time span, requests, errors and error rate."""
    n, errors = F.count(F.lit(1)), F.count_if(F.col("status") == "error")
    span = F.max("started_at").cast("timestamp").cast("double") - F.min("started_at").cast(
        "timestamp"
    ).cast("double")
    return requests.agg(
        F.bround(span, 3).alias("uptime_seconds"),
        n.alias("total_requests"),
        errors.alias("total_errors"),
        F.bround(errors / F.greatest(n, F.lit(1)), 6).alias("error_rate"),
    )


def active_requests(requests: DataFrame, slot: str = "minute") -> DataFrame:
    """Open requests per endpoint after every instant at which one starts or ends.

    The running sum is taken inside short time slots and lifted by the sum of all earlier slots,
    so a busy endpoint is never put in order in one task: a slot has at most one row per instant.
    """
    changes = F.array(
        F.struct(F.col("started_at").alias("at"), F.lit(1).alias("d")),
        F.struct(F.col("ended_at").alias("at"), F.lit(-1).alias("d")),
    )
    moves = requests.select("endpoint", F.explode(changes).alias("c")).select(
        "endpoint", F.col("c.at").alias("at"), F.col("c.d").alias("d"),
        F.date_trunc(slot, F.col("c.at")).alias("__slot"),
    ).where(F.col("at").isNotNull())
    steps = moves.groupBy("endpoint", "__slot", "at").agg(F.sum("d").alias("__d"))
    slots = moves.groupBy("endpoint", "__slot").agg(F.sum("d").alias("__net"))
    earlier = Window.partitionBy("endpoint").orderBy("__slot").rowsBetween(
        Window.unboundedPreceding, -1
    )
    base = slots.select(
        "endpoint", "__slot", F.coalesce(F.sum("__net").over(earlier), F.lit(0)).alias("__base")
    )
    inside = Window.partitionBy("endpoint", "__slot").orderBy("at").rowsBetween(
        Window.unboundedPreceding, 0
    )
    running = steps.withColumn("__run", F.sum("__d").over(inside))
    return running.join(base, ["endpoint", "__slot"]).select(
        "endpoint", "at", (F.col("__base") + F.col("__run")).alias("active")
    )


def load_summary(samples: DataFrame) -> DataFrame:
    """Success and response times by round and over all rounds (``round`` = ``all``)."""
    percents = [50, 90]
    labels = F.explode(F.array(F.col("round").cast("string"), F.lit("all")))
    labelled = samples.select(labels.alias("round"), "ok", "ttfb", "total_time")
    good = labelled.where("ok")
    base = labelled.groupBy("round").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("ok").alias("succeeded"),
        *[
            fn(F.when(F.col("ok"), F.col(c))).alias(f"{c}_{name}")
            for c in ("ttfb", "total_time")
            for name, fn in (("min", F.min), ("max", F.max))
        ],
    )
    times = ["ttfb", "total_time"]
    ranks = pin(nearest_ranks(good, times, percents, ["round"]), "load-percentiles")
    for column in times:
        own = ranks.where(F.col("column") == column)
        base = base.join(widen(own, percents, ["round"], f"{column}_p"), "round", "left")
    return base
