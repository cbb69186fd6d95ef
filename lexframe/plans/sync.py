"""Corpus sync: documents to articles, merge, removal of repealed articles, reconciliation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.corpus import (
    KEYS, extract_articles, merge_articles, reconcile, reconcile_summary, remove_stale,
    upsert_vectors, vector_rows,
)
from ..session import pin
from ..sources.statutes import split_documents


@dataclass
class SyncResult:
    """New tables and what happened."""

    articles: DataFrame
    points: DataFrame | None
    per_law: DataFrame
    quarantine: DataFrame
    report: DataFrame | None = None
    summary: DataFrame | None = None


def sync_corpus(target: DataFrame, documents: DataFrame, now: Column,
                points: DataFrame | None = None, embed=None) -> SyncResult:
    """New article and vector tables after taking in ``documents`` (``law_name, doc``).

    A document that is no law ends up in ``quarantine``; its law keeps all rows. A law without
    extracted articles is not touched either. ``embed`` maps extracted articles to a table of the
    keys and ``embedding``; without it only articles are synced. If that table keeps the other columns of the articles as
    they are, their texts are not moved to meet the vectors (see :func:`vector_rows`).
    """
    good, bad = split_documents(documents)
    incoming = pin(extract_articles(good), "incoming-articles", "zstd")
    # A stale row is never one that is merged, so it can go first: the old table is read once.
    articles = merge_articles(remove_stale(target, incoming), incoming, now, written=True)
    counts = incoming.groupBy("law_name").agg(F.count(F.lit(1)).alias("articles"))
    seen = good.select("law_name").distinct()
    per_law = seen.join(counts, "law_name", "left").select(
        "law_name", F.coalesce("articles", F.lit(0)).alias("articles"),
        F.when(F.col("articles").isNull(), "no_articles").otherwise("synced").alias("status"),
    ).unionByName(bad.select("law_name").distinct().select(
        "law_name", F.lit(0).cast("bigint").alias("articles"), F.lit("failed").alias("status"),
    ))
    result = SyncResult(articles, None, per_law, bad)
    if points is not None and embed is not None:
        fresh = vector_rows(incoming, embed(incoming))
        result.points = upsert_vectors(remove_stale(points, incoming), fresh)
        result.report = reconcile(articles, result.points, KEYS[0])
        result.summary = reconcile_summary(result.report)
    return result
