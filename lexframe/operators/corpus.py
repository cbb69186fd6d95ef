"""Versioned article tables: extraction, merge, stale rows, reconciliation, vectors, caches.

Plain files know no MERGE or DELETE, so every operator returns the new table; see
``sources.parts`` for replacing parts of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import (
    article_display, article_forms, clean_text, content_hash, normalize_name, point_id,
)
from ..functions.articles import date_field, date_node, date_value, last_of_list
from ..functions.text import SPACE
from ..session import pin
from .keyed import latest_by_key
from .keyfilter import listed_by, split_by_keys, without_keys

KEYS = ["law_name_norm", "article_number_norm"]
_REPEALED = (
    rf"^제[{SPACE}]*\p{{Nd}}+[{SPACE}]*조(?:의[{SPACE}]*\p{{Nd}}+)?[{SPACE}]*삭제"
)
_LAW = "`법령` struct<`시행일자`: string, `시행일`: string, `조문`: string>"
_UNIT = "`조문여부` string, `조문번호` string, `조문가지번호` string, `조문시행일자` string"


def article_units(documents: DataFrame) -> DataFrame:
    """One row per unit node; ``documents`` has ``law_name, doc`` (JSON text).

    The unit list may be missing (the container itself is the unit), a single object, or the
    container may already be a list. Whatever belongs to the law is read before the units are
    exploded, so the document is not carried along.
    """
    law = F.from_json("doc", _LAW)["법령"]
    read = documents.withColumn("law", law).select(
        "law_name", F.col("law.시행일자").alias("law_date"), F.col("law.시행일").alias("law_date_short"),
        F.col("law.조문").alias("holder"),
    )
    inner = F.when(F.col("holder").startswith("{"), F.get_json_object("holder", "$.조문단위"))
    read = read.withColumn("units", F.coalesce(inner, "holder")).drop("holder")
    listed = F.when(F.col("units").startswith("["), F.col("units")).otherwise(
        F.concat(F.lit("["), "units", F.lit("]"))
    )
    return read.select(
        "law_name", "law_date", "law_date_short",
        F.posexplode(F.from_json(listed, "array<string>")).alias("position", "unit"),
    )


def _digits(name: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(name), F.lit("")), r"[^\p{Nd}]", "")


def extract_articles(documents: DataFrame) -> DataFrame:
    """Articles of statute documents: headings, repealed and empty articles dropped."""
    units = article_units(documents).withColumn("head", F.from_json("unit", _UNIT))
    read = units.select(
        "law_name", "position",
        F.col("head.조문여부").alias("kind"),
        _digits("head.조문번호").alias("main"),
        _digits("head.조문가지번호").alias("branch"),
        date_node(F.col("head.조문시행일자"), F.col("law_date"), F.col("law_date_short")).alias(
            "date_node"),
        article_forms(F.col("unit"), F.col("law_name")).alias("forms"),
    ).withColumn("raw_text", F.col("forms.raw"))
    kept = read.where(
        (F.col("kind") == "조문") & (F.col("main") != "")
        & (F.col("raw_text") != "") & ~F.col("raw_text").rlike(_REPEALED)
    )
    number = F.when(
        F.col("branch") != "", F.concat("main", F.lit("의"), "branch")
    ).otherwise(F.col("main"))
    articles = kept.withColumns({
        "article_number_norm": number,
        "date_node": last_of_list(F.col("date_node")),
        "text": clean_text(F.col("raw_text"), F.coalesce("forms.composed", "raw_text")),
        "law_name_norm": normalize_name(F.col("law_name"), F.coalesce("forms.name", "law_name")),
    }).withColumn("day", date_field(F.col("date_node")))
    key = F.concat_ws(":", "law_name_norm", "article_number_norm", "position")
    return articles.select(
        F.sha2(key, 256).alias("chunk_id"),
        "law_name", "law_name_norm",
        article_display(F.col("article_number_norm")).alias("article_number"),
        "article_number_norm", "text",
        date_value(F.col("day")).alias("enforcement_date"),
        "position",
    )


def merge_articles(target: DataFrame, incoming: DataFrame, now: Column, written: bool = False) -> DataFrame:
    """Insert or update by key.

    A match replaces number, text and date and moves ``updated_at``; its chunk id, name and
    creation time stay. Of repeated incoming keys the last one is written, but a new key keeps
    the chunk id and name of the first. Keys that the target has or that come in more than once are found
    among keys alone; rows of other keys are passed on as they are. ``incoming`` is read several times and written out
    first, unless it is a ``written`` table.
    """
    incoming = incoming if written else pin(incoming, "incoming")
    counted = incoming.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.count("position").alias("placed"))
    old = target.select(*KEYS).distinct().withColumn("known", F.lit(True))
    meeting = counted.join(old, KEYS, "left").where("known OR n > 1 OR placed = 0").select(*KEYS, "placed")
    meeting = pin(meeting, "meeting-keys")
    (kept, met), (added, changes) = split_by_keys(meeting.select(*KEYS), target, incoming)
    # the old text of a row that is surely replaced need not travel
    unreplaced = met.select(*KEYS).distinct().join(meeting.where("placed > 0").select(*KEYS), KEYS, "left_anti")
    stays = listed_by(pin(unreplaced, "unreplaced-keys"), met)[0]
    met = met.withColumn("text", F.when(stays, F.col("text")))
    new = added.select(
        "chunk_id", "law_name", *KEYS, "article_number", "text", "enforcement_date",
        now.alias("created_at"), now.alias("updated_at"),
    )
    return kept.select(*new.columns).unionByName(new).unionByName(_merge_met(met, changes, now))


def _merge_met(target: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """The merge for rows whose keys may meet. Their increment is written out first, so Spark knows its size;
    the target's rows only look it up, and only its keys are needed to find what is new."""
    position = "position"
    fresh = incoming.groupBy(*KEYS).agg(
        F.min_by(F.struct("chunk_id", "law_name"), position).alias("born"),
        F.max_by(F.struct("article_number", "text", "enforcement_date"), position).alias("new"),
    )
    old = target.select(
        *KEYS, F.struct("chunk_id", "law_name", "article_number", "text", "enforcement_date",
                        "created_at", "updated_at").alias("old"),
    )
    fresh = pin(fresh, "increment")
    added = fresh.join(target.select(*KEYS), KEYS, "left_anti").withColumn(
        "old", F.lit(None).cast(old.schema["old"].dataType)
    )
    merged = old.join(fresh, KEYS, "left").unionByName(added)
    known, changed = F.col("old").isNotNull(), F.col("new").isNotNull()

    def kept(name: str, otherwise: Column) -> Column:
        return F.when(known, F.col("old")[name]).otherwise(otherwise).alias(name)

    def replaced(name: str) -> Column:
        return F.when(changed, F.col("new")[name]).otherwise(F.col("old")[name]).alias(name)

    return merged.select(
        kept("chunk_id", F.col("born.chunk_id")),
        kept("law_name", F.col("born.law_name")),
        *KEYS,
        replaced("article_number"),
        replaced("text"),
        replaced("enforcement_date"),
        kept("created_at", now),
        F.when(changed, now).otherwise(F.col("old.updated_at")).alias("updated_at"),
    )


def flag_stale(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Adds ``stale``: the row's law has incoming rows, but none with the row's number.

    Laws without incoming rows are left alone, and rows without an article number never count.
    Both look-ups are plain left joins, which adaptive execution splits where a law is large. The
    names of the laws are written first, so Spark knows whether they are few enough to broadcast.
    """
    keys = incoming.select(*KEYS).distinct().withColumn("__listed", F.lit(True))
    laws = pin(incoming.select(KEYS[0]).distinct(), "laws").withColumn("__synced", F.lit(True))
    flagged = current.join(keys, KEYS, "left").join(laws, KEYS[0], "left")
    stale = (
        F.col("__synced").isNotNull() & F.col("__listed").isNull() & F.col(KEYS[1]).isNotNull()
    )
    return flagged.withColumn("stale", stale).drop("__listed", "__synced")


def stale_articles(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows that the incoming version of their law no longer has."""
    return flag_stale(current, incoming).where("stale").select(*current.columns)


def remove_stale(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """The table without its stale rows. Which keys are stale is found among keys alone; see :func:`without_keys`."""
    stale = stale_articles(current.select(*KEYS).distinct(), incoming)
    return without_keys(current, pin(stale, "stale-keys"))


def reconcile(a: DataFrame, b: DataFrame, law: str = "law_name_norm") -> DataFrame:
    """Articles per law in both stores."""
    count_a = a.groupBy(law).agg(F.count(F.lit(1)).alias("count_a"))
    count_b = b.groupBy(law).agg(F.count(F.lit(1)).alias("count_b"))
    both = count_a.join(count_b, law, "full_outer")
    return both.select(
        law,
        F.coalesce("count_a", F.lit(0)).alias("count_a"),
        F.coalesce("count_b", F.lit(0)).alias("count_b"),
    ).withColumn("matches", F.col("count_a") == F.col("count_b"))


def unmatched(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys that only one store has, with ``only_in`` ``a`` or ``b``; what a differing count is made of."""
    keys_a = a.select(*KEYS).distinct().withColumn("__a", F.lit(True))
    keys_b = b.select(*KEYS).distinct().withColumn("__b", F.lit(True))
    both = keys_a.join(keys_b, KEYS, "full_outer").where("__a IS NULL OR __b IS NULL")
    return both.select(*KEYS, F.when(F.col("__b").isNull(), "a").otherwise("b").alias("only_in"))


def reconcile_summary(report: DataFrame) -> DataFrame:
    """One row: every law of store A agrees and the totals agree."""
    differing = F.count_if((F.col("count_a") > 0) & ~F.col("matches"))
    total_a, total_b = F.sum("count_a"), F.sum("count_b")
    return report.agg(
        F.count_if(F.col("count_a") > 0).alias("laws"),
        total_a.alias("total_a"),
        total_b.alias("total_b"),
        F.count_if(~F.col("matches")).alias("mismatches"),
        ((differing == 0) & (total_a == total_b)).alias("ok"),
    )


def vector_rows(articles: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vector points of articles; ``vectors`` has the keys and ``embedding``.

    ``vectors`` that carry the other columns of their articles unchanged are points already: only articles of repeated
    keys are joined to them, the others stay where they lie.
    """
    payload = [c for c in articles.columns if c not in ("chunk_id", "created_at", "updated_at",
                                                        "position")]

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.select(*payload).join(right.select(*KEYS, "embedding"), KEYS).select(*payload, "embedding")

    if set(payload) <= set(vectors.columns):
        repeated = articles.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*KEYS)
        (_, several), (single, others) = split_by_keys(pin(repeated, "repeated-keys"), articles, vectors)
        keyed = F.col(KEYS[0]).isNotNull() & F.col(KEYS[1]).isNotNull()
        rows = single.where(keyed).select(*payload, "embedding").unionByName(joined(several, others))
    else:
        rows = joined(articles, vectors)
    return rows.withColumn("point_id", point_id(F.col(KEYS[0]), F.col(KEYS[1])))


def upsert_vectors(points: DataFrame, incoming: DataFrame, order="position") -> DataFrame:
    """Replace points by id. Old points only meet the incoming ids, and only where those list theirs."""
    fresh = latest_by_key(incoming, "point_id", order) if order in incoming.columns else incoming
    replaced = points.select("point_id").distinct().join(incoming.select("point_id"), "point_id", "left_semi")
    kept = without_keys(points, pin(replaced, "replaced-points"))
    return kept.unionByName(fresh.select(*points.columns))


def cache_misses(texts: DataFrame, cache: DataFrame, column: str = "text") -> DataFrame:
    """Distinct texts without a cached vector. Copies collapse before the join."""
    hashed = texts.where(F.col(column).isNotNull()).select(
        content_hash(F.col(column)).alias("query_hash"), F.col(column).alias("query_text")
    )
    missing = hashed.join(cache.select("query_hash"), "query_hash", "left_anti")
    return missing.dropDuplicates(["query_hash"])


def cache_merge(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or replace by hash; the newest entry stays. Only hashes are compared as a whole: entries whose hash the
    other side has too, or ``new`` more than once, are put in order, all others are passed on as they are."""
    sides = cache.select("query_hash", F.lit(0).alias("n")).unionByName(new.select("query_hash", F.lit(1).alias("n")))
    counted = sides.groupBy(F.col("query_hash").alias("__hash")).agg(F.sum("n").alias("new"), F.count(F.lit(1)).alias("entries"))
    several = pin(counted.where("new > 0 AND entries > 1").select("__hash"), "hashes-in-order")
    # without a hash, old entries stay and of the new ones the newest
    old_too, new_too = F.col("query_hash") == F.col("__hash"), F.col("query_hash").eqNullSafe(F.col("__hash"))
    ordered = cache.join(several, old_too, "left_semi").unionByName(new.join(several, new_too, "left_semi"))
    alone = cache.join(several, old_too, "left_anti").unionByName(new.join(several, new_too, "left_anti"))
    return alone.unionByName(latest_by_key(ordered, "query_hash", "ts"))
