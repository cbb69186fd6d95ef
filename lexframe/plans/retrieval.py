"""Tiered retrieval for a table of questions: exact article, scoped search, open search, fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import (
    article_display, collapse_space, detect_entity, extract_article_ref, mentions_unknown_entity, priority_scope,
    strip_space,
)
from ..operators.corpus import KEYS
from ..operators.keyed import keep_first
from ..operators.vectors import vector_topk
from ..session import pin

_CITATIONS = "array<struct<law_name:string,article_number:string,score:double,rank:int>>"


def understand(questions: DataFrame, names=None, scope_rules=None) -> DataFrame:
    """Adds ``name, article, unknown`` and ``scope`` (preferred law) to questions."""
    text, dense = F.col("question"), F.col("__dense")
    read = questions.withColumn("__dense", collapse_space(text)).withColumns({
        "name": detect_entity(text, names, dense),
        "article": extract_article_ref(text),
        "scope": priority_scope(text, scope_rules, dense),
    }).drop("__dense")
    unknown = mentions_unknown_entity(text, F.col("name"), F.col("article"))
    return read.withColumn("unknown", unknown)


def widening_search(questions: DataFrame, points: DataFrame, k: int, **limits) -> DataFrame:
    """Search in the question's scope; search everywhere when it has none or, with ``widen``,
    when the scope gives no good hit.

    ``questions`` has ``query_id, embedding, scope, widen``. Both result tables hold at most ``k``
    rows per question and are written out, so the wider search runs for the open questions only
    and nothing is scored twice.
    """
    corpus = points.select(
        F.col("point_id").alias("candidate_id"), "embedding", F.col(KEYS[0]).alias("scope")
    )
    in_scope = questions.where(F.col("scope").isNotNull())
    scoped = pin(vector_topk(in_scope, corpus, k, scope=True, **limits), "scoped-hits")
    good = scoped.where(
        (F.col("rank") == 1) & (F.col("score") >= rules.OPEN_SCOPE_MIN_SCORE)
    ).select("query_id")
    retried = in_scope.where("widen").join(good, "query_id", "left_anti")
    open_ones = questions.where(F.col("scope").isNull()).unionByName(retried)
    opened = pin(vector_topk(open_ones, corpus, k, **limits), "open-hits")
    kept = scoped.join(open_ones.select("query_id"), "query_id", "left_anti")
    return kept.unionByName(opened)


def _with_payload(hits: DataFrame, points: DataFrame, text) -> DataFrame:
    """Hits with law, article and what is needed of their text."""
    payload = points.select(
        F.col("point_id").alias("candidate_id"), "law_name",
        F.col(KEYS[1]).alias("article_norm"), *text,
    )
    joined = hits.join(payload, "candidate_id")
    return joined.withColumnRenamed("query_id", "question_id")


def _label(law, article):
    return F.concat(law, F.lit(" "), article_display(article))


def _direct(asked: DataFrame, articles: DataFrame, points: DataFrame, available: bool):
    """Exact articles. While the article table is unavailable the vector payload answers."""
    source = "pg" if available else "qdrant"
    table = articles if available else points
    wanted = asked.select("question_id", F.col("name").alias(KEYS[0]),
                          F.col("article").alias(KEYS[1]))
    # only whether a key has a text travels, not the text
    known = table.groupBy(*KEYS).agg(F.min(F.col("text") != "").alias("has_text"))
    joined = wanted.join(known, KEYS, "left")
    found = F.coalesce("has_text", F.lit(False))
    missing = "not_found" if available else "unavailable"
    label = _label(F.col(KEYS[0]), F.col(KEYS[1]))
    cited = F.array(F.struct(
        F.col(KEYS[0]).alias("law_name"), F.col(KEYS[1]).alias("article_number"),
        F.lit(1.0).alias("score"), F.lit(1).alias("rank"),
    ))
    return joined.select(
        "question_id",
        F.when(found, "answered").otherwise(missing).alias("status"),
        F.lit("direct_article").alias("query_type"),
        F.when(found, source).alias("selected_source"),
        F.when(found, F.array(label)).otherwise(_no_strings()).alias("selected_articles"),
        F.when(found, cited.cast(_CITATIONS)).otherwise(_no_citations()).alias("citations"),
        F.lit(False).alias("fallback_used"),
        F.lit(None).cast("double").alias("confidence_score"),
    )


def _no_strings():
    return F.array().cast("array<string>")


def _no_citations():
    return F.array().cast(_CITATIONS)


def _collected(hits: DataFrame) -> DataFrame:
    """Per question: best score and its non-empty, distinct articles in rank order.

    A question has at most ``KEEP_LIMIT`` hits, so its list is deduplicated in place.
    """
    row = F.struct("rank", "law_name", "article_norm", "score", "has_words")
    filled = F.collect_list(F.when(F.col("has_text"), row))
    grouped = hits.groupBy("question_id").agg(
        F.max("score").alias("top"), F.sort_array(filled).alias("hits")
    )

    def repeated(hit, i):
        return F.exists(F.slice("hits", F.lit(1), i), lambda earlier: (
            earlier["law_name"].eqNullSafe(hit["law_name"])
            & earlier["article_norm"].eqNullSafe(hit["article_norm"])
        ))

    return grouped.withColumn("hits", F.filter("hits", lambda hit, i: ~repeated(hit, i)))


def tiered_retrieve(questions: DataFrame, articles: DataFrame, points: DataFrame,
                    mode: str = "service", compat: bool = False, available: bool = True,
                    names=None, scope_rules=None, **limits) -> DataFrame:
    """One row per question: status, source, articles, citations, fallback flag and confidence.

    ``questions`` has ``question_id, question, embedding`` (of the expanded question). In
    ``service`` mode a named article is looked up and never replaced by another one; a named law
    is searched for its single best article; anything else is searched widely. ``eval`` mode lets
    a missing exact article fall through to the search and applies no final threshold.
    ``compat`` reports a named-law hit as (name, "", 1.0). With ``available=False`` exact
    questions are answered from the vector payload.
    """
    if mode == "eval":
        return _evaluate(questions, articles, points, names, scope_rules, limits)
    asked = pin(understand(questions, names, scope_rules), "questions")
    named, numbered = F.col("name").isNotNull(), F.col("article") != ""
    direct = _direct(asked.where(named & numbered), articles, points, available)

    searched = asked.where(~(named & numbered)).select(
        F.col("question_id").alias("query_id"), "embedding",
        F.coalesce("name", "scope").alias("scope"), (~named).alias("widen"),
    )
    hits = widening_search(searched, points, rules.KEEP_LIMIT, **limits)
    text = F.coalesce("text", F.lit(""))
    found = _collected(_with_payload(hits, points, [
        (text != "").alias("has_text"), (strip_space(text) != "").alias("has_words"),
    ]))
    open_ = asked.where(~(named & numbered)).select("question_id", "name", "unknown")
    joined = open_.join(found, "question_id", "left")

    is_named = F.col("name").isNotNull()
    first = F.try_element_at("hits", F.lit(1))
    best = F.when(first["rank"] == 1, first)
    wide_ok = ~is_named & (F.col("top") >= rules.OPEN_SCOPE_MIN_SCORE) & ~F.col("unknown")
    named_ok = (
        is_named & (F.col("top") >= rules.NAMED_SCOPE_MIN_SCORE)
        & best["has_words"]
    )
    wide_ok, named_ok = (F.coalesce(c, F.lit(False)) for c in (wide_ok, named_ok))
    listed = F.coalesce("hits", F.array().cast(
        "array<struct<rank:int,law_name:string,article_norm:string,score:double,has_words:boolean>>"
    ))
    kept = F.when(named_ok, F.slice(listed, 1, 1)).when(wide_ok, listed)
    labels = F.transform(kept, lambda h: F.when(
        h["article_norm"] != "", _label(h["law_name"], h["article_norm"])
    ).otherwise(h["law_name"]))
    cited = F.transform(kept, lambda h, i: F.struct(
        h["law_name"].alias("law_name"), h["article_norm"].alias("article_number"),
        F.bround(h["score"], 4).alias("score"), (i + 1).alias("rank"),
    ))
    if compat:
        quirk = F.array(F.struct(
            F.col("name").alias("law_name"), F.lit("").alias("article_number"),
            F.lit(1.0).alias("score"), F.lit(1).alias("rank"),
        ))
        cited = F.when(named_ok, quirk.cast(_CITATIONS)).otherwise(cited.cast(_CITATIONS))
    answered = wide_ok | named_ok
    semantic = joined.select(
        "question_id",
        F.when(answered, "answered").otherwise("web_fallback").alias("status"),
        F.lit("semantic").alias("query_type"),
        F.when(answered, "qdrant").otherwise("web").alias("selected_source"),
        F.coalesce(labels, _no_strings()).alias("selected_articles"),
        F.coalesce(cited.cast(_CITATIONS), _no_citations()).alias("citations"),
        (~answered).alias("fallback_used"),
        F.when(wide_ok, first["score"]).alias("confidence_score"),
    )
    return direct.unionByName(semantic)


def _evaluate(questions, articles, points, names, scope_rules, limits) -> DataFrame:
    asked = pin(understand(questions, names, scope_rules), "questions")
    wanted = asked.where(F.col("name").isNotNull() & (F.col("article") != "")).select(
        "question_id", F.col("name").alias(KEYS[0]), F.col("article").alias(KEYS[1])
    )
    exact = keep_first(
        wanted.join(articles.select(*KEYS, "text"), KEYS),
        "question_id", F.col("text").asc(),
    )
    direct = exact.select(
        "question_id",
        F.array(strip_space(F.col("text"))).alias("contexts"),
        F.array(_label(F.col(KEYS[0]), F.col(KEYS[1]))).alias("retrieved_articles"),
    )
    rest = asked.join(exact.select("question_id"), "question_id", "left_anti")
    searched = rest.select(
        F.col("question_id").alias("query_id"), "embedding", "scope", F.lit(True).alias("widen")
    )
    hits = widening_search(searched, points, rules.KEEP_LIMIT, **limits)
    rows = _with_payload(hits, points, ["text"]).where(strip_space(F.col("text")) != "")
    label = F.when(
        F.col("article_norm") != "", _label(F.col("law_name"), F.col("article_norm"))
    ).otherwise(F.col("law_name"))
    listed = F.sort_array(F.collect_list(
        F.struct("rank", strip_space(F.col("text")).alias("text"), label.alias("label"))
    ))
    grouped = rows.groupBy("question_id").agg(listed.alias("h")).select(
        "question_id",
        F.transform("h", lambda x: x["text"]).alias("contexts"),
        F.transform("h", lambda x: x["label"]).alias("retrieved_articles"),
    )
    semantic = rest.select("question_id").join(grouped, "question_id", "left").select(
        "question_id",
        F.coalesce("contexts", _no_strings()).alias("contexts"),
        F.coalesce("retrieved_articles", _no_strings()).alias("retrieved_articles"),
    )
    return direct.unionByName(semantic)
