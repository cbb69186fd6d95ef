"""Turns of question-and-answer sessions: pairing, context, summaries, search, maintenance.

Turns have ``session_id, turn_index, role, content`` and, where an operator needs them,
``id, user_id, metadata, score, feedback, created_at, updated_at``. Question and answer of a
request share one ``created_at``, so time order is always completed by ``turn_index`` and ``id``.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import json_field, preview, quality_score, search_term, short_tool
from ..functions.text import SPACE
from ..session import pin
from .keyed import latest_by_key, newest, top_per_group

TIME_ORDER = ("created_at", "turn_index", "id")
PAIR_KEYS = ["session_id", "turn_index"]
GRAM = 3
TERMS_PER_BLOCK = 1024
BLOCK_CHARS = 1 << 20


def _ordered(turns: DataFrame) -> list[str]:
    return [c for c in TIME_ORDER if c in turns.columns]


def pair_turns(turns: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Every user turn with the assistant turn right after it; unanswered turns drop out.

    ``asked`` stands in for the user turns when they were filtered beforehand.
    """
    asked = user_questions(turns) if asked is None else asked
    return asked.join(_answers(turns), ["session_id", "turn_index"])


def _answers(turns: DataFrame) -> DataFrame:
    """Assistant turns under the turn index of the question they may answer."""
    return turns.where(F.col("role") == "assistant").select(
        "session_id",
        (F.col("turn_index") - 1).alias("turn_index"),
        F.col("content").alias("answer"),
    )


def user_questions(turns: DataFrame) -> DataFrame:
    """User turns in the columns that pairs have."""
    return turns.where(F.col("role") == "user").select(
        "session_id", "turn_index", F.col("content").alias("question"), *_extra(turns)
    )


def recent_pairs(turns: DataFrame, n: int = 5, order=None) -> DataFrame:
    """The newest ``n`` question/answer pairs of all sessions.

    The pairs are found by their keys alone; the texts are then read for those (at most ``n``)
    keys only, so no text that is not part of the result is shuffled.
    """
    keys = ["session_id", "turn_index"]
    asked, answers = user_questions(turns), _answers(turns)
    order = newest(*(order or _ordered(asked)))
    found = asked.join(answers, keys).orderBy(*order).limit(n).select(*keys).distinct()
    found = F.broadcast(found)
    picked = asked.join(found, keys, "left_semi").join(
        answers.join(found, keys, "left_semi"), keys
    )
    return picked.orderBy(*order).limit(n)


def keyword_filter(df: DataFrame, column: str, term: Column) -> DataFrame:
    """Case-insensitive containment; ``%`` and ``_`` in the term act as wildcards."""
    return df.where(_contains(F.col(column), term))


def _has_wildcard(term: Column) -> Column:
    return term.rlike(r"[%_\\]")


def _contains(text: Column, term: Column) -> Column:
    plain = F.lower(text).contains(F.lower(term))
    wild = F.ilike(text, F.concat(F.lit("%"), term, F.lit("%")))
    return F.when(_has_wildcard(term), wild).otherwise(plain)


def search_history(queries: DataFrame, turns: DataFrame, n: int = 5, order=None,
                   block_terms: int = TERMS_PER_BLOCK) -> DataFrame:
    """Newest ``n`` pairs whose question contains the query's subject, else the newest ``n`` pairs.

    ``queries`` has ``query_id, query``. Every distinct term is searched once. The questions' trigrams
    are postings; a term looks up those of its rarest trigram, and what they name is verified, so the work follows the
    matches and not terms times questions. A term with a trigram that no question has matches nothing. Terms of under
    three characters and those with wildcards travel with one scan of the questions, in blocks of at most about
    ``block_terms`` terms and ``BLOCK_CHARS`` characters.
    """
    asked = user_questions(turns)
    order = list(order or _ordered(asked))
    terms = queries.select("query_id", search_term(F.col("query")).alias("term")).where(F.col("term") != "")
    terms = terms.select("query_id", F.lower("term").alias("term"), _has_wildcard(F.col("term")).alias("wild"))
    distinct = terms.select("term", "wild").distinct()
    by_gram = ~F.col("wild") & (F.length("term") >= GRAM)
    answers = _answers(turns)
    answered = asked.join(answers.select(*PAIR_KEYS).distinct(), PAIR_KEYS, "left_semi")
    named = _named(asked, distinct.where(by_gram))
    matched = _matched(answered, named, distinct.where(~by_gram), block_terms)
    # the newest keys of a term are found without the texts, which are then read for those keys only
    leading = top_per_group(matched, "term", newest(*order), n).select("term", *PAIR_KEYS).distinct()
    named_again = asked.join(leading, PAIR_KEYS).where(_contains(F.col("question"), F.col("term")))
    newest_asked = top_per_group(named_again, "term", newest(*order), n)
    columns = [*PAIR_KEYS, "question", "answer", *_extra(turns)]
    hits = top_per_group(newest_asked.join(answers, PAIR_KEYS), "term", newest(*order), n)
    hits = terms.join(hits, "term").select("query_id", *columns, F.lit(True).alias("matched"))
    pair = F.struct(*columns)
    recent = recent_pairs(turns, n, order).agg(F.collect_list(pair).alias("pairs"))
    joined = queries.select("query_id").join(hits, "query_id", "left")
    shown = F.when(F.col("matched"), F.array(pair)).otherwise(recent.scalar())
    return joined.select(
        "query_id", F.coalesce("matched", F.lit(False)).alias("matched"),
        F.explode(shown).alias("pair"),
    ).select("query_id", *[F.col("pair")[c].alias(c) for c in columns], "matched")


def _grams(text: Column) -> Column:
    """The distinct overlapping trigrams of a text, in one pass over it."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), 1))


def _named(asked: DataFrame, terms: DataFrame) -> DataFrame:
    """Per question the ``named`` terms whose rarest trigram it has."""
    postings = asked.select(*PAIR_KEYS, F.explode(_grams(F.lower("question"))).alias("gram"))
    of_terms = terms.select("term", F.explode(_grams(F.col("term"))).alias("gram"))
    held = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("held"))
    held_by = F.coalesce("held", F.lit(0))
    lead = of_terms.join(held, "gram", "left").groupBy("term").agg(
        F.min_by("gram", held_by).alias("gram"), F.min(held_by).alias("least")
    ).where("least > 0").select("term", "gram")
    looked_up = postings.join(pin(lead, "history-leads"), "gram")
    return looked_up.groupBy(*PAIR_KEYS).agg(F.collect_set("term").alias("named"))


def _matched(asked: DataFrame, named: DataFrame, others: DataFrame, block_terms: int) -> DataFrame:
    """Questions of ``asked``, without their texts, with every ``term`` they contain: those named for them, and all of
    ``others`` by trial. A row per match is sorted and shuffled, so it has to be short."""
    columns = [c for c in asked.columns if c != "question"]
    n_terms, chars = others.agg(F.count(F.lit(1)), F.sum(F.length("term"))).first()
    packed = F.collect_list(F.struct("term", "wild"))
    n_blocks = max(1, math.ceil(n_terms / block_terms), math.ceil((chars or 0) / BLOCK_CHARS))
    block = F.pmod(F.xxhash64("term"), F.lit(n_blocks))
    lowered = asked.withColumn("lowered", F.lower("question"))
    by_trial = []
    for number in range(n_blocks):
        tried = lowered.withColumn("terms", others.where(block == number).agg(packed).scalar())
        by_trial.append(tried.select(*columns, F.explode(_matching()).alias("term")))
    found = F.filter("named", lambda term: F.col("lowered").contains(term))
    by_name = lowered.join(named, PAIR_KEYS).select(*columns, F.explode(found).alias("term"))
    return reduce(DataFrame.unionAll, by_trial, by_name)


def _matching() -> Column:
    """Terms (of the column ``terms``) that the question contains."""
    text = F.col("lowered")
    found = F.filter("terms", lambda t: F.when(
        t["wild"], F.like(text, F.concat(F.lit("%"), t["term"], F.lit("%")))
    ).otherwise(text.contains(t["term"])))
    return F.transform(found, lambda t: t["term"])


def _extra(turns: DataFrame) -> list[str]:
    return [c for c in ("created_at", "id") if c in turns.columns]


def session_context(turns: DataFrame, n: int = 5, user_label: str = "사용자",
                    other_label: str = "assistant", order=None) -> DataFrame:
    """The newest ``2n`` turns of each session, in time order, one labelled line per turn."""
    order = list(order or _ordered(turns))
    speaker = F.when(F.col("role") == "user", user_label).otherwise(other_label)
    last = top_per_group(turns, "session_id", newest(*order), 2 * n)
    line = F.concat(speaker, F.lit(": "), F.col("content")).alias("line")
    lines = F.sort_array(F.collect_list(F.struct(*order, line)))
    return last.groupBy("session_id").agg(
        F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("context")
    )


def last_tool(turns: DataFrame) -> DataFrame:
    """Tool of the newest assistant turn of each session; empty when it has none."""
    sessions = turns.groupBy("session_id").agg(
        F.max_by(
            json_field(F.col("metadata"), "tool"),
            F.when(F.col("role") == "assistant", F.col("id")),
        ).alias("tool")
    )
    return sessions.select("session_id", F.coalesce("tool", F.lit("")).alias("tool"))


def chat_statistics(turns: DataFrame) -> DataFrame:
    """Use of each tool by assistant turns."""
    return (
        turns.where(F.col("role") == "assistant")
        .groupBy(json_field(F.col("metadata"), "tool").alias("tool_name"))
        .agg(
            F.count(F.lit(1)).alias("usage_count"),
            F.avg("score").alias("avg_score"),
            F.max("created_at").alias("last_used"),
            F.countDistinct("user_id").alias("unique_users"),
        )
    )


def tool_stats(turns: DataFrame) -> DataFrame:
    """Like :func:`chat_statistics`, with the score rounded for display, most used first."""
    score = F.bround(F.avg("score"), 1)
    return (
        turns.where(F.col("role") == "assistant")
        .groupBy(json_field(F.col("metadata"), "tool").alias("tool"))
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.coalesce(score, F.lit(0.0)).alias("avg_score"),
            F.max("created_at").alias("last_used"),
        )
        .orderBy(F.desc("count"), F.asc("tool"))
    )


def session_summary(turns: DataFrame, window: int = 200, title_chars: int = 60) -> DataFrame:
    """Sessions among the newest ``window`` rows of each user: first question and last activity."""
    order = _ordered(turns)
    recent = top_per_group(turns, "user_id", newest(*order), window)
    position = F.struct(*order)
    session = F.coalesce(F.nullif(F.col("session_id").cast("string"), F.lit("")), F.lit("default"))
    asked = F.when(F.col("role") == "user", position)
    return (
        recent.groupBy("user_id", session.alias("session_id"))
        .agg(
            F.min_by("content", asked).alias("title"),
            F.max_by("created_at", position).alias("last_active"),
            F.count_if(F.col("role") == "user").alias("questions"),
        )
        .where(F.col("questions") > 0)
        .select(
            "user_id", "session_id",
            preview(F.col("title"), title_chars).alias("title"),
            "last_active",
        )
    )


def history(turns: DataFrame, user_id=None, limit: int = 50) -> DataFrame:
    """Newest turns of one user, or of every user when none is given."""
    shown = [
        "user_id", "id", "session_id", "role", "content",
        json_field(F.col("metadata"), "tool").alias("tool"), "score", "created_at", "turn_index",
    ]
    order = newest(*_ordered(turns))
    if user_id is not None:
        return turns.where(F.col("user_id") == user_id).orderBy(*order).limit(limit).select(*shown)
    return top_per_group(turns, "user_id", order, limit).select(*shown)


def session_turns(turns: DataFrame, session_id=None, limit: int = 50) -> DataFrame:
    """First turns of one session, or of every session when none is given."""
    order = _ordered(turns)
    if session_id is not None:
        return turns.where(F.col("session_id") == session_id).orderBy(*order).limit(limit)
    return top_per_group(turns, "session_id", order, limit)


def validate_turns(turns: DataFrame) -> DataFrame:
    """Reason to reject a turn; NULL for valid turns."""
    bad_role = ~F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False))
    bad_feedback = ~F.coalesce(F.col("feedback").isin(1, -1), F.lit(True))
    return turns.withColumn(
        "reject_reason", F.when(bad_role, "role").when(bad_feedback, "feedback")
    )


def drop_empty_answers(answers: DataFrame, column: str = "answer") -> DataFrame:
    """Answers that hold at least one character that is not whitespace."""
    return answers.where(F.col(column).rlike(f"[^{SPACE}]"))


def delete_sessions(turns: DataFrame, ids: DataFrame | None = None,
                    prefix: str | None = None) -> DataFrame:
    """Turns left after removing sessions by id or by id prefix."""
    if prefix is not None:
        turns = turns.where(~F.coalesce(F.col("session_id").startswith(prefix), F.lit(False)))
    if ids is not None:
        turns = turns.join(ids.select("session_id").distinct(), "session_id", "left_anti")
    return turns


def apply_feedback(turns: DataFrame, feedback: DataFrame, now: Column) -> DataFrame:
    """Set +1/-1 on assistant turns by id; the last vote counts, other turns stay as they are.

    ``feedback`` has ``id, value, position``.
    """
    votes = latest_by_key(feedback.where(F.col("value").isin(1, -1)), "id", "position")
    votes = votes.select("id", F.col("value").alias("__vote"))
    joined = turns.join(votes, "id", "left")
    voted = F.col("__vote").isNotNull() & (F.col("role") == "assistant")
    return (
        joined.withColumn("feedback", F.when(voted, F.col("__vote")).otherwise(F.col("feedback")))
        .withColumn("updated_at", F.when(voted, now).otherwise(F.col("updated_at")))
        .select(*turns.columns)
    )


def cascade_citations(citations: DataFrame, turns: DataFrame) -> DataFrame:
    """Citations whose turn still exists."""
    kept = turns.select(F.col("id").alias("chat_history_id"))
    return citations.join(kept, "chat_history_id", "left_semi")


def append_turns(answered: DataFrame, default_session: str = "default_session", keep=()) -> DataFrame:
    """Two rows per answered question; ``answered`` has
    ``session_id, user_id, question, answer, tool, asked_at``. Empty answers are not stored.
    The columns named in ``keep`` are passed on."""
    stored = drop_empty_answers(answered)
    turn = F.unix_seconds(F.col("asked_at").cast("timestamp"))
    rows = F.array(
        F.struct(turn.alias("turn_index"), F.lit("user").alias("role"),
                 F.col("question").alias("content")),
        F.struct((turn + 1).alias("turn_index"), F.lit("assistant").alias("role"),
                 F.col("answer").alias("content")),
    )
    session = F.coalesce(F.nullif("session_id", F.lit("")), F.lit(default_session))
    return stored.select(
        *keep,
        session.alias("session_id"),
        "user_id",
        F.to_json(F.struct(short_tool(F.col("tool")).alias("tool"))).alias("metadata"),
        quality_score(F.col("answer")).alias("score"),
        F.col("asked_at").alias("created_at"),
        F.explode(rows).alias("turn"),
    ).select(*keep, "session_id", "user_id", "metadata", "score", "created_at", "turn.*")


def citation_rows(answered: DataFrame) -> DataFrame:
    """One row per citation of a stored answer; ``answered`` has ``chat_history_id, citations``."""
    return answered.select("chat_history_id", F.explode("citations").alias("c")).select(
        "chat_history_id",
        F.coalesce("c.law_name", F.lit("")).alias("law_name"),
        F.coalesce("c.article_number", F.lit("")).alias("article_number"),
        F.col("c.score").alias("score"),
        F.col("c.rank").alias("rank"),
    )
