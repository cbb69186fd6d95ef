"""Citations in answers: extraction, verification, contexts and a grounding screen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import article_display, normalize_article, normalize_name, strip_space
from ..functions.text import SPACE
from .corpus import KEYS

_MARKS = "\x01\x02\x03"
_STRICT = rf"\[([^\]]+?)[{SPACE}]+제(\p{{Nd}}+(?:의\p{{Nd}}+)?)조\]"


def _pattern(text: str) -> str:
    """A notation for the JVM, with the digits and blanks of all scripts."""
    return text.replace(r"\s", f"[{SPACE}]").replace(r"\d", r"\p{Nd}")


def _placed(column: Column, notation: str, laws: list[int], article: int) -> Column:
    """(start, law_name, article_number) of every match of a notation.

    One replacement marks all matches and their groups, so the text is searched once; the lengths of the
    marked pieces add up to the places. Characters that serve as marks are blanks to the search.
    """
    plain = F.translate(column, _MARKS, " " * len(_MARKS))
    begin, cut, end = _MARKS
    law = "".join(f"${group}" for group in laws)
    marked = F.regexp_replace(plain, _pattern(notation), f"{begin}$0{cut}{law}{cut}${article}{end}")
    pieces = F.split(marked, end)
    empty = F.array().cast("array<struct<start:int,law_name:string,article_number:string>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("found"))

    def add(state: Column, piece: Column) -> Column:
        text, match, name, number = (F.get(F.split(piece, f"[{begin}{cut}]"), i) for i in range(4))
        place = state["at"] + F.char_length(text)
        return F.struct(
            (place + F.char_length(match)).alias("at"),
            F.array_append(state["found"], F.struct(
                place.alias("start"), strip_space(name).alias("law_name"), number.alias("article_number"),
            )).alias("found"),
        )

    # what follows the last match has no mark
    matched = F.filter(pieces, lambda piece: piece.contains(begin))
    return F.aggregate(matched, start, add, lambda state: state["found"])


def cited_articles(column: Column, limit: int | None = None) -> Column:
    """Citations of an answer in any of the accepted notations, in order of place, each once.

    ``limit`` keeps the first so many; None keeps all.
    """
    candidate = column.contains("조") & (column.contains("[") | column.contains("**"))
    text = F.coalesce(F.when(candidate, column), F.lit(""))
    both = F.concat(
        _placed(text, rules.CITATION_OUTSIDE, [1, 2], 3), _placed(text, rules.CITATION_INSIDE, [1], 2)
    )
    named = F.array_distinct(F.transform(
        F.sort_array(both), lambda c: F.struct(c["law_name"], c["article_number"])
    ))
    kept = named if limit is None else F.slice(named, 1, limit)
    return F.transform(kept, lambda c, place: F.struct(
        c["law_name"].alias("law_name"), c["article_number"].alias("article_number"),
        F.lit(None).cast("double").alias("score"), (place + 1).alias("rank"),
    ))


def extract_citations(answers: DataFrame, column: str = "answer", limit: int | None = None) -> DataFrame:
    """One row per citation, ranked by place in the text."""
    cited = answers.select("answer_id", F.explode(cited_articles(F.col(column), limit)).alias("c"))
    return cited.select("answer_id", "c.*")


def extract_strict_citations(answers: DataFrame, column: str = "answer") -> DataFrame:
    """Every ``[name 제N조]`` of an answer with its place in the list."""
    pairs = F.arrays_zip(
        F.regexp_extract_all(column, F.lit(_STRICT), 1).alias("law_name"),
        F.regexp_extract_all(column, F.lit(_STRICT), 2).alias("article_number"),
    )
    exploded = answers.select("answer_id", F.posexplode(pairs).alias("position", "c"))
    return exploded.select("answer_id", "position", "c.law_name", "c.article_number")


def verify_citations(answers: DataFrame, articles: DataFrame, column: str = "answer") -> DataFrame:
    """Citations missing from the corpus per answer; answers that cite nothing are OK.

    Only citing answers go through the joins, so answers without a citation build no NULL key.
    """
    cited = extract_strict_citations(answers, column).withColumns({
        KEYS[0]: normalize_name(F.col("law_name")),
        KEYS[1]: normalize_article(F.col("article_number")),
    })
    missing = cited.join(articles.select(*KEYS), KEYS, "left_anti")
    label = F.concat("law_name", F.lit(" 제"), "article_number", F.lit("조"))
    grouped = missing.groupBy("answer_id").agg(
        F.sort_array(F.collect_list(F.struct("position", label.alias("label")))).alias("found")
    )
    labels = F.transform("found", lambda x: x["label"])
    joined = answers.select("answer_id").join(grouped, "answer_id", "left")
    return joined.select(
        "answer_id",
        F.when(F.col("found").isNull(), "OK").otherwise("CITATION_MISS").alias("verdict"),
        F.coalesce(labels, F.array().cast("array<string>")).alias("missing"),
    )


def citations_of(turns: DataFrame, citations: DataFrame, articles: DataFrame) -> DataFrame:
    """Citations of each assistant turn and whether the corpus has the article."""
    said = turns.where(F.col("role") == "assistant").select(
        F.col("id").alias("chat_history_id"), "session_id"
    )
    keyed = citations.withColumns({
        KEYS[0]: normalize_name(F.col("law_name")),
        KEYS[1]: normalize_article(F.col("article_number")),
    })
    known = articles.select(*KEYS).distinct().withColumn("in_corpus", F.lit(True))
    cited = keyed.join(known, KEYS, "left")
    joined = said.join(cited, "chat_history_id", "left")
    # turns that cite nothing are met last and by their own id, so they build no common key
    return joined.withColumns({
        KEYS[0]: F.coalesce(KEYS[0], F.lit("")), KEYS[1]: F.coalesce(KEYS[1], F.lit("")),
        "in_corpus": F.coalesce("in_corpus", F.lit(False)),
    }).select(
        *KEYS, "chat_history_id", "session_id",
        *[c for c in citations.columns if c != "chat_history_id"], "in_corpus",
    )


def assemble_context(hits: DataFrame, style: str = "article", history: str | None = None,
                     keep: int | None = None) -> DataFrame:
    """One context text per question from its ranked hits.

    Styles: ``article`` ``[law 제N조]``-headed blocks, ``numbered`` ``[조문 i]`` blocks, ``web``
    ``[i] title / snippet / link`` blocks, ``items`` one list entry per result. ``keep`` limits the
    hits of a question; None keeps all.
    """
    if keep is not None:
        hits = hits.where(F.col("rank") <= keep)
    newline = F.lit("\n")
    body = {
        "article": lambda: F.concat(
            F.lit("["), "law_name", F.lit(" "), article_display(F.col("article_number")),
            F.lit("]\n"), "text"),
        "numbered": lambda: F.concat(
            F.lit("[조문 "), F.col("rank").cast("string"), F.lit("]\n"), "text"),
        "web": lambda: F.concat(
            F.lit("["), F.col("rank").cast("string"), F.lit("] "), "title", newline, "snippet",
            newline, "link"),
        "items": lambda: F.concat(
            F.lit("- 제목: "), "title", F.lit("\n  매체: "), "source", F.lit("\n  날짜: "),
            F.coalesce("published", F.lit("")), F.lit("\n  링크: "), "link", F.lit("\n  내용: "),
            F.coalesce("snippet", F.lit(""))),
    }[style]()
    joint = "\n" if style == "items" else "\n\n"
    blocks = F.sort_array(F.collect_list(F.struct("rank", body.alias("block"))))
    text = F.array_join(F.transform(blocks, lambda b: b["block"]), joint)
    extra = [F.first(history).alias("__history")] if history else []
    grouped = hits.groupBy("question_id").agg(text.alias("context"), *extra)
    if history:
        said = F.coalesce("__history", F.lit(""))
        prefixed = F.concat(F.lit("[이전 대화]\n"), said, F.lit("\n\n"), "context")
        grouped = grouped.withColumn(
            "context", F.when(said != "", prefixed).otherwise(F.col("context"))
        ).drop("__history")
    return grouped


def _claims(text: Column) -> Column:
    """Numbers and cited articles of a text."""
    numbers = F.regexp_extract_all(text, F.lit(r"\d+(?:\.\d+)?"), 0)
    cited = F.regexp_extract_all(text, F.lit(r"제\d+조(?:의\d+)?"), 0)
    return F.array_distinct(F.concat(numbers, cited))


def screen_grounding(answers: DataFrame) -> DataFrame:
    """A screen, not a judge: which numbers and cited articles of the answer no context holds.

    ``answers`` has ``answer_id, answer, contexts``.
    """
    known = F.flatten(F.transform("contexts", _claims))
    screened = answers.select("answer_id", _claims(F.col("answer")).alias("claims"),
                              F.coalesce(known, F.array().cast("array<string>")).alias("known"))
    screened = screened.withColumn("missing", F.array_except("claims", "known"))
    n_claims, n_missing = F.size("claims"), F.size("missing")
    verdict = (
        F.when(n_missing == 0, "GROUNDED")
        .when(n_missing < n_claims, "PARTIAL")
        .otherwise("HALLUCINATION")
    )
    return screened.select(
        "answer_id", n_claims.alias("claims"), n_missing.alias("missing"),
        F.array_sort("missing").alias("missing_claims"), verdict.alias("verdict"),
    )
