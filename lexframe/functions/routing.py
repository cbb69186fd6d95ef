"""Question routing and query rewriting by ordered rules."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .articles import ARTICLE_MENTION, any_word
from .text import collapse_space, nfc, strip_space


def expand_terms(column: Column, term_map=None, dense: Column | None = None) -> Column:
    """Append the statutory term of the first trigger found, unless it is already there."""
    text = collapse_space(column) if dense is None else dense
    result = None
    for trigger, term in term_map or rules.TERM_MAP:
        applies = text.contains(trigger) & ~text.contains(term)
        longer = F.concat(column, F.lit(rules.TERM_SUFFIX.format(term=term)))
        result = F.when(applies, longer) if result is None else result.when(applies, longer)
    return result.otherwise(column)


def squeeze(column: Column) -> Column:
    """Lower case without ASCII spaces, in composed form."""
    return nfc(F.replace(F.lower(column), F.lit(" "), F.lit("")))


def route_question(column: Column, squeezed: Column | None = None) -> Column:
    """Tool of the first matching rule; NULL where only a label can decide.

    ``squeezed`` is :func:`squeeze` of the question, for callers that have it as a column.
    """
    lowered = F.lower(column)
    squeezed = squeeze(column) if squeezed is None else squeezed
    return (
        F.when(any_word(lowered, rules.FOREIGN_KEYWORDS), "websearch_tool")
        .when(column.rlike(ARTICLE_MENTION), "law_rag_tool")
        .when(any_word(squeezed, rules.LAW_KEYWORDS), "law_rag_tool")
        .when(any_word(squeezed, rules.ROUTER_NAMES), "law_rag_tool")
        .when(any_word(squeezed, rules.NEWS_KEYWORDS), "news_tool")
        .when(any_word(squeezed, rules.BLOG_KEYWORDS), "blog_tool")
        .when(any_word(squeezed, rules.DB_KEYWORDS), "db_query_tool_async")
        .when(any_word(squeezed, rules.GENERAL_KEYWORDS), "general_tool")
    )


def search_term(column: Column) -> Column:
    """The subject of a history request: router triggers and request verbs removed."""
    for phrase in rules.DB_KEYWORDS + rules.REQUEST_VERBS:
        column = F.replace(column, F.lit(phrase), F.lit(""))
    return strip_space(column)


def short_tool(column: Column) -> Column:
    return F.substring_index(column, "_", 1)


def law_label(column: Column) -> Column:
    return F.when(column.isin(rules.LAW_TOOLS), "law").otherwise("non-law")


def handler_of(column: Column, handlers=None, default: str = rules.DEFAULT_HANDLER) -> Column:
    """Handler of a tool; unknown tools get the default."""
    pairs = chain.from_iterable((handlers or rules.HANDLERS).items())
    lookup = F.create_map(*[F.lit(v) for v in pairs])
    return F.coalesce(F.try_element_at(lookup, column), F.lit(default))
