"""Names, article numbers, keys and dates of a corpus."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .text import SPACE, collapse_space, nfc, strip_space

_D = r"\p{Nd}"
_BRANCH = rf"({_D}+)[{SPACE}]*(?:조)?[{SPACE}]*의[{SPACE}]*({_D}+)"
_REFERENCE = rf"(?:제)?[{SPACE}]*({_D}+)[{SPACE}]*조(?:[{SPACE}]*의[{SPACE}]*({_D}+))?"
_FOREIGN_REFERENCE = rf"[가-힣]{{2,15}}(?:법률|법|규칙|시행령)[{SPACE}]*(?:제)?[{SPACE}]*{_D}+[{SPACE}]*조"
ARTICLE_MENTION = rf"(?:제)?[{SPACE}]*{_D}+[{SPACE}]*조"


def normalize_name(column: Column, composed: Column | None = None) -> Column:
    """NFC without whitespace and middle dots; NULL becomes empty.

    ``composed`` is the NFC form, for callers that have it as a column already.
    """
    composed = nfc(F.coalesce(column, F.lit(""))) if composed is None else F.coalesce(composed, F.lit(""))
    return F.regexp_replace(composed, f"[{SPACE}·]", "")


def normalize_article(column: Column) -> Column:
    """``제14조의2`` -> ``14의2``, ``제17조`` -> ``17``; NULL becomes empty."""
    text = F.coalesce(column, F.lit(""))
    branch = F.concat(
        F.regexp_extract(text, _BRANCH, 1), F.lit("의"), F.regexp_extract(text, _BRANCH, 2)
    )
    digits = F.regexp_replace(text, rf"[^{_D}]", "")
    return F.when(text.rlike(_BRANCH), branch).otherwise(digits)


def article_display(column: Column) -> Column:
    """``14`` -> ``제14조``, ``14의2`` -> ``제14조의2``."""
    parts = F.split(F.coalesce(column, F.lit("")), "의", 2)
    branch = F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))
    main = F.concat(F.lit("제"), F.element_at(parts, 1), F.lit("조"))
    return F.when(branch != "", F.concat(main, F.lit("의"), branch)).otherwise(main)


def any_word(text: Column, words: list[str]) -> Column:
    """The text contains at least one of the words."""
    return text.rlike("|".join(rf"\Q{w}\E" for w in words))


def detect_entity(column: Column, names: list[str] | None = None,
                  dense: Column | None = None) -> Column:
    """First listed name contained in the whitespace-free text, else NULL.

    ``dense`` is that text, for callers that have it as a column already.
    """
    text = collapse_space(column) if dense is None else dense
    hits = [F.when(text.contains(n), F.lit(n)) for n in (names or rules.KNOWN_NAMES)]
    return F.coalesce(*hits)


def extract_article_ref(column: Column) -> Column:
    """First article number mentioned, as ``N`` or ``N의M``; empty when there is none."""
    main = F.regexp_extract(column, _REFERENCE, 1)
    branch = F.regexp_extract(column, _REFERENCE, 2)
    return F.when(branch != "", F.concat(main, F.lit("의"), branch)).otherwise(main)


def mentions_unknown_entity(question: Column, name: Column, article: Column) -> Column:
    """A law-like name with an article number, although no known name was found."""
    return name.isNull() & (article != "") & question.rlike(_FOREIGN_REFERENCE)


def priority_scope(column: Column, scope_rules=None, dense: Column | None = None) -> Column:
    """Preferred scope of the first keyword set with a hit, else NULL."""
    text = collapse_space(column) if dense is None else dense
    ordered = scope_rules or rules.SCOPE_RULES
    return F.coalesce(*[F.when(any_word(text, words), F.lit(scope)) for words, scope in ordered])


def point_id(name_norm: Column, article_norm: Column) -> Column:
    """48-bit vector key: the first 12 hex digits of md5(``name:article``)."""
    digest = F.md5(F.concat(name_norm, F.lit(":"), article_norm))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint")


def content_hash(column: Column) -> Column:
    return F.sha2(column, 256)


def _present(node: Column) -> Column:
    """NULL for the values that count as missing in the source documents."""
    return F.when(~node.isin("", "[]", "{}", "null", "false", "0"), node)


def date_node(article: Column, law: Column, law_short: Column) -> Column:
    """The article's own date node, else the law's."""
    return F.coalesce(_present(article), _present(law), _present(law_short))


def last_of_list(node: Column) -> Column:
    """The last entry of a JSON list; anything else as it is."""
    entries = F.from_json(node, "array<string>")
    return F.when(node.startswith("["), F.try_element_at(entries, F.lit(-1))).otherwise(node)


def date_field(node: Column) -> Column:
    """The first ten characters of a date node, which may be an object around the date."""
    attribute = F.coalesce(
        _present(F.get_json_object(node, "$.@시행일자")), F.get_json_object(node, "$.#text")
    )
    text = F.when(node.startswith("{"), attribute).otherwise(node)
    return F.substring(strip_space(text), 1, 10)


def date_value(text: Column) -> Column:
    """``yyyyMMdd`` or ``yyyy-MM-dd``; NULL for anything else."""
    dashed = (F.char_length(text) == 10) & (F.substring(text, 5, 1) == "-")
    return F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd")).when(
        dashed, F.try_to_date(text, "yyyy-MM-dd")
    )


def pick_enforcement_date(article: Column, law: Column, law_short: Column) -> Column:
    """Date of an article: its own, else the law's; the last of a list, the field of an object.

    Jobs over many rows apply the four steps as columns of their own, so that each is computed
    once.
    """
    return date_value(date_field(last_of_list(date_node(article, law, law_short))))


def source_url(name: Column, article: Column) -> Column:
    """Link to the public statute page of an article."""
    quoted = F.url_encode(name)
    for encoded, plain in [("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")]:
        quoted = F.replace(quoted, F.lit(encoded), F.lit(plain))
    return F.concat(
        F.lit("https://www.law.go.kr/법령/"), quoted, F.lit("/"), article_display(article)
    )
