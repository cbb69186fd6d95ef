"""Text expressions: Unicode forms, markup, nested text, scoring, previews."""

from __future__ import annotations

import html
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rules


def _char_class(spans: list[tuple[int, int]]) -> str:
    """Inside of a regex character class for code point spans."""
    return "".join(rf"\x{{{low:X}}}-\x{{{high:X}}}" for low, high in spans)


# Whitespace as Python's str.strip() and \s see it. Java's \s is ASCII only.
_SPACE_SPANS = [
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
    (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
]
SPACE = _char_class(_SPACE_SPANS)
_SPACE_CHARS = "".join(chr(c) for low, high in _SPACE_SPANS for c in range(low, high + 1))

# Characters that no normalisation form changes: Latin, Cyrillic, punctuation, kana, Han, Hangul.
# Texts made of these alone never leave the JVM.
_STABLE_NFC = "^[" + _char_class([
    (0x00, 0x2FF), (0x400, 0x482), (0x2010, 0x2027), (0x2030, 0x205E), (0x3001, 0x3029),
    (0x3041, 0x3096), (0x30A1, 0x30FA), (0x3130, 0x318F), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3),
    (0xFF01, 0xFF60),
]) + "]*$"
_STABLE_NFKC = "^[" + _char_class([
    (0x09, 0x0A), (0x20, 0x7E), (0xA1, 0xA7), (0xA9, 0xA9), (0xAB, 0xAC), (0xAE, 0xAE),
    (0xB0, 0xB1), (0xB6, 0xB7), (0xBB, 0xBB), (0xBF, 0x131), (0x4E00, 0x9FFC), (0xAC00, 0xD7A3),
]) + "]*$"  # and none of which clean_text drops


@F.pandas_udf(T.StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


@F.pandas_udf(T.StringType())
def _unescape(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else html.unescape(v))


def _only_where(column: Column, needed: Column, udf) -> Column:
    """Hand a value to the Arrow helper only when it needs it; send NULL for the rest."""
    return F.coalesce(udf(F.when(needed, column)), column)


def nfc(column: Column) -> Column:
    return _only_where(column, ~column.rlike(_STABLE_NFC), _nfc)


def strip_space(column: Column) -> Column:
    """Trim Unicode whitespace on both ends."""
    return F.btrim(column, F.lit(_SPACE_CHARS))


def collapse_space(column: Column) -> Column:
    """Remove every whitespace character."""
    return F.regexp_replace(column, f"[{SPACE}]", "")


def clean_text(column: Column, composed: Column | None = None) -> Column:
    """NFKC, no control or unassigned characters except newline and tab, trimmed, never NULL.

    ``composed`` is the NFKC form, for callers that have it as a column already.
    """
    changed = _nfkc(F.when(~column.rlike(_STABLE_NFKC), column)) if composed is None else composed
    visible = F.regexp_replace(changed, r"[\p{C}&&[^\n\t]]", "")
    # a text that the helper was not given has nothing to drop either
    visible = F.coalesce(visible, column) if composed is None else visible
    return F.coalesce(strip_space(visible), F.lit(""))


def strip_markup(column: Column) -> Column:
    """Drop tags, decode entities, trim; never NULL."""
    bare = F.regexp_replace(F.coalesce(column, F.lit("")), "<[^>]+>", "")
    return strip_space(_only_where(bare, bare.contains("&"), _unescape))


def _children(node) -> list:
    """What a JSON node holds, without attributes and numbers that the text repeats."""
    if isinstance(node, dict):
        shown = node.keys() - set(rules.NUMBER_ONLY_KEYS)
        return [node[key] for key in node if key in shown and key[:1] != "@"]
    return node if isinstance(node, list) else []


def _pieces(*nodes) -> list[str]:
    """Texts below the nodes in document order, read from a stack, so depth is no limit."""
    found, waiting = [], list(nodes[::-1])
    while waiting:
        node = waiting.pop()
        waiting.extend(reversed(_children(node)))
        text = node.strip() if isinstance(node, str) else ""
        if text:
            found.append(text)
    return found


def _parse(text: str | None):
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


def _flatten_one(text: str | None) -> str | None:
    return None if text is None else "\n".join(_pieces(_parse(text)))


def _article_one(text: str | None) -> str:
    unit = _parse(text)
    if not isinstance(unit, dict):
        return ""
    pieces = _pieces(*map(unit.get, ("조문내용", "항", "조문단위")))
    if not pieces:
        title = unit.get("조문제목")
        pieces = [title] if isinstance(title, str) else []
    return "\n".join(pieces).strip()


@F.pandas_udf(T.StringType())
def _flatten_json(values: pd.Series) -> pd.Series:
    return values.map(_flatten_one)


def _changed(form: str, value: str | None) -> str | None:
    """The normal form of a value where it differs from it."""
    composed = None if value is None else unicodedata.normalize(form, value)
    return None if composed == value else composed


@F.pandas_udf(T.StructType([T.StructField(form, T.StringType()) for form in ("raw", "composed", "name")]))
def _article_json(units: pd.Series, names: pd.Series) -> pd.DataFrame:
    raw = [_article_one(unit) for unit in units]
    return pd.DataFrame({
        "raw": raw, "composed": [_changed("NFKC", text) for text in raw], "name": [_changed("NFC", name) for name in names],
    }, dtype=object)


# Keeps a filter on the text from being pushed below it, which would run the helper twice.
_article_json = _article_json.asNondeterministic()


def flatten_text(column: Column) -> Column:
    """All text of a JSON node, depth first, one piece per line."""
    return _flatten_json(column)


def article_text(column: Column) -> Column:
    """Body of one article node: content, paragraphs and nested units, else its title."""
    return article_forms(column, F.lit(None).cast("string"))["raw"]


def article_forms(unit: Column, name: Column) -> Column:
    """``raw``, the body of an article node (see :func:`article_text`), ``composed``, its NFKC form, and ``name``, the NFC
    form of a name; both forms are NULL where they change nothing. One helper makes all three, as every helper in a plan
    runs Python workers of its own."""
    return _article_json(unit, name)


def reference_count(column: Column) -> Column:
    return F.regexp_count(column, F.lit("「.*?」"))


def quality_score(column: Column) -> Column:
    """35 points, 10 per quoted law, 5 per article number, at most 100."""
    articles = F.regexp_count(column, F.lit(r"제\p{Nd}+조"))
    return F.least(reference_count(column) * 10 + articles * 5 + 35, F.lit(100))


def preview(column: Column, length: int, suffix: str = "") -> Column:
    """The first ``length`` characters; ``suffix`` only where something was cut."""
    return F.when(
        F.char_length(column) > length, F.concat(F.substring(column, 1, length), F.lit(suffix))
    ).otherwise(column)


def number_paragraphs(column: Column) -> Column:
    """``1 text`` at a line start becomes ``1. text``."""
    return F.regexp_replace(column, r"(?m)^(\d+) ", "$1. ")


def json_field(column: Column, key: str) -> Column:
    return F.get_json_object(column, f"$.{key}")
