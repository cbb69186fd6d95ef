"""Result rows of web, news and blog providers in one shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import news_date, source_brand, strip_markup

NO_DATE = "정보 없음"


def _column(df: DataFrame, *names: str) -> Column:
    """First non-empty of the named columns that exist."""
    found = [F.nullif(F.col(n), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*found, F.lit(""))


def read_web_results(df: DataFrame, kind: str = "web", dated: str = "rfc822") -> DataFrame:
    """``title, link, snippet, source, published`` from any provider's columns.

    ``url`` stands in for ``link`` and ``content`` or ``description`` for ``snippet``; the
    original link is preferred. ``kind`` chooses how the source is named (``news``, ``blog``, or
    the provider's own for ``web``). Other columns, such as the position, are kept.
    """
    link = _column(df, "originallink", "link", "url")
    brand = source_brand(link, kind) if kind in ("news", "blog") else _column(df, "source")
    if "pubDate" in df.columns and dated == "rfc822":
        published = news_date(F.col("pubDate"))
    else:
        published = F.coalesce(F.nullif(_column(df, "published_date"), F.lit("")), F.lit(NO_DATE))
    used = {"title", "originallink", "link", "url", "snippet", "content", "description", "source",
            "pubDate", "published_date"}
    return df.select(
        *[c for c in df.columns if c not in used],
        strip_markup(_column(df, "title")).alias("title"),
        link.alias("link"),
        strip_markup(_column(df, "snippet", "content", "description")).alias("snippet"),
        brand.alias("source"),
        published.alias("published"),
    )
