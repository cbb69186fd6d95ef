"""Links and dates of web, news and blog results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules

_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_STAMP = r"^[A-Za-z]{3}, (\d{1,2} [A-Za-z]{3} \d{4}) \d{1,2}:\d{1,2}:\d{1,2} (?:[+-]\d{2}:?\d{2}|Z)$"


def source_brand(column: Column, kind: str = "news") -> Column:
    """Publisher of a link: a known host, else the last telling label of the host name."""
    brands, noise, unknown = {
        "news": (rules.NEWS_BRANDS, rules.NEWS_HOST_NOISE, "출처 미상"),
        "blog": (rules.BLOG_BRANDS, rules.BLOG_HOST_NOISE, "BLOG"),
    }[kind]
    host = F.lower(F.regexp_extract(F.coalesce(column, F.lit("")), _HOST, 1))
    labels = F.filter(F.split(host, r"\."), lambda label: ~label.isin(noise))
    telling = F.upper(F.try_element_at(labels, F.lit(-1)))
    known = [F.when(host.contains(part), F.lit(brand)) for part, brand in brands]
    return F.coalesce(*known, telling, F.lit(unknown))


def news_date(column: Column, missing: str = "정보 없음") -> Column:
    """Day of an RFC 822 stamp in the stamp's own offset."""
    day = F.try_to_date(F.regexp_extract(column, _STAMP, 1), "d MMM yyyy")
    return F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit(missing))
