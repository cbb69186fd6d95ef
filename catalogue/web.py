"""Web results: markup, brands, dates, ordered union and deduplication over ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexframe import functions as fx
from lexframe import rules
from lexframe.operators.keyed import keep_first, top_sources, union_sources
from lexframe.sources.web import read_web_results

from .common import load, load_dealt, sql_list
from .registry import registry

QUERIES, ORACLES, query = registry()

_TITLE = "<title>(.*?)</title>"


def _unescaped(column: str) -> str:
    """The entities that occur in the test pages, with or without their semicolon."""
    for entity, char in [("quot", '"'), ("middot", "·"), ("copy", "©"), ("lt", "<"), ("gt", ">"),
                         ("amp", "&")]:
        column = f"regexp_replace({column}, '&{entity};?', '{char}', 'g')"
    return column


def _stripped(column: str) -> str:
    bare = f"regexp_replace({column}, '<[^>]+>', '', 'g')"
    return f"trim({_unescaped(bare)}, ' ' || chr(9) || chr(10) || chr(13))"


def _brand_sql(column: str, brands, noise, unknown: str) -> str:
    host = f"lower(regexp_extract({column}, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//([^/?#]*)', 1))"
    known = " ".join(f"WHEN contains({host}, '{part}') THEN '{name}'" for part, name in brands)
    labels = (f"list_filter(string_split({host}, '.'), lambda p: NOT list_contains("
              f"[{sql_list(noise)}], p))")
    return f"CASE {known} ELSE coalesce(upper({labels}[-1]), '{unknown}') END"


_NEWS_SQL = _brand_sql("url", rules.NEWS_BRANDS, rules.NEWS_HOST_NOISE, "출처 미상")
_BLOG_SQL = _brand_sql("url", rules.BLOG_BRANDS, rules.BLOG_HOST_NOISE, "BLOG")


@query(f"SELECT page_id, {_stripped('html')} AS text FROM pages")
def strip_markup(spark, sf_dir):
    return load_dealt(spark, sf_dir, "pages").select("page_id", fx.strip_markup(F.col("html")).alias("text"))


@query(f"SELECT page_id, {_NEWS_SQL} AS news, {_BLOG_SQL} AS blog FROM pages")
def source_brand(spark, sf_dir):
    url = F.col("url")
    return load_dealt(spark, sf_dir, "pages").select(
        "page_id", fx.source_brand(url).alias("news"), fx.source_brand(url, "blog").alias("blog")
    )


def _news(spark, sf_dir):
    """Pages as a news provider returns them; a page without a query string has a bad stamp."""
    day = F.date_format(F.date_add(F.lit("2024-01-01"), F.col("page_id").cast("int")),
                        "EEE, dd MMM yyyy")
    stamp = F.when(F.col("url").contains("?"), F.concat(day, F.lit(" 23:30:00 +0900")))
    return load_dealt(spark, sf_dir, "pages").select(
        F.col("page_id").alias("position"),
        F.regexp_extract("html", _TITLE, 1).alias("title"),
        F.col("html").alias("description"),
        F.when(F.col("url").contains("?"), "").otherwise(F.col("url")).alias("originallink"),
        F.col("url").alias("link"),
        F.coalesce(stamp, F.lit("yesterday")).alias("pubDate"),
    )


_NEWS_ROWS_SQL = f"""news AS (
  SELECT page_id AS position, {_stripped(f"regexp_extract(html, '{_TITLE}', 1)")} AS title,
         url AS link, {_stripped('html')} AS snippet, {_NEWS_SQL} AS source,
         CASE WHEN contains(url, '?') THEN strftime(DATE '2024-01-01' + CAST(page_id AS INTEGER),
              '%Y-%m-%d') ELSE '정보 없음' END AS published FROM pages)"""


@query(f"WITH {_NEWS_ROWS_SQL} SELECT * FROM news")
def read_news_results(spark, sf_dir):
    return read_web_results(_news(spark, sf_dir), "news")


def _general(spark, sf_dir):
    """The same pages as a general search returns them, without tracking parameters."""
    return read_web_results(load_dealt(spark, sf_dir, "pages").select(
        F.col("page_id").alias("position"),
        F.regexp_extract("html", _TITLE, 1).alias("title"),
        F.regexp_replace("url", "[?#].*$", "").alias("url"),
        F.col("html").alias("content"), F.lit("general").alias("source"),
    ))


_UNION_SQL = f"""{_NEWS_ROWS_SQL}, general AS (
  SELECT page_id AS position, {_stripped(f"regexp_extract(html, '{_TITLE}', 1)")} AS title,
         regexp_replace(url, '[?#].*$', '') AS link, 'general' AS source FROM pages),
stacked AS (SELECT 0 AS source_order, position, title, link, source FROM general
            UNION ALL SELECT 1, position, title, link, source FROM news)"""


def _stacked(spark, sf_dir):
    news = read_web_results(_news(spark, sf_dir), "news")
    return union_sources(_general(spark, sf_dir), news).select(
        "source_order", "position", "title", "link", "source"
    )


def _first_sql(key: str) -> str:
    return f"""SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY {key}
  ORDER BY source_order, position) AS rn FROM stacked WHERE {key} <> '') WHERE rn = 1"""


@query(f"WITH {_UNION_SQL} {_first_sql('link')}")
def union_dedup_link(spark, sf_dir):
    return keep_first(_stacked(spark, sf_dir), "link", ["source_order", "position"])


@query(f"WITH {_UNION_SQL} {_first_sql('title')}")
def union_dedup_title(spark, sf_dir):
    return keep_first(_stacked(spark, sf_dir), "title", ["source_order", "position"])


@query(f"""WITH {_UNION_SQL} SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (
  PARTITION BY source ORDER BY source_order, position) AS rn FROM stacked) WHERE rn <= 5""")
def top_sources_per_brand(spark, sf_dir):
    return top_sources(_stacked(spark, sf_dir), "source", ["source_order", "position"], 5)
