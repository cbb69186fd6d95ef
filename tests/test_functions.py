"""Column expressions on the inputs and results the service's own tests state, and on edges."""

import datetime as dt
import unicodedata

from pyspark.sql import functions as F

from lexframe import functions as fx
from lexframe.functions.text import _STABLE_NFC, _STABLE_NFKC


def test_normalize_article(column):
    given = ["제14조의2", "14조의2", "25의4", "제17조", "17", "", None, "제 3 조 의 4"]
    assert column(fx.normalize_article, given) == ["14의2", "14의2", "25의4", "17", "17", "", "",
                                                   "3의4"]


def test_article_display(column):
    assert column(fx.article_display, ["14의2", "17", None]) == ["제14조의2", "제17조", "제조"]


def test_normalize_name_composes_and_squeezes(column):
    decomposed = unicodedata.normalize("NFD", "재난 및 안전·관리")
    given = [decomposed, "재난　및 안전\u00a0관리", None]
    assert column(fx.normalize_name, given) == ["재난및안전관리", "재난및안전관리", ""]


def test_expand_terms(column):
    given = ["폭발 위험 분위기라면 쓸 장비는", "사다리 길이의 한도",
             "폭발위험분위기 폭발위험장소"]
    out = column(fx.expand_terms, given)
    assert out[0] == given[0] + " (관련 법령 용어: 폭발위험장소)"
    assert out[1:] == given[1:]


def test_detect_entity_takes_longest_first(column):
    given = ["산업안전보건법 시행규칙 제3조", "산업안전보건법을 찾는다", "철도안전법 5조"]
    assert column(fx.detect_entity, given) == ["산업안전보건법시행규칙", "산업안전보건법", None]


def test_article_reference(column):
    given = ["제31조 전체", "6 조 의 8", "번호가 없다", "40조의3과 41조"]
    assert column(fx.extract_article_ref, given) == ["31", "6의8", "", "40의3"]


def test_unknown_entity(spark):
    rows = [("철도안전법 5조", None, "5"), ("산업안전보건법 31조", "산업안전보건법", "31"),
            ("번호 없는 물음", None, "")]
    df = spark.createDataFrame(rows, "q string, n string, a string")
    found = df.select(fx.mentions_unknown_entity(F.col("q"), F.col("n"), F.col("a")).alias("u"))
    assert [r.u for r in found.collect()] == [True, False, False]


def test_priority_scope_first_set_wins(column):
    given = ["비계 처벌", "경영 책임자 처벌", "안전관리자 재난", "날씨"]
    assert column(fx.priority_scope, given) == [
        "산업안전보건기준에관한규칙", "중대재해처벌등에관한법률", "산업안전보건법", None]


def test_route_question(column):
    given = {
        "규칙의 조문을 보여 줘": "law_rag_tool",
        "터널 현장 뉴스": "news_tool",
        "앞의 것 중 하나만 최근 거로": None,
        "미국 OSHA 사다리 규칙": "websearch_tool",
        "전기사업법 9조": "law_rag_tool",
        "용접 학원 후기": "blog_tool",
        "환기 기록에서 확인해줘": "db_query_tool_async",
        "환기 기록 확인": None,  # the trigger has a space, the text it is sought in has none
        "요즘 피곤하네": "general_tool",
        "다친 것을 숨기면 어떻게 되나": None,
        unicodedata.normalize("NFD", "안전 기준"): "law_rag_tool",
    }
    assert column(fx.route_question, list(given)) == list(given.values())


def test_search_term(column):
    given = ["비계 기록에서 확인해줘", "흙막이 점검표 데이터에서 찾아줘", "비계"]
    assert column(fx.search_term, given) == ["비계", "흙막이 점검표", "비계"]


def test_handlers(column):
    given = ["news_tool", "nobody", None]
    assert column(fx.handler_of, given) == ["news_agent", "general_agent", "general_agent"]


def test_clean_text_matches_python(column):
    def expected(text):
        text = unicodedata.normalize("NFKC", text or "")
        kept = [c for c in text if c in "\n\t" or unicodedata.category(c)[0] != "C"]
        return "".join(kept).strip()

    given = ["ｆｕｌｌ ①", "a\x00b\x07c\n\td", "  　x\u00a0", "\u200b보이지\ufeff않음", "가" * 50, "", None,
             "ﬁ ² ½", "줄\r\n바꿈"]
    assert column(fx.clean_text, given) == [expected(t) for t in given]


def test_stable_character_classes_hold():
    import re

    for pattern, form in ((_STABLE_NFC, "NFC"), (_STABLE_NFKC, "NFKC")):
        python = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(
            chr(int(m[1], 16))), pattern))
        stable = [chr(c) for c in range(0x10000) if not 0xD800 <= c <= 0xDFFF
                  and python.match(chr(c))]
        assert len(stable) > 10_000
        assert all(unicodedata.normalize(form, c) == c for c in stable)
        text = "".join(stable)
        assert unicodedata.normalize(form, text) == text
        if form == "NFKC":
            assert all(c in "\n\t" or unicodedata.category(c)[0] != "C" for c in stable)


def test_strip_markup(column):
    given = ["<b>A</b> &amp; &lt;B&gt; &#39;c&#39; &hellip;", None, "  <p>x  "]
    assert column(fx.strip_markup, given) == ["A & <B> 'c' …", "", "x"]


def test_source_brand(column):
    given = ["https://n.news.naver.com/a", "http://www.hani.co.kr/x", "https://m.example.net/1",
             "https://x.example.org", "no link", "https://www.co.kr/", None]
    assert column(fx.source_brand, given) == ["NAVER", "HANI", "EXAMPLE", "ORG", "", "출처 미상", ""]
    blogs = ["https://blog.naver.com/a", "https://me.blogspot.com", "https://m.example.com"]
    assert column(lambda c: fx.source_brand(c, "blog"), blogs) == ["NAVER BLOG", "BLOGGER", "EXAMPLE"]


def test_news_date(column):
    given = ["Mon, 01 Jan 2024 23:30:00 +0900", "yesterday", None, "Mon, 31 Feb 2024 10:00:00 +0900"]
    assert column(fx.news_date, given) == ["2024-01-01", "정보 없음", "정보 없음", "정보 없음"]


def test_quality_score(column):
    given = ["없음", "「가」 제1조 제2조", "「가」" * 9]
    assert column(fx.quality_score, given) == [35, 55, 100]


def test_point_id(column):
    import hashlib

    def expected(law, article):
        return int(hashlib.md5(f"{law}:{article}".encode()).hexdigest()[:12], 16)

    found = column(lambda c: fx.point_id(F.lit("산업안전보건법"), c), ["17", "17의2"])
    assert found == [expected("산업안전보건법", "17"), expected("산업안전보건법", "17의2")]


def test_enforcement_date(spark):
    rows = [
        ("20251001", None, None), ("2025-10-01", None, None), ('["20240101","20250101"]', None, None),
        ('{"@시행일자":"20230303"}', None, None), ('{"#text":"2023-03-04"}', None, None),
        ("garbage", None, None), (None, "20260101", None), ("", None, "20270101"),
        ("20251399", None, None), (None, None, None), ("[]", "20260101", None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                               "i int, a string, b string, c string")
    picked = fx.pick_enforcement_date(F.col("a"), F.col("b"), F.col("c"))
    found = [r.d for r in df.select("i", picked.alias("d")).orderBy("i").collect()]
    assert found == [dt.date(2025, 10, 1), dt.date(2025, 10, 1), dt.date(2025, 1, 1),
                     dt.date(2023, 3, 3), dt.date(2023, 3, 4), None, dt.date(2026, 1, 1),
                     dt.date(2027, 1, 1), None, None, dt.date(2026, 1, 1)]


def test_flatten_keeps_document_order(column):
    node = '[{"항번호":"①","항내용":" 가 ","호":[{"호번호":"1","호내용":"나","목":["다",7]}],"@x":"no"}]'
    assert column(fx.flatten_text, [node, '"하나"', "[]"]) == ["가\n나\n다", "하나", ""]


def test_previews(column):
    assert column(lambda c: fx.preview(c, 3, "..."), ["abcd", "abc", None]) == ["abc...", "abc", None]
    assert column(fx.number_paragraphs, ["1 가\n2. 나\n12 다"]) == ["1. 가\n2. 나\n12. 다"]


def test_source_url(column):
    from urllib.parse import quote

    names = ["산업안전보건법", "가 나/다~*&"]
    expected = [f"https://www.law.go.kr/법령/{quote(n)}/제14조의2" for n in names]
    assert column(lambda c: fx.source_url(c, F.lit("14의2")), names) == expected


def test_verdicts_and_actions(column, spark):
    replies = ['{"verdict": "HALLUCINATION"}', '{"verdict": "UNKNOWN_VALUE"}', "broken", None]
    assert column(fx.coerce_verdict, replies) == ["HALLUCINATION", "GROUNDED", "GROUNDED", "GROUNDED"]
    assert column(lambda c: fx.coerce_verdict(c, offline=True), replies) == [
        "HALLUCINATION", "UNKNOWN_VALUE", "ERROR", "ERROR"]
    relevance = ['{"verdict": "NOT_RELEVANT"}', "broken"]
    assert column(lambda c: fx.coerce_verdict(c, "relevance"), relevance) == [
        "NOT_RELEVANT", "RELEVANT"]
    rows = [("GROUNDED", None, 1), ("PARTIAL", None, 1), ("HALLUCINATION", None, 1),
            ("HALLUCINATION", None, 2), ("GROUNDED", "RELEVANT", 1),
            ("GROUNDED", "NOT_RELEVANT", 1)]
    df = spark.createDataFrame(rows, "v string, r string, n int")
    found = df.select(fx.next_action(F.col("v"), F.col("r"), F.col("n")).alias("a")).collect()
    assert [r.a for r in found] == ["grade_relevance", "grade_relevance", "retrieve",
                                    "websearch_fallback", "end", "websearch_fallback"]


def test_infer_source(column, spark):
    payloads = ['{"law_url":"u"}', '{"retrieved_laws":[{"law_name":"x"}]}', '{"retrieved_laws":[]}',
                "Web result", "other"]
    assert column(fx.source_of_event, payloads) == ["pg", "qdrant", None, "web", None]
    rows = [("pg", "출처"), (None, "OSHA 규정"), (None, "답변")]
    df = spark.createDataFrame(rows, "s string, t string")
    found = df.select(fx.infer_source(F.col("s"), F.col("t")).alias("o")).collect()
    assert [r.o for r in found] == ["pg", "web", "pg"]


def test_failure_reason(spark):
    rows = [(False, 0.9, ["a"]), (True, None, []), (False, 0.5, ["a"]), (False, 0.7, None),
            (None, 0.0, ["a"])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                               "i int, f boolean, s double, a array<string>").orderBy("i")
    args = (F.col("f"), F.col("s"), F.col("a"))
    found = df.select("i", fx.is_failure(*args).alias("x"), fx.failure_reason(*args).alias("r"))
    assert [(r.x, r.r) for r in found.orderBy("i").collect()] == [
        (False, "unknown"), (True, "fallback_used | confidence_null | no_articles"),
        (True, "low_confidence(0.500)"), (True, "no_articles"), (True, "low_confidence(0.000)")]


def test_clean_text_drops_unseen_characters_everywhere(column):
    """Every character alone and inside a stable text, as the forms and classes of Python and Java say."""
    chars = [chr(c) for c in [*range(0x250), *range(0x4DF0, 0x4E10), *range(0x9FF0, 0xA000), *range(0xABF0, 0xAC10),
                              *range(0xD790, 0xD800), 0x200B, 0xFEFF, 0xFB01, 0x3000]]
    found = column(fx.clean_text, [f"가{c}a" for c in chars] + [None, "", " \n가\ta \x85"])
    dropped = column(lambda v: F.regexp_replace(v, r"[\p{C}&&[^\n\t]]", ""), [unicodedata.normalize("NFKC", f"가{c}a") for c in chars])
    assert found[:-3] == dropped
    assert found[-3:] == ["", "", "가\ta"]
