import random

import pytest

from lexframe import rules
from lexframe.functions import detect_entity, priority_scope, route_question
from lexframe.operators import rule_tables as rt
from lexframe.session import pin
from pyspark.sql import functions as F

QUESTIONS = [
    "산업안전보건법 시행령 제3조", "산업안전보건법", "산업 안전 보건 법", "계단 균열", "ISO 기준", "데이터 확인 부탁", "제 12 조 뉴스",
    "미국 12조", "", None, "고마워", "아무것도", "산업안전보건법" * 300 + " 재난", "경영책임자의 처벌",
]


@pytest.fixture
def asked(spark):
    return spark.createDataFrame(list(enumerate(QUESTIONS)), "id bigint, query string")


def test_equal_to_the_expressions(asked):
    questions = asked.withColumnRenamed("query", "question")
    rows = rt.detect_by_table(questions, "id").withColumns({
        "want_name": detect_entity(F.col("question")), "want_scope": priority_scope(F.col("question"))}).collect()
    assert len(rows) == len(QUESTIONS)
    assert all(r["name"] == r["want_name"] and r["scope"] == r["want_scope"] for r in rows)
    routed = rt.route_by_table(asked, "id").withColumn("want", route_question(F.col("query"))).collect()
    assert len(routed) == len(QUESTIONS) and all(r["rule_tool"] == r["want"] for r in routed)


@pytest.mark.parametrize("head, block", [(3, 512), (1, 4), (5, 7)])
def test_brute_force(spark, head, block):
    made = random.Random(head)

    def word(longest):
        return "".join(made.choice("ab\n🙂") for _ in range(made.randint(0, longest)))

    names = [("t", word(9), made.randint(0, 30), made.choice(["x", "y", None])) for _ in range(60)]
    names += [("t", None, 0, "x"), (None, "a", 0, "x"), ("t", "a", None, "x"), ("t", "", 0, "x")]
    texts = [(i, word(60)) for i in range(200)] + [(900, None), (901, ""), (None, "ab" * 20)]
    found = rt.match_rules(spark.createDataFrame(texts, "id bigint, t string"),
                           spark.createDataFrame(names, rt.RULES), "id", head, block).collect()
    want = {}
    for key, text in texts:
        fits = [(p, n, v or "", v) for view, n, p, v in names
                if view and n and p is not None and text and n in text]
        if key is not None and fits:
            want[key] = min(fits, key=lambda f: f[:3])
    assert {r["id"]: (r["priority"], r["name"], r["value"]) for r in found} == {
        k: (p, n, v) for k, (p, n, _, v) in want.items()}
    assert len(found) == len(want)


def test_empty_tables(spark, asked):
    table = rt.rule_table(spark, "query", [(["산업"], "x")])
    assert rt.match_rules(asked.limit(0), table, "id").collect() == []
    assert rt.match_rules(asked, table.limit(0), "id").collect() == []


def test_many_names(spark):
    names = spark.range(100_000).select(
        F.lit("t").alias("view"), F.format_string("name%06d.", "id").alias("name"), F.col("id").alias("priority"),
        F.col("id").cast("string").alias("value"))
    texts = spark.range(2_000).select("id", F.format_string("x name%06d. name%06d. y", F.col("id") * 49, F.col("id")).alias("t"))
    rows = rt.match_rules(texts, names, "id").collect()
    assert len(rows) == 2_000 and all(r["value"] == str(r["id"]) for r in rows)


def test_lists_are_the_defaults(spark):
    tables = rt.default_rules(spark)
    assert [r["name"] for r in tables["names"].orderBy("priority").collect()] == rules.KNOWN_NAMES


def test_equal_pieces_are_looked_through_once(spark, monkeypatch):
    """Names of letters only: every long word is one piece, however many texts have it; short ones are none."""
    pinned = {}
    monkeypatch.setattr(rt, "pin", lambda df, name: pinned.setdefault(name, pin(df, name)))
    words = ["grundlagen", "vorschrift", "absturzsicherung", "des", "und"]
    texts = spark.range(300).select("id", F.concat_ws(" 7-", *[F.lit(w) for w in words]).alias("t"))
    names = rt.rule_table(spark, "t", [(["vorschriften", "sturzsicher"], "x"), (["rundlage"], "y")])
    rows = rt.match_rules(texts, names, "id").collect()
    assert len(rows) == 300 and {(r["name"], r["value"]) for r in rows} == {("sturzsicher", "x")}
    assert sorted(r["piece"] for r in pinned["rule-texts"].collect()) == sorted(words[:3])
    assert {len(r["head"]) for r in pinned["rule-heads"].collect()} == {8}


def test_names_keep_pieces_whole(spark):
    """A kind of character that one name has cuts no text."""
    texts = spark.createDataFrame([(1, "Ärzte an 12 Orten"), (2, "Ärzte an\n12 Orten"), (3, "an 12"), (4, "än 12")], "id int, t string")
    names = rt.rule_table(spark, "t", [(["an 12 O"], "x"), (["te an"], "y"), (["̈n"], "z")])
    rows = rt.match_rules(texts, names, "id").collect()
    assert {r["id"]: r["value"] for r in rows} == {1: "x", 2: "y", 4: "z"}
