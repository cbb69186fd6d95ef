"""Turn operators where keys repeat, have gaps or tie."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lexframe.operators import conversations as ops

SCHEMA = "id long, session_id string, turn_index long, role string, content string, created_at long"


def turns(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_pairs_are_a_join_not_a_lead(spark):
    rows = [
        (1, "a", 1, "user", "q1", 1), (2, "a", 2, "assistant", "a1", 1),
        (3, "a", 4, "user", "q2", 2), (4, "a", 6, "assistant", "late", 2),
        (5, "b", 1, "user", "q3", 3), (6, "b", 2, "assistant", "a3", 3),
        (7, "b", 2, "assistant", "a3 again", 3), (8, "b", 3, "user", "open", 4),
    ]
    found = {(r.question, r.answer) for r in ops.pair_turns(turns(spark, rows)).collect()}
    assert found == {("q1", "a1"), ("q3", "a3"), ("q3", "a3 again")}


def test_context_takes_the_newest_and_breaks_ties(spark):
    rows = [(i, "a", i, "user" if i % 2 else "assistant", f"t{i}", i // 2) for i in range(1, 9)]
    context = ops.session_context(turns(spark, rows), 2, other_label="답").first().context
    assert context == "사용자: t5\n답: t6\n사용자: t7\n답: t8"


HISTORY = [
    (1, "a", 1, "user", "환기 설비", 1), (2, "a", 2, "assistant", "답1", 1),
    (3, "b", 1, "user", "100% 안전한가 A_b", 2), (4, "b", 2, "assistant", "답2", 2),
    (5, "c", 1, "user", "환기 점검 ABC", 3), (6, "c", 2, "assistant", "답3", 3),
]


@pytest.mark.parametrize("inline", [1024, 2])
def test_search_history(spark, inline):
    asked = spark.createDataFrame([
        (1, "환기 기록에서 확인해줘"), (2, "없는 말 찾아줘"), (3, "기록에서 알려줘"), (4, "abc"), (5, "a_c"),
        (6, "100%"),
    ], "query_id long, query string")
    found = {}
    rows = ops.search_history(asked, turns(spark, HISTORY), 2, block_terms=inline)
    for r in rows.collect():
        found.setdefault((r.query_id, r.matched), set()).add(r.answer)
    assert found == {
        (1, True): {"답1", "답3"}, (2, False): {"답2", "답3"}, (3, False): {"답2", "답3"},
        (4, True): {"답3"}, (5, True): {"답3"}, (6, True): {"답2"},
    }


def test_search_by_postings_equals_plain_containment(spark):
    rng = random.Random(8)
    letters = "abC\U0001f600"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 40))) for _ in range(120)] + [None, "", "ab" * 20000]
    rows = []
    for i, text in enumerate(texts):
        rows += [(2 * i, f"s{i}", 1, "user", text, i), (2 * i + 1, f"s{i}", 2 if i % 7 else 5, "assistant", f"a{i}", i)]
    rows += [(900, "s1", 1, "user", "abc abc", 900)]  # two questions share an answer
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(60)] + ["a_c", "b%", "zzz", "abab"]
    asked = spark.createDataFrame(list(enumerate(words + words[:5])), "query_id long, query string")
    got = ops.search_history(asked, turns(spark, rows), 4).where("matched").select("query_id", "id").collect()
    answered = sorted(((r[5], r[2], r[0]), r[4]) for r in rows if r[3] == "user" and r[4] is not None
                      and (r[1], 2, "assistant") in {(x[1], x[2], x[3]) for x in rows})
    want = set()
    for query_id, word in enumerate(words + words[:5]):
        shape = re.compile("".join("." if c == "_" else ".*" if c == "%" else re.escape(c) for c in word.lower()), re.S)
        hits = [key[2] for key, text in answered if shape.search(text.lower())]
        want |= {(query_id, i) for i in hits[-4:]}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_search_of_an_empty_history(spark):
    asked = spark.createDataFrame([(1, "환기")], "query_id long, query string")
    assert ops.search_history(asked, turns(spark, []), 5).count() == 0


def test_session_summary_window_and_default(spark):
    rows = [(i, None if i < 3 else "s", i, "user" if i % 2 else "assistant", f"문{i}" * 40, i)
            for i in range(1, 9)]
    df = turns(spark, rows).withColumn("user_id", F.lit("u"))
    found = {r.session_id: r for r in ops.session_summary(df, 200).collect()}
    assert set(found) == {"default", "s"}
    assert found["s"].title == ("문3" * 40)[:60] and found["s"].last_active == 8
    assert {r.session_id for r in ops.session_summary(df, 1).collect()} == set()


def test_last_tool_uses_the_highest_id(spark):
    df = turns(spark, [(9, "a", 1, "assistant", "x", 1), (3, "a", 2, "assistant", "y", 2),
                       (4, "b", 1, "user", "z", 1)])
    df = df.withColumn("metadata", F.concat(F.lit('{"tool":"t'), "id", F.lit('"}')))
    assert {(r.session_id, r.tool) for r in ops.last_tool(df).collect()} == {("a", "t9"), ("b", "")}


def test_feedback_last_vote_counts(spark):
    df = turns(spark, [(1, "a", 1, "user", "q", 1), (2, "a", 2, "assistant", "x", 1),
                       (3, "a", 4, "assistant", "y", 1)]).withColumns({
        "feedback": F.lit(None).cast("int"), "updated_at": F.lit(0)})
    votes = spark.createDataFrame([(2, 1, 1), (2, -1, 2), (2, 5, 3), (1, 1, 1)],
                                  "id long, value int, position int")
    found = {r.id: (r.feedback, r.updated_at)
             for r in ops.apply_feedback(df, votes, F.lit(7)).collect()}
    assert found == {1: (None, 0), 2: (-1, 7), 3: (None, 0)}


def test_delete_by_prefix_and_id_cascades(spark):
    df = turns(spark, [(1, "eval-mt-1", 1, "user", "q", 1), (2, "a", 1, "user", "q", 1),
                       (3, "b", 1, "user", "q", 1), (4, None, 1, "user", "q", 1)])
    gone = spark.createDataFrame([("b",), ("b",)], "session_id string")
    kept = ops.delete_sessions(df, gone, prefix="eval-mt-")
    assert {r.id for r in kept.collect()} == {2, 4}
    cited = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")],
                                  "chat_history_id long, law_name string")
    assert {r.law_name for r in ops.cascade_citations(cited, kept).collect()} == {"y", "z"}


def test_append_skips_empty_answers(spark):
    df = spark.sql("""SELECT * FROM VALUES
      (NULL, 'u', 'q1', '「가」 제1조', 'law_rag_tool', TIMESTAMP '2026-01-01 00:00:10'),
      ('s', 'u', 'q2', ' \n　', 'news_tool', TIMESTAMP '2026-01-01 00:00:20')
      AS t(session_id, user_id, question, answer, tool, asked_at)""")
    rows = sorted(ops.append_turns(df).collect(), key=lambda r: r.turn_index)
    assert [(r.role, r.content, r.session_id, r.score) for r in rows] == [
        ("user", "q1", "default_session", 50), ("assistant", "「가」 제1조", "default_session", 50)]
    assert rows[1].turn_index == rows[0].turn_index + 1 and rows[0].metadata == '{"tool":"law"}'


def test_citation_rows(spark):
    df = spark.sql("""SELECT 1L AS chat_history_id, array(
      named_struct('law_name', '법', 'article_number', '1', 'score', 0.5D, 'rank', 1),
      named_struct('law_name', NULL, 'article_number', NULL, 'score', NULL, 'rank', 2)) AS citations
      UNION ALL SELECT 2L, array()""")
    assert sorted((r["rank"], r.law_name) for r in ops.citation_rows(df).collect()) == [(1, "법"), (2, "")]


def test_validation_reasons(spark):
    df = spark.createDataFrame(
        [("user", None), ("system", 1), ("assistant", 2), (None, None), ("assistant", -1)],
        "role string, feedback int")
    assert [r.reject_reason for r in ops.validate_turns(df).collect()] == [
        None, "role", "feedback", "role", None]


def test_matches_carry_no_texts(spark):
    """A row per match is sorted and shuffled; the question would come along as often as it has terms."""
    asked = ops.user_questions(turns(spark, HISTORY))
    terms = spark.createDataFrame([("화재", False)], "term string, wild boolean")
    none = ops._named(asked, terms.limit(0))
    assert "question" not in ops._matched(asked, none, terms, 10).columns
