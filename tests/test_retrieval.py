"""Every branch of tiered retrieval on a small corpus of hand-made vectors."""

import pytest

from lexframe.plans.retrieval import tiered_retrieve

BIG, ACT, PUNISH = "산업안전보건기준에관한규칙", "산업안전보건법", "중대재해처벌등에관한법률"


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [
        (1, [1.0, 0.0, 0.0], BIG, "10", "비계 본문"),
        (2, [0.0, 1.0, 0.0], ACT, "17", "관리자 본문"),
        (3, [0.6, 0.8, 0.0], ACT, "14의2", "가지 본문"),
        (4, [0.0, 0.0, 1.0], PUNISH, "6", "   "),
        (5, [0.0, 0.1, 1.0], PUNISH, "7", "처벌 본문"),
        (6, [0.0, 0.0, 0.9], PUNISH, "8", ""),
    ]
    return spark.createDataFrame(
        [(i, v, law, law, f"제{n}조", n, text, None) for i, v, law, n, text in rows],
        "point_id long, embedding array<float>, law_name string, law_name_norm string, "
        "article_number string, article_number_norm string, text string, enforcement_date date")


def ask(spark, corpus, questions, **options):
    df = spark.createDataFrame(
        [(i, q, v) for i, (q, v) in enumerate(questions)],
        "question_id long, question string, embedding array<float>")
    found = tiered_retrieve(df, corpus, corpus, **options).collect()
    return {r.question_id: r for r in found}


QUESTIONS = [
    (f"{ACT} 제17조 내용은?", [1.0, 0.0, 0.0]),           # exact hit
    (f"{ACT} 제14조의2", [1.0, 0.0, 0.0]),                # exact hit on a branch number
    (f"{ACT} 제142조", [0.0, 1.0, 0.0]),                  # exact miss is never replaced
    (f"{ACT}에서 관리자는?", [0.1, 1.0, 0.0]),            # named law, good hit: the best one only
    (f"{ACT} 안내", [0.0, 0.0, 1.0]),                     # named law, nothing near
    ("비계 높이는?", [1.0, 0.1, 0.0]),                    # preferred law, good hit
    ("비계 관리자는?", [0.0, 1.0, 0.0]),                  # preferred law weak, searched everywhere
    ("소방기본법 2조", [1.0, 0.0, 0.0]),                  # unknown law with a number: not trusted
    ("아무 질문", [0.0, -1.0, -1.0]),                     # nothing near anywhere
    ("과태료는?", [0.0, 0.0, 1.0]),                       # best article is blank: the rest remain
]


def test_service_branches(spark, corpus):
    found = ask(spark, corpus, QUESTIONS)
    assert len(found) == len(QUESTIONS)
    direct = found[0]
    assert (direct.status, direct.selected_source, direct.query_type) == (
        "answered", "pg", "direct_article")
    assert direct.selected_articles == [f"{ACT} 제17조"] and direct.confidence_score is None
    assert (direct.citations[0].score, direct.citations[0].rank) == (1.0, 1)
    assert found[1].selected_articles == [f"{ACT} 제14조의2"]
    assert (found[2].status, found[2].selected_source, found[2].citations) == ("not_found", None, [])
    named = found[3]
    assert named.selected_articles == [f"{ACT} 제17조"] and named.confidence_score is None
    assert [c.article_number for c in named.citations] == ["17"]
    assert (found[4].status, found[4].selected_source, found[4].fallback_used) == (
        "web_fallback", "web", True)
    assert found[5].selected_articles == [f"{BIG} 제10조"]
    assert found[5].confidence_score > 0.9
    assert found[6].selected_articles[0] == f"{ACT} 제17조" and found[6].confidence_score == 1.0
    assert [c.rank for c in found[6].citations] == list(range(1, len(found[6].citations) + 1))
    assert found[7].status == found[8].status == "web_fallback"
    # the blank text with white space only is kept, the empty one is not
    assert found[9].selected_articles[0] == f"{PUNISH} 제6조"
    assert f"{PUNISH} 제8조" not in found[9].selected_articles


def test_compat_reports_the_asked_law(spark, corpus):
    cited = ask(spark, corpus, QUESTIONS, compat=True)[3].citations
    assert [(c.law_name, c.article_number, c.score) for c in cited] == [(ACT, "", 1.0)]


def test_unavailable_table_is_not_reported_as_absence(spark, corpus):
    found = ask(spark, corpus, QUESTIONS, available=False)
    assert (found[0].status, found[0].selected_source) == ("answered", "qdrant")
    assert found[2].status == "unavailable"


def test_eval_mode_falls_through(spark, corpus):
    found = ask(spark, corpus, QUESTIONS, mode="eval")
    assert found[0].retrieved_articles == [f"{ACT} 제17조"]
    assert found[0].contexts == ["관리자 본문"]
    assert found[2].retrieved_articles[0] == f"{ACT} 제17조"
    assert found[8].retrieved_articles != []
    assert all(t.strip() for t in found[9].contexts)


def test_large_batches_take_the_grid(spark, corpus):
    small = ask(spark, corpus, QUESTIONS)
    grid = ask(spark, corpus, QUESTIONS, block_bytes=96)
    assert small == grid
