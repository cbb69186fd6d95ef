"""Citations, checks, retests, scenarios, runs and samples."""

from pyspark.sql import functions as F

from lexframe.operators import checks, citations, retrieval_eval, runs
from lexframe.operators.keyed import keep_first
from lexframe.plans.acceptance import acceptance_gate
from lexframe.sources import evaluation as files

ANSWERS = {
    1: "근거는 다음과 같다. [철도안전법] 제7조에 따라 계획을 세운다.",
    2: "먼저 **도로교통법** 제44조 제2항을 보고, 이어 **자동차관리법** 제30조를 본다.",
    3: "[승강기 안전관리에 관한 규정 제12조]에 검사 주기가 있다.",
    4: ("**항공안전법** 제9조가 먼저이고\n[철도안전법] 제7조가 다음이며\n"
        "[승강기 안전관리에 관한 규정 제12조]가 끝이다."),
    5: "인용 없음",
    6: " ".join(f"[법{i}] 제{i}조 [법{i}] 제{i}조" for i in range(1, 9)),
    7: "[항공안전법 제31의4조 제2항]",
}


def answers(spark):
    return spark.createDataFrame(list(ANSWERS.items()), "answer_id int, answer string")


def test_citation_notations(spark):
    found = {}
    for r in citations.extract_citations(answers(spark), limit=5).collect():
        found.setdefault(r.answer_id, {})[r["rank"]] = (r.law_name, r.article_number)
    assert found[1] == {1: ("철도안전법", "7")}
    assert found[2] == {1: ("도로교통법", "44"), 2: ("자동차관리법", "30")}
    assert found[3] == {1: ("승강기 안전관리에 관한 규정", "12")}
    assert found[4] == {1: ("항공안전법", "9"), 2: ("철도안전법", "7"), 3: ("승강기 안전관리에 관한 규정", "12")}
    assert 5 not in found
    everything = citations.extract_citations(answers(spark)).where("answer_id = 6")
    assert everything.count() == 8 and "Python" not in everything._jdf.queryExecution().toString()
    assert found[6] == {i: (f"법{i}", str(i)) for i in range(1, 6)}
    assert found[7] == {1: ("항공안전법", "31의4")}


def test_places_across_notations_and_marks_in_the_text(spark):
    text = "앞\x01 [나법 제2조] 중\x03간\x02 **가법** 제1조 [나법] 제2조 끝 [다법 제3의2조 뒤]"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "조 [ **")], "answer_id int, answer string")
    found = sorted((r["answer_id"], r["rank"], r["law_name"], r["article_number"]) for r in citations.extract_citations(df).collect())
    assert found == [(1, 1, "나법", "2"), (1, 2, "가법", "1"), (1, 3, "다법", "3의2")]


def test_verified_citations(spark):
    said = spark.createDataFrame(
        [(1, "[산업 안전법 제1조] [없는법 제2의3조] [없는법 제2의3조]"), (2, "인용 없음"), (3, None)],
        "answer_id int, answer string")
    corpus = spark.createDataFrame([("산업안전법", "1"), ("산업안전법", "1")],
                                   "law_name_norm string, article_number_norm string")
    found = {r.answer_id: (r.verdict, r.missing)
             for r in citations.verify_citations(said, corpus).collect()}
    assert found == {1: ("CITATION_MISS", ["없는법 제2의3조", "없는법 제2의3조"]), 2: ("OK", []),
                     3: ("OK", [])}


def test_context_styles(spark):
    hits = spark.createDataFrame(
        [(1, r, "법", "1의2", f"본문{r}", f"제목{r}", "요약", "http://x", "출처", "2026-01-01")
         for r in range(1, 8)],
        "question_id int, rank int, law_name string, article_number string, text string, "
        "title string, snippet string, link string, source string, published string")

    def text(style):
        keep = 5 if style == "numbered" else None
        return citations.assemble_context(hits, style, keep=keep).first().context

    assert text("article").startswith("[법 제1조의2]\n본문1\n\n[법 제1조의2]\n본문2")
    assert text("numbered").endswith("[조문 5]\n본문5")
    assert text("web").startswith("[1] 제목1\n요약\nhttp://x\n\n[2]")
    assert text("items").split("\n")[:2] == ["- 제목: 제목1", "  매체: 출처"]


def test_grounding_screen(spark):
    df = spark.sql("""SELECT * FROM VALUES (1, '제3조는 50명', array('제3조', '50')),
      (2, '제3조는 60명', array('제3조')), (3, '70', array('8')), (4, '말뿐', array()),
      (5, '7', NULL) AS t(answer_id, answer, contexts)""")
    found = {r.answer_id: r.verdict for r in citations.screen_grounding(df).collect()}
    assert found == {1: "GROUNDED", 2: "PARTIAL", 3: "HALLUCINATION", 4: "GROUNDED",
                     5: "HALLUCINATION"}


def case(spark, **values):
    base = dict(must_contain=None, expected_source=None, expected_article=None,
                expected_behaviour=None, response_text="", response_source="pg")
    row = {**base, **values}
    schema = ("must_contain array<string>, expected_source string, expected_article array<string>, "
              "expected_behaviour string, response_text string, response_source string")
    df = spark.createDataFrame([tuple(row[c.split()[0]] for c in schema.split(", "))], schema)
    r = checks.classify_failures(checks.check_responses(df)).first()
    return r.passed, r.failed_checks, r.failure_class


def test_response_checks(spark):
    assert case(spark) == (True, [], None)
    assert case(spark, expected_source="web") == (False, ["expected_source"], "fallback_error")
    assert case(spark, expected_source="qdrant")[2] == "output_error"
    assert case(spark, expected_behaviour="not_exist")[2] == "hallucination"
    assert case(spark, expected_behaviour="not_exist", response_text="찾을 수 없습니다")[0]
    assert case(spark, expected_article=["26조"], response_text="제2조")[2] == "wrong_law_selection"
    assert case(spark, expected_behaviour="conditional_answer")[2] == "intent_error"
    assert case(spark, expected_behaviour="scope_explanation", response_text="가" * 81)[0]
    assert not case(spark, expected_behaviour="scope_explanation", response_text="가" * 80)[0]
    assert case(spark, expected_behaviour="no such kind")[2] == "output_error"
    assert case(spark, must_contain=["가", "나"], response_text="가")[1] == ["must_contain"]


def test_retest_cascade(spark):
    failures = spark.createDataFrame(
        [(1, "q", "fallback_used"), (2, "q", "no_articles"), (3, "q", "confidence_null"), (4, "", "x"),
         (5, "q", "fallback_used"), (6, "q", "x")], "case_id int, query string, failure_reason string")
    responses = spark.createDataFrame(
        [(1, "가" * 50, False, None, None), (2, "가" * 60, True, ["a"], None),
         (3, "가" * 201, False, None, None), (4, "가" * 300, False, None, None),
         (5, "가" * 49, False, None, None), (6, "가" * 300, False, None, "timeout")],
        "case_id int, text string, fallback boolean, articles array<string>, error string")
    tested = checks.retest(failures, responses)
    assert {r.case_id: r.improved for r in tested.collect()} == {
        1: True, 2: True, 3: True, 4: None, 5: False, 6: False}
    total = checks.improvement_rate(tested).first()
    assert (total.total_retested, total.improved, total.still_failing, total.improvement_rate) == (
        6, 3, 2, 0.5)


def test_scenarios(spark):
    turns = spark.createDataFrame(
        [(1, "s1", "assistant", "비계 답", '{"tool":"websearch"}'),
         (2, "s2", "assistant", "답", '{"tool":"law"}'), (3, "s2", "user", "비계", "{}")],
        "id long, session_id string, role string, content string, metadata string")
    scenarios = spark.createDataFrame(
        [("MT-1", "s1", ["비계"], "websearch", None), ("MT-2", "s2", ["비계"], "news", "law"),
         ("MT-3", "s3", None, None, None)],
        "scenario_id string, session_id string, expect_any array<string>, expect_tool string, "
        "forbid_tool string")
    found = {r.scenario_id: r.failures for r in checks.check_scenarios(scenarios, turns).collect()}
    assert found == {"MT-1": [], "MT-2": ["expect_any", "expect_tool", "forbid_tool"], "MT-3": []}


def run(ts, tag, **metrics):
    return ts, tag, 1, 1, metrics


def gate(spark, *rows):
    df = spark.createDataFrame(
        list(rows), "run_ts string, tag string, dataset_size long, success_count long, "
        "metrics map<string,double>").withColumn("run_ts", F.to_timestamp("run_ts"))
    return {r.metric: r for r in runs.regression_gate(df).collect()}


def test_regression_gate_thresholds(spark):
    old = run("2026-01-01", "a", faithfulness=0.1, recall=0.1)
    before = run("2026-01-02", "b", faithfulness=1.0, recall=1.0, zero=0.0, gone=1.0)
    quiet = gate(spark, old, before, run("2026-01-03", "c", faithfulness=0.9, recall=0.96, zero=1.0))
    assert {m: r.status for m, r in quiet.items()} == {
        "faithfulness": "stable", "recall": "stable", "zero": "stable", "gone": "N/A"}
    assert not quiet["recall"].has_regression
    bad = gate(spark, before, run("2026-01-03", "c", faithfulness=0.8, recall=1.2))
    assert bad["faithfulness"].status == "regression" and bad["recall"].status == "improved"
    assert bad["recall"].has_regression
    assert gate(spark, before) == {}


def test_runs_round_trip(spark, tmp_path):
    cases = spark.createDataFrame([(1, "success"), (2, "error")], "id int, status string")
    metrics = spark.createDataFrame([(0.5, 0.25)], "faithfulness double, recall double")
    for day in ("2026-01-01 00:00:00", "2026-01-02 00:00:00"):
        row = files.run_row(cases, metrics, day, "t")
        files.write_run(row, cases, str(tmp_path))
    found = files.read_runs(spark, str(tmp_path)).collect()
    assert [str(r.run_ts)[:10] for r in found] == ["2026-01-02", "2026-01-01"]
    assert (found[0].dataset_size, found[0].success_count, found[0].metrics["recall"]) == (2, 1, 0.25)
    assert spark.read.parquet(f"{tmp_path}/cases").count() == 4


def test_golden_file(spark, tmp_path):
    path = tmp_path / "golden.json"
    path.write_text('{"version": 1,\n "dataset": [{"id": "GS-001", "article_number": "1", '
                    '"accepted_articles": [{"law": "법", "article": "2"}]}, {"id": "GS-002"}]}')
    assert [r.id for r in files.read_golden(spark, str(path)).collect()] == ["GS-001", "GS-002"]
    only = files.read_golden(spark, str(path), sample=1, with_article=True).first()
    assert only.accepted_articles[0].article == "2"


def test_diverse_sample_fills_up(spark):
    rows = [(i, t) for i, t in enumerate(["a", "a", "b", "a", None, "c", "unknown"])]
    df = spark.createDataFrame(rows, "position int, kind string")

    def sample(n):
        return [r.position for r in runs.diverse_sample(df, "kind", n).collect()]

    assert sample(3) == [0, 2, 4]
    assert sample(6) == [0, 2, 4, 5, 1, 3]
    assert sample(50) == [0, 2, 4, 5, 1, 3, 6]


def test_hits_need_the_whole_label(spark):
    golden = spark.createDataFrame(
        [(1, "산업안전보건법", "3", None), (2, "법 률", "5", [("다른법", "7")]), (3, "법", "1", None)],
        "case_id int, law_name string, article_number string, "
        "accepted array<struct<law:string,article:string>>")
    results = spark.createDataFrame(
        [(1, 1, "산업안전보건법시행규칙 제3조", 0.9), (1, 2, "산업안전보건법 제33조", 0.8), (2, 1, "x", 0.0),
         (2, 4, "다른 법 제7조", 0.1), (3, 1, None, None)],
        "case_id int, rank int, label string, score double")
    flags = retrieval_eval.hit_flags(results, retrieval_eval.expected_labels(golden))
    found = {(r.case_id, r.k): (r.top1_hit, r.top3_hit, r.topk_hit) for r in flags.collect()}
    assert found[(1, 10)] == found[(3, 10)] == found[(2, 3)] == (False, False, False)
    assert found[(2, 5)] == (False, False, True)
    metrics = {r.k: r for r in retrieval_eval.retrieval_metrics(flags).collect()}
    assert (metrics[5].topk_recall, metrics[5].avg_top1_score) == (0.3333, 0.9)


def test_acceptance_takes_the_last_attempt(spark):
    bad, good = '{"verdict": "HALLUCINATION"}', '{"verdict": "GROUNDED"}'
    yes = '{"verdict": "RELEVANT"}'
    attempts = spark.createDataFrame(
        [(1, 1, bad, yes), (1, 2, good, yes), (2, 1, bad, yes), (2, 2, bad, yes),
         (3, 1, good, '{"verdict": "NOT_RELEVANT"}')],
        "question_id int, attempt int, grounding_reply string, relevance_reply string")
    found = {r.question_id: (r.action, r.final_tool, r.retry_count)
             for r in acceptance_gate(attempts).collect()}
    assert found == {1: ("end", "law_rag_tool", 2), 2: ("websearch_fallback", "websearch_tool", 2),
                     3: ("websearch_fallback", "websearch_tool", 1)}


def test_keep_first_follows_the_order(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("", 0), (None, 0), ("b", 5)], "k string, o int")
    assert {(r.k, r.o) for r in keep_first(df, "k", "o").collect()} == {("a", 1), ("b", 5)}
