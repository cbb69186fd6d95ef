"""Log files, event lines, reports and service metrics."""

import json

from pyspark.sql import functions as F

from lexframe.operators import answers, logs, metrics
from lexframe.sources import logs as files


def test_log_round_trip_drops_noise(spark, tmp_path):
    requests = spark.sql("""SELECT * FROM VALUES
      (TIMESTAMP '2026-01-01 10:00:00', repeat('가', 400), 0.81235D, array('a')),
      (TIMESTAMP '2026-01-02 10:00:00', 'q', 0.0D, array()),
      (TIMESTAMP '2026-01-02 11:00:00', 'r', NULL, array('b'))
      AS t(ts, query, confidence_score, selected_articles)""").withColumns({
        "tool": F.lit("law_rag_tool"), "query_type": F.lit("semantic"),
        "selected_source": F.lit("pg"), "fallback_used": F.lit(False)})
    path = str(tmp_path / "log")
    files.write_qa_log(requests, path, query_chars=300)
    files.write_qa_log(requests.limit(1), path, query_chars=300)
    (tmp_path / "log" / "day=20260103").mkdir()
    (tmp_path / "log" / "day=20260103" / "qa_x.jsonl").write_text('\n{broken\n[1]\n  \n')
    rows = files.read_qa_log(spark, path)
    assert rows.count() == 4
    found = sorted((r.ts, len(r.query), r.confidence_score) for r in rows.collect())
    assert found[0] == ("2026-01-01T10:00:00", 300, 0.8124)
    assert [f[2] for f in found[2:]] == [None, None]
    assert sorted(p.name for p in (tmp_path / "log").glob("day=*")) == [
        "day=20260101", "day=20260102", "day=20260103"]


def test_report_of_an_empty_log(spark):
    empty = spark.createDataFrame([], "selected_source string, query_type string, tool string, "
                                  "selected_articles array<string>, fallback_used boolean, "
                                  "confidence_score double")
    assert logs.qa_report(empty).count() == 0
    assert logs.failure_rollup(empty).count() == 0


def test_distribution_counts_blanks_as_missing(spark):
    df = spark.createDataFrame([("pg",), ("",), (None,), ("pg",)], "s string")
    assert [(r.value, r.n, r.percent) for r in logs.distribution(df, "s", "none").collect()] == [
        ("none", 2, 50.0), ("pg", 2, 50.0)]


def test_event_lines(spark):
    lines = ['data: {"event": "text", "payload": "가 "}', 'data:{"type":"source","payload":{"a":1}}',
             "", "  ", "data: nonsense", ": ping", '{"event":"saved","payload":"7"}',
             'data: {"event":"status"}']
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "seq int, value string")
    found = {r.seq: (r.event, r.payload) for r in files.parse_event_lines(df).collect()}
    assert found == {0: ("text", "가 "), 1: ("source", '{"a":1}'), 6: ("saved", "7"),
                     7: ("status", "")}


def test_chunks_come_back_whole(spark):
    texts = ["가나다라마" * 13, "", "x", "줄\n바꿈 \r\n" * 30, "𝒳" * 41]
    df = spark.createDataFrame(list(enumerate(texts)), "request_id int, text string")
    parts = answers.chunk_text(df, "text", 20)
    assert max(len(r.chunk) for r in parts.collect()) == 20
    chunks = parts.select("request_id", "seq", F.lit("text").alias("event"),
                          F.col("chunk").alias("payload"))
    for block in (2, 1024):
        found = {r.request_id: r.answer for r in answers.assemble_answer(
            chunks.repartition(3), block).collect()}
        assert found == {i: t for i, t in enumerate(texts) if t}


def test_assembled_answer_keeps_the_last_source(spark):
    def laws(name):
        return json.dumps({"retrieved_laws": [{"law_name": name}], "law_url": "u"}, ensure_ascii=False)

    rows = [(1, 0, "status", "🌐 Web fallback 실행"), (1, 1, "source", laws("앞")), (1, 2, "text", "a"),
            (1, 5000, "source", laws("뒤")), (1, 5001, "text", "b"), (1, 5002, "error", "x"),
            (1, 5003, "saved", "11"), (2, 0, "status", "검색")]
    df = spark.createDataFrame(rows, "request_id int, seq int, event string, payload string")
    found = {r.request_id: r for r in answers.assemble_answer(df).collect()}
    one = found[1]
    assert (one.answer, one.saved_id, one.fallback, one.errors, one.events, one.source) == (
        "ab", "11", True, 1, 7, "pg")
    assert json.loads(one.sources) == [{"law_name": "뒤"}]
    assert (found[2].answer, found[2].sources, found[2].fallback) == ("", None, False)


def test_active_requests_carry_over_slots(spark):
    df = spark.sql("""SELECT * FROM VALUES
      ('ask', TIMESTAMP_NTZ '2026-01-01 00:00:10', TIMESTAMP_NTZ '2026-01-01 00:05:00'),
      ('ask', TIMESTAMP_NTZ '2026-01-01 00:01:00', TIMESTAMP_NTZ '2026-01-01 00:01:30'),
      ('ask', TIMESTAMP_NTZ '2026-01-01 00:01:30', NULL),
      ('law', TIMESTAMP_NTZ '2026-01-01 00:01:00', TIMESTAMP_NTZ '2026-01-01 00:01:00')
      AS t(endpoint, started_at, ended_at)""")
    found = sorted((r.endpoint, str(r["at"])[11:], r.active) for r in metrics.active_requests(df).collect())
    assert found == [("ask", "00:00:10", 1), ("ask", "00:01:00", 2), ("ask", "00:01:30", 2),
                     ("ask", "00:05:00", 1), ("law", "00:01:00", 0)]


def test_load_summary_without_successes(spark):
    df = spark.createDataFrame([(1, False, None, 3.0), (2, True, None, 1.0), (2, True, 0.5, 2.0)],
                               "round int, ok boolean, ttfb double, total_time double")
    found = {r.round: r for r in metrics.load_summary(df).collect()}
    assert (found["1"].total, found["1"].succeeded, found["1"].total_time_p50) == (1, 0, None)
    assert (found["all"].total, found["all"].total_time_p50, found["2"].ttfb_p90) == (3, 2.0, 0.5)
