"""Streams against batch, late rows, unfinished requests and repeated batches."""

import json
import os

from pyspark.sql import functions as F

from lexframe import session
from lexframe.operators.vectors import vectorize
from lexframe.session import scratch_path, scratch_root
from lexframe.sources.parts import part_of, read_parts
from lexframe.sources.schemas import ARTICLES, POINTS
from lexframe.sources.statutes import stream_statute_json
from lexframe.streaming import jobs

CHUNKS = "request_id string, seq long, event string, payload string, at timestamp"


class Feed:
    """A folder that receives one file per batch, and a stream that has read the earlier ones."""

    def __init__(self, spark, schema, build):
        self.spark, self.schema = spark, schema
        self.inbox, self.out = scratch_path(spark, "inbox"), scratch_path(spark, "out")
        self.checkpoint = scratch_path(spark, "checkpoint")
        self.build = build

    def push(self, rows):
        df = self.spark.createDataFrame(rows, self.schema)
        df.coalesce(1).write.mode("append").parquet(self.inbox)
        stream = self.build(self.spark.readStream.schema(df.schema).parquet(self.inbox))
        jobs.append_to(stream, self.out, self.checkpoint).awaitTermination()
        return self.spark.read.schema(stream.schema).parquet(self.out)


def at(second):
    import datetime as dt

    return dt.datetime(2026, 1, 1) + dt.timedelta(seconds=second)


def test_answers_over_several_batches(spark):
    feed = Feed(spark, CHUNKS, lambda s: jobs.stream_answers(s, "10 seconds", 60_000))
    feed.push([("a", 1, "text", "나", at(1)), ("a", 0, "text", "가", at(0)),
               ("b", 0, "text", "끝나지 않음", at(2)), ("c", 0, "status", "빈 답", at(2)),
               ("c", 1, "saved", "3", at(3))])
    done = feed.push([("a", 2, "source", json.dumps({"retrieved_laws": [1]}), at(4)),
                      ("a", 3, "saved", "7", at(5))])
    rows = {r.request_id: r for r in done.collect()}
    assert set(rows) == {"a"}
    assert (rows["a"].answer, rows["a"].status, rows["a"].saved_id, rows["a"].sources) == (
        "가나", "complete", "7", "[1]")
    feed.push([("a", 4, "status", "저장 완료", at(6)), ("d", 0, "text", "x", at(500))])
    final = feed.push([("d", 1, "saved", "9", at(501))]).collect()
    assert sorted((r.request_id, r.status) for r in final) == [
        ("a", "complete"), ("b", "incomplete"), ("d", "complete")]


def test_damaged_sources_and_late_chunks(spark):
    feed = Feed(spark, CHUNKS, lambda s: jobs.stream_answers(s, "10 seconds", 60_000))
    feed.push([("a", 0, "text", "가", at(0)), ("a", 2, "source", "{broken", at(1)), ("a", 3, "saved", "1", at(2))])
    rows = feed.push([("a", 1, "text", "나", at(3)), ("b", 0, "text", "x", at(4))]).collect()
    assert [(r.request_id, r.answer, r.status, r.sources) for r in rows] == [("a", "가나", "complete", None)]


def test_stored_answers_are_stored_once(spark):
    requests = spark.createDataFrame(
        [("a", "s", "u", "qa", at(0)), ("b", None, "u", "qb", at(10)), ("c", "s", "u", "qc", at(20))],
        "request_id string, session_id string, user_id string, question string, asked_at timestamp")
    meta = json.dumps({"tool": "law_rag_tool", "query_type": "semantic", "confidence_score": 0.0, "selected_articles": ["x"],
                       "citations": [{"law_name": "법", "article_number": "3", "score": 0.5, "rank": 1}]})
    rows = [
        ("a", 0, "meta", meta, at(0)), ("a", 2, "saved", "1", at(2)), ("b", 0, "meta", "{broken", at(1)), ("b", 1, "text", "답 b", at(1)),
        ("b", 2, "saved", "2", at(1)), ("c", 0, "meta", meta, at(1)), ("c", 1, "text", " ", at(1)), ("c", 2, "saved", "3", at(1)),
        ("a", None, "text", "?", at(1)), (None, 1, "text", "?", at(1)), ("a", 3, None, None, at(1)), ("a", 0, "meta", meta, at(1)),
    ]
    inbox, root, checkpoint = (scratch_path(spark, n) for n in ("inbox", "root", "checkpoint"))

    def push(rows):
        spark.createDataFrame(rows, CHUNKS).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(CHUNKS).parquet(inbox)
        ended = jobs.ended_requests(stream, "10 seconds", 60_000)
        jobs.store_answers(ended, requests, root, checkpoint).awaitTermination()

    push(rows)
    push([("a", 1, "text", "답 a", at(3)), ("b", 9, "status", "late", at(3))])
    turns = sorted((r.request_id, r.role, r.session_id, r.content) for r in spark.read.parquet(f"{root}/turns").collect())
    assert turns == [("a", "assistant", "s", "답 a"), ("a", "user", "s", "qa"),
                     ("b", "assistant", "default_session", "답 b"), ("b", "user", "default_session", "qb")]
    cited = spark.read.parquet(f"{root}/citations").collect()
    assert [(r.chat_history_id, r.law_name, r.article_number, r.rank) for r in cited] == [("a", "법", "3", 1)]
    log = spark.read.parquet(f"{root}/log").collect()
    assert sorted((r.request_id, r.query, r.tool, r.confidence_score) for r in log if r.query_type) == [
        ("a", "qa", "law_rag_tool", None), ("c", "qc", "law_rag_tool", None)]


def test_windows_drop_late_rows(spark):
    schema = "endpoint string, agent_type string, status string, duration double, started_at timestamp"
    feed = Feed(spark, schema, lambda s: jobs.stream_metrics(s, "1 minute", "30 seconds"))
    feed.push([("ask", "x", "success", 0.2, at(1)), ("ask", "x", "error", 3.0, at(59)),
               ("ask", "x", "success", 0.1, at(200))])
    rows = feed.push([("ask", "x", "success", 9.0, at(2)), ("ask", "x", "success", 1.0, at(400))])
    found = {str(r.window_start)[14:16]: r for r in rows.collect()}
    first = found["00"]
    assert (first.requests, first.errors, first.le_0_5, first.le_5_0) == (2, 1, 1, 2)
    assert found["03"].requests == 1


def test_first_result_per_link(spark):
    feed = Feed(spark, "link string, n int, seen timestamp",
                lambda s: jobs.stream_dedup(s, "link", "seen", "1 hour"))
    feed.push([("u", 1, at(0)), ("", 2, at(0)), (None, 3, at(0))])
    rows = feed.push([("u", 4, at(10)), ("v", 5, at(11))])
    assert sorted((r.link, r.n) for r in rows.collect()) == [("u", 1), ("v", 5)]


def test_routes_with_labels(spark):
    labels = spark.createDataFrame([("산재 은폐하면?", "news_tool")], "query string, tool string")
    feed = Feed(spark, "query string", lambda s: jobs.stream_route(s, labels))
    rows = feed.push([("안전 기준",), ("산재 은폐하면?",), ("무엇?",)])
    assert {r.query: (r.tool, r.resolved) for r in rows.collect()} == {
        "안전 기준": ("law_rag_tool", True), "산재 은폐하면?": ("news_tool", True),
        "무엇?": ("law_rag_tool", False)}


def test_log_lines(spark, tmp_path):
    line = {"ts": "t", "query": "q", "selected_articles": ["a"], "fallback_used": False,
            "confidence_score": 0.5}
    (tmp_path / "qa_1.jsonl").write_text(json.dumps(line) + "\n\n{broken\n")
    stream = jobs.stream_qa_log(spark, str(tmp_path))
    out = scratch_path(spark, "flagged")
    jobs.append_to(stream, out, scratch_path(spark, "checkpoint")).awaitTermination()
    rows = spark.read.schema(stream.schema).parquet(out).collect()
    assert [(r.query, r.failure_reason) for r in rows] == [("q", "low_confidence(0.500)")]


def test_statutes_arrive_twice(spark, tmp_path):
    def write(name, *numbers):
        units = [{"조문여부": "조문", "조문번호": n, "조문내용": f"본문 {n}"} for n in numbers]
        (tmp_path / name).write_text(json.dumps({"법령": {"조문": {"조문단위": units}}},
                                                ensure_ascii=False), encoding="utf-8")

    root, checkpoint = scratch_path(spark, "corpus"), scratch_path(spark, "checkpoint")

    def drain():
        stream = stream_statute_json(spark, str(tmp_path))
        now = F.lit("2026-01-01").cast("timestamp_ntz")
        jobs.stream_sync(stream, root, checkpoint, now).awaitTermination()
        rows = read_parts(spark, f"{root}/articles", ARTICLES).collect()
        return {(r.law_name_norm, r.article_number_norm) for r in rows}

    def files(law):
        part = spark.range(1).select(part_of(F.lit(law)).alias("p")).first().p
        return set(spark.read.parquet(f"{root}/articles/part={part}").inputFiles())

    write("가법.json", "1", "2")
    assert drain() == {("가법", "1"), ("가법", "2")}
    before = files("가법")
    write("나법.json", "1")
    (tmp_path / "다법.json").write_text("broken")
    assert drain() == {("가법", "1"), ("가법", "2"), ("나법", "1")}
    # the second batch rewrote the part of its laws only
    assert files("가법") == before
    assert drain() == {("가법", "1"), ("가법", "2"), ("나법", "1")}
    write("가법2.json", "9")
    assert ("가법2", "9") in drain()


def test_a_batch_leaves_only_its_tables(spark, tmp_path):
    def drain(*laws):
        for law, n in laws:
            units = [{"조문여부": "조문", "조문번호": str(i + 1), "조문내용": f"본문 {i}"} for i in range(n)]
            (tmp_path / f"{law}.json").write_text(json.dumps({"법령": {"조문": {"조문단위": units}}}, ensure_ascii=False), encoding="utf-8")
        stream = stream_statute_json(spark, str(tmp_path))
        jobs.stream_sync(stream, root, checkpoint, F.lit("2026-01-01").cast("timestamp_ntz"),
                         lambda articles: vectorize(articles, "text", 4), 2).awaitTermination()
        return [sorted((r.law_name_norm, r.article_number_norm) for r in read_parts(spark, f"{root}/{name}", schema).collect())
                for name, schema in (("articles", ARTICLES), ("points", POINTS))]

    root, checkpoint = scratch_path(spark, "corpus"), scratch_path(spark, "checkpoint")
    before = {name.rsplit("-", 1)[0] for name in os.listdir(scratch_root(spark))}
    held = set(session._made)
    for laws in ([("가", 2), ("나", 1), ("다", 1)], [("라", 1), ("마", 2)]):
        articles, points = drain(*laws)
        assert articles == points and {(law, str(n)) for law, n in laws} <= set(articles)
    assert len(articles) == 7
    assert set(session._made) == held
    left = {name.rsplit("-", 1)[0] for name in os.listdir(scratch_root(spark))}
    assert not left & {"arrived", "incoming-articles", "meeting-keys", "replaced-points", "stale-keys"} - before


class _State:
    """A handle and its states in memory that count the calls made on them."""

    def __init__(self):
        self.calls, self.value, self.items, self.timers = [], None, [], set()

    def __getattr__(self, name):
        def call(*given):
            self.calls.append(name)
            if name in ("getListState", "getValueState"):
                return self
            if name == "get":
                return self.value
            if name == "update":
                self.value = given[0]
            elif name == "registerTimer":
                self.timers.add(given[0])
            elif name == "deleteTimer":
                self.timers.discard(given[0])

        return call

    def getCurrentWatermarkInMs(self):
        return 0


def test_a_whole_request_makes_three_calls_on_the_state():
    state = _State()
    assembler = jobs._Assembler(60_000, "saved")
    assembler.init(state)
    state.calls.clear()

    def take(*rows):
        made = [{"seq": s, "event": e, "payload": p, "at_ms": at_ms} for s, e, p, at_ms in rows]
        return list(assembler.handleInputRows(("a",), iter(made), state))

    assert [r["answer"] for r in take((1, "saved", "7", 20), (0, "text", "가", 10))] == ["가"]
    assert sorted(state.calls) == ["get", "registerTimer", "update"] and state.timers == {60_020}
    assert take((2, "status", "late", 30)) == [] and state.timers == {60_030}
