"""Extraction, merge, stale rows, reconciliation, sync and replaced parts."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lexframe.operators import corpus as ops
from lexframe.operators import lookup
from lexframe.operators.keyfilter import split_by_keys, without_keys
from lexframe.operators.vectors import vectorize_missed
from lexframe.plans.sync import sync_corpus
from lexframe.session import scratch_path
from lexframe.sources.schemas import ARTICLES
from lexframe.sources.statutes import read_statute_json, split_documents, write_statute_json
from lexframe.sources.buckets import store_buckets
from lexframe.sources.parts import part_of, read_parts, replace_parts

LAW = "재난및안전관리기본법"


def unit(no, text, branch=None, kind="조문", **more):
    node = {"조문여부": kind, "조문번호": no, "조문내용": text, **more}
    if branch:
        node["조문가지번호"] = branch
    return node


def document(units, wrap=True, **law):
    holder = {"조문단위": units} if wrap else units
    return json.dumps({"법령": {"시행일자": "20260101", **law, "조문": holder}}, ensure_ascii=False)


def extracted(spark, *docs, law=LAW):
    df = spark.createDataFrame([(law, d) for d in docs], "law_name string, doc string")
    return ops.extract_articles(df)


def test_branch_numbers_stay_apart(spark):
    doc = document([unit("14", "제14조(본부) 내용"), unit("14", "제14조의2(파견) 내용", "2")])
    found = {r.article_number_norm: r.article_number for r in extracted(spark, doc).collect()}
    assert found == {"14": "제14조", "14의2": "제14조의2"}


def test_repealed_headings_and_empty_are_dropped(spark):
    doc = document([unit("9", "제9조의2 삭제 <2013.8.6>", "2"), unit("10", "제10조 내용"),
                    unit("1", "제1장", kind="전문"), unit("", "번호 없음"), unit("11", "  ")])
    assert [r.article_number_norm for r in extracted(spark, doc).collect()] == ["10"]


def test_body_paragraphs_nested_units_and_title(spark):
    paragraphs = [{"항번호": "①", "항내용": "① 첫째"}, {"항번호": "②", "항내용": "② 둘째",
                  "호": [{"호번호": "1.", "호내용": "1. 가", "목": {"목번호": "가.", "목내용": "가. 나"}}]}]
    full = unit("1", ["제1조", " (목적) "], 항=paragraphs, 조문단위={"조문내용": "부속"})
    titled = unit("2", "", 조문제목="(제목뿐)")
    found = {r.article_number_norm: r.text for r in extracted(
        spark, document([full, titled])).collect()}
    # compatibility forms are folded: the circled numbers become digits
    assert found["1"] == "제1조\n(목적)\n1 첫째\n2 둘째\n1. 가\n가. 나\n부속"
    assert found["2"] == "(제목뿐)"


def test_shapes_of_the_unit_holder(spark):
    one = unit("3", "제3조 하나")
    as_object = document(one)
    as_list = document([one], wrap=False)
    itself = document(one, wrap=False)
    for doc in (as_object, as_list, itself):
        assert [r.article_number_norm for r in extracted(spark, doc).collect()] == ["3"]


def test_dates_of_articles(spark):
    doc = document([unit("1", "가", 조문시행일자="20251001"), unit("2", "나"),
                    unit("3", "다", 조문시행일자=["20240101", "2025-02-03"]),
                    unit("4", "라", 조문시행일자={"@시행일자": "20230303"}), unit("5", "마", 조문시행일자="?")])
    found = {r.article_number_norm: r.enforcement_date for r in extracted(spark, doc).collect()}
    assert found == {"1": dt.date(2025, 10, 1), "2": dt.date(2026, 1, 1), "3": dt.date(2025, 2, 3),
                     "4": dt.date(2023, 3, 3), "5": None}


def empty_articles(spark):
    return spark.createDataFrame([], ARTICLES)


def now(day):
    return F.lit(f"2026-01-{day:02d} 00:00:00").cast("timestamp_ntz")


def test_merge_keeps_birth_data_and_last_text(spark):
    old = spark.createDataFrame(
        [("c1", "옛 이름", "법", "제1조", "1", "옛", None, dt.datetime(2025, 1, 1),
          dt.datetime(2025, 1, 1))], ARTICLES)
    incoming = spark.createDataFrame(
        [("n1", "새 이름", "법", "제1조", "1", "새", None, 0),
         ("n2", "첫 이름", "법", "제2조", "2", "앞", None, 1),
         ("n3", "둘 이름", "법", "제2조", "2", "뒤", None, 2)],
        "chunk_id string, law_name string, law_name_norm string, article_number string, "
        "article_number_norm string, text string, enforcement_date date, position int")
    merged = {r.article_number_norm: r for r in ops.merge_articles(old, incoming, now(2)).collect()}
    first, second = merged["1"], merged["2"]
    assert (first.chunk_id, first.law_name, first.text) == ("c1", "옛 이름", "새")
    assert (first.created_at.year, first.updated_at.year) == (2025, 2026)
    assert (second.chunk_id, second.law_name, second.text) == ("n2", "첫 이름", "뒤")
    again = ops.merge_articles(ops.merge_articles(old, incoming, now(2)), incoming, now(2))
    assert sorted(again.collect()) == sorted(ops.merge_articles(old, incoming, now(2)).collect())


def keys(rows):
    return {(r.law_name_norm, r.article_number_norm) for r in rows.collect()}


def test_stale_rows_only_of_laws_that_came_in(spark):
    schema = "law_name_norm string, article_number_norm string"
    current = spark.createDataFrame(
        [("a", "1"), ("a", "2"), ("b", "1"), ("a", None)], schema)
    incoming = spark.createDataFrame([("a", "1"), ("a", "9"), ("a", "1")], schema)
    assert keys(ops.stale_articles(current, incoming)) == {("a", "2")}
    assert keys(ops.remove_stale(current, incoming)) == {("a", "1"), ("b", "1"), ("a", None)}
    assert ops.remove_stale(current, incoming).count() == 3
    assert ops.stale_articles(current, incoming.limit(0)).count() == 0


def test_reconcile_sees_laws_of_either_store(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "law_name_norm string")
    b = spark.createDataFrame([("x",), ("x",), ("z",)], "law_name_norm string")
    report = ops.reconcile(a, b)
    assert {r.law_name_norm: r.matches for r in report.collect()} == {
        "x": True, "y": False, "z": False}
    assert not ops.reconcile_summary(report).first().ok
    assert ops.reconcile_summary(ops.reconcile(a, a)).first().ok


def embed(articles):
    return articles.select(
        "law_name_norm", "article_number_norm",
        F.array(F.char_length("text").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))


def points(spark):
    schema = ("embedding array<float>, law_name string, law_name_norm string, "
              "article_number string, article_number_norm string, text string, "
              "enforcement_date date, point_id bigint")
    return spark.createDataFrame([], schema)


def test_sync_is_idempotent_and_both_stores_agree(spark):
    docs = spark.createDataFrame(
        [(LAW, document([unit("1", "가"), unit("2", "나"), unit("2", "나의", "2")])),
         ("다른 법", document([unit("1", "다")])), ("깨진 법", "{not json"), ("빈 법", document([]))],
        "law_name string, doc string")
    first = sync_corpus(empty_articles(spark), docs, now(1), points(spark), embed)
    assert keys(first.articles) == {(LAW, "1"), (LAW, "2"), (LAW, "2의2"), ("다른법", "1")}
    assert first.summary.first().ok
    assert {r.law_name: r.status for r in first.per_law.collect()} == {
        LAW: "synced", "다른 법": "synced", "깨진 법": "failed", "빈 법": "no_articles"}
    assert [r.law_name for r in first.quarantine.collect()] == ["깨진 법"]
    second = sync_corpus(first.articles, docs, now(1), first.points, embed)
    assert sorted(second.articles.collect()) == sorted(first.articles.collect())
    assert second.summary.first().ok

    fewer = spark.createDataFrame(
        [(LAW, document([unit("1", "가")])), ("다른 법", "broken"), ("빈 법", document([]))],
        "law_name string, doc string")
    third = sync_corpus(second.articles, fewer, now(2), second.points, embed)
    assert keys(third.articles) == {(LAW, "1"), ("다른법", "1")}
    assert keys(third.points) == keys(third.articles) and third.summary.first().ok


def test_documents_from_files(spark, tmp_path):
    (tmp_path / "가 법.json").write_text(document([unit("1", "가\n나")]), encoding="utf-8")
    (tmp_path / "나 법.json").write_text("[1, 2", encoding="utf-8")
    docs = read_statute_json(spark, str(tmp_path))
    good, bad = split_documents(docs)
    assert [r.law_name for r in good.collect()] == ["가 법"]
    assert [r.law_name for r in bad.collect()] == ["나 법"]
    assert ops.extract_articles(good).first().text == "가\n나"


def test_documents_to_files(spark, tmp_path):
    texts = [document([unit("1", "가\n나")]), document([unit("2", "다")]), document([unit("2", "다")]), None, "[1, 2"]
    laws = spark.createDataFrame(list(enumerate(texts)), "n int, doc string").repartition(3)
    for base in (str(tmp_path / "a b"), (tmp_path / "c").as_uri()):
        write_statute_json(laws, base)
        write_statute_json(laws, base)  # as a repeated task does
        docs = read_statute_json(spark, base)
        assert docs.columns == ["law_name", "doc"]
        assert sorted(r.doc for r in docs.collect()) == sorted(t for t in texts if t)
    files = [f.name for f in (tmp_path / "c").rglob("*") if f.is_file()]
    assert len(files) == len(texts) and all(f.endswith(".json") for f in files)


def test_parts_are_replaced_alone(spark):
    path = scratch_path(spark, "parts")
    schema = "law string, n int"
    assert read_parts(spark, path, schema).count() == 0
    laws = [f"law{i}" for i in range(20)]
    replace_parts(spark.createDataFrame([(x, 1) for x in laws], schema), path, "law", 8)
    new = spark.createDataFrame([("law3", 2)], schema)
    part = new.select(part_of("law", 8).alias("p")).first().p
    others = {r.law for r in spark.createDataFrame([(x,) for x in laws], "law string").where(part_of("law", 8) != part).collect()}
    assert {r.law for r in read_parts(spark, path, schema).collect()} == set(laws)
    replace_parts(new, path, "law", 8)
    replace_parts(new, path, "law", 8)
    assert {tuple(r) for r in read_parts(spark, path, schema).collect()} == {("law3", 2)} | {(x, 1) for x in others}
    assert {tuple(r) for r in read_parts(spark, path, schema, [part]).collect()} == {("law3", 2)}


def test_cache_misses_collapse_copies(spark):
    texts = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "text string")
    cache = spark.createDataFrame([("b",)], "t string").select(F.sha2("t", 256).alias("query_hash"))
    assert [r.query_text for r in ops.cache_misses(texts, cache).collect()] == ["a"]


def test_exact_lookup_gives_one_row_per_request(spark):
    articles = spark.createDataFrame(
        [("법", "1", "법", "b", None), ("법", "1", "법", "a", None), ("법", "2의3", "법", "c", None)],
        "law_name_norm string, article_number_norm string, law_name string, text string, "
        "enforcement_date date")
    asked = spark.createDataFrame(
        [(1, " 법 ", "제1조"), (2, "법", "제2조의3"), (3, "법", "제23조"), (4, "법", " ")],
        "question_id long, name string, article string")
    found = {r.question_id: (r.status, r.text) for r in lookup.exact_lookup(
        asked, articles).collect()}
    assert found == {1: ("found", "a"), 2: ("found", "c"), 3: ("not_found", None), 4: ("invalid", None)}


def test_seed_golden_numbers_all_cases(spark):
    articles = spark.createDataFrame([("법", "2", "법", " 본문 ")],
                                     "law_name_norm string, article_number_norm string, "
                                     "law_name string, text string")
    cases = spark.createDataFrame(
        [(1, "법", "9", "q1", "concept"), (2, "법", "2", "q2", "penalty")],
        "position int, law_name_norm string, article_number_norm string, question string, "
        "question_type string")
    found = {r.id: (r.matched, r.ground_truth) for r in lookup.seed_golden(cases, articles).collect()}
    assert found == {"GS-001": (False, None), "GS-002": (True, "본문")}


def test_route_labels_fill_open_routes_only(spark):
    from lexframe.plans.routing import route_questions

    asked = spark.createDataFrame([("안전 기준",), ("산재 은폐하면?",), ("모르는 질문",)], "query string")
    labels = spark.createDataFrame([("안전 기준", "blog_tool"), ("산재 은폐하면?", "news_tool")],
                                   "query string, tool string")
    found = {r.query: (r.tool, r.handler) for r in route_questions(asked, labels).collect()}
    assert found == {"안전 기준": ("law_rag_tool", "law_agent"),
                     "산재 은폐하면?": ("news_tool", "news_agent"),
                     "모르는 질문": ("law_rag_tool", "law_agent")}


@pytest.fixture(scope="module")
def buckets(spark):
    rows = spark.range(6000).selectExpr(
        "concat('c', id) AS chunk_id", "concat('law', id % 7) AS law_name", "concat('law', id % 7) AS law_name_norm",
        "if(id = 9, null, cast(id AS string)) AS article_number_norm", "concat('제', id, '조') AS article_number",
        "concat('text ', id) AS text", "cast(null AS date) AS enforcement_date", "1L AS created_at", "1L AS updated_at")
    plain = scratch_path(spark, "buckets_plain")
    rows.write.parquet(plain)
    return rows, store_buckets(rows, scratch_path(spark, "buckets")), spark.read.parquet(plain)


def _shuffled(df) -> list[str]:
    """Per exchange of the plan, the plan below it."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
    found = []
    for at, line in enumerate(plan):
        if "Exchange hashpartitioning" in line:
            depth = line.index("Exchange")
            below = []
            for other in plan[at + 1:]:
                if len(other) - len(other.lstrip(" :+-")) <= depth - 1:
                    break
                below.append(other)
            found.append("\n".join(below))
    return found


def test_stored_side_is_not_shuffled(spark, buckets):
    rows, stored, plain = buckets
    incoming = rows.where("chunk_id < 'c3'").withColumns(
        {"text": F.concat("text", F.lit("!")), "position": F.lit(1)})
    asked = rows.selectExpr("chunk_id AS question_id", "law_name AS name", "article_number_norm AS article")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "6000b")
    try:
        for job in (
            lambda t: ops.merge_articles(t, incoming, F.lit(2).cast("bigint")),
            lambda t: ops.remove_stale(t, incoming),
            lambda t: lookup.exact_lookup(asked, t),
            lambda t: ops.unmatched(t, t),
        ):
            found = job(stored)
            assert not [below for below in _shuffled(found) if "buckets_" in below]
            assert [below for below in _shuffled(job(plain)) if "buckets_" in below]
            assert found.exceptAll(job(rows)).count() == 0 == job(rows).exceptAll(found).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_extraction_runs_one_python_helper(spark):
    """A second helper would hold workers of its own in every task."""
    docs = spark.createDataFrame([("법가", '{"법령":{"조문":{"조문여부":"조문","조문번호":"1","조문내용":"① ﬁ"}}}')], "law_name string, doc string")
    found = ops.extract_articles(docs)
    assert [tuple(r) for r in found.select("law_name_norm", "text").collect()] == [("법가", "1 fi")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_a_merge_into_an_unwritten_table_joins_nothing(spark):
    """The increment's texts would be shuffled again for joins that find nothing."""
    empty = read_parts(spark, scratch_path(spark, "unwritten"), ARTICLES)
    docs = spark.createDataFrame([("법가", document([unit("1", "본문")]))], "law_name string, doc string")
    result = sync_corpus(empty, docs, F.lit("2026-01-01").cast("timestamp_ntz"))
    assert "Join" not in result.articles._jdf.queryExecution().optimizedPlan().toString()
    assert [r.text for r in result.articles.collect()] == ["본문"]


def test_cache_merge_orders_only_repeated_hashes(spark):
    rows = "query_hash string, v string, ts bigint"
    cache = spark.createDataFrame([("a", "old", 1), ("b", "old", 1), ("c", "old", 1), ("c", "old", 1), (None, "old", 1)], rows)
    new = spark.createDataFrame([("b", "new", 2), ("d", "new", 2), ("e", "new", 2), ("e", "newer", 3),
                                 (None, "new", 2), (None, "newer", 3)], rows)
    merged = ops.cache_merge(cache, new)
    assert sorted((r.query_hash or "", r.v, r.ts) for r in merged.collect()) == [
        ("", "newer", 3), ("", "old", 1), ("a", "old", 1), ("b", "new", 2), ("c", "old", 1), ("c", "old", 1),
        ("d", "new", 2), ("e", "newer", 3)]


def test_missed_texts_are_found_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    texts = spark.createDataFrame([(t,) for t in ["a b", "a b", "b c", "c", None]], "text string").mapInPandas(counted, "text string")
    cache = spark.createDataFrame([("c", "c", [1.0], 1)], "h string, query_text string, embedding array<float>, ts bigint")
    cache = cache.select(F.sha2("h", 256).alias("query_hash"), "query_text", "embedding", "ts")
    rows = vectorize_missed(texts, cache, F.lit(2).cast("bigint"), features=8).collect()
    assert sorted((r.query_text, r.ts, len(r.embedding)) for r in rows) == [("a b", 2, 8), ("b c", 2, 8), ("c", 1, 1)]
    assert read.value == 5


def _repeats(spark):
    schema = ("chunk_id string, law_name string, law_name_norm string, article_number string, article_number_norm string, "
              "text string, enforcement_date date, position int")
    rows = [(f"n{i}", law, law, "제", no, f"t{i}", None, i) for i, (law, no) in enumerate(
        [("a", "1"), ("a", "2"), ("a", "2"), ("b", "1"), ("b", None), ("b", None)])]
    return spark.createDataFrame(rows, schema)


def test_split_by_keys_misses_no_listed_row(spark):
    rows = spark.range(20000).selectExpr("id", "cast(id % 7 AS int) AS n", "if(id % 5 = 0, null, concat('k', id)) AS k")
    keys = rows.where("id % 10 < 2").selectExpr("cast(n AS bigint) AS n", "k")
    rest, some = split_by_keys(keys, rows)[0]
    listed = {r.id for r in some.collect()}
    assert listed >= {i for i in range(20000) if i % 10 < 2} and len(listed) < 6500  # null keys are alike in seven kinds
    assert rest.count() + len(listed) == 20000
    expected = rows.join(keys, ["n", "k"], "left_anti").select("id", "n", "k")
    assert without_keys(rows, keys).exceptAll(expected).count() == 0 == expected.exceptAll(without_keys(rows, keys)).count()
    assert without_keys(rows, keys.limit(0)).count() == 20000


def test_only_rows_that_may_meet_are_shuffled(spark, buckets):
    rows, _, plain = buckets
    incoming = rows.where("chunk_id < 'c3'").withColumns({"text": F.concat("text", F.lit("!")), "position": F.lit(1)})
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for job in (lambda t: ops.merge_articles(t, incoming, F.lit(2).cast("bigint")), lambda t: ops.remove_stale(t, incoming)):
            moved = [below for below in _shuffled(job(plain)) if "buckets_" in below]
            assert moved and all("ubquery" in below for below in moved)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_merge_of_repeated_and_null_keys(spark):
    old = spark.createDataFrame(
        [(f"c{i}", law, law, "제", no, f"old{i}", None, dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 1))
         for i, (law, no) in enumerate([("a", "1"), ("a", "1"), ("b", None), ("c", "1")])], ARTICLES)
    merged = ops.merge_articles(old, _repeats(spark), now(2))
    assert sorted((r.chunk_id, r.law_name_norm, r.article_number_norm or "", r.text) for r in merged.collect()) == [
        ("c0", "a", "1", "t0"), ("c1", "a", "1", "t0"), ("c2", "b", "", "old2"), ("c3", "c", "1", "old3"),
        ("n1", "a", "2", "t2"), ("n3", "b", "1", "t3"), ("n4", "b", "", "t5")]


def test_old_texts_of_changed_rows_stay_where_no_new_one_has_a_place(spark):
    old = spark.createDataFrame(
        [(f"c{i}", "a", "a", "제", str(i), f"old{i}", None, dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 1)) for i in range(400)], ARTICLES)
    incoming = spark.createDataFrame(
        [(f"n{i}", "a", "a", "제", str(i), f"t{i}", None, i if i % 3 else None) for i in range(0, 400, 2)],
        "chunk_id string, law_name string, law_name_norm string, article_number string, article_number_norm string, "
        "text string, enforcement_date date, position int")
    merged = {r.chunk_id: r.text for r in ops.merge_articles(old, incoming, now(2)).collect()}
    assert merged == {f"c{i}": f"t{i}" if i % 2 == 0 and i % 3 else f"old{i}" for i in range(400)}


def test_vectors_that_carry_their_articles_are_not_joined(spark):
    articles = _repeats(spark)
    carried = articles.withColumn("embedding", F.array(F.col("position").cast("float")))
    by_key, taken = ops.vector_rows(articles, carried.select(*ops.KEYS, "embedding")), ops.vector_rows(articles, carried)
    assert sorted(by_key.columns) == sorted(taken.columns)
    assert sorted(map(str, by_key.collect())) == sorted(map(str, taken.select(*by_key.columns).collect())) and taken.count() == 6
    single = articles.where("chunk_id IN ('n0', 'n1', 'n3')")
    points = ops.vector_rows(single, single.withColumn("embedding", F.array(F.lit(1.0).cast("float"))))
    assert "Join" not in points._jdf.queryExecution().optimizedPlan().toString() and points.count() == 3


def test_parts_are_replaced_by_what_reads_them(spark):
    path, schema = scratch_path(spark, "parts"), "law string, n int"
    replace_parts(spark.createDataFrame([(f"law{i}", 1) for i in range(20)], schema), path, "law", 4)
    for n in (2, 3):
        replace_parts(read_parts(spark, path, schema).withColumn("n", F.lit(n)), path, "law", 4)
        assert sorted(tuple(r) for r in read_parts(spark, path, schema).collect()) == sorted((f"law{i}", n) for i in range(20))
