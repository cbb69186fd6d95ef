"""Stored tables, provider shapes and reports."""

import pytest
from pyspark.sql import functions as F

from lexframe.operators.keyed import union_sources
from lexframe.sources import evaluation, tables
from lexframe.sources.web import read_web_results


def stored_points(spark, path):
    spark.range(20).select(
        F.col("id").alias("point_id"), F.array(F.lit(1.0).cast("float")).alias("embedding"),
        F.concat(F.lit("법"), F.col("id") % 2).alias("law_name"),
        F.concat(F.lit("법"), F.col("id") % 2).alias("law_name_norm"),
        F.lit("제1조").alias("article_number"), F.col("id").cast("string").alias(
            "article_number_norm"), F.lit("본문").alias("text"),
        F.lit(None).cast("date").alias("enforcement_date"),
    ).write.parquet(path)


def test_vectors_read_only_what_is_asked(spark, tmp_path):
    path = str(tmp_path / "points")
    stored_points(spark, path)
    payload = tables.read_vectors(spark, path, with_vectors=False, law_name_norm="법1")
    plan = payload._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "EqualTo(law_name_norm,법1)" in scan and "embedding" not in scan
    assert payload.count() == 10
    ids = tables.read_vectors(spark, path, with_payload=False)
    assert ids.columns == ["point_id", "embedding"] and ids.count() == 20


def test_tables_have_fixed_schemas(spark, tmp_path):
    path = str(tmp_path / "turns")
    spark.createDataFrame([(1, "s", 1, "user", "q")], "id long, session_id string, "
                          "turn_index long, role string, content string").write.parquet(path)
    turns = tables.read_table(spark, "turns", path)
    assert turns.schema["feedback"].dataType.simpleString() == "tinyint"
    assert tables.key_filter(turns, role="user", session_id="s").count() == 1
    assert tables.key_filter(turns, role="assistant").count() == 0


def test_provider_shapes(spark):
    news = spark.createDataFrame(
        [(0, "<b>제목</b>", "http://o.example.org/1", "http://n.news.naver.com/1", "a &lt; b",
          "Mon, 01 Jan 2024 10:00:00 +0900"),
         (1, "t", "", "http://www.hani.co.kr/2", None, "bad")],
        "position int, title string, originallink string, link string, description string, "
        "pubDate string")
    general = spark.createDataFrame([(0, "T", "https://m.x.net/3", "body", None)],
                                    "position int, title string, url string, content string, "
                                    "published_date string")
    blog = spark.createDataFrame([(0, "B", "https://me.tistory.com/4", "d")],
                                 "position int, title string, link string, description string")
    rows = [tuple(r) for r in read_web_results(news, "news").orderBy("position").collect()]
    assert rows == [(0, "제목", "http://o.example.org/1", "a < b", "ORG", "2024-01-01"),
                    (1, "t", "http://www.hani.co.kr/2", "", "HANI", "정보 없음")]
    stacked = union_sources(read_web_results(general, "news"), read_web_results(blog, "blog"))
    found = {(r.source_order, r.source, r.snippet, r.published) for r in stacked.collect()}
    assert found == {(0, "X", "body", "정보 없음"), (1, "TISTORY", "d", "정보 없음")}


def test_reports_are_replaced_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "report")
    evaluation.write_report(spark.range(5), path)
    evaluation.write_report(spark.range(3), path)
    assert spark.read.schema("id long").json(path).count() == 3


def test_published_date_of_a_provider_is_kept(spark):
    df = spark.createDataFrame([("T", "u", "c", "2024-05-06")],
                               "title string, url string, content string, published_date string")
    assert read_web_results(df, "news").first().published == "2024-05-06"


def test_scratch_is_shared_or_local_only(spark, tmp_path):
    from lexframe import session

    path = session.scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    before, session._made[:] = list(session._made), [path]
    assert session.clear_scratch(spark) == 1 and session._made == []
    session._made[:] = [p for p in before if p != path]

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default: None)

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                @staticmethod
                def sc():
                    class Context:
                        @staticmethod
                        def getCheckpointDir():
                            class Nothing:
                                isDefined = staticmethod(lambda: False)
                            return Nothing
                    return Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_root(Cluster)
