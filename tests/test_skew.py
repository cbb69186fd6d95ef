"""One key holding a third of the rows or more: results stay whole."""

from pyspark.sql import functions as F

from lexframe.operators import conversations, corpus, keyed, lookup, retrieval_eval


def test_hot_article_is_answered_for_every_request(spark):
    articles = spark.createDataFrame([("법", "1", "법", "본문", None), ("법", "2", "법", "둘", None)],
                                     "law_name_norm string, article_number_norm string, "
                                     "law_name string, text string, enforcement_date date")
    asked = spark.range(6000).select(
        F.col("id").alias("question_id"), F.lit("법").alias("name"),
        F.when(F.col("id") % 3 < 2, "제1조").otherwise(F.col("id").cast("string")).alias("article"))
    found = lookup.exact_lookup(asked, articles).groupBy("status").count().collect()
    expected_hits = 4000 + sum(1 for i in range(6000) if i % 3 == 2 and str(i) in ("1", "2"))
    assert {r.status: r["count"] for r in found} == {
        "found": expected_hits, "not_found": 6000 - expected_hits}


def test_hot_session_and_law(spark):
    rows = spark.range(9000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("session_id"),
        F.col("id").alias("turn_index"))
    gone = spark.createDataFrame([("hot",)], "session_id string")
    assert conversations.delete_sessions(rows, gone).count() == 3000
    current = rows.select(F.col("session_id").alias("law_name_norm"),
                          F.col("turn_index").cast("string").alias("article_number_norm"))
    incoming = current.where("law_name_norm = 'hot' AND article_number_norm % 2 = 0")
    assert corpus.stale_articles(current, incoming).count() == 3000
    assert corpus.remove_stale(current, incoming).count() == 6000


def test_groups_are_cut_before_the_shuffle(spark):
    turns = spark.range(100).select((F.col("id") % 2).alias("k"), "id")
    plan = keyed.top_per_group(turns, "k", F.desc("id"), 3)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_increments_merge(spark):
    schema = ("chunk_id string, law_name string, law_name_norm string, article_number string, "
              "article_number_norm string, text string, enforcement_date date")
    target = spark.createDataFrame(
        [(f"c{i}", "법", None if i == 3 else "법", "제", str(i), f"옛{i}", None) for i in range(50)],
        schema).withColumns({"created_at": F.lit(1), "updated_at": F.lit(1)})
    incoming = spark.createDataFrame(
        [(f"n{i}", "새", "법", "제", str(i), f"새{i}", None) for i in (1, 3, 9, 9)],
        schema).withColumn("position", F.monotonically_increasing_id())
    merged = corpus.merge_articles(target, incoming, F.lit(2)).collect()
    # the stored article 3 has no law, so the incoming one is new
    assert len(merged) == 51
    assert sorted(r.text for r in merged if r.updated_at == 2) == ["새1", "새3", "새9"]
    stale = corpus.flag_stale(target, incoming).where("stale")
    assert {int(r.article_number_norm) for r in stale.collect()} == {0, 2, *range(4, 50)} - {9}


def test_every_request_has_a_row(spark):
    articles = spark.range(500).select(
        F.lit("법").alias("law_name_norm"), F.col("id").cast("string").alias("article_number_norm"),
        F.lit("법").alias("law_name"), F.concat(F.lit("t"), "id").alias("text"),
        F.lit(None).cast("date").alias("enforcement_date"))
    asked = spark.range(490, 510).select(F.col("id").alias("question_id"), F.lit("법").alias("name"),
                                       F.col("id").cast("string").alias("article"))
    odd = spark.createDataFrame([(1, None, "1"), (2, "법", " "), (3, "", None)],
                                "question_id long, name string, article string")
    status = {r.question_id: r.status for r in lookup.exact_lookup(asked.unionByName(odd), articles).collect()}
    assert len(status) == 23 and [status[i] for i in (1, 2, 3, 490, 509)] == [
        "invalid", "invalid", "invalid", "found", "not_found"]


def test_cases_without_results_are_misses(spark):
    golden = spark.createDataFrame([(1, "법1제1조"), (2, "법1제2조")], "case_id int, label string")
    results = spark.createDataFrame([(1, 1, "법1제1조", 0.9)], "case_id int, rank int, label string, score double")
    flags = {(r.case_id, r.k): r.topk_hit for r in retrieval_eval.hit_flags(results, golden, (3,)).collect()}
    assert flags == {(1, 3): True, (2, 3): False}
