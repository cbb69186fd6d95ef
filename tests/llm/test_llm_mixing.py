from compare import difference, duck, duck_rows, spark_rows
from lexframe.llm import mixing as m
from lexframe.llm.queries import ORACLES, QUERIES
from pyspark.sql import functions as F


def test_sql(spark, sf_dir):
    name = "op8_source_mixing"
    assert difference(spark_rows(QUERIES[name](spark, sf_dir)), duck_rows(duck(sf_dir), ORACLES[name])) is None


def test_shares_near_targets_and_bounds(spark):
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") < 40, F.lit("a")).when(F.col("id") % 7 == 0, F.lit(None))
        .otherwise(F.concat(F.lit("s"), F.col("id") % 4)).alias("source"),
        F.repeat(F.lit("w "), (F.col("id") % 50).cast("int")).alias("text"),
    )
    rows = m.mix_sizes(docs).join(docs.select("doc_id", "source"), "doc_id")
    by = rows.groupBy("source").agg(F.first("source_size"), F.first("target"), F.sum("taken"), F.sum("size")).collect()
    assert abs(sum(r[2] for r in by) - sum(r[4] for r in by)) < 1e-6 * sum(r[4] for r in by)
    for _, size, target, taken, total in by:
        assert size == total and target <= 3 * size + 1e-6 and abs(taken - target) <= 50
    assert rows.where("taken > 3 * size").count() == 0
    again = m.mix_sizes(docs.repartition(7))
    assert spark_rows(m.mix_sizes(docs)) == spark_rows(again)


def test_capped_sources_reshare(spark):
    rows = [("a", 1), ("b", 1000), ("c", 1000)]
    got = {r["source"]: r["target"] for r in m.source_targets(spark.createDataFrame(rows, "source string, size bigint")).collect()}
    assert got["a"] == 3 and abs(got["b"] - 1998 * 2 / 3) < 1e-9 and abs(got["c"] - 1998 / 3) < 1e-9


def test_odd_rows(spark, odd_docs, no_docs):
    out = m.mix_sizes(odd_docs).collect()
    assert len(out) == 9 and all(0 <= r["taken"] <= 3 * r["size"] for r in out)
    assert m.mix_sizes(no_docs).count() == 0
    taken = m.take_mix(odd_docs.withColumn("size", F.lit("x")))
    assert taken.columns[-3:] == ["size", "times", "taken"] and taken.where("taken <= 0 and size > 0").count() == 0
