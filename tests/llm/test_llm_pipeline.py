from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from lexframe.llm import decontaminate
from lexframe.llm.queries import ORACLES, QUERIES
from lexframe.session import pin
from test_llm_near_copies import brute


def test_stages_keep_the_columns_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = pin(stage(spark, docs, sf_dir), name)
        assert out.columns == columns or name == "source_mixing"
        assert out.join(docs, "doc_id", "left_anti").count() == 0
        sizes.append(out.count())
        if name == "near_dedup":
            rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
            assert sorted(r["doc_id"] for r in out.select("doc_id").collect()) == brute(rows)
        if name == "decontamination":
            items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
            assert decontaminate.find_items(out, items).where("contaminated").count() == 0
        docs = out
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    assert docs.where(F.col("taken") != F.col("size") * F.col("times")).count() == 0


def test_stages_on_odd_rows(spark, odd_docs, no_docs, sf_dir):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, sf_dir).count()


def test_registered():
    names = __spark_entry__.queries()
    assert set(QUERIES) | {"pipeline"} <= set(names) and set(ORACLES) <= set(__spark_entry__.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
