from compare import difference, duck, duck_rows, spark_rows
from lexframe.llm import decontaminate as d
from lexframe.llm.queries import ORACLES, QUERIES


def test_sql(spark, sf_dir):
    name = "op7_decontamination"
    assert difference(spark_rows(QUERIES[name](spark, sf_dir)), duck_rows(duck(sf_dir), ORACLES[name])) is None


ITEMS = [
    (1, "One two three four five six seven eight nine ten eleven"), (2, "greek λόγος"), (3, ""), (4, None),
    (None, "twelve"), (10, "ten ELEVEN"), (1, "one two three four five six seven eight nine ten eleven"),
]


def found(spark, docs, **options):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    return d.find_items(docs, items, **options)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = found(spark, odd_docs).collect()
    assert len(rows) == 9
    for r in rows:
        first = (r["text"] or "").lower().startswith("one two")
        assert r["item_ids"] == (["1", "10"] if first else []) and r["n_hit"] == (12 if first else 0)
        assert r["contaminated"] == first
        if first:
            assert [r["text"][s["start"]:s["end"]] for s in r["spans"]] == [r["text"][:-1]]
    assert found(spark, no_docs).count() == 0
    nothing = spark.createDataFrame([], "item_id bigint, text string")
    assert d.find_items(odd_docs, nothing).where("contaminated").count() == 0


def test_blocks_agree_with_one_automaton(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(
        [(90, "ä greek, Λόγος greek λόγος; ten eleven nine ten eleven twelve")], "doc_id bigint, text string"))
    assert spark_rows(found(spark, docs)) == spark_rows(found(spark, docs, block_bytes=20).select(found(spark, docs).columns))


def test_offsets_are_code_points(spark):
    docs = spark.createDataFrame([(1, "ßß é🙂 Greek—λόγος!")], "doc_id bigint, text string")
    (row,) = found(spark, docs).collect()
    assert [row["text"][s["start"]:s["end"]] for s in row["spans"]] == ["Greek—λόγος"] or row["n_hit"] == 0


def test_contaminated_documents_go(spark, odd_docs):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    kept = d.drop_contaminated(odd_docs, items)
    assert kept.columns == odd_docs.columns and kept.count() == 6
