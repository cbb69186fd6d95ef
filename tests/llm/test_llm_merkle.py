import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lexframe.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes):
    """(root, siblings of every node from below)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, place in enumerate(at):
            if (other := place ^ 1) < len(level):
                paths[i].append((other & 1, level[other]))
            else:
                paths[i].append((1, ""))
        level, at = [h(*level[k:k + 2]) for k in range(0, len(level), 2)], [p // 2 for p in at]
    return level[0], paths


def brute(rows):
    """Rows of (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for doc_id, source, lang, n_chars, text in rows:
        leaf = h(*map(field, (doc_id, source, lang, n_chars, text)))
        more = n_chars is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        altered = h(*map(field, (doc_id, source, lang, n_chars + 1 if more else n_chars, text)))
        groups.setdefault(lang, []).append(((doc_id is not None, doc_id or 0, leaf), doc_id, leaf, altered))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    below = {}
    for g in names:
        groups[g].sort(key=lambda x: x[0])
        below[g] = tree([x[2] for x in groups[g]])
    root, above = tree([below[g][0] for g in names])
    out = []
    for g, top in zip(names, above):
        for (_, doc_id, leaf, altered), path in zip(groups[g], below[g][1]):
            node = altered
            for right, other in path + top:
                node = h(node, other) if right else h(other, node)
            proof = h(*[other for _, other in path + top])
            out.append((doc_id, leaf, below[g][0], root, proof, node, node == root))
    return out


def manifest(docs, **options):
    altered = {"n_chars": merkle.altered_count(F.col("n_chars"), F.col("doc_id"))}
    return [tuple(r) for r in merkle.manifest(docs, tampered=altered, **options).collect()]


@pytest.mark.parametrize("bits", [1, 3, 8])
def test_against_the_definition(spark, bits):
    rows = [(i * 3, f"s{i % 5}", lang, i * 7, f"text {i} é") for k, lang in enumerate(["en", "de", None, "", "zz"])
            for i in range([70, 33, 9, 2, 1][k])]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").repartition(7)
    got = manifest(docs, bits=bits)
    assert sorted(got) == sorted(brute(rows))
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_one_group_and_one_row(spark):
    ddl = "doc_id bigint, source string, lang string, n_chars bigint, text string"
    for rows in ([(1, "a", "en", 1, "x")], [(1, "a", "en", 1, "x"), (2, "a", "en", 1, "x")], [(i, "a", "en", 1, "x") for i in range(9)]):
        assert sorted(manifest(spark.createDataFrame(rows, ddl), bits=2)) == sorted(brute(rows))


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["source"], r["lang"], None if r["n_words"] is None else r["n_words"], r["text"]) for r in odd_docs.collect()]
    docs = odd_docs.withColumn("n_chars", F.col("n_words")).withColumn("leaf", F.lit(1)).withColumn("tree", F.lit("t"))
    got = manifest(docs)
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr) and len(got) == odd_docs.count()
    assert manifest(no_docs.withColumn("n_chars", F.col("n_words"))) == []


def test_ranks_of_one_group_in_many_partitions(spark):
    nodes = spark.range(5000).select(F.lit("t").alias("tree"), F.col("id"), F.lit("x").alias("node")).repartition(9)
    placed = merkle.place(nodes, "tree", "id")
    assert placed.where("pos <> id or size <> 5000").count() == 0 and placed.count() == 5000
