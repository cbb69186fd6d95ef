import random
import re

import numpy as np
import xxhash

from lexframe.llm import simhash as s
from pyspark.sql import functions as F


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in prints:
        for b in prints:
            if a < b and (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    return {p: find(p) for p in prints}


def check(rows):
    prints = {r["fp"] for r in rows}
    root = brute_classes(prints)
    least = {}
    for r in rows:
        key = root[r["fp"]]
        least[key] = min([x for x in (least.get(key), r["doc_id"]) if x is not None], default=None)
    for r in rows:
        assert r["component_id"] == least[root[r["fp"]]]


def test_documents_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = [r.asDict() for r in s.near_duplicates(docs).collect()]
    assert len(rows) == len(texts)
    for r in rows:
        r["fp"] = int(r["fingerprint"], 16)
        if r["doc_id"] % 5 == 0:
            assert r["fp"] == brute_print(texts[r["doc_id"]])
    check(rows)


def test_first_hash_is_sparks(spark):
    (row,) = spark.createDataFrame([("a b c",)], "t string").select(F.xxhash64("t").alias("h")).collect()
    assert s.fingerprint(b"A b\tc") == row["h"]
    assert s.fingerprint(("x y z " * 50_000).encode()) & (1 << 64) - 1 == brute_print("x y z " * 50_000)


def links_of(spark, prints, crowd):
    signed = np.array(sorted(prints), np.uint64).view(np.int64).tolist()
    fps = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    rows = s.fingerprint_classes(fps, crowd).collect()
    mask = (1 << 64) - 1
    got = {}
    for r in rows:
        got.setdefault(r["root"], set()).add(r["fp"] & mask)
    return sorted(map(sorted, got.values()))


def expected(prints):
    got = {}
    for p, r in brute_classes(prints).items():
        got.setdefault(r, set()).add(p)
    return sorted(map(sorted, got.values()))


def test_crowded_variants_lose_no_link(spark):
    rng = random.Random(3)
    prints = set()
    for _ in range(3):
        center = rng.getrandbits(64)
        near = {center}
        while len(near) < 60:
            near.add(rng.choice(sorted(near)) ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(1, 5))}))
        prints |= near
    prints |= {rng.getrandbits(32) << 32 | 77 for _ in range(120)} | {rng.getrandbits(64) for _ in range(50)}
    # one half shared by many, the other halves mostly far apart
    prints |= {(5 << 32) | (9 << 16) | rng.getrandbits(16) for _ in range(60)}
    want = expected(prints)
    assert links_of(spark, prints, 2048) == want
    assert links_of(spark, prints, 3) == want


def test_long_chains_meet(spark):
    path, p = [], 0
    for k in range(60):
        path.append(p)
        p ^= 1 << k
    assert len(links_of(spark, set(path), 2048)) == 1


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [r.asDict() | {"fp": int(r["fingerprint"], 16)} for r in s.near_duplicates(odd_docs).collect()]
    assert len(rows) == 9
    check(rows)
    assert {r["component_id"] for r in rows if r["doc_id"] in (2, 3, 4)} == {2}
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, None)} == {1}
    assert s.near_duplicates(no_docs).count() == 0
    kept = s.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 5, 6, 7]
    assert s.drop_near_duplicates(no_docs).count() == 0
