from collections import Counter

import corpus_pipeline
import numpy as np

from lexframe.llm import language_id as l
from lexframe.llm.common import held_out
from pyspark.sql import functions as F


def test_held_out_languages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = l.identify(docs, l.learn(docs)).where(held_out(F.col("doc_id"))).select("lang", "lang_pred", "score").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_decisions_against_exact_sets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    rows = l.identify(docs.withColumn("out", held_out(F.col("doc_id"))), l.learn(docs)).collect()
    counts = {}
    for r in rows:
        if r["lang"] is not None and not r["out"] and r["text"]:
            plain = l.letters(r["text"].encode())
            counts.setdefault(r["lang"], Counter()).update(plain[k:k + 3] for k in range(len(plain) - 2))
    held, reach = {}, {}
    for lang, c in counts.items():
        least = max(1, c.total() * l.MIN_SHARE)
        held[lang] = {g for g, n in c.items() if n >= least}
        reach[lang] = max(l.MIN_REACH, sum(n for n in c.values() if n - 1 >= least) / c.total())
    for r in rows:
        plain = l.letters((r["text"] or "").encode())
        grams = [plain[k:k + 3] for k in range(len(plain) - 2)]
        if not grams:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        shares = {lang: sum(g in own for g in grams) / len(grams) / reach[lang] for lang, own in held.items()}
        top = max(shares.values())
        assert shares[r["lang_pred"]] > top - 0.02 and abs(r["score"] - min(1.0, top)) < 0.02


def test_a_script_of_thousands_of_characters_survives(spark):
    rng = np.random.default_rng(5)
    words = rng.integers(0x4E00, 0x4E00 + 3000, (5000, 2))
    common = 1 / np.arange(1, 5001)

    def text(lang):
        if lang == "zz":
            return "".join(map(chr, words[rng.choice(5000, 300, p=common / common.sum())].ravel()))
        return " ".join("".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 8))) for _ in range(80))

    docs = spark.createDataFrame(
        [(k, t, t, "s", 1) for k in range(400) for t in ["zz" if k % 2 else "aa"]],
        "doc_id bigint, text string, lang string, source string, n_chars bigint")
    texts = {r["doc_id"]: text(r["lang"]) for r in docs.collect()}
    docs = spark.createDataFrame(
        [(r["doc_id"], texts[r["doc_id"]], r["lang"], "s", 1) for r in docs.collect()], docs.schema)
    noise = spark.createDataFrame([(900, "ღმერთსა შემვედრე ნუთუ კვლა", None, "s", 1)], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.keep_languages(spark, docs.unionByName(noise), "").collect()}
    assert kept == set(range(400))
    model = l.learn(docs)
    assert model.reach[1] < 0.6 < model.reach[0]
    rows = l.identify(docs, model).where(held_out(F.col("doc_id"))).collect()
    assert all(r["lang"] == r["lang_pred"] for r in rows) and np.mean([r["score"] for r in rows if r["lang"] == "zz"]) > 0.9


def test_held_out_texts_teach_nothing(spark):
    docs = spark.range(300).select(
        F.col("id").alias("doc_id"), F.when(held_out(F.col("id")), "zz").otherwise("aa").alias("lang"), F.lit("abc abd").alias("text"))
    assert l.learn(docs).languages == ["aa"]


def test_masks_hold_every_language_of_a_trigram():
    rng = np.random.default_rng(0)
    sets = {f"l{k:02d}": set(rng.integers(0, 1 << 62, 300).tolist()) for k in range(70)}
    shared = set(list(sets["l00"])[:50])
    sets["l69"] |= shared
    model = l.build_filter([(k, g, 1) for k, v in sets.items() for g in v], {k: 300 for k in sets})
    masks = model.masks(np.array(sorted(shared), np.int64).view(np.uint64))
    assert (masks[:, 0] & np.uint64(1)).all() and (masks[:, 1] & np.uint64(1 << 5)).all()
    others = model.masks(rng.integers(0, 1 << 62, 200_000).astype(np.uint64))
    for k in (0, 30, 69):
        rate = np.count_nonzero(others[:, k >> 6] & np.uint64(1 << (k & 63))) / 200_000
        assert abs(rate - model.false_positive[k]) < 3e-4


def test_pieces_of_a_long_text_are_all_its_trigrams(monkeypatch):
    text = l.letters("Abc déf, ghi " .encode() * 50)
    whole = np.concatenate(list(l.trigrams(text)))
    monkeypatch.setattr(l, "_PIECE", 7)
    assert (np.concatenate(list(l.trigrams(text))) == whole).all() and len(whole) == len(text) - 2


def test_what_is_a_letter():
    assert l.letters("² ½ ٣ _ 12 ́".encode()) == "" and l.letters("1a²".encode()).strip()[0] == "a"
    assert l.letters("ß".encode()) == " ß " and l.letters(None) == l.letters(b"") == ""


def test_odd_rows(spark, odd_docs, no_docs):
    model = l.learn(odd_docs)
    rows = l.identify(odd_docs, model).collect()
    assert len(rows) == 9 and l.identify(no_docs, model).count() == 0
    for r in rows:
        assert (r["lang_pred"] == "und") == (r["doc_id"] in (2, 3, 4, 7))
        assert r["lang_pred"] in ("und", *model.languages)
    nothing = l.learn(no_docs)
    assert {r["lang_pred"] for r in l.identify(odd_docs, nothing).collect()} == {"und"}
