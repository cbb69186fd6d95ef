import random
import re

import corpus_pipeline
from lexframe.llm import near_copies


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    """Smallest id of every class."""
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and similarity(sets[a], sets[b]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted(i for i in root if root[i] == i)


def copies():
    """Texts of 300 words, each with copies that have 1 to 7 words replaced, chains of copies, and other texts."""
    rng, rows = random.Random(5), []
    for _ in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        rows.append(" ".join(words))
        for edits in (1, 2, 3, 4, 5, 6, 7, 9, 12):
            again = list(words)
            for at in rng.sample(range(0, 300, 6), edits):
                again[at] = f"x{rng.randrange(5000)}"
            rows.append(" ".join(again))
        for _ in range(4):
            words[rng.randrange(300)] = "y"
            words[rng.randrange(300)] = "z"
            rows.append(" ".join(words))
    rng.shuffle(rows)
    return list(enumerate(rows + [rows[3], None, "", " \n", "a b", "A  b", "a b c d e f g"]))


def test_copies_from_080_to_095_against_brute_force(spark):
    rows = copies()
    sets = [shingles(t) for _, t in rows]
    at = [similarity(a, b) for i, a in enumerate(sets) for b in sets[:i]]
    for low in (0.8, 0.85, 0.9, 0.95):
        assert any(low <= s < low + 0.05 for s in at)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = corpus_pipeline.keep_distinct(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == brute(rows)


def family(rng, size, words, edits, base=None):
    """Copies of one text with ``edits`` words replaced each."""
    base = base or [f"w{rng.randrange(9000)}" for _ in range(words)]
    out = []
    for _ in range(size):
        again = list(base)
        for at in rng.sample(range(words), edits if isinstance(edits, int) else rng.choice(edits)):
            again[at] = f"x{rng.randrange(90000)}"
        out.append(" ".join(again))
    return out


def candidates(monkeypatch, docs):
    """(rows kept, candidate pairs of crowded bands)."""
    seen, plain = [], near_copies.crowd_pairs

    def counted(*args):
        proved, more = plain(*args)
        seen.append(more.count())
        return proved, more

    monkeypatch.setattr(near_copies, "crowd_pairs", counted)
    kept = sorted(r["doc_id"] for r in near_copies.drop_near_copies(docs).collect())
    monkeypatch.undo()
    return kept, seen[0]


def test_crowded_bands_against_brute_force(spark, monkeypatch):
    rng = random.Random(12)
    texts = family(rng, 150, 60, 1) + family(rng, 120, 60, [0, 1, 2, 3]) + family(rng, 100, 150, [1, 2, 3, 4])
    base = [f"w{rng.randrange(9000)}" for _ in range(120)]
    for _ in range(5):  # sub-families that share a far ancestor
        mine = family(rng, 1, 120, 6, base)[0].split()
        texts += family(rng, 40, 120, [1, 2], mine)
    # pairs of exactly 0.8: 4 of 40 shingles differ on each side of 36 shared ones
    texts += [" ".join([f"k{i}" for i in range(40)] + [f"e{j}_{i}" for i in range(4)]) for j in range(40)]
    sets = [shingles(t) for t in texts[-40:]]
    assert similarity(sets[0], sets[1]) == 36 / 44 and len(sets[0]) == 40
    rows = list(enumerate(texts + ["u v w x y z " * 9]))
    rng.shuffle(rows)
    monkeypatch.setattr(near_copies, "CROWD", 8)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert candidates(monkeypatch, docs)[0] == brute(rows)


def test_candidates_do_not_grow_with_the_square(spark, monkeypatch):
    made = {}
    for size in (150, 600):
        rows = list(enumerate(family(random.Random(3), size, 40, 1)))
        sets = [shingles(t) for _, t in rows]
        links = sum(similarity(sets[i], sets[j]) >= 0.8 for i in range(size) for j in range(i))
        kept, made[size] = candidates(monkeypatch, spark.createDataFrame(rows, "doc_id bigint, text string"))
        assert kept == brute(rows)
        assert made[size] <= 40 * size + 2 * links


def test_exactly_080(spark):
    base = [f"k{i}" for i in range(40)]  # 36 shingles
    text = lambda n, tail: " ".join(base[:n] + [f"{tail}{i}" for i in range(4)])
    rows = [(1, text(40, "a")), (2, text(40, "b")), (3, " ".join(base[:36])), (4, " ".join(base[:28] + ["z"]))]
    at = {(i, j): similarity(shingles(rows[i][1]), shingles(rows[j][1])) for i in range(4) for j in range(i)}
    assert at[2, 0] == 0.8 and at[3, 2] < 0.8
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in near_copies.drop_near_copies(docs).collect()) == brute(rows)


def test_documents_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    want = brute([tuple(r) for r in docs.collect()])
    assert sorted(r["doc_id"] for r in near_copies.drop_near_copies(docs).collect()) == want


def test_odd_rows(spark, odd_docs, no_docs):
    kept = near_copies.drop_near_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 5, 6, 7]
    assert near_copies.drop_near_copies(no_docs).count() == 0


def test_simhash_links_alone_make_classes(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(2000))
    rows = [(1, text), (2, text + " end"), (3, "start " + text), (4, " ".join(f"v{i}" for i in range(2000))), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    seen = []
    classes = near_copies.simhash.fingerprint_classes
    monkeypatch.setattr(near_copies.simhash, "fingerprint_classes", lambda fps: seen.append(classes(fps)) or seen[-1])
    kept = sorted(r["doc_id"] for r in near_copies.drop_near_copies(docs).collect())
    assert kept == brute(rows) == [1, 4, 5]
    assert len(seen) == 1 and seen[0].select("root").distinct().count() < seen[0].count()
