import hashlib

import numpy as np

from lexframe.llm import vector_codes as codes


def brute(rows, parts=8, entries=16, rounds=6):
    """The definition in plain Python: rows of (vec_id, vector, label), all usable, ids distinct."""
    whole = {i: [int(np.floor(4096 * float(x))) for x in v] for i, v, _ in rows}
    width = len(next(iter(whole.values()))) // parts
    part = {i: [q[p * width:(p + 1) * width] for p in range(parts)] for i, q in whole.items()}
    first = sorted(whole)[:entries]
    books = [[part[i][p] for i in first] for p in range(parts)]

    def assign(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, entry)), e) for e, entry in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            near = {i: assign(part[i][p], books[p])[1] for i in part}
            for e in range(len(first)):
                own = [part[i][p] for i in part if near[i] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    found = {i: [assign(part[i][p], books[p]) for p in range(parts)] for i in part}
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    error = {i: sum(d for d, _ in f) for i, f in found.items()}
    label = {i: x for i, _, x in rows}
    return {
        (i, "".join(f"{e:02x}" for _, e in f), error[i], sum(error[j] for j in error if label[j] == label[i]), digest)
        for i, f in found.items()
    }


def test_tree_finds_the_nearest_entry_and_the_lower_of_equals():
    rng = np.random.default_rng(1)
    for spread in (3, 40, 4000):
        entries = rng.integers(-spread, spread, (16, 8))
        entries[7], entries[11] = entries[3], entries[3]
        rows = np.concatenate([rng.integers(-spread, spread, (500, 8)), entries])
        index, far = codes.nearest(rows, entries)
        apart = ((rows[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (index == apart.argmin(axis=1)).all() and (far == apart.min(axis=1)).all()


def test_tree_skips_subtrees():
    rng = np.random.default_rng(2)
    centres = rng.integers(-4000, 4000, (4, 8))
    entries = np.concatenate([c + rng.integers(-50, 50, (4, 8)) for c in centres])
    rows = entries[rng.integers(0, 16, 1000)] + rng.integers(-20, 20, (1000, 8))
    best, index = np.full(1000, codes._MOST), np.full(1000, 16)
    done = codes.Gnat(entries).search(rows, np.arange(1000), best, index)
    assert done < 1000 * 16 / 2
    assert (index == ((rows[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)).all()


def test_against_the_definition(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.normal(size=16).round(2).tolist(), [None, 1, 2][i % 3]) for i in rng.permutation(90)]
    rows += [(200 + i, rows[0][1], 1) for i in range(30)]  # copies
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(5)
    assert {tuple(r) for r in codes.compress(df).collect()} == brute(rows)


def test_few_vectors_and_great_components(spark):
    rows = [(3, [1e30] * 8 + [0.0] * 8, 1), (1, [-1e9, 2.0] * 8, None), (2, [0.0] * 16, None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in codes.compress(df).collect()}
    assert sorted(got) == [1, 2, 3] and {r["error"] for r in got.values()} == {0}
    assert got[1]["code"] == "00" * 8 and got[2]["code"] == "01" * 8 and got[3]["code"][:8] == "02" * 4


def test_decoded(spark, sf_dir):
    whole = codes.quantise(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", "label")
    books = codes.learn_codebooks(whole)
    row = codes.decode(codes.encode(whole, books), books).orderBy("vec_id").first()
    want = np.concatenate([books[p][int(row["code"][2 * p:2 * p + 2], 16)] for p in range(8)]) / 4096
    assert row["decoded"] == want.tolist()


def test_odd_rows(spark):
    nan = float("nan")
    rows = [
        (1, [0.5] * 10, "a", "x"), (1, [0.5] * 10, "a", "x"), (None, [0.25] * 10, None, None), (2, None, "a", "x"),
        (3, [], "a", "x"), (4, [nan] * 10, "a", "x"), (5, [None] + [1.0] * 9, "a", "x"), (6, [1.0], "b", "x"),
        (7, [float("inf")] * 10, "b", "x"),
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label string, code string")
    got = codes.compress(df).collect()
    assert sorted(str(r["vec_id"]) for r in got) == ["1", "1", "None"]
    assert got[0].__fields__ == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert codes.compress(df.limit(0)).count() == 0
