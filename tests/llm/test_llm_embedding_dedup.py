import numpy as np

from lexframe.llm import embedding_dedup as dedup

DDL = "vec_id bigint, embedding array<float>, label int"


def usable(v):
    return v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)


def brute(rows, threshold=dedup.THRESHOLD):
    """{position: (vec_id, links, smallest id reachable)} of rows (vec_id, vector, label)."""
    near = {i: [] for i in range(len(rows))}
    by = {}
    for i, (_, v, label) in enumerate(rows):
        if label is not None and usable(v):
            by.setdefault((label, len(v)), []).append(i)
    for at in by.values():
        x = np.array([np.array(rows[i][1], np.float32) for i in at], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        met = x @ x.T >= threshold
        np.fill_diagonal(met, False)
        for k, i in enumerate(at):
            near[i] = [at[j] for j in np.flatnonzero(met[k])]
    out, seen = {}, {}
    for i in near:
        if i not in seen:
            stack, members = [i], {i}
            while stack:
                for j in near[stack.pop()]:
                    if j not in members:
                        members.add(j)
                        stack.append(j)
            least = min(rows[j][0] for j in members)
            seen |= dict.fromkeys(members, least)
        out[i] = (rows[i][0], len(near[i]), seen[i])
    return sorted(out.values())


def around(rng, centre, n, noise):
    """``n`` vectors about ``noise`` radians from a centre."""
    off = rng.normal(size=(n, len(centre)))
    off -= (off @ centre)[:, None] * centre
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    return np.cos(noise) * centre + np.sin(noise) * off


def unit(rng, d=64):
    x = rng.normal(size=d)
    return x / np.linalg.norm(x)


def found(df, **options):
    return sorted(tuple(r)[:3] for r in dedup.near_duplicates(df, **options).collect())


def table(spark, rows, parts=6):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], label) for i, v, label in rows], DDL).repartition(parts)


def test_groups_of_all_sizes_against_brute_force(spark):
    rng = np.random.default_rng(4)
    vectors = [unit(rng) for _ in range(400)]
    for size, noise in ((2, 0.1), (5, 0.2), (40, 0.24), (300, 0.1), (300, 0.22), (250, 0.262)):
        vectors += list(around(rng, unit(rng), size, noise) * rng.uniform(0.5, 3, (size, 1)))
    vectors += [vectors[3]] * 30 + [vectors[700]] * 9  # copies
    rows = [(int(i), v, int(k % 2) if k < 400 else 1) for k, (i, v) in enumerate(zip(rng.permutation(5000), vectors))]
    want = brute(rows)
    assert max(r[1] for r in want) > 290
    df = table(spark, rows)
    assert found(df, block=32) == want
    out = dedup.near_duplicates(df).collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)


def test_chains_and_wide_classes(spark):
    rng = np.random.default_rng(5)
    a, b = unit(rng), unit(rng)
    b = b - (a @ b) * a
    b /= np.linalg.norm(b)
    chain = [np.cos(t) * a + np.sin(t) * b for t in np.arange(0, 3, 0.005)]
    rows = [(i, v, 7) for i, v in enumerate(chain)]
    assert found(table(spark, rows), block=16) == brute(rows)


def test_recall_of_pairs_at_the_threshold(spark):
    rng = np.random.default_rng(6)
    vectors = []
    for _ in range(1500):
        x = unit(rng)
        vectors += [x, around(rng, x, 1, np.arccos(0.931))[0]]
    rows = [(i, v, 1) for i, v in enumerate(vectors)]
    want, got = brute(rows), found(table(spark, rows))
    assert sum(r[1] for r in got) >= 0.9 * sum(r[1] for r in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want))


def test_windows_cross_small_partitions(spark):
    rng = np.random.default_rng(7)
    rows = [(i, v, 1) for i, v in enumerate(around(rng, unit(rng), 90, 0.2))]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        assert found(table(spark, rows), passes=1) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_passes_grow_slowly():
    few, many = (dedup.plan_passes(n, 64, 0.93, 64, 0.95) for n in (1000, 10_000_000))
    assert 1 < few < many < 20


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1, 5), (2, [2.0, 0.01], 1, 5), (2, [2.0, 0.01], 1, None), (3, None, 1, 5), (4, [], 1, 5), (5, [0.0, 0.0], 1, 5),
        (6, [nan, 1.0], 1, 5), (7, [inf, 1.0], 1, 5), (8, [None, 1.0], 1, 5), (9, [1.0, 0.0], None, 5), (10, [1.0, 0.0], 2, 5),
        (11, [1.0, 0.0, 0.0], 1, 5), (None, [3.0, 0.0], 1, 5), (None, [0.0, 9.0], 1, 5), (12, [-0.0, 5.0], 3, 5), (13, [0.0, 5.0], 3, 5),
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, n_links int")
    got = sorted((tuple(r) for r in dedup.near_duplicates(df).collect()), key=repr)
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)]
    assert got == sorted(alone + [
        (1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (None, 3, 1, False), (None, 0, None, True), (12, 1, 12, True), (13, 1, 12, False),
    ], key=repr)
    assert dedup.near_duplicates(df.limit(0)).count() == 0
    assert dedup.near_duplicates(df.where("vec_id = 3")).count() == 1
