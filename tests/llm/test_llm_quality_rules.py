import re

from compare import difference, duck, duck_rows, spark_rows
from lexframe.llm import quality_rules as q
from lexframe.llm.queries import ORACLES, QUERIES


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    again = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else set(windows)
    covered = {i + k for i, w in enumerate(windows) if w in again for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(covered))


def test_measures_against_brute_force(spark, odd_docs):
    more = ["a b c a b c", "x x x x", "a b c d a b c\nq\n\nq\n q", "#1 *2 |", "\x0ba\x1cb c", "a b", "a b c a b"]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame([(50 + k, t) for k, t in enumerate(more)], "doc_id bigint, text string"))
    for r in q.measure(docs).collect():
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        if r["doc_id"] == 5:
            assert got[0] == 24001 and got[4] == 24000
        else:
            assert got == brute(r["text"]), r["text"]


def test_sql(spark, sf_dir):
    name = "op4_quality_rules"
    assert difference(spark_rows(QUERIES[name](spark, sf_dir)), duck_rows(duck(sf_dir), ORACLES[name])) is None


def test_policies_and_ablations_read_the_ledger(spark, odd_docs, no_docs):
    table = q.ledger(odd_docs)
    assert table.columns.count("n_words") == 1
    judged = q.apply_policy(table).collect()
    assert len(judged) == 9 and all(r["base_failed"] == bool(r["failures"] & 3) for r in judged)
    mask = q.POLICIES["2"].mask()
    assert all(r["kept"] == (r["failures"] & (mask | 3) == 0) for r in judged)
    rows = {r["rule"]: r for r in q.ablations(table).collect()}
    assert rows["few_words"]["rejected"] == sum(bool(r["failures"] & 1) for r in judged)
    assert rows["few_words"]["kept_without"] == sum(r["failures"] & mask & ~1 == 0 for r in judged)
    assert q.apply_policy(q.ledger(no_docs)).count() == 0


def test_native_and_not_repeated_by_filters(odd_docs):
    plan = q.apply_policy(q.ledger(odd_docs)).where("kept")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert plan.split("Generate")[0].count("xxhash64") == 0
