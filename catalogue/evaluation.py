"""Verdicts, response checks, retests, scenarios, runs and case sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexframe import rules
from lexframe.functions import coerce_verdict
from lexframe.operators import checks, runs
from lexframe.operators.lookup import join_case_responses
from lexframe.plans.acceptance import acceptance_gate as gate
from lexframe.session import scratch_path
from lexframe.sources import evaluation as files

from .common import EVENT_TURNS_SQL, LABELLED_SQL, event_turns, labelled, load, sql_contains_any
from .registry import registry

QUERIES, ORACLES, query = registry()


def _replies(spark, sf_dir):
    """Judge replies made from the labels; toxic documents get a broken or unknown reply."""
    toxic, good = F.col("toxic") == 1, F.col("quality") == 1
    reply = (
        F.when(toxic & good, "not json").when(toxic, '{"verdict": "MAYBE"}')
        .when(good & (F.col("n_chars") > 1000), '{"verdict": "PARTIAL"}')
        .when(good, '{"verdict": "GROUNDED"}').otherwise('{"verdict": "HALLUCINATION"}')
    )
    return labelled(spark, sf_dir).select("doc_id", "lang", "source", "n_chars", "quality", "toxic",
                                          "text", reply.alias("reply"))


_REPLIES_SQL = f"""{LABELLED_SQL}, replies AS (
  SELECT *, CASE WHEN toxic = 1 AND quality = 1 THEN NULL WHEN toxic = 1 THEN 'MAYBE'
    WHEN quality = 1 AND n_chars > 1000 THEN 'PARTIAL' WHEN quality = 1 THEN 'GROUNDED'
    ELSE 'HALLUCINATION' END AS said FROM labelled)"""


@query(f"""WITH {_REPLIES_SQL}, judged AS (
  SELECT coalesce(said, 'ERROR') AS verdict, lang = 'fr' AS miss FROM replies)
SELECT count(*) AS total, count(*) FILTER (WHERE verdict = 'GROUNDED') AS grounded,
  count(*) FILTER (WHERE verdict = 'PARTIAL') AS partial,
  count(*) FILTER (WHERE verdict = 'HALLUCINATION') AS hallucination,
  count(*) FILTER (WHERE verdict = 'ERROR') AS errors,
  count(*) FILTER (WHERE verdict <> 'ERROR') AS valid,
  round_even(count(*) FILTER (WHERE verdict = 'HALLUCINATION')
    / greatest(count(*) FILTER (WHERE verdict <> 'ERROR'), 1), 4) AS hallucination_rate,
  round_even(count(*) FILTER (WHERE verdict IN ('GROUNDED', 'PARTIAL'))
    / greatest(count(*) FILTER (WHERE verdict <> 'ERROR'), 1), 4) AS safe_rate,
  count(*) FILTER (WHERE miss) AS citation_misses FROM judged""")
def verdict_rollup(spark, sf_dir):
    verdicts = _replies(spark, sf_dir).select(
        coerce_verdict(F.col("reply"), offline=True).alias("verdict"),
        F.when(F.col("lang") == "fr", "CITATION_MISS").otherwise("OK").alias("citation_verdict"),
    )
    return runs.verdict_rollup(verdicts)


@query(f"""WITH {_REPLIES_SQL}, attempts AS (
  SELECT doc_id, lang, said, 1 AS attempt FROM replies UNION ALL
  SELECT doc_id, lang, said, 2 FROM replies WHERE said = 'HALLUCINATION' AND lang <> 'es'),
graded AS (SELECT doc_id, attempt, CASE
  WHEN coalesce(said, '') <> 'HALLUCINATION' AND lang = 'de' THEN 'websearch_fallback'
  WHEN coalesce(said, '') <> 'HALLUCINATION' THEN 'end' WHEN attempt < 2 THEN 'retrieve'
  ELSE 'websearch_fallback' END AS action FROM attempts),
last AS (SELECT doc_id AS question_id, arg_max(action, attempt) AS action,
  CAST(max(attempt) AS INTEGER) AS retry_count FROM graded GROUP BY doc_id)
SELECT *, CASE action WHEN 'websearch_fallback' THEN 'websearch_tool' ELSE 'law_rag_tool' END
  AS final_tool FROM last""")
def acceptance_gate(spark, sf_dir):
    replies = _replies(spark, sf_dir)
    hallucinated = coerce_verdict(F.col("reply")) == "HALLUCINATION"
    tries = F.when(hallucinated & (F.col("lang") != "es"), F.array(F.lit(1), F.lit(2)))
    relevance = F.when(F.col("lang") == "de", '{"verdict": "NOT_RELEVANT"}').otherwise(
        '{"verdict": "RELEVANT"}')
    attempts = replies.select(
        F.col("doc_id").alias("question_id"), F.col("reply").alias("grounding_reply"),
        relevance.alias("relevance_reply"),
        F.explode(F.coalesce(tries, F.array(F.lit(1)))).alias("attempt"),
    )
    return gate(attempts)


_BEHAVIOURS = ["not_exist", "refuse", "conditional_answer", "no_without_condition",
               "ask_for_law_name", "scope_explanation", "condition_explanation", "unheard_of"]
_SNIPPETS = ["", " 해당 조문은 존재하지 않습니다", " 조건에 해당하는 경우에만", " 어떤 법인지 알 수 없습니다"]


def _cases(spark, sf_dir):
    """One case per document: words of its source and language, a source, an article, a kind of
    answer, each asked for only where the document's number says so."""
    number = F.col("doc_id")
    behaviour = F.element_at(F.array(*[F.lit(b) for b in _BEHAVIOURS]),
                             F.pmod(number, F.lit(len(_BEHAVIOURS))).cast("int") + 1)
    return load(spark, sf_dir, "documents").select(
        number.alias("case_id"), F.col("lang").alias("type"),
        F.when(number % 3 == 0, F.array(F.lit("the"), F.lit("a"))).alias("must_contain"),
        F.when(number % 4 == 0, F.when(number % 8 == 0, "web").otherwise("pg")).alias(
            "expected_source"),
        F.when(number % 5 == 0, F.array(F.lit("제26조"), F.concat(F.lit("제"), number % 25,
                                                                F.lit("조")))).alias(
            "expected_article"),
        F.when(number % 2 == 0, behaviour).alias("expected_behaviour"),
    )


def _responses(spark, sf_dir):
    number = F.col("doc_id")
    snippet = F.element_at(F.array(*[F.lit(s) for s in _SNIPPETS]),
                           F.pmod(number, F.lit(len(_SNIPPETS))).cast("int") + 1)
    return load(spark, sf_dir, "documents").select(
        number.alias("case_id"),
        F.concat("text", F.lit(" 제"), number % 50, F.lit("조"), snippet).alias("response_text"),
        F.when(number % 3 == 0, "web").otherwise("pg").alias("response_source"),
    )


_BEHAVIOUR_SQL = " ".join(
    f"WHEN '{name}' THEN {sql_contains_any('response_text', words)}"
    for name, words in rules.BEHAVIOURS.items()
)
_CHECKED_SQL = f"""WITH cases AS (
  SELECT doc_id AS case_id, lang AS type, doc_id % 3 = 0 AS has_words,
    CASE WHEN doc_id % 8 = 0 THEN 'web' WHEN doc_id % 4 = 0 THEN 'pg' END AS expected_source,
    doc_id % 5 = 0 AS has_article, '제' || (doc_id % 25) || '조' AS article,
    CASE WHEN doc_id % 2 = 0 THEN list_extract([{", ".join(f"'{b}'" for b in _BEHAVIOURS)}],
      doc_id % {len(_BEHAVIOURS)} + 1) END AS behaviour,
    text || ' 제' || (doc_id % 50) || '조' || list_extract([{", ".join(f"'{s}'" for s in
      _SNIPPETS)}], doc_id % {len(_SNIPPETS)} + 1) AS response_text,
    CASE WHEN doc_id % 3 = 0 THEN 'web' ELSE 'pg' END AS response_source FROM documents),
tested AS (SELECT *, list_filter([
    CASE WHEN has_words AND NOT (contains(response_text, 'the') AND contains(response_text, 'a'))
      THEN 'must_contain' END,
    CASE WHEN expected_source IS NOT NULL AND response_source <> expected_source
      THEN 'expected_source' END,
    CASE WHEN has_article AND NOT (contains(response_text, '제26조')
      OR contains(response_text, article)) THEN 'expected_article' END,
    CASE WHEN behaviour IS NOT NULL AND NOT coalesce(CASE behaviour {_BEHAVIOUR_SQL}
      WHEN 'scope_explanation' THEN length(response_text) > 80 END, false)
      THEN 'behavior:' || behaviour END], lambda c: c IS NOT NULL) AS failed_checks FROM cases),
checked AS (SELECT *, len(failed_checks) = 0 AS passed, CASE WHEN len(failed_checks) = 0 THEN NULL
    WHEN list_contains(failed_checks, 'expected_source')
      AND (expected_source = 'web' OR response_source = 'web') THEN 'fallback_error'
    WHEN list_contains(failed_checks, 'behavior:not_exist') THEN 'hallucination'
    WHEN list_contains(failed_checks, 'expected_article') THEN 'wrong_law_selection'
    WHEN list_has_any(failed_checks, [{", ".join(f"'behavior:{b}'" for b in
      rules.CONDITIONAL_BEHAVIOURS)}]) THEN 'intent_error' ELSE 'output_error' END AS failure_class
  FROM tested)"""


def _checked(spark, sf_dir):
    joined = join_case_responses(_cases(spark, sf_dir), _responses(spark, sf_dir))
    return checks.classify_failures(checks.check_responses(joined))


@query(f"{_CHECKED_SQL} SELECT case_id, failed_checks, passed, failure_class FROM checked")
def check_responses(spark, sf_dir):
    return _checked(spark, sf_dir).select("case_id", "failed_checks", "passed", "failure_class")


@query(f"""{_CHECKED_SQL} SELECT type, count(*) FILTER (WHERE passed) AS passed, count(*) AS total,
  round_even(count(*) FILTER (WHERE passed) / count(*) * 100, 0) AS percent
FROM checked GROUP BY type""")
def pass_rate_by_type(spark, sf_dir):
    return checks.pass_rate_by_type(_checked(spark, sf_dir))


@query(f"""{_CHECKED_SQL} SELECT failure_class, count(*) AS n FROM checked WHERE NOT passed
GROUP BY failure_class""")
def failure_classes(spark, sf_dir):
    return checks.failure_classes(_checked(spark, sf_dir))


_RETEST_SQL = """WITH tried AS (
  SELECT d.doc_id AS case_id, CASE WHEN d.source = 'src3' THEN '' ELSE d.lang END AS query,
    CASE WHEN n_chars % 4 = 0 THEN 'fallback_used' WHEN n_chars % 4 = 1 THEN 'no_articles'
      WHEN n_chars % 4 = 2 THEN 'fallback_used | no_articles' ELSE 'confidence_null' END AS reason,
    d.text, l.toxic = 1 AS fallback, l.quality = 1 AS has_articles,
    CASE WHEN d.source = 'src5' THEN 'timeout' END AS error, l.doc_id IS NOT NULL AS answered
  FROM documents d LEFT JOIN labels l USING (doc_id)),
retested AS (SELECT *, CASE WHEN query = '' OR NOT answered THEN NULL
    WHEN error IS NOT NULL THEN false WHEN length(text) < 50 THEN false
    WHEN contains(reason, 'fallback_used') AND NOT fallback THEN true
    WHEN contains(reason, 'no_articles') AND has_articles THEN true
    ELSE length(text) > 200 AND NOT fallback END AS improved FROM tried)"""


def _retested(spark, sf_dir):
    rest = F.col("n_chars") % 4
    reason = (
        F.when(rest == 0, "fallback_used").when(rest == 1, "no_articles")
        .when(rest == 2, "fallback_used | no_articles").otherwise("confidence_null")
    )
    failures = load(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("case_id"),
        F.when(F.col("source") == "src3", "").otherwise(F.col("lang")).alias("query"),
        reason.alias("failure_reason"),
    )
    responses = labelled(spark, sf_dir).select(
        F.col("doc_id").alias("case_id"), "text", (F.col("toxic") == 1).alias("fallback"),
        F.when(F.col("quality") == 1, F.array("lang")).alias("articles"),
        F.when(F.col("source") == "src5", "timeout").alias("error"),
    )
    return checks.retest(failures, responses)


@query(f"{_RETEST_SQL} SELECT case_id, improved FROM retested")
def retest(spark, sf_dir):
    return _retested(spark, sf_dir).select("case_id", "improved")


@query(f"""{_RETEST_SQL} SELECT count(*) AS total_retested,
  count(*) FILTER (WHERE improved) AS improved, count(*) FILTER (WHERE NOT improved)
    AS still_failing, round_even(count(*) FILTER (WHERE improved) / count(*), 4)
    AS improvement_rate FROM retested""")
def improvement_rate(spark, sf_dir):
    return checks.improvement_rate(_retested(spark, sf_dir))


@query(f"""WITH {EVENT_TURNS_SQL}, last AS (
  SELECT session_id, arg_max(content, id) FILTER (WHERE role = 'assistant') AS answer,
         coalesce(arg_max(tool, id) FILTER (WHERE role = 'assistant'), '') AS tool
  FROM turns GROUP BY session_id)
SELECT session_id AS scenario_id, list_filter([
    CASE WHEN NOT (contains(answer, '1') OR contains(answer, '2')) THEN 'expect_any' END,
    CASE WHEN session_id % 2 = 0 AND tool <> 'view' THEN 'expect_tool' END,
    CASE WHEN session_id % 3 = 0 AND tool = 'click' THEN 'forbid_tool' END],
    lambda f: f IS NOT NULL) AS failures, len(failures) = 0 AS ok, left(answer, 120)
  AS answer_preview FROM last""")
def check_scenarios(spark, sf_dir):
    turns = event_turns(spark, sf_dir)
    number = F.col("session_id")
    scenarios = turns.select("session_id").distinct().select(
        number.alias("scenario_id"), "session_id",
        F.array(F.lit("1"), F.lit("2")).alias("expect_any"),
        F.when(number % 2 == 0, "view").alias("expect_tool"),
        F.when(number % 3 == 0, "click").alias("forbid_tool"),
    )
    return checks.check_scenarios(scenarios, turns, preview_chars=120)


def _runs(spark, sf_dir):
    """One run per source: its labelled documents are the cases."""
    scored = labelled(spark, sf_dir).groupBy("source").agg(
        F.count(F.lit(1)).alias("dataset_size"),
        F.sum("quality").alias("success_count"),
        F.bround(F.avg("quality"), 4).alias("faithfulness"),
        F.bround(F.avg("n_chars"), 2).alias("mean_chars"),
        F.bround(F.avg("toxic"), 4).alias("toxicity"),
    )
    metrics = [v for c in ("faithfulness", "mean_chars", "toxicity") for v in (F.lit(c), F.col(c))]
    stamp = F.timestamp_seconds(F.lit(1704067200) + F.substring("source", 4, 9).cast("int") * 60)
    return scored.select(
        stamp.alias("run_ts"), F.col("source").alias("tag"), "dataset_size", "success_count",
        F.create_map(*metrics).alias("metrics"),
    )


_RUNS_SQL = f"""{LABELLED_SQL}, runs AS (
  SELECT CAST(substr(source, 4) AS INTEGER) AS ord, source AS tag, count(*) AS dataset_size,
    CAST(sum(quality) AS BIGINT) AS success_count, round_even(avg(quality), 4) AS faithfulness,
    round_even(avg(n_chars), 2) AS mean_chars, round_even(avg(toxic), 4) AS toxicity
  FROM labelled GROUP BY source)"""


@query(f"""WITH {_RUNS_SQL} SELECT tag, dataset_size, success_count, faithfulness FROM runs
WHERE ord <> (SELECT max(ord) FROM runs) ORDER BY ord DESC LIMIT 2""")
def latest_runs(spark, sf_dir):
    every = _runs(spark, sf_dir)
    newest = every.agg(F.max("run_ts")).scalar()
    found = runs.latest_runs(every.where(F.col("run_ts") != newest), 2)
    return found.select("tag", "dataset_size", "success_count",
                        F.col("metrics")["faithfulness"].alias("faithfulness"))


@query(f"""WITH {LABELLED_SQL} SELECT 'all' AS tag, count(*) AS dataset_size,
  count(*) FILTER (WHERE quality = 1) AS success_count, round_even(avg(n_chars), 4) AS mean_chars,
  count(*) AS case_rows FROM labelled""")
def run_round_trip(spark, sf_dir):
    """A run and its case rows written and read back."""
    cases = labelled(spark, sf_dir).select(
        "doc_id", "n_chars", F.when(F.col("quality") == 1, "success").otherwise("error").alias(
            "status"))
    means = runs.metric_means(cases, exclude=["doc_id"])
    path = scratch_path(spark, "runs")
    files.write_run(files.run_row(cases, means, "2026-01-01 00:00:00", "all"), cases, path)
    stored = spark.read.parquet(f"{path}/cases").groupBy("tag").agg(
        F.count(F.lit(1)).alias("case_rows"))
    return files.read_runs(spark, path).join(stored, "tag").select(
        "tag", "dataset_size", "success_count",
        F.bround(F.col("metrics")["n_chars"], 4).alias("mean_chars"), "case_rows",
    )


@query(f"""WITH {_RUNS_SQL}, two AS (SELECT *, row_number() OVER (ORDER BY ord DESC) AS r FROM runs),
pairs AS (
  SELECT m.metric, CASE m.metric WHEN 'faithfulness' THEN b.faithfulness WHEN 'mean_chars'
      THEN b.mean_chars ELSE b.toxicity END AS before_value,
    CASE m.metric WHEN 'faithfulness' THEN a.faithfulness WHEN 'mean_chars' THEN a.mean_chars
      ELSE a.toxicity END AS after_value
  FROM two a JOIN two b ON a.r = 1 AND b.r = 2,
    (VALUES ('faithfulness'), ('mean_chars'), ('toxicity')) AS m(metric)),
moved AS (SELECT *, CASE WHEN before_value <> 0 THEN (after_value - before_value) / before_value END
  AS delta, CASE metric WHEN 'faithfulness' THEN 0.15 ELSE 0.05 END AS lim FROM pairs),
judged AS (SELECT metric, before_value, after_value, round_even(delta, 6) AS delta,
  CASE WHEN before_value = 0 THEN 'stable' WHEN delta > lim THEN 'improved' WHEN delta < -lim
    THEN 'regression' ELSE 'stable' END AS status FROM moved)
SELECT *, (SELECT bool_or(status = 'regression') FROM judged) AS has_regression FROM judged""")
def regression_gate(spark, sf_dir):
    return runs.regression_gate(_runs(spark, sf_dir)).withColumn("delta", F.bround("delta", 6))


@query(f"""WITH {LABELLED_SQL}, before AS (SELECT lang AS metric, round_even(avg(n_chars), 4)
  AS before_value FROM documents GROUP BY lang),
after AS (SELECT lang AS metric, round_even(avg(n_chars), 4) AS after_value FROM labelled
  WHERE toxic = 0 GROUP BY lang)
SELECT metric, before_value, after_value, CASE WHEN before_value IS NULL OR after_value IS NULL
    THEN 'N/A' WHEN (after_value - before_value) / before_value > 0.05 THEN 'improved'
  WHEN (after_value - before_value) / before_value < -0.05 THEN 'regression' ELSE 'stable' END
  AS status FROM before FULL OUTER JOIN after USING (metric)""")
def compare_runs(spark, sf_dir):
    def run(df):
        means = df.groupBy("lang").agg(F.bround(F.avg("n_chars"), 4).alias("v"))
        return means.agg(F.map_from_entries(F.collect_list(F.struct("lang", "v"))).alias("metrics"))

    before = run(load(spark, sf_dir, "documents"))
    after = run(labelled(spark, sf_dir).where("toxic = 0"))
    compared = runs.compare_runs(before, after)
    return compared.select("metric", "before_value", "after_value", "status")


@query("""WITH typed AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id)
  AS r FROM documents),
firsts AS (SELECT doc_id, lang, false AS filled FROM typed WHERE r = 1 ORDER BY doc_id LIMIT 6),
fill AS (SELECT doc_id, lang, true AS filled FROM documents
  WHERE doc_id NOT IN (SELECT doc_id FROM firsts) ORDER BY doc_id LIMIT 6)
SELECT * FROM (SELECT * FROM firsts UNION ALL SELECT * FROM fill) ORDER BY filled, doc_id LIMIT 6""")
def diverse_sample(spark, sf_dir):
    cases = load(spark, sf_dir, "documents").select("doc_id", "lang")
    return runs.diverse_sample(cases, "lang", 6, order="doc_id")


def _results(spark, sf_dir):
    labels = load(spark, sf_dir, "labels")
    docs = load(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    return docs.select(
        "doc_id", F.col("lang").alias("question_type"), F.col("text").alias("answer"),
        F.when(F.coalesce("toxic", F.lit(0)) == 1, "error").otherwise("success").alias("status"),
        F.when(F.col("quality").isNotNull(), F.array("text")).otherwise(
            F.array().cast("array<string>")).alias("contexts"),
    )


_RESULTS_SQL = """results AS (SELECT doc_id, lang AS question_type, coalesce(toxic, 0) <> 1 AS ok,
  quality IS NOT NULL AS covered FROM documents LEFT JOIN labels USING (doc_id))"""


@query(f"WITH {_RESULTS_SQL} SELECT doc_id, question_type FROM results WHERE ok AND covered")
def valid_cases(spark, sf_dir):
    kept = runs.valid_cases(_results(spark, sf_dir), need_answer=True)
    return kept.select("doc_id", "question_type")


@query(f"""WITH {_RESULTS_SQL} SELECT question_type, count(*) FILTER (WHERE covered)
  AS with_contexts, count(*) AS cases, round_even(count(*) FILTER (WHERE covered) / count(*), 4)
  AS coverage FROM results WHERE ok GROUP BY question_type""")
def context_coverage(spark, sf_dir):
    return runs.context_coverage(_results(spark, sf_dir))


@query("""SELECT round_even(avg(quality), 6) AS quality, round_even(avg(toxic), 6) AS toxic
FROM documents LEFT JOIN labels USING (doc_id)""")
def metric_means(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id")
    scores = docs.join(load(spark, sf_dir, "labels"), "doc_id", "left")
    means = runs.metric_means(scores, exclude=["doc_id"])
    return means.select(*[F.bround(c, 6).alias(c) for c in means.columns])
