"""Routing and question rules over whole conversation texts with an appended request."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexframe import functions as fx
from lexframe import rules
from lexframe.operators import retrieval_eval, rule_tables
from lexframe.plans import routing as plans
from lexframe.plans.retrieval import understand

from .common import load, load_dealt, sql_contains_any, sql_first_of, sql_list
from .registry import registry

QUERIES, ORACLES, query = registry()

REQUESTS = [
    "산업안전보건법 제38조를 풀어 설명해 주세요", "산업안전보건기준에 관한 규칙 제 44 조의 3 전문",
    "중대재해처벌법 제4조의 의무는 누구에게 있나", "보건관리자를 뽑는 법적 근거가 있나", "환기 설비 점검 주기",
    "지난주 건설 현장 사고 소식", "현장소장이 쓴 블로그 글을 보고 싶다", "안전모 신제품 리뷰 모아 줘",
    "일본 크레인 자격 제도", "요즘 일이 많아 피곤하다", "거푸집 기록에서 보여줘", "데이터에서 찾아주세요",
    "인화성 물질이 있는 폭발 위험 분위기의 환기", "전기공사업법 7조", "재난 및 안전관리 기본법이 다루는 범위",
    "방금 말한 것 중 하나만 더", "중대재해 처벌 등에 관한 법률 시행령을 보여주세요", "난간이 낮으면 어떻게 하나",
]


def questions(spark, sf_dir):
    """Requests rotate over the turns; the text of the turn stands in front."""
    place = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(REQUESTS))).cast("int") + 1
    request = F.element_at(F.array(*[F.lit(r) for r in REQUESTS]), place)
    return load_dealt(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", F.concat("text", F.lit(" "), request).alias("query")
    )


QUESTIONS_SQL = f"""requests AS (
  SELECT *, list_extract([{sql_list(REQUESTS)}], CAST((conv_id + turn) % {len(REQUESTS)} + 1
         AS INTEGER)) AS request FROM conversations),
questions AS (SELECT conv_id, turn, role, text || ' ' || request AS query FROM requests),
prepared AS (SELECT *, lower(query) AS lowered,
  nfc_normalize(replace(lower(query), ' ', '')) AS squeezed,
  regexp_replace(query, '\\s', '', 'g') AS dense FROM questions)"""

_ROUTE_SQL = " ".join(
    f"WHEN {test} THEN '{tool}'"
    for test, tool in [
        (sql_contains_any("lowered", rules.FOREIGN_KEYWORDS), "websearch_tool"),
        ("regexp_matches(query, '(?:제)?\\s*[0-9]+\\s*조')", "law_rag_tool"),
        (sql_contains_any("squeezed", rules.LAW_KEYWORDS), "law_rag_tool"),
        (sql_contains_any("squeezed", rules.ROUTER_NAMES), "law_rag_tool"),
        (sql_contains_any("squeezed", rules.NEWS_KEYWORDS), "news_tool"),
        (sql_contains_any("squeezed", rules.BLOG_KEYWORDS), "blog_tool"),
        (sql_contains_any("squeezed", rules.DB_KEYWORDS), "db_query_tool_async"),
        (sql_contains_any("squeezed", rules.GENERAL_KEYWORDS), "general_tool"),
    ]
)
_HANDLER_SQL = " ".join(f"WHEN '{tool}' THEN '{name}'" for tool, name in rules.HANDLERS.items())
_ROUTED_SQL = f"""WITH {QUESTIONS_SQL},
ruled AS (SELECT *, CASE {_ROUTE_SQL} END AS rule_tool FROM prepared),
labels AS (SELECT trim(query) AS query, min(CASE WHEN turn % 2 = 0 THEN 'news_tool'
           ELSE 'robot_tool' END) AS label FROM questions WHERE role = 'assistant' GROUP BY 1),
routed AS (SELECT r.*, coalesce(rule_tool, l.label, 'law_rag_tool') AS tool
           FROM ruled r LEFT JOIN labels l ON l.query = trim(r.query) AND r.rule_tool IS NULL)"""


def _routed(spark, sf_dir):
    asked = questions(spark, sf_dir)
    tool = F.when(F.col("turn") % 2 == 0, "news_tool").otherwise("robot_tool")
    labels = asked.where("role = 'assistant'").select("query", tool.alias("tool"))
    return plans.route_questions(asked, labels)


@query(f"""{_ROUTED_SQL} SELECT conv_id, turn, query, rule_tool, tool,
  coalesce(CASE tool {_HANDLER_SQL} END, 'general_agent') AS handler FROM routed""")
def route_questions(spark, sf_dir):
    return _routed(spark, sf_dir).select("conv_id", "turn", "query", "rule_tool", "tool", "handler")


_PREDICTED_SQL = f"""{_ROUTED_SQL}, predicted AS (
  SELECT CASE WHEN (conv_id + turn) % {len(REQUESTS)} < 5 THEN 'law' ELSE 'non-law' END AS label,
         CASE WHEN tool = 'law_rag_tool' THEN 'law' ELSE 'non-law' END AS rule_label,
         CASE WHEN role = 'user' THEN 'law' ELSE 'non-law' END AS model_label FROM routed)"""


def _predicted(spark, sf_dir):
    place = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(REQUESTS)))
    return _routed(spark, sf_dir).select(
        F.when(place < 5, "law").otherwise("non-law").alias("label"),
        fx.law_label(F.col("tool")).alias("rule_label"),
        F.when(F.col("role") == "user", "law").otherwise("non-law").alias("model_label"),
    )


@query(f"""{_PREDICTED_SQL} SELECT count(*) AS total,
  count(*) FILTER (WHERE rule_label = label) AS rule_correct,
  count(*) FILTER (WHERE model_label = label) AS model_correct,
  round_even(avg(CAST(rule_label = label AS INTEGER)), 4) AS rule_accuracy,
  round_even(avg(CAST(model_label = label AS INTEGER)), 4) AS model_accuracy FROM predicted""")
def router_accuracy(spark, sf_dir):
    return retrieval_eval.router_accuracy(_predicted(spark, sf_dir))


@query(f"""{_PREDICTED_SQL} SELECT label, rule_label, model_label FROM predicted
WHERE model_label <> label""")
def router_wrong_cases(spark, sf_dir):
    return retrieval_eval.wrong_cases(_predicted(spark, sf_dir), "model_label")


@query(f"""{_PREDICTED_SQL} SELECT label, rule_label AS predicted, count(*) AS n
FROM predicted GROUP BY ALL""")
def router_confusion(spark, sf_dir):
    return retrieval_eval.confusion(_predicted(spark, sf_dir))


_REFERENCE = "'(?:제)?\\s*([0-9]+)\\s*조(?:\\s*의\\s*([0-9]+))?'"
_TERM_SQL = "query"
for _phrase in rules.DB_KEYWORDS + rules.REQUEST_VERBS:
    _TERM_SQL = f"replace({_TERM_SQL}, '{_phrase}', '')"
_TRIGGER, _TERM = rules.TERM_MAP[0]


@query(f"""WITH {QUESTIONS_SQL}, found AS (SELECT *,
  {sql_first_of('dense', [([n], n) for n in rules.KNOWN_NAMES])} AS name,
  {sql_first_of('dense', rules.SCOPE_RULES)} AS scope,
  regexp_extract(query, {_REFERENCE}, 1) AS main, regexp_extract(query, {_REFERENCE}, 2) AS branch,
  regexp_matches(query, '[가-힣]{{2,15}}(?:법률|법|규칙|시행령)\\s*(?:제)?\\s*[0-9]+\\s*조') AS lawlike
  FROM prepared)
SELECT conv_id, turn, name, scope,
  CASE WHEN branch <> '' THEN main || '의' || branch ELSE main END AS article,
  name IS NULL AND main <> '' AND lawlike AS unknown,
  CASE WHEN contains(dense, '{_TRIGGER}') AND NOT contains(dense, '{_TERM}')
       THEN query || ' (관련 법령 용어: {_TERM})' ELSE query END AS expanded,
  trim({_TERM_SQL}, ' ' || chr(9) || chr(10) || chr(13)) AS term FROM found""")
def question_rules(spark, sf_dir):
    return understand(questions(spark, sf_dir).withColumnRenamed("query", "question")).select(
        "conv_id", "turn", "name", "scope", "article", "unknown",
        fx.expand_terms(F.col("question")).alias("expanded"),
        fx.search_term(F.col("question")).alias("term"),
    )


@query("""WITH made AS (
  SELECT doc_id, '제 ' || doc_id || ' 조' || CASE WHEN n_chars % 3 = 0 THEN '의 ' || (n_chars % 7)
    ELSE '' END AS written, doc_id || CASE WHEN n_chars % 3 = 0 THEN '의' || (n_chars % 7) ELSE ''
    END AS norm, source, lang FROM documents)
SELECT doc_id, norm, CASE WHEN contains(norm, '의') THEN '제' || split_part(norm, '의', 1) || '조의'
    || split_part(norm, '의', 2) ELSE '제' || norm || '조' END AS display,
  source || '관' || lang AS name,
  'https://www.law.go.kr/법령/' || source || '%20%26/' || CASE WHEN contains(norm, '의') THEN '제'
    || split_part(norm, '의', 1) || '조의' || split_part(norm, '의', 2) ELSE '제' || norm || '조' END
    AS url, split_part(source || '_' || lang || '_tool', '_', 1) AS tool FROM made""")
def article_keys(spark, sf_dir):
    branch = F.when(F.col("n_chars") % 3 == 0, F.concat(F.lit("의 "), F.col("n_chars") % 7))
    written = F.concat(F.lit("제 "), "doc_id", F.lit(" 조"), F.coalesce(branch, F.lit("")))
    norm = fx.normalize_article(written)
    return load(spark, sf_dir, "documents").select(
        "doc_id", norm.alias("norm"), fx.article_display(norm).alias("display"),
        fx.normalize_name(F.concat("source", F.lit("· 관 "), "lang")).alias("name"),
        fx.source_url(F.concat("source", F.lit(" &")), norm).alias("url"),
        fx.short_tool(F.concat_ws("_", "source", "lang", F.lit("tool"))).alias("tool"),
    )


def _keyed_questions(spark, sf_dir):
    return questions(spark, sf_dir).withColumn("id", F.struct("conv_id", "turn"))


@query(f"""{_ROUTED_SQL} SELECT conv_id, turn, rule_tool FROM routed""")
def rule_table_routes(spark, sf_dir):
    """The router's keyword lists as a table."""
    routed = rule_tables.route_by_table(_keyed_questions(spark, sf_dir), "id")
    return routed.select("conv_id", "turn", "rule_tool")


@query(f"""WITH {QUESTIONS_SQL} SELECT conv_id, turn,
  {sql_first_of('dense', [([n], n) for n in rules.KNOWN_NAMES])} AS name,
  {sql_first_of('dense', rules.SCOPE_RULES)} AS scope FROM prepared""")
def rule_table_questions(spark, sf_dir):
    """Known names and preferred scopes by tables."""
    asked = _keyed_questions(spark, sf_dir).withColumnRenamed("query", "question")
    return rule_tables.detect_by_table(asked, "id").select("conv_id", "turn", "name", "scope")


@query(r"""WITH words AS (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}]{8,}')) AS name FROM documents),
names AS (SELECT name, count(*) AS n FROM words GROUP BY 1),
turns AS (SELECT conv_id, turn, lower(text) AS text FROM conversations),
hits AS (SELECT conv_id, turn, min(struct_pack(priority := -n, name := name)) AS r, count(*) AS found
         FROM turns JOIN names ON contains(text, name) GROUP BY ALL)
SELECT conv_id, turn, r.name AS name, CAST(r.priority AS BIGINT) AS priority FROM hits""")
def rule_table_words(spark, sf_dir):
    """Every long word of the documents is a name, frequent ones first; all conversations are matched."""
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]{8,}"), F.lit(0))).alias("name")
    names = load(spark, sf_dir, "documents").select(word).groupBy("name").agg((-F.count("*")).alias("priority"))
    turns = load(spark, sf_dir, "conversations").select(
        F.struct("conv_id", "turn").alias("id"), F.lower("text").alias("words"))
    found = rule_tables.match_rules(
        turns, names.select(F.lit("words").alias("view"), "name", "priority", F.col("name").alias("value")), "id")
    return found.select("id.conv_id", "id.turn", "name", "priority")
