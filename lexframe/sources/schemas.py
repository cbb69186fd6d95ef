"""Table schemas as DDL."""

ARTICLES = (
    "chunk_id string, law_name string, law_name_norm string, article_number string, "
    "article_number_norm string, text string, enforcement_date date, "
    "created_at timestamp_ntz, updated_at timestamp_ntz"
)
POINTS = (
    "point_id bigint, embedding array<float>, law_name string, law_name_norm string, "
    "article_number string, article_number_norm string, text string, enforcement_date date"
)
TURNS = (
    "id bigint, session_id string, turn_index bigint, role string, content string, "
    "user_id string, metadata string, score int, feedback tinyint, "
    "created_at timestamp_ntz, updated_at timestamp_ntz"
)
CITATIONS = (
    "id bigint, chat_history_id bigint, law_name string, article_number string, score double, "
    "rank int, created_at timestamp_ntz"
)
CACHE = "query_hash string, query_text string, embedding array<float>, ts timestamp"
QA_LOG = (
    "ts string, tool string, query string, query_type string, selected_source string, "
    "selected_articles array<string>, fallback_used boolean, confidence_score double"
)
CHUNKS = "request_id string, seq bigint, event string, payload string, at timestamp"
GOLDEN_CASE = (
    "id string, question_type string, law_name string, law_name_norm string, "
    "article_number string, article_number_norm string, question string, ground_truth string, "
    "expected_keywords array<string>, "
    "accepted_articles array<struct<law:string,article:string>>"
)
RUN = (
    "run_ts timestamp, tag string, dataset_size bigint, success_count bigint, "
    "metrics map<string,double>"
)
WEB_RESULT = "title string, link string, snippet string, source string, published string"

TABLES = {
    "articles": ARTICLES, "points": POINTS, "turns": TURNS, "citations": CITATIONS,
    "cache": CACHE,
}
