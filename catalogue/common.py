"""Test tables in the shapes the operators expect, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TURN_ID_STEP = 100_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for work that is heavy per row. A file with fewer splits than there are task slots
    (the test tables are single row groups) is dealt out; larger tables are read as they are."""
    table = load(spark, sf_dir, name)
    slots = spark.sparkContext.defaultParallelism
    return table.repartition(slots) if table.rdd.getNumPartitions() < slots else table


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as turns; time order is (conv_id, turn)."""
    identity = F.col("conv_id") * TURN_ID_STEP + F.col("turn")
    return load(spark, sf_dir, "conversations").select(
        identity.alias("id"),
        F.col("conv_id").alias("session_id"),
        F.col("turn").alias("turn_index"),
        "role",
        F.col("text").alias("content"),
        F.floor(F.col("conv_id") / 10).alias("user_id"),
        identity.alias("created_at"),
    )


TURNS_SQL = f"""turns AS (
  SELECT conv_id * {TURN_ID_STEP} + turn AS id, conv_id AS session_id, turn AS turn_index, role,
         text AS content, conv_id // 10 AS user_id, conv_id * {TURN_ID_STEP} + turn AS created_at
  FROM conversations)"""


def event_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as turns of their users: the event type is the tool, k the score."""
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("session_id"),
        F.col("event_id").alias("turn_index"),
        F.when(F.col("event_type") == "error", "user").otherwise("assistant").alias("role"),
        F.col("props").alias("content"),
        "user_id",
        F.to_json(F.struct(F.col("event_type").alias("tool"))).alias("metadata"),
        F.get_json_object("props", "$.k").cast("int").alias("score"),
        F.col("ts").alias("created_at"),
    )


EVENT_TURNS_SQL = """turns AS (
  SELECT event_id AS id, user_id AS session_id, event_id AS turn_index,
         CASE WHEN event_type = 'error' THEN 'user' ELSE 'assistant' END AS role,
         props AS content, user_id, event_type AS tool,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS score, ts AS created_at
  FROM events)"""


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as an article table: the source is the law, the document id the number."""
    return load(spark, sf_dir, "documents").select(
        F.concat(F.lit("c"), F.col("doc_id")).alias("chunk_id"),
        F.col("source").alias("law_name"),
        F.col("source").alias("law_name_norm"),
        F.concat(F.lit("제"), F.col("doc_id"), F.lit("조")).alias("article_number"),
        F.col("doc_id").cast("string").alias("article_number_norm"),
        "text",
        F.date_add(F.lit("2024-01-01"), F.pmod("doc_id", F.lit(28)).cast("int")).alias(
            "enforcement_date"),
        F.lit(1).cast("bigint").alias("created_at"),
        F.lit(1).cast("bigint").alias("updated_at"),
    )


ARTICLES_SQL = """articles AS (
  SELECT 'c' || doc_id AS chunk_id, source AS law_name, source AS law_name_norm,
         '제' || doc_id || '조' AS article_number, CAST(doc_id AS VARCHAR) AS article_number_norm,
         text, DATE '2024-01-01' + CAST(doc_id % 28 AS INTEGER) AS enforcement_date,
         CAST(1 AS BIGINT) AS created_at, CAST(1 AS BIGINT) AS updated_at
  FROM documents)"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that carry a label, with its columns."""
    return load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id")


LABELLED_SQL = "labelled AS (SELECT * FROM documents JOIN labels USING (doc_id))"


def sql_list(values) -> str:
    return ", ".join(sql_text(v) for v in values)


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_contains_any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {sql_text(w)})" for w in words) + ")"


def sql_first_of(column: str, rules) -> str:
    """CASE over (words, result) pairs; the first set with a contained word decides."""
    branches = " ".join(
        f"WHEN {sql_contains_any(column, words)} THEN {sql_text(result)}" for words, result in rules
    )
    return f"CASE {branches} END"
