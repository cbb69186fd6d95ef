"""A corpus from raw documents: language, rules, near-duplicates, benchmark passages, mixture.

Each stage takes what its predecessor wrote and keeps, drops or repeats whole documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexframe.llm import decontaminate, language_id, mixing, near_copies, quality_rules
from lexframe.llm.common import set_aside
from lexframe.session import pin

#: Below this share of the known trigrams that a language's own texts reach, no learned language fits.
MIN_LANGUAGE_SCORE = 0.3


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that could be told; others go, those without a letter among them."""
    model = language_id.learn(docs)
    rows, name, back = set_aside(docs)
    known = (F.col("lang_pred") != language_id.UNDECIDED) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    return back(language_id.identify(rows, model, name["text"]).where(known))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy of the rule ledger keeps."""
    rows, name, back = set_aside(docs)
    return back(quality_rules.apply_policy(quality_rules.ledger(rows, name["text"])).where("kept"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: candidates by SimHash and minhash bands, five-word shingles of similarity 0.8 or more."""
    return near_copies.drop_near_copies(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixture, with size, times and words taken."""
    return mixing.take_mix(docs)


STAGES = [
    ("language_id", keep_languages),
    ("quality_rules", keep_quality),
    ("near_dedup", keep_distinct),
    ("decontamination", keep_uncontaminated),
    ("source_mixing", mix_sources),
]

#: Language models and fingerprints have no SQL form; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = pin(docs, f"pipeline-{name}")
    return docs
