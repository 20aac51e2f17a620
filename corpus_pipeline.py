"""Corpus pipeline over ``documents``: language identification, near-duplicate
removal, benchmark decontamination, secret redaction, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run`
writes each result as Parquet to the shared folder and reads it again as the
next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelspark.llm import decontamination, language_id, mixing, secret_scan
from reelspark.llm.ngram_join import jaccard_components
from reelspark.llm.queries import language_model
from reelspark.llm.runtime import Workspace, keep_ids

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that language identification rejects: null texts, texts
    without letters and texts too far from every learned language."""
    docs = docs.select(*COLUMNS)
    return language_id.accepted(spark, docs, language_model(spark, docs))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each class of near duplicates
    (five-word shingles, Jaccard 0.8 or more); of rows that repeat an id one
    stays, rows with a null id all stay."""
    work = Workspace(spark, "dedup")
    docs = docs.select(*COLUMNS)
    classes = work.table(jaccard_components(spark, docs, width=5, percent=80))
    dropped = work.table(classes.where("doc_id <> component_id").select("doc_id").distinct())
    kept = keep_ids(docs, dropped, "doc_id", "left_anti")
    again = work.table(classes.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return kept
    once = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(again, "doc_id", "left_anti").unionByName(once).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents over the coverage limit of benchmark words; other
    documents stay as they are."""
    return decontamination.uncontaminated(spark, docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=13, limit=20)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets, also encoded ones, by a mark; every document stays."""
    return secret_scan.redact_documents(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents to tempered source, language and topic weights; returns
    the kept documents with topic, tokens and probability."""
    rows = docs.select(*COLUMNS, mixing.topic_of("text").alias("topic"), mixing.word_count("text").alias("n_tokens"))
    return mixing.sample(spark, rows, power=0.5, rate=0.5)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

#: The learned language model, the components and the raking have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = work.table(stage(spark, docs, sf_dir))
    return docs


