"""From raw documents to packed sequences: each stage calls one operator on what the one before it kept.

All stages but the last return the columns of their input, whatever they are called, with the values they had
(decontamination changes text and n_chars).

Defined results: a null or empty text, or one of under 50 words, is rejected by the rules; a null source, language or
length is a value of its own to the classifier; equal rows are one document to the near-duplicate stage, which keeps
the least doc_id of a group, of rows with one doc_id and text the first by their other columns, and of rows without
doc_id one for each text; texts of any length are read whole; a score right at a threshold is kept; empty tables give
no rows (without labels all documents count as good and not toxic; without a benchmark nothing is removed).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwatch.llm import decontaminate, ngram_join, packing, quality_classifier, quality_rules
from millwatch.sources.shared import new_path, ship, table


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """Documents that the rules keep."""
    ship(spark)
    return quality_rules.keep(docs)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good and not toxic."""
    ship(spark)
    return quality_classifier.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """The document with the least doc_id of each group of near copies, once."""
    ship(spark)
    return ngram_join.firsts(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the benchmark passages in their texts; n_chars is that of the new text."""
    ship(spark)
    clean = decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """Pieces of the documents in sequences of 2048 tokens, with their ids."""
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Learned models and token ids are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each one's result written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
