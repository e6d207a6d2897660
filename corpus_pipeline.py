"""A training corpus from raw documents: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm import language_id, mixing, packing, simhash
from skein.llm.cluster import discard, materialize


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model, trained on these documents' labels, recognises."""
    return language_id.keep_identified(docs, language_id.fit(language_id.training_rows(docs)))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of SimHash near-duplicates."""
    return simhash.one_of_each_group(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as brings the domains to their target weights."""
    return mixing.mixed_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their token ids and places in sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [("language_id", known_language), ("simhash_dedup", without_near_copies), ("source_mixing", mixed), ("best_fit_packing", packed)]

#: Trained models and token ids aren't expressible in SQL; tests/llm compares the stages with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``. Each stage's table goes once the next one's is written; the last's stays, as the result reads it.

    Null texts and texts without letters go in the first stage; rows without an id stay
    to the end, rows with the same id are one document to the second; further columns
    of the documents are carried along. No documents: no rows.
    """
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, before, sf_dir), name)
        discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
