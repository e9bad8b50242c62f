"""Corpus pipeline: language ID, exact and near deduplication, benchmark decontamination, encoding."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quantloom.llm import bpe, decontaminate, exact_dedup, language_id, near_dedup
from quantloom.llm.common import materialise


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; null and letterless texts and doubtful languages go."""
    return language_id.recognised(docs, language_id.fit(docs, ~language_id.held_out()))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every text, that with the largest id."""
    return exact_dedup.distinct_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group linked by a Jaccard similarity of 0.8 of their five-word shingles."""
    return near_dedup.one_per_group(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty lies in a passage of a benchmark item."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of the token ids, and digest of the text decoded from them."""
    return bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), digests=True)


STAGES = [("language ID", language), ("exact dedup", exact), ("MinHash near-dedup", near), ("benchmark decontamination", decontamination),
          ("BPE encoding", encoding)]

#: The first stage is a trained model and the last a tokenizer: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
