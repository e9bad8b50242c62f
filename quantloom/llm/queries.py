"""Registered queries of the corpus operators, each over its whole table, and their DuckDB texts."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import (bpe, decontaminate, exact_dedup, fill_middle, hard_negatives, html_text, language_id, near_dedup, oracles, pii, quality, sharding, url_filter,
                           warc)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@register("op6_information_theoretic_pii")
def op6_information_theoretic_pii(spark: SparkSession, folder: str) -> DataFrame:
    d = pii.span_columns(pii.find(table(spark, folder, "documents").select("doc_id", "text")))
    return d.select("row.doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


@register("op7_ftrl_language_id")
def op7_ftrl_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language_id.fit(docs, ~language_id.held_out())
    p = language_id.predict(docs.select("doc_id", language_id.held_out().alias("held_out"), "text"), model)
    return p.select("row.doc_id", "row.held_out", "lang_pred", "score")


@register("op8_quadratic_discriminant_quality")
def op8_quadratic_discriminant_quality(spark: SparkSession, folder: str) -> DataFrame:
    d = quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"), ~quality.held_out(), limit=0.3)
    return d.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


@register("op9_exact_dedup", oracles.EXACT_DEDUP)
def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    d = exact_dedup.decisions(table(spark, folder, "documents"))
    return d.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.col("digest").alias("text_sha256"))


@register("op1_warc_capture_index", oracles.WARC)
def op1_warc_capture_index(spark: SparkSession, folder: str) -> DataFrame:
    return warc.capture_index(table(spark, folder, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op2_bpe_forced_boundaries")
def op2_bpe_forced_boundaries(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), digests=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


#: The rules of the query.
URL_RULES = [url_filter.Rule("allow", "com", "/"), url_filter.Rule("block", "example.com", "/en/"), url_filter.Rule("allow", "www.example.com", "/en/"),
             url_filter.Rule("block", "net", "/es/"), url_filter.Rule("block", "net", "/fr/")]


@register("op3_link_graph_url_filter")
def op3_link_graph_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.verdicts(table(spark, folder, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@register("op4_jump_hash_sharding", oracles.SHARDING)
def op4_jump_hash_sharding(spark: SparkSession, folder: str) -> DataFrame:
    d = sharding.assign(table(spark, folder, "documents"), shards=24)
    return d.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


@register("op5_benchmark_decontamination", oracles.DECONTAMINATION)
def op5_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    d = decontaminate.verdicts(decontaminate.find_spans(docs, table(spark, folder, "benchmark"), keep_text=False))
    return d.select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@register("op10_hyperminhash_near_dedup", oracles.NEAR_DEDUP)
def op10_hyperminhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    d = near_dedup.near_duplicates(table(spark, folder, "documents"), words=2, percent=80)
    return d.select("doc_id", "n_shingles", "component_id", "kept")


@register("op11_fill_in_middle", oracles.FILL_MIDDLE)
def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    d = fill_middle.transform(table(spark, folder, "documents").select("doc_id", "text"))
    return d.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.encode("output", "UTF-8"), 256).alias("output_sha256"),
                    F.sha2(F.encode(fill_middle.restored(), "UTF-8"), 256).alias("restored_sha256"))


@register("op13_slot_hard_negatives", oracles.HARD_NEGATIVES)
def op13_slot_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, folder, "embeddings"), F.col("id") % 100 == 0, label=label)


@register("op12_line_block_html_text", oracles.HTML_TEXT)
def op12_line_block_html_text(spark: SparkSession, folder: str) -> DataFrame:
    d = html_text.extract(table(spark, folder, "pages").select("page_id", "url", "html"))
    return d.select("row.page_id", "row.url", "text", "n_chars")
