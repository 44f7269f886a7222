"""Registered queries of the corpus operators and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, conversations, decontaminate, html_extract, line_dedup, lm_score, packing, pii, quality, sharding, simhash, topk, toxicity
from .common import table
from .oracle import TOP_K, TRIE


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = pii.find_spans(table(spark, sf_dir, "documents"))
    base = tuple(pii.PATTERNS)
    sizes = [F.size(k).cast("long").alias(f"n_{k}") for k in base]
    return spans.select(F.col("id").alias("doc_id"), *sizes, F.sha2(pii.span_text(base), 256).alias("base_sha256"), pii.span_text(pii.KINDS).alias("spans"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_classes(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "score", "end_word")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_documents(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.prefix_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (
        op1_html_extraction, op2_lm_scoring, op3_pii, op4_simhash, op5_line_dedup,
        op6_packing, op7_decontamination, op8_quality, op9_toxicity, op10_sharding,
        op11_alignment, op12_top_k, op13_conversation_trie,
    )
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    """The others depend on a model, a hash or an iteration that DuckDB's SQL doesn't have; tests/llm compare them with brute force."""
    return {"op12_top_k": TOP_K, "op13_conversation_trie": TRIE}
