"""The queries of the operators in this folder, one each, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobsieve.llm import (
    byte_bpe, conversations, decontamination, embedding_groups, hard_negatives, license_scan, near_dedup,
    pseudo_likelihood, quality_rules, quality_trees, revisits, sharding, token_counts)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), size=2)


def op2_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_trees.document_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.document_rules(_table(spark, sf_dir, "documents"))


def op4_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.document_scores(_table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.document_tokens(_table(spark, sf_dir, "documents"))


def op6_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.document_licenses(_table(spark, sf_dir, "documents"))


def op7_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisits.page_revisits(_table(spark, sf_dir, "pages"))


def op8_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted_documents(_table(spark, sf_dir, "documents"))


def op9_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.document_shards(_table(spark, sf_dir, "documents"))


def op11_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups.linked_vectors(_table(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.damaged_repairs(_table(spark, sf_dir, "conversations"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.embedding_negatives(_table(spark, sf_dir, "embeddings"))


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """The queries and the SQL of those that SQL can express."""
    found = (op1_minhash_groups, op2_quality_trees, op3_divergence_rules, op4_pseudo_likelihood, op5_byte_bpe,
             op6_license_diagonals, op7_revisits, op8_separator_scan, op9_template_leaks, op10_feistel_shards,
             op11_cap_filters, op12_conversation_repair, op13_hard_negatives)
    return {f.__name__: f for f in found}, {
        "op1_minhash_groups": near_dedup.DOCUMENT_GROUPS_SQL, "op7_revisits": revisits.PAGE_REVISITS_SQL, "op11_cap_filters": embedding_groups.LINKED_VECTORS_SQL,
        "op12_conversation_repair": conversations.DAMAGED_REPAIRS_SQL,
        "op13_hard_negatives": hard_negatives.EMBEDDING_NEGATIVES_SQL}
