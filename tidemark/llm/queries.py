"""Queries of this subpackage: one for each operator, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (
    decontamination,
    exact_dedup,
    kneser_ney,
    license_scan,
    packing,
    pii,
    prefix_trie,
    quality_rules,
    secret_scan,
    sharding,
    simhash,
    token_counts,
    vector_codes,
)
from .common import read


def op1_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(read(spark, sf_dir, "documents")).drop("found")


def op2_simhash_deletion_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents")).drop("row_key")


def op3_structural_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read(spark, sf_dir, "documents")).drop("found")


def op4_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), with_ids=False)


def op5_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a map of this run alone, in a folder of its own
    return sharding.shard(read(spark, sf_dir, "documents"), shards=8)


def op6_license_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents")).drop("found")


def op7_hashed_likelihood_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop("row_key")


def op9_seed_and_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("row_key")


def op10_count_only_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations"))


def op12_quotient_filter_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op13_elkan_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(read(spark, sf_dir, "embeddings"))


def queries() -> dict:
    every = (
        op1_skip_chain_pii, op2_simhash_deletion_variants, op3_structural_secrets, op4_swap_packing, op5_virtual_slots,
        op6_license_automaton, op7_hashed_likelihood_ratio, op8_kneser_ney, op9_seed_and_align, op10_count_only_viterbi,
        op11_prefix_trie, op12_quotient_filter_dedup, op13_elkan_codes,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {}
