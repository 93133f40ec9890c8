"""The operators' registered queries: each over its whole table, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import chat, jaccard, lattice, mixing, packing, privacy, quality, sharding, suffix_tree, tokens

#: The folder of the public tokenizers' files.
TOKENIZERS = os.environ.get("QUILLON_TOKENIZERS", "/opt/tokenizers")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.counted(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/word_bpe_49k.json")


def op3_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality.COUNTS[:5], "base_failed", "kept", "rule")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    rounded = [F.round(name, digits).alias(name) for name, digits in (("weight", 9), ("probability", 6))]
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", *rounded)


def op6_e8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.dedup(table(spark, sf_dir, "embeddings"))


def op7_disclosure_sanitiser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.digest(privacy.spans(table(spark, sf_dir, "documents")))


def op8_prefix_sum_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op10_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_token_counts, op2_best_fit_packing, op3_suffix_tree_scores, op4_quality_rules, op5_mixing,
        op6_e8_near_dedup, op7_disclosure_sanitiser, op8_prefix_sum_sharding, op9_ngram_jaccard_join, op10_chat_rotation,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op6_e8_near_dedup": lattice.ORACLE, "op9_ngram_jaccard_join": jaccard.ORACLE, "op10_chat_rotation": chat.ORACLE}
