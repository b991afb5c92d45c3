"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vaultline.llm import binary_output, bpe, decontamination, merkle, near_dedup, oracles, quality_rules, secrets, sharding, substring_dedup, suffix_dedup, token_counts, toxicity, whitening

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on_documents(operator: Callable[..., DataFrame], *args: object) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"), *args)


def queries() -> dict[str, Query]:
    return {
        "op1_near_dedup": on_documents(near_dedup.op1),
        "op2_token_counts": on_documents(token_counts.op2, TOKENIZER),
        "op3_quality_rules": lambda spark, d: quality_rules.op3(table(spark, d, "documents"), table(spark, d, "labels")),
        "op4_sharding": on_documents(sharding.op4),
        "op5_decontamination": lambda spark, d: decontamination.op5(table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op6_secrets": on_documents(secrets.op6),
        "op7_bpe": on_documents(bpe.op7, TOKENIZER),
        "op8_substring_dedup": on_documents(substring_dedup.op8),
        "op9_suffix_dedup": on_documents(suffix_dedup.op9),
        "op10_token_files": on_documents(binary_output.op10, TOKENIZER),
        "op11_toxicity": lambda spark, d: toxicity.op11(table(spark, d, "documents"), table(spark, d, "labels")),
        "op12_embedding_whitening": lambda spark, d: whitening.op12(table(spark, d, "embeddings")),
        "op13_merkle_manifest": on_documents(merkle.op13),
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_decontamination": oracles.OP5, "op8_substring_dedup": oracles.OP8, "op9_suffix_dedup": oracles.OP9, "op13_merkle_manifest": oracles.OP13}
