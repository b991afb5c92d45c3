"""A corpus pipeline: rules, near-duplicates, contamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir), with docs as the stage before left them, and works on all of them:

1. ``quality``: documents that the base rule or the learned list rejects go;
2. ``near_dedup``: of each class of near-duplicates the document of the least doc_id stays;
3. ``decontamination``: documents contaminated by the benchmark go;
4. ``secrets``: every secret in a text is masked;
5. ``tokens``: each document's token ids.

``run`` writes what a stage returns to the shared folder and reads it for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vaultline.llm import bpe, decontamination, near_dedup, quality_rules, secrets
from vaultline.llm.queries import TOKENIZER, table
from vaultline.llm.shared import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.kept(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.first_of_class(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, TOKENIZER)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_duplicates),
    ("decontamination", decontaminated),
    ("secrets", without_secrets),
    ("tokens", tokens),
]

#: SQL can express neither the learned rules nor the token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
