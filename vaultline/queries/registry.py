"""All queries of the library, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vaultline.queries import governance, loads, marts, retrieval
from vaultline.queries.bindings import Query, Registry


def registry() -> Registry:
    r = Registry()
    for module in (loads, marts, governance, retrieval):
        module.register(r)
    return r


def queries() -> dict[str, Query]:
    return registry().queries


def oracle_sql() -> dict[str, str]:
    return registry().sql


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by market segment and month end, over the vault."""
    return registry().queries["bv7_fact_measures"](spark, sf_dir)
