"""Data-quality checks. Each returns rows, so that many checks form one result table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: failures; one pass over the table."""
    one = df.agg(*(F.coalesce(F.sum(F.col(c).isNull().cast("int")), F.lit(0)).cast("long").alias(c) for c in columns))
    return one.unpivot([], columns, "column_name", "failures").withColumn("status", F.when(F.col("failures") == 0, "pass").otherwise("fail"))


def check_unique(df: DataFrame, columns: list[str]) -> DataFrame:
    """The keys that occur more than once, and how often."""
    return df.groupBy(*columns).agg(F.count("*").alias("copies")).where("copies > 1")


def check_hash_format(df: DataFrame, column: str) -> DataFrame:
    """How many values are hex hashes of 32 or 64 characters, over all rows."""
    good = F.col(column).rlike("^([0-9a-fA-F]{32}|[0-9a-fA-F]{64})$")
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum((~F.coalesce(good, F.lit(False))).cast("int")), F.lit(0)).cast("long").alias("failures"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, n_rows and OK, or WARN for an empty table."""
    counts = union_all([df.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n, df in sorted(tables.items())])
    return counts.withColumn("status", F.when(F.col("n_rows") > 0, "OK").otherwise("WARN"))


def check_versions(hub: DataFrame, sat: DataFrame, pk: str, nk: str, least: int) -> DataFrame:
    """Versions of each hub key and whether they are ``least`` or more."""
    counts = sat.groupBy(pk).agg(F.count("*").alias("versions"))
    out = hub.select(pk, nk).join(counts, pk, "left").withColumn("versions", F.coalesce("versions", F.lit(0)))
    return out.select(nk, "versions", (F.col("versions") >= least).alias("passed"))


def check_orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows without a parent."""
    return child.where(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")


def rate(hits: Column, of: Column) -> Column:
    """A ratio to four places; null where there is nothing to divide by."""
    total = F.sum(of.cast("int"))
    return F.when(total > 0, F.round(F.sum(hits.cast("int")) / total, 4))


def pass_rates(results: DataFrame, by: list[str] = ()) -> DataFrame:
    """Model and test pass rates of check results (resource_type, status); skipped ones do not count."""
    kind, status = F.col("resource_type"), F.col("status")
    model, test = (kind == "model") & (status != "skipped"), (kind == "test") & (status != "skipped")
    return results.groupBy(*by).agg(
        F.count("*").alias("n_results"),
        rate(model & (status == "success"), model).alias("model_rate"),
        rate(test & (status == "pass"), test).alias("test_rate"),
    )


def outcome_counts(results: DataFrame, statuses: list[str]) -> DataFrame:
    return results.groupBy("resource_type").pivot("status", statuses).count().na.fill(0)


def sweep_rates(results: DataFrame) -> DataFrame:
    """The means of the projects' rates; projects without a rate do not count."""
    own = pass_rates(results, ["project"])
    return own.agg(F.count("*").alias("projects"), F.round(F.avg("model_rate"), 4).alias("model_rate"), F.round(F.avg("test_rate"), 4).alias("test_rate"))


def reconcile(source: DataFrame, source_key: str, hub: DataFrame, hub_key: str, by: Column, name: str) -> DataFrame:
    """Distinct keys of source and hub per group, and their difference."""
    left = source.select(by.alias(name), F.col(source_key).alias("k")).distinct().groupBy(name).agg(F.count("*").alias("source_keys"))
    right = hub.select(by.alias(name), F.col(hub_key).alias("k")).distinct().groupBy(name).agg(F.count("*").alias("hub_keys"))
    both = left.join(right, name, "full").na.fill(0, ["source_keys", "hub_keys"])
    return both.withColumn("difference", F.col("source_keys") - F.col("hub_keys"))


def audit_log(spark_rows: DataFrame, model: Column, status: Column, n_rows: Column, at: Column) -> DataFrame:
    """Append-only events of loads: model, status, row count, time."""
    return spark_rows.select(model.alias("model"), status.alias("status"), n_rows.alias("n_rows"), at.alias("logged_at"))


def audit_status(log: DataFrame) -> DataFrame:
    """The last status of each model with its time, and the time since its start."""
    last = F.max_by(F.struct("status", "n_rows"), F.struct("logged_at", "status"))
    return log.groupBy("model").agg(last.alias("l"), F.max("logged_at").alias("logged_at"), F.min("logged_at").alias("started")).select("model", "l.status", "l.n_rows", "logged_at", "started")
