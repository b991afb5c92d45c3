"""Append-only logs and versioned records: latest-per-key reads, unique appends, rates over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultline.functions.running import running_sums


def append_unique(log: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to append, rows rejected because the log has their key)."""
    return new.join(log.select(*keys), keys, "left_anti"), new.join(log.select(*keys), keys, "left_semi")


def history(log: DataFrame, key: str, value: object, order: list[str]) -> DataFrame:
    return log.where(F.col(key) == F.lit(value)).orderBy(*order)


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each key's last row by ``order``: an aggregate without a sort, combined before the shuffle."""
    rest = [c for c in log.columns if c not in keys]
    best = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest))


def recent(log: DataFrame, n: int, order: list[str], actor_column: str | None = None, actor: str | None = None) -> DataFrame:
    """The last ``n`` rows; of one actor (in either case) when named, filtered before the limit."""
    rows = log if actor is None else log.where(F.lower(F.col(actor_column).cast("string")) == actor.lower())
    return rows.orderBy(*(F.desc(c) for c in order)).limit(n)


def audit_metrics(log: DataFrame, by: list[str] = ()) -> DataFrame:
    """Counts by status, rates among decisions, completeness and rationale coverage, time span. Ratios without a denominator are null.

    log: status (draft, approved, rejected, changes_requested), actor, decided_at, comment.
    """
    n = lambda c: F.sum(c.cast("int")).cast("long")
    is_a = lambda v: F.coalesce(F.col("status") == v, F.lit(False))
    decided = is_a("approved") | is_a("rejected") | is_a("changes_requested")
    rejected = is_a("rejected")
    named = F.length(F.trim(F.coalesce("actor", F.lit("")))) > 0
    why = F.length(F.trim(F.coalesce("comment", F.lit("")))) > 0
    ratio = lambda a, b: F.round(F.sum((a & b).cast("int")) / F.nullif(F.sum(b.cast("int")), F.lit(0)), 4)
    return log.groupBy(*by).agg(
        F.count("*").alias("events"), *(n(is_a(s)).alias(s) for s in ("draft", "approved", "rejected", "changes_requested")), n(decided).alias("decisions"),
        ratio(is_a("approved"), is_a("approved") | rejected).alias("approval_rate"), ratio(rejected, is_a("approved") | rejected).alias("rejection_rate"),
        ratio(named & F.col("decided_at").isNotNull(), decided).alias("completeness"), ratio(why, rejected).alias("rationale_coverage"),
        F.min("decided_at").alias("first_at"), F.max("decided_at").alias("last_at"),
    )


def approval_trajectory(log: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The approval rate among the decisions so far, at each decision of a group; ``order`` begins with a number or a time."""
    decided = log.where(F.col("status").isin("approved", "rejected")).withColumns({"_hit": (F.col("status") == "approved").cast("int"), "_one": F.lit(1)})
    summed = running_sums(decided, by, order, {"_hits": "_hit", "_ones": "_one"})
    return summed.select(*log.columns, F.round(F.col("_hits") / F.col("_ones"), 4).alias("approval_rate"))


def latest_doc(docs: DataFrame, key: str, order: list[str], text: str) -> DataFrame:
    """Each key's last version with a digest of its text."""
    return latest(docs, [key], order).withColumn("digest", F.sha2(F.coalesce(text, F.lit("")), 256))


def inventory(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Counts by ``a``, by ``b`` and in all; null stands for "all"."""
    sets = rows.groupingSets([[F.col(a)], [F.col(b)], []], F.col(a), F.col(b))
    return sets.agg(F.count("*").alias("n"))


def exclude(rows: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Leave-one-out: rows of other groups; rows without a group stay."""
    return rows.where(~F.coalesce(F.col(column).isin(names), F.lit(False)))


def upsert_runs(runs: DataFrame, new: DataFrame, key: str, at: str, keep: int = 200) -> DataFrame:
    """The last record of each run, newest first, the ``keep`` newest: a top-k over the whole table."""
    both = runs.unionByName(new)
    return latest(both, [key], [at]).orderBy(F.desc(at), key).limit(keep)


def next_records(log: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (plan_id, status, actor) with their version, and whether the transition is allowed: an approval needs a stored
    validation report (JSON with an error count) without errors."""
    heads = latest(log.select("plan_id", "version", "validation_json"), ["plan_id"], ["version"])
    joined = requests.join(heads, "plan_id", "left")
    errors = F.from_json("validation_json", "errors int")["errors"]
    allowed = (F.col("status") != "approved") | F.coalesce(errors == 0, F.lit(False))
    return joined.select("plan_id", "status", "actor", (F.coalesce("version", F.lit(0)) + 1).alias("version"), allowed.alias("allowed"))


def cache_misses(texts: DataFrame, cache: DataFrame, model: str, text: str = "text") -> DataFrame:
    """One row per text that the cache (key) has not seen for the model."""
    key = F.sha2(F.concat(F.lit(f"{model}\0"), F.coalesce(F.col(text), F.lit(""))), 256)
    return texts.withColumn("key", key).groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).join(cache.select("key"), "key", "left_anti")
