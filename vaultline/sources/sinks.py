"""Materialisations, and which kind of vault entity uses which."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultline.functions.search import below
from vaultline.sources.versioned import VersionedTable, merge_on  # noqa: F401  merge_on is for those who write versions themselves


def as_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def as_table(df: DataFrame, path: str, compression: str | None = None) -> DataFrame:
    df.write.mode("overwrite").parquet(path, compression=compression)
    return df.sparkSession.read.parquet(path)


def append_new(df: DataFrame, path: str) -> DataFrame:
    """Appends rows that a loader found to be new."""
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.parquet(path)


def overwrite_partitions(df: DataFrame, path: str, columns: list[str], compression: str | None = None) -> DataFrame:
    """Replaces only the partitions that ``df`` has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path, compression=compression)
    return df.sparkSession.read.parquet(path)


def append_evolving(target: DataFrame, new: DataFrame) -> DataFrame:
    """The union by column name; columns that only one side has are null in the other's rows."""
    return target.unionByName(new, allowMissingColumns=True)


#: Bits of each cluster column's rank in a space-filling order.
RANK_BITS = 8


def as_number(df: DataFrame, column: str) -> Column:
    """A double that sorts as the column does; of texts the first six bytes count."""
    kind = dict(df.dtypes)[column]
    if kind == "string":
        return F.conv(F.rpad(F.substring(F.hex(F.encode(column, "UTF-8")), 1, 12), 12, "0"), 16, 10).cast("double")
    return F.unix_micros(F.col(column).cast("timestamp")).cast("double") if kind.startswith(("date", "timestamp")) else F.col(column).cast("double")


def interleaved(df: DataFrame, cluster: list[str], bits: int = RANK_BITS) -> Column:
    """A number that keeps rows together which are near in every cluster column: the bits of the columns' ranks by turns.

    A rank is the stretch between approximate quantiles, so columns of any scale and skew weigh the same.
    """
    cuts = [k / (1 << bits) for k in range(1, 1 << bits)]
    edges = df.agg(*(F.percentile_approx(as_number(df, c), cuts, 10_000).alias(c) for c in cluster)).first()
    ranks = [below(as_number(df, c), sorted(edges[c] or [])) for c in cluster]  # a value that fills several stretches skips ranks
    out = F.lit(0).cast("long")
    for b in range(bits):
        for j, rank in enumerate(ranks):
            bit = F.shiftright(rank, b).bitwiseAND(1).cast("long")
            out = out.bitwiseOR(F.shiftleft(bit, b * len(ranks) + len(ranks) - 1 - j))
    return out


def layout(df: DataFrame, cluster: list[str], partition: str | None = None, parts: int | None = None) -> DataFrame:
    """Rows clustered so that files have narrow ranges of every cluster column and readers can skip files.

    One cluster column is sorted; several are ordered along a space-filling curve, since a sort by the first leaves the others spread
    over all files. ``partition`` comes first; write its folders with ``write_layout``.
    """
    first = [partition] if partition else []
    if len(cluster) == 1:
        keys, laid = [*first, *cluster], df
    else:
        keys, laid = [*first, "_curve"], df.withColumn("_curve", interleaved(df, cluster))
    spread = laid.repartitionByRange(parts, *keys) if parts else laid.repartitionByRange(*keys)
    return spread.sortWithinPartitions(*keys).select(*df.columns)


def write_layout(df: DataFrame, path: str, cluster: list[str], partition: str | None = None, parts: int | None = None) -> DataFrame:
    """Writes ``df`` clustered, in a folder for each value of ``partition`` (a date or coarser): readers skip folders, then files."""
    laid = layout(df, cluster, partition, parts)
    (laid.write.partitionBy(partition) if partition else laid.write).mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def deduplicated(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the greatest by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(*keys, *(F.col(f"_best.{c}").alias(c) for c in rest)).select(*df.columns)


#: Default materialisation of each entity kind.
STRATEGY = {
    "bronze": "append", "staging": "view", "hub": "append", "link": "append", "sat": "append", "eff_sat": "merge",
    "bv_sat": "append", "pit": "overwrite_partitions", "bridge": "table", "dim": "view", "fact": "view",
}


def materialise(kind: str, df: DataFrame, target: str, partition: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """Writes (or names) ``df`` as its entity kind asks. A merge is into what is stored, by ``keys``, as a new version of a versioned table."""

    def merged() -> DataFrame:
        stored = VersionedTable(df.sparkSession, target, partition or [])
        stored.merge(df, keys or [])
        return stored.read()

    how: dict[str, Callable[[], DataFrame]] = {
        "view": lambda: as_view(df, target),
        "table": lambda: as_table(df, target),
        "merge": merged,
        "append": lambda: append_new(df, target),
        "overwrite_partitions": lambda: overwrite_partitions(df, target, partition or []),
    }
    return how[STRATEGY[kind]]()
