"""Staging: source columns with derived, null-replaced, hashed and ranked ones, in that order."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultline.functions.hashing import END_OF_TIME, hash_key, hashdiff


@dataclass(frozen=True)
class Derived:
    """A column from an SQL expression, from source columns (several are joined by a blank), or a literal."""

    name: str
    expr: str | None = None
    source: str | list[str] | None = None
    literal: object = None

    def column(self) -> Column:
        if self.expr is not None:
            return F.expr(self.expr)
        if self.source is not None:
            names = [self.source] if isinstance(self.source, str) else self.source
            columns = [F.col(f"`{n}`") for n in names]
            return columns[0] if len(columns) == 1 else F.concat_ws(" ", *columns)
        return F.lit(self.literal)


@dataclass(frozen=True)
class Hashed:
    name: str
    columns: list[str]
    diff: bool = False
    algorithm: str = "md5"

    def column(self) -> Column:
        return (hashdiff if self.diff else hash_key)(self.columns, self.algorithm)


@dataclass(frozen=True)
class Ranked:
    name: str
    partition_by: list[str]
    order_by: list[str | Column]
    dense: bool = False

    def column(self) -> Column:
        window = Window.partitionBy(*self.partition_by).orderBy(*self.order_by)
        return (F.dense_rank if self.dense else F.rank)().over(window).cast("long")


@dataclass(frozen=True)
class Nulls:
    required: list[str] = field(default_factory=list)
    optional: list[str] = field(default_factory=list)


def stage(df: DataFrame, derived: list[Derived] = (), nulls: Nulls | None = None, hashed: list[Hashed] = (), ranked: list[Ranked] = (), include_source: bool = True) -> DataFrame:
    """Adds the declared columns; later ones may use earlier ones."""
    out = df
    for d in derived:
        out = out.withColumn(d.name, d.column())
    if nulls:
        out = replace_nulls(out, nulls.required, nulls.optional)
    for h in hashed:
        out = out.withColumn(h.name, h.column())
    for r in ranked:
        out = out.withColumn(r.name, r.column())
    return out if include_source else out.select(*(c for c in out.columns if c not in df.columns))


def replace_nulls(df: DataFrame, required: list[str], optional: list[str]) -> DataFrame:
    """Key columns as text with -1 (required) or -2 (optional) for null; the value stays in ``<column>_original``."""
    new = {f"{c}_original": F.col(c) for c in [*required, *optional]}
    new |= {c: F.coalesce(F.col(c).cast("string"), F.lit(code)) for own, code in ((required, "-1"), (optional, "-2")) for c in own}
    return df.withColumns(new)


def derive_cdc(df: DataFrame, flag: Column, ldts: str) -> DataFrame:
    """CDC_FLAG, IS_DELETED, EFFECTIVE_FROM, START_DATE and END_DATE of change rows."""
    gone = F.coalesce(flag == "D", F.lit(False))
    end = F.when(gone, F.col(ldts)).otherwise(F.lit(END_OF_TIME).cast("timestamp_ntz"))
    return df.withColumns({"cdc_flag": flag, "is_deleted": gone, "effective_from": F.col(ldts), "start_date": F.col(ldts), "end_date": end})


def staging_specs(hubs: DataFrame, links: DataFrame, sats: DataFrame) -> DataFrame:
    """The hashes each source table must compute, in order: hub keys (0), link keys (1), hashdiffs (2).

    hubs: source_table, hash_key, business_keys; links: source_table, hash_key, fk_columns (hub hash keys);
    sats: source_table, parent_hub (hub hash key), hashdiff, payload.
    """
    keys = hubs.select("hash_key", "business_keys").dropDuplicates(["hash_key"])
    own = hubs.select("source_table", "hash_key")
    parents = sats.select("source_table", F.col("parent_hub").alias("hash_key"))
    needed = links.select("source_table", F.explode("fk_columns").alias("hash_key"))
    hub_rows = own.union(parents).union(needed).distinct().join(keys, "hash_key").select("source_table", F.lit(0).alias("step"), F.col("hash_key").alias("name"), F.col("business_keys").alias("columns"))
    link_rows = links.select("source_table", F.lit(1).alias("step"), F.col("hash_key").alias("name"), F.col("fk_columns").alias("columns"))
    diff_rows = sats.select("source_table", F.lit(2).alias("step"), F.col("hashdiff").alias("name"), F.col("payload").alias("columns"))
    return hub_rows.union(link_rows).union(diff_rows).dropDuplicates(["source_table", "step", "name"])
