"""Bronze tables: typed reads, incremental scans, landing, discovery."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG = "system_id string, table_name string, ordinal int, column_name string, raw_dtype string, nullable boolean"


def read_bronze(spark: SparkSession, path: str, casts: dict[str, str], strict: bool = True) -> DataFrame:
    """The named columns in their declared types; dirty values become null unless ``strict``."""
    df = spark.read.parquet(path)
    cast = (lambda c, t: F.col(c).cast(t)) if strict else (lambda c, t: F.col(c).try_cast(t))
    return df.select(*(cast(c, t).alias(c) for c, t in casts.items()))


def high_water_mark(target: DataFrame, ts: str) -> object:
    return target.agg(F.max(ts)).first()[0]


def incremental_scan(source: DataFrame, target: DataFrame | None, ts: str) -> DataFrame:
    """Source rows newer than the target's latest; all of them when there is no target or it is empty. Beside a mark, rows without a
    time are never new: see ``late_rows``."""
    mark = None if target is None else high_water_mark(target, ts)
    return source if mark is None else source.where(F.col(ts) > F.lit(mark))


def late_rows(source: DataFrame, mark: object, ts: str) -> DataFrame:
    """The complement of an incremental scan, for a side table: rows at or below the mark, and those without a time. Without a mark
    the scan takes all rows and nothing is late."""
    return source.where(F.lit(False)) if mark is None else source.where((F.col(ts) <= F.lit(mark)) | F.col(ts).isNull())


def stamp(df: DataFrame, source: str, at: Column | None = None) -> DataFrame:
    return df.withColumns({"record_source": F.lit(source), "ingested_at": F.current_timestamp() if at is None else at})


def land(df: DataFrame, path: str, mode: str = "append") -> None:
    """Writes change rows: ``overwrite`` for the initial load, ``append`` for an update batch."""
    df.write.mode(mode).parquet(path)


def ensure_db(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{name}`")


def discover(spark: SparkSession, tables: dict[str, DataFrame], system_id: str = "main") -> DataFrame:
    """Catalog rows of named DataFrames; only schemas are looked at."""
    rows = [
        (system_id, name, k, f.name, f.dataType.simpleString(), f.nullable)
        for name, df in sorted(tables.items())
        for k, f in enumerate(df.schema.fields, 1)
    ]
    return spark.createDataFrame(rows, CATALOG)


def discover_database(spark: SparkSession, database: str, system_id: str = "main") -> DataFrame:
    """Catalog rows of a database's permanent tables."""
    names = [t.name for t in spark.catalog.listTables(database) if not t.isTemporary]
    return discover(spark, {n: spark.table(f"`{database}`.`{n}`") for n in names}, system_id)


def discover_declared(tables: DataFrame, systems: DataFrame) -> DataFrame:
    """Declared tables, with their system's catalog and schema where they name none."""
    own = tables.join(systems.select("system_id", F.col("catalog").alias("_catalog"), F.col("schema_name").alias("_schema")), "system_id", "left")
    filled = own.withColumns({"catalog": F.coalesce("catalog", "_catalog"), "schema_name": F.coalesce("schema_name", "_schema")})
    return filled.drop("_catalog", "_schema")


def matches(column: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (column.rlike(f"(?i)^(?:{p})$") for p in patterns), F.lit(False))


def filter_tables(catalog: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, tables: list[str] | None = None, hidden: list[str] | None = None) -> DataFrame:
    """Tables by full-match, case-insensitive patterns. Exclusion wins, an explicit list beats patterns, and
    ``hidden`` names (of metadata) never show."""
    name = F.col("table_name")
    if tables is not None:
        keep = F.lower(name).isin([t.lower() for t in tables])
    else:
        keep = (matches(name, include) if include else F.lit(True)) & ~matches(name, exclude or [])
    return catalog.where(keep & ~F.lower(name).isin([h.lower() for h in hidden or []]))
