"""Column profiles and discovery of keys, links and models from data and names."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultline.functions.running import neighbours

# Type prefixes with their types (the first that fits counts), names and prefixes of system columns, names and
# suffixes of keys, and patterns of column names by rate of change.
TYPES = [
    ("timestamp", "timestamp"),
    ("datetime", "timestamp"),
    ("date", "date"),
    ("uuid", "uuid"),
    ("json", "json"),
    ("bool", "boolean"),
    ("varchar", "string"),
    ("char", "string"),
    ("string", "string"),
    ("text", "string"),
    ("bigint", "integer"),
    ("int", "integer"),
    ("smallint", "integer"),
    ("tinyint", "integer"),
    ("long", "integer"),
    ("decimal", "float"),
    ("numeric", "float"),
    ("double", "float"),
    ("float", "float"),
]
SYSTEM_NAMES = [
    "record_source", "load_date", "load_datetime", "load_ts", "loaded_at", "dl_loaded_at", "dl_load_date", "dl_load_ts", "ingestion_timestamp", "ingest_ts",
    "etl_load_ts", "_loaded_at", "created_at", "updated_at", "modified_at", "deleted_at", "sys_created_on", "sys_updated_on", "sys_mod_count",
]
SYSTEM_PREFIXES = ["__$", "_dl_", "dl__"]
KEY_NAMES = ["mrid", "id", "uuid"]
KEY_SUFFIXES = ["_mrid", "_id", "_key", "_uuid"]
HINT_NAMES = ["mrid", "sys_id", "guid", "uuid", "uid"]
HINT_SUFFIXES = ["_id", "id", "_key", "_guid", "_uuid"]
OPERATIONAL = [
    "^status$", "_status$", "^state$", "_state$", "^connected$", "^is_[a-z0-9_]+$", "^has_[a-z0-9_]+$", "_flag$", "^flag$", "^active$", "^enabled$", "^in_service$",
    "^operational$", "^current_[a-z0-9_]+$", "^last_[a-z0-9_]+_at$", "^heartbeat$", "_state_at$",
]
MEASUREMENTS = [
    "_reading$", "_value$", "_kw$", "_kwh$", "_kva$", "_mva$", "_mvar$", "_amps?$", "_volts?$", "_celsius$", "_fahrenheit$", "_pressure$", "_temperature$", "_count$",
    "_total$", "^load_[a-z0-9_]+$", "^measure[d]?_[a-z0-9_]+$",
]
NEVER_PAYLOAD = ["^load_dts$", "^load_date$", "^record_source$", "^cdc_flag$", "^effective_from$", "^start_date$", "^end_date$", "^dl_[a-z0-9_]+$", "^__[a-z0-9_]+$"]
KEY_LIKE = 0.95


def profile(df: DataFrame, columns: list[str] | None = None, samples: int = 0, exact: bool = True) -> DataFrame:
    """One row per column: rows, nulls, distinct values, null rate, cardinality ratio, likely-key flag and (if asked for) the least distinct values.

    One aggregation over the whole table. ``exact`` counts of many columns expand each row by the number of columns, into a number and a text
    each, so what a task groups is as narrow as one value; for wide or large tables ask for approximate ones.
    """
    names = columns or df.columns
    text = {c: F.col(f"`{c}`") if not df.schema[c].dataType.typeName() in ("array", "map", "struct") else F.to_json(F.col(f"`{c}`")) for c in names}
    rows = df.select(*(text[c].alias(c) for c in names))
    if exact:
        values = F.array(*(F.struct(F.lit(i).alias("at"), same_text(rows, c).alias("value")) for i, c in enumerate(names)))
        each = rows.select(F.inline(values)).groupBy("at", "value").agg(F.count("*").alias("n"))
        nulls = F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0))
        counts = each.groupBy("at").agg(F.sum("n").alias("n_rows"), nulls.alias("n_nulls"), F.count("value").alias("n_distinct"))
        one = counts.agg(F.map_from_entries(F.collect_list(F.struct("at", F.struct("n_rows", "n_nulls", "n_distinct")))).alias("found"))  # a row for each column
        count = lambda i, k: F.coalesce(F.col("found")[i][k], F.lit(0).cast("long")).alias(k)
        cells = [F.struct(F.lit(c).alias("column_name"), *(count(i, k) for k in ("n_rows", "n_nulls", "n_distinct"))) for i, c in enumerate(names)]
    else:
        one = rows.agg(F.count("*").alias("n"), *(F.count(F.col(f"`{c}`")).alias(f"k{i}") for i, c in enumerate(names)), *(F.approx_count_distinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(names)))
        cells = [F.struct(F.lit(c).alias("column_name"), F.col("n").alias("n_rows"), (F.col("n") - F.col(f"k{i}")).alias("n_nulls"), F.col(f"d{i}").alias("n_distinct")) for i, c in enumerate(names)]
    out = one.select(F.inline(F.array(*cells)))
    known = F.col("n_rows") - F.col("n_nulls")
    out = out.withColumns({
        "null_rate": F.when(F.col("n_rows") == 0, 0.0).otherwise(F.round(F.col("n_nulls") / F.col("n_rows"), 6)),
        "cardinality_ratio": F.when(known == 0, 0.0).otherwise(F.round(F.col("n_distinct") / known, 6)),
    })
    out = out.withColumn("is_likely_key", likely_key())
    return out.join(sample_values(rows, names, samples), "column_name", "left") if samples else out


def same_text(df: DataFrame, column: str) -> Column:
    """A text that is equal just for equal values of this column."""
    kind, value = df.schema[column].dataType.typeName(), F.col(f"`{column}`")
    if kind in ("float", "double"):
        return (value + F.lit(0.0).cast(kind)).cast("string")  # zero has two signs
    return (F.unix_micros(value) if kind == "timestamp" else value).cast("string")


def likely_key(system: Column | None = None) -> Column:
    ok = (F.col("n_rows") > 0) & (F.col("n_nulls") == 0) & (F.col("cardinality_ratio") >= 0.99)
    return ok if system is None else ok & ~system


def sample_values(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """The ``n`` least distinct values of each column as text of at most 200 characters, ``<empty>`` for empty ones.

    Each task keeps the least ``n`` of every column, so tasks x columns x n values are shuffled and no row is expanded by its columns.
    """
    shown = df.select(*(F.when(F.col(f"`{c}`").cast("string") == "", "<empty>").otherwise(F.substring(F.col(f"`{c}`").cast("string"), 1, 200)).alias(c) for c in columns))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [pa.array([], pa.string())] * len(columns)
        for batch in batches:
            for i, values in enumerate(batch.columns):
                known = pc.unique(pa.chunked_array([best[i], pc.drop_null(values).cast(pa.string())]))
                best[i] = known.take(pc.array_sort_indices(known)).slice(0, n)
        rows = [(c, v) for c, values in zip(columns, best) for v in values.to_pylist()]
        yield pa.record_batch([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], ["column_name", "value"])

    rank = F.row_number().over(Window.partitionBy("column_name").orderBy("value"))
    few = shown.mapInArrow(least, "column_name string, value string").distinct().withColumn("r", rank).where(F.col("r") <= n)
    return few.groupBy("column_name").agg(F.array_sort(F.collect_list("value")).alias("samples"))


#: Sketches of 2^SKETCH cells; their relative error is below SKETCH_ERROR in 95 of 100 cases.
SKETCH = 14
SKETCH_ERROR = 2 * 1.04 / 2 ** (SKETCH / 2)


def part_profiles(df: DataFrame, part: str, columns: list[str] | None = None) -> DataFrame:
    """For each value of ``part`` (a date, a batch) and each column: part, column_name, n_rows, n_nulls and a sketch of distinct values.

    One aggregation with a bounded buffer a column: rows are not expanded. Keep the result beside the table; a new part's rows are
    added to it and no other part is read again.
    """
    names = [c for c in columns or df.columns if c != part]
    kind = {c: df.schema[c].dataType.typeName() for c in names}
    value = {c: F.to_json(F.col(f"`{c}`")) if kind[c] in ("array", "map", "struct") else F.col(f"`{c}`").cast("string") for c in names}
    counted = [F.count(F.col(f"`{c}`")).alias(f"k{i}") for i, c in enumerate(names)]
    sketched = [F.hll_sketch_agg(value[c], F.lit(SKETCH)).alias(f"s{i}") for i, c in enumerate(names)]
    one = df.groupBy(F.col(f"`{part}`").cast("string").alias("part")).agg(F.count("*").alias("n"), *counted, *sketched)
    cells = [F.struct(F.lit(c).alias("column_name"), F.col("n").alias("n_rows"), (F.col("n") - F.col(f"k{i}")).alias("n_nulls"), F.col(f"s{i}").alias("sketch")) for i, c in enumerate(names)]
    return one.select("part", F.inline(F.array(*cells)))


def merged_profile(parts: DataFrame) -> DataFrame:
    """The profile of all parts' rows together from their sketches, with ``n_distinct_error`` (of 95 cases in 100).

    ``is_likely_key`` takes a column whose ratio may reach the limit within that error; ask ``profile`` for just these columns to be sure.
    """
    total = parts.groupBy("column_name").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_nulls").alias("n_nulls"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
    known = F.col("n_rows") - F.col("n_nulls")
    rates = {
        "n_distinct": F.least("estimate", known), "n_distinct_error": F.ceil(F.col("estimate") * SKETCH_ERROR).cast("long"),
        "null_rate": F.when(F.col("n_rows") == 0, 0.0).otherwise(F.round(F.col("n_nulls") / F.col("n_rows"), 6)),
        "cardinality_ratio": F.when(known == 0, 0.0).otherwise(F.round(F.least("estimate", known) / known, 6)),
    }
    reach = F.col("cardinality_ratio") * (1 + SKETCH_ERROR) >= 0.99
    return total.withColumns(rates).withColumn("is_likely_key", (F.col("n_rows") > 0) & (F.col("n_nulls") == 0) & reach).drop("estimate")


def infer_type(column: Column) -> Column:
    text = F.lower(F.trim(column))
    out = F.when(text.isNull(), "unknown")
    for prefix, kind in TYPES:
        out = out.when(text.startswith(prefix), kind)
    return out.otherwise("unknown")


def starts(column: Column, prefixes: list[str]) -> Column:
    return reduce(Column.__or__, (column.startswith(p) for p in prefixes))


def ends(column: Column, suffixes: list[str]) -> Column:
    return reduce(Column.__or__, (column.endswith(x) for x in suffixes))


def is_system(column: Column, override: Column | None = None) -> Column:
    name = F.lower(F.trim(column))
    flag = F.coalesce(name.isin(SYSTEM_NAMES) | starts(name, SYSTEM_PREFIXES), F.lit(False))
    return flag if override is None else F.coalesce(override, flag)


def detect_bk(catalog: DataFrame) -> DataFrame:
    """Each table's business key by name: the first column of an exact name, else the first with a key's suffix, else null."""
    name = F.lower("column_name")
    tier = F.when(name.isin(KEY_NAMES), 0).when(ends(name, KEY_SUFFIXES), 1)
    best = F.min(F.when(tier.isNotNull(), F.struct(tier.alias("tier"), "ordinal", "column_name")))
    return catalog.groupBy("system_id", "table_name").agg(best["column_name"].alias("business_key"))


def pick_bk(catalog: DataFrame, profiles: DataFrame) -> DataFrame:
    """Each table's key among columns that are no system columns: the first likely key, else of a key's name, else with a key's
    suffix, else the first column; null where a table has none."""
    flags = profiles.select("table_name", "column_name", "is_likely_key")
    rows = catalog.join(flags, ["table_name", "column_name"], "left")
    name = F.lower("column_name")
    tier = F.when(F.coalesce("is_likely_key", F.lit(False)), 0).when(name.isin(HINT_NAMES), 1).when(ends(name, HINT_SUFFIXES), 2).otherwise(3)
    best = F.min(F.when(~is_system(F.col("column_name")), F.struct(tier.alias("rank"), "ordinal", "column_name")))
    return rows.groupBy("system_id", "table_name").agg(best["column_name"].alias("business_key"), best["rank"].alias("rank"))


def singular(column: Column) -> Column:
    name = F.lower(column)
    cut = lambda n: F.substring(name, F.lit(1), F.length(name) - n)
    long = F.length(name) > 3
    return F.when(name.endswith("ies") & long, F.concat(cut(3), F.lit("y"))).when(name.endswith("ses") & long, cut(2)).when(name.endswith("s") & ~name.endswith("ss"), cut(1)).otherwise(name)


def detect_fk(catalog: DataFrame, prefix: str = r"^[a-z]_") -> DataFrame:
    """Columns named for another table (``customer_id``, ``customerid``, ``customer_key``, ``custkey`` by table prefix left away)."""
    tables = catalog.select("system_id", F.col("table_name").alias("parent_table"), singular(F.col("table_name")).alias("stem")).distinct()
    names = tables.withColumn("fk_name", F.explode(F.array(*(F.concat("stem", F.lit(s)) for s in ("_id", "id", "_key", "key")))))
    columns = catalog.withColumn("fk_name", F.regexp_replace(F.lower("column_name"), prefix, ""))
    joined = columns.join(names, ["system_id", "fk_name"]).where("table_name <> parent_table")
    return joined.select("system_id", "table_name", "column_name", "parent_table").distinct()


def inclusion(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """How many distinct child values a candidate parent key has."""
    values = child.select(F.col(child_key).alias("k")).where("k is not null").distinct()
    known = parent.select(F.col(parent_key).alias("k"), F.lit(1).alias("hit")).where("k is not null").distinct()
    out = values.join(known, "k", "left").agg(F.count("*").alias("child_values"), F.count("hit").alias("found"))
    return out.withColumn("included", (F.col("child_values") > 0) & (F.col("found") == F.col("child_values")))


def comparable(df: DataFrame, column: str) -> Column:
    """A text that is equal for equal values of two columns whose types can be compared, and never equal for others."""
    kind, value = df.schema[column].dataType.typeName(), F.col(f"`{column}`")
    if kind in ("byte", "short", "integer", "long"):
        return F.concat(F.lit("i"), value.cast("string"))
    if kind in ("float", "double", "decimal"):
        return F.concat(F.lit("d"), value.cast("double").cast("string"))
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.concat(F.lit("t"), value.cast("timestamp_ntz").cast("string"))
    return F.concat(F.lit("s"), F.to_json(value) if kind in ("array", "map", "struct") else value.cast("string"))


def inclusions(tables: dict[str, DataFrame], columns: dict[str, list[str]] | None = None) -> DataFrame:
    """Inclusion of every column in every other at once: child_table, child_column, parent_table, parent_column, child_values, found,
    included, for pairs that share a value.

    Each table is read once. A distinct value becomes the set of columns that hold it, equal sets are counted, and a pair's shared values
    are the counts of the sets that have both: columns meet by sets, never values by pairs.
    """
    names, long = [], None
    for t, df in tables.items():
        own = (columns or {}).get(t, df.columns)
        cells = F.array(*(F.struct(F.lit(len(names) + i).alias("at"), comparable(df, c).alias("value")) for i, c in enumerate(own)))
        one = df.select(F.inline(cells)).where("value is not null").distinct()
        names += [(t, c) for c in own]
        long = one if long is None else long.unionByName(one)
    sets = long.groupBy("value").agg(F.array_sort(F.collect_set("at")).alias("holders")).groupBy("holders").agg(F.count("*").alias("n"))
    held = sets.select("n", "holders", F.explode("holders").alias("child"))
    pairs = held.select("n", "child", F.explode("holders").alias("parent")).groupBy("child", "parent").agg(F.sum("n").alias("found"))
    sizes = pairs.where("child = parent").select("child", F.col("found").alias("child_values"))
    label = lambda at, k: F.array(*(F.lit(n[k]) for n in names))[F.col(at)]
    each = pairs.where("child <> parent").join(F.broadcast(sizes), "child")  # a row for each column at most
    return each.select(
        label("child", 0).alias("child_table"), label("child", 1).alias("child_column"), label("parent", 0).alias("parent_table"), label("parent", 1).alias("parent_column"),
        "child_values", "found", (F.col("found") == F.col("child_values")).alias("included"),
    )


def classify_columns(catalog: DataFrame, keys: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """details, operational or measurements (numbers only) for each payload column. Left out: ``keys`` (table_name, column_name, in
    either case), system columns, and columns whose profile is a key's."""
    name, any_of = F.lower("column_name"), lambda patterns: F.lower("column_name").rlike("|".join(patterns))
    measured = any_of(MEASUREMENTS) & infer_type(F.col("raw_dtype")).isin("integer", "float")
    bucket = F.when(any_of(OPERATIONAL), "operational").when(measured, "measurements").otherwise("details")
    left_out = keys.where("column_name is not null").select("table_name", F.lower("column_name").alias("_name")).distinct()
    rows = catalog.withColumn("_name", name).join(left_out, ["table_name", "_name"], "left_anti")
    if profiles is not None:
        unique = profiles.where(F.col("is_likely_key") | (F.col("cardinality_ratio") >= KEY_LIKE)).select("table_name", "column_name").distinct()
        rows = rows.join(unique, ["table_name", "column_name"], "left_anti")
    own = rows.where(~is_system(F.col("column_name")) & ~any_of(NEVER_PAYLOAD))
    return own.select("system_id", "table_name", "ordinal", "column_name", bucket.alias("bucket"))


def split_hint(classified: DataFrame) -> DataFrame:
    """Per table the columns of each bucket, and whether to split: two changing columns and a detail at least."""
    own = lambda b: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("bucket") == b, F.struct("ordinal", "column_name")))), lambda x: x["column_name"]), ",")
    n = lambda b: F.sum((F.col("bucket") == b).cast("int"))
    changing = F.greatest(n("operational"), n("measurements")) >= 2
    velocity = F.when(n("measurements") >= 2, "high").when(n("operational") >= 2, "medium").otherwise("low")
    return classified.groupBy("system_id", "table_name").agg(
        own("details").alias("details"), own("operational").alias("operational"), own("measurements").alias("measurements"),
        (changing & (n("details") >= 1)).alias("split"), velocity.alias("velocity"),
    )


def change_rate(stg: DataFrame, key: str, ldts: str, columns: list[str], order: list[str], stretches: int = 1) -> DataFrame:
    """For each column, in which share of a key's later versions it differs from the version before (``order`` leaves no ties). With ``stretches``
    above 1 a key's many versions are dealt out over so many tasks."""
    rows = stg.select(key, ldts, *(c for c in dict.fromkeys([*order, *columns]) if c not in (key, ldts)), F.lit(1).alias("_row"))
    near = neighbours(rows, [key], [ldts, *order], {"_later": "_row"} | {f"_before_{c}": c for c in columns}, {}, stretches)
    one = near.where("_later is not null").agg(*(F.avg((~F.col(c).eqNullSafe(F.col(f"_before_{c}"))).cast("int")).alias(c) for c in columns))
    return one.unpivot([], columns, "column_name", "rate").select("column_name", F.round("rate", 6).alias("change_rate"))


def picked_once(keys: DataFrame) -> DataFrame:
    """A row for each table of the catalog, brought to the driver: a plan that names the keys twice would profile the tables twice."""
    return keys.sparkSession.createDataFrame(keys.collect(), keys.schema)


def infer_model(catalog: DataFrame, profiles: DataFrame) -> DataFrame:
    """A rule-based model: a hub per table, a link per foreign key, one satellite of the rest.

    kind, name, source_table, columns: the key, the two hubs' tables, or the payload in column order.
    """
    keys = picked_once(pick_bk(catalog, profiles))
    fks = detect_fk(catalog)
    hubs = keys.select(F.lit("hub").alias("kind"), F.concat(F.lit("hub_"), "table_name").alias("name"), F.col("table_name").alias("source_table"), F.col("business_key").alias("columns"))
    links = fks.select(F.lit("link").alias("kind"), F.concat(F.lit("link_"), "table_name", F.lit("_"), "parent_table").alias("name"), F.col("table_name").alias("source_table"), F.concat_ws(",", "table_name", "parent_table").alias("columns")).distinct()
    used = keys.select("table_name", F.col("business_key").alias("column_name")).unionByName(fks.select("table_name", "column_name"))
    rest = catalog.join(used.distinct(), ["table_name", "column_name"], "left_anti").where(~is_system(F.col("column_name")))
    payload = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "column_name"))), lambda x: x["column_name"]), ",")
    sats = rest.groupBy("table_name").agg(payload.alias("columns")).select(F.lit("sat").alias("kind"), F.concat(F.lit("sat_"), "table_name").alias("name"), F.col("table_name").alias("source_table"), "columns")
    return hubs.unionByName(links).unionByName(sats)
