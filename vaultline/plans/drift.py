"""Schema snapshots, their differences, and what the differences put at risk: joins over catalog tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Name prefixes of vault entities, longest meaning first.
PREFIXES = [
    ("hub_", "hub"), ("lnk_", "link"), ("link_", "link"), ("eff_sat_", "eff_sat"), ("bv_sat_", "bv_sat"), ("ma_sat_", "ma_sat"), ("sat_", "sat"),
    ("pit_", "pit"), ("bridge_", "bridge"), ("br_", "bridge"), ("dim_", "dim"), ("fct_", "fact"), ("fact_", "fact"), ("stg_", "staging"), ("brz_", "bronze"),
]
LOSSLESS = [("tinyint", "smallint"), ("tinyint", "int"), ("tinyint", "bigint"), ("smallint", "int"), ("smallint", "bigint"), ("int", "bigint"), ("int", "decimal(38,0)"), ("bigint", "decimal(38,0)"), ("float", "double"), ("date", "timestamp")]
COSTS = {"missed": 5, "false_alarm": 1, "other": 1}
IMPACTS = ["additive", "cosmetic", "breaking"]


def entity_kind(name: Column) -> Column:
    text = F.lower(name)
    out = F.when(text.isNull(), "unknown")
    for prefix, kind in PREFIXES:
        out = out.when(text.startswith(prefix), kind)
    return out.otherwise("unknown")


def stem(name: Column) -> Column:
    """The lower-case name without its vault prefix."""
    return F.regexp_replace(F.lower(name), "^(" + "|".join(p for p, _ in PREFIXES) + ")", "")


def match_targets(bronze: DataFrame, vault: DataFrame) -> DataFrame:
    """The vault entity of each bronze table: that of the same stem, a hub before others, then by name."""
    entities = vault.select(F.col("table_name").alias("target"), stem(F.col("table_name")).alias("stem")).distinct()
    tables = bronze.select("table_name").distinct().withColumn("stem", stem(F.col("table_name")))
    best = F.min(F.when(F.col("target").isNotNull(), F.struct((entity_kind(F.col("target")) != "hub").alias("late"), "target")))["target"]
    return tables.join(entities, "stem", "left").groupBy("table_name").agg(best.alias("target"))


def column_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per column that was added, removed or retyped; names compare case-insensitively.

    Both have table_name, column_name, raw_dtype, is_key; columns of tables on one side only are not listed.
    """
    keyed = lambda df, p: df.select(F.lower("table_name").alias("table_name"), F.lower("column_name").alias("column_name"), F.col("raw_dtype").alias(f"{p}_dtype"), F.col("is_key").alias(f"{p}_key"), F.lit(True).alias(p))
    both = old.select(F.lower("table_name").alias("table_name")).distinct().join(new.select(F.lower("table_name").alias("table_name")).distinct(), "table_name")
    joined = keyed(old, "old").join(keyed(new, "new"), ["table_name", "column_name"], "full").join(both, "table_name", "left_semi")
    retyped = F.lower("old_dtype") != F.lower("new_dtype")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(retyped, "type_changed")
    key = F.coalesce("old_key", "new_key", F.lit(False))
    return joined.select("table_name", "column_name", change.alias("change"), "old_dtype", "new_dtype", key.alias("is_key")).where("change is not null")


def change_risk() -> Column:
    """HIGH: a key went or changed its type; MEDIUM: another column did; LOW: a column came."""
    return F.when(F.col("change").isin("removed", "type_changed", "table_removed") & F.col("is_key"), "HIGH").when(F.col("change").isin("removed", "type_changed", "table_removed"), "MEDIUM").otherwise("LOW")


def table_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Every table as NEW, ORPHANED, DRIFT or UNCHANGED, with the highest risk among its columns and counts as notes."""
    names = lambda df, p: df.select(F.lower("table_name").alias("table_name")).distinct().withColumn(p, F.lit(True))
    tables = names(old, "was").join(names(new, "is"), "table_name", "full")
    level = F.when(change_risk() == "HIGH", 3).when(change_risk() == "MEDIUM", 2).otherwise(1)
    n = lambda c: F.sum((F.col("change") == c).cast("int")).cast("long")
    diffs = column_diff(old, new).groupBy("table_name").agg(F.max(level).alias("level"), n("added").alias("added"), n("removed").alias("removed"), n("type_changed").alias("type_changed"))
    out = tables.join(diffs, "table_name", "left").na.fill(0, ["added", "removed", "type_changed"])
    category = F.when(F.col("was").isNull(), "NEW").when(F.col("is").isNull(), "ORPHANED").when(F.col("level").isNull(), "UNCHANGED").otherwise("DRIFT")
    out = out.withColumn("category", category)
    risk = F.when(F.col("category") == "ORPHANED", "MEDIUM").when(F.col("level") == 3, "HIGH").when(F.col("level") == 2, "MEDIUM").otherwise("LOW")
    return out.select("category", "table_name", risk.alias("risk"), "added", "removed", "type_changed")


def atomic_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per column change, and one per table that came or went."""
    columns = column_diff(old, new)
    tables = table_changes(old, new).where(F.col("category").isin("NEW", "ORPHANED"))
    none = F.lit(None).cast("string")
    whole = tables.select("table_name", none.alias("column_name"), F.when(F.col("category") == "NEW", "table_added").otherwise("table_removed").alias("change"), none.alias("old_dtype"), none.alias("new_dtype"), F.lit(False).alias("is_key"))
    return columns.unionByName(whole).withColumn("risk", change_risk())


def impact(changes: DataFrame, widening: bool = False) -> DataFrame:
    """additive, cosmetic or breaking for each change; with ``widening``, a lossless type change of a non-key is cosmetic."""
    rule = F.when(F.col("change").isin("added", "table_added"), "additive").when(F.col("change").isin("removed", "table_removed", "type_changed"), "breaking").otherwise("cosmetic")
    if not widening:
        return changes.withColumn("impact", rule)
    table = F.broadcast(changes.sparkSession.createDataFrame(LOSSLESS, "_old string, _new string").withColumn("_lossless", F.lit(True)))
    joined = changes.join(table, (F.lower("old_dtype") == F.col("_old")) & (F.lower("new_dtype") == F.col("_new")), "left")
    mild = (F.col("change") == "type_changed") & ~F.col("is_key") & F.col("_lossless").isNotNull()
    return joined.withColumn("impact", F.when(mild, "cosmetic").otherwise(rule)).drop("_old", "_new", "_lossless")


def score_impacts(pairs: DataFrame, by: list[str] = ()) -> DataFrame:
    """Accuracy, cost and the breaking class's precision and recall of (expert, predicted)."""
    e, p = F.col("expert"), F.col("predicted")
    cost = F.when(e == p, 0).when(e == "breaking", COSTS["missed"]).when(p == "breaking", COSTS["false_alarm"]).otherwise(COSTS["other"])
    n = lambda c: F.sum(c.cast("int"))
    hit = n((e == "breaking") & (p == "breaking"))
    return pairs.groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.avg((e == p).cast("int")), 4).alias("accuracy"), F.sum(cost).cast("long").alias("cost"),
        F.round(hit / F.nullif(n(e == "breaking"), F.lit(0)), 4).alias("breaking_recall"), F.round(hit / F.nullif(n(p == "breaking"), F.lit(0)), 4).alias("breaking_precision"),
    )


def confusion(pairs: DataFrame, classes: list) -> DataFrame:
    return pairs.groupBy("expert").pivot("predicted", classes).count().na.fill(0)


def actionable(changes: DataFrame, bronze: DataFrame) -> DataFrame:
    """Bronze tables that are NEW or DRIFT, with their columns."""
    return bronze.withColumn("table_name", F.lower("table_name")).join(changes.where(F.col("category").isin("NEW", "DRIFT")).select("table_name", "category"), "table_name")


def skipped(changes: DataFrame, samples: int = 3) -> DataFrame:
    """How many tables are skipped for each reason, and the first names."""
    rank = F.row_number().over(Window.partitionBy("category").orderBy("table_name"))
    rows = changes.where(~F.col("category").isin("NEW", "DRIFT")).withColumn("r", rank)
    few = F.array_join(F.array_sort(F.collect_list(F.when(F.col("r") <= samples, F.col("table_name")))), ",")
    return rows.groupBy("category").agg(F.count("*").alias("n_tables"), few.alias("samples"))


SIGNALS = "system_id, signal, severity, value"


def signals_of(one: DataFrame, rules: list[tuple[str, str, Column, Column]]) -> DataFrame:
    """A row for each (signal, severity, condition, value) that holds for a row of ``one``."""
    cells = [F.struct(F.lit(n).alias("signal"), F.lit(s).alias("severity"), c.alias("on"), v.cast("double").alias("value")) for n, s, c, v in rules]
    return one.select("system_id", F.inline(F.array(*cells))).where("on").drop("on")


def risk_snapshot(changes: DataFrame, atomic: DataFrame, new_tables: int = 15, drift_share: float = 0.4, orphans: bool = False) -> DataFrame:
    """Signals of change sets, many systems at once."""
    n = lambda c: F.sum((F.col("category") == c).cast("int"))
    one = changes.groupBy("system_id").agg(n("NEW").alias("new"), n("ORPHANED").alias("orphaned"), (n("DRIFT") / F.nullif(n("DRIFT") + n("UNCHANGED"), F.lit(0))).alias("share"))
    broken = atomic.groupBy("system_id").agg(F.sum((F.col("impact") == "breaking").cast("int")).alias("breaking"))
    both = one.join(broken, "system_id", "left").na.fill(0)
    rules = [
        ("many_new_tables", "MEDIUM", F.col("new") > new_tables, F.col("new")),
        ("drift_share", "MEDIUM", F.col("share") > drift_share, F.col("share")),
        ("breaking_change", "HIGH", F.col("breaking") > 0, F.col("breaking")),
    ]
    if orphans:
        rules.append(("orphans", "LOW", F.col("orphaned") > 0, F.col("orphaned")))
    return signals_of(both, rules)


def risk_plan(hubs: DataFrame, systems: DataFrame, low: float = 0.6, share: float = 0.4) -> DataFrame:
    """Signals of plans: none at all, or too many hubs of low confidence."""
    own = hubs.groupBy("system_id").agg(F.count("*").alias("n"), F.avg((F.col("confidence") < low).cast("int")).alias("low"))
    both = systems.select("system_id").distinct().join(own, "system_id", "left").na.fill(0)
    return signals_of(both, [("empty_plan", "HIGH", F.col("n") == 0, F.col("n")), ("low_confidence", "MEDIUM", F.col("low") > share, F.col("low"))])


def risk_validation(issues: DataFrame, warnings: int = 10) -> DataFrame:
    """Signals of validation reports (system_id, level)."""
    n = lambda v: F.sum((F.col("level") == v).cast("int"))
    one = issues.groupBy("system_id").agg(n("error").alias("errors"), n("warning").alias("warnings"))
    return signals_of(one, [("errors", "HIGH", F.col("errors") > 0, F.col("errors")), ("many_warnings", "MEDIUM", F.col("warnings") > warnings, F.col("warnings"))])


def recommend_gate(signals: DataFrame) -> DataFrame:
    """pause on a HIGH signal or two MEDIUM ones, else proceed; and the highest severity."""
    n = lambda v: F.sum((F.col("severity") == v).cast("int"))
    level = F.max(F.when(F.col("severity") == "HIGH", 3).when(F.col("severity") == "MEDIUM", 2).otherwise(1))
    return signals.groupBy("system_id").agg(
        F.when((n("HIGH") > 0) | (n("MEDIUM") >= 2), "pause").otherwise("proceed").alias("recommendation"),
        F.element_at(F.array(F.lit("LOW"), F.lit("MEDIUM"), F.lit("HIGH")), level).alias("severity"),
    )


def validate_spec(references: DataFrame, available: DataFrame, stages: DataFrame) -> DataFrame:
    """Issues of a specification's references (stage, entity, column_name, is_literal, in_derived).

    A column must be in its stage's source or declared earlier (``available``: stage, column_name); a stage must be declared
    (``stages``: stage); literals belong in derived columns only.
    """
    known = references.join(stages.select("stage").distinct(), "stage", "left_semi")
    unknown = references.join(stages.select("stage").distinct(), "stage", "left_anti")
    lower = lambda df: df.withColumn("key", F.lower("column_name"))
    missing = lower(known.where("not is_literal")).join(lower(available).select("stage", "key").distinct(), ["stage", "key"], "left_anti")
    issue = lambda df, text: df.select("stage", "entity", "column_name", F.lit(text).alias("issue"))
    return issue(missing, "unknown_column").unionByName(issue(unknown, "unknown_stage")).unionByName(issue(known.where("is_literal and not in_derived"), "misplaced_literal")).distinct()


def validate_structure(entities: DataFrame, hubs: DataFrame, hashes: DataFrame, technical: list[str]) -> DataFrame:
    """Issues of a specification's entities (entity, kind, parent, hashdiff, payload, strategy, on_schema_change)."""
    sats = entities.where(F.col("kind").isin("sat", "eff_sat", "bv_sat"))
    issue = lambda df, text, level: df.select("entity", F.lit(text).alias("issue"), F.lit(level).alias("level"))
    found = [
        issue(sats.join(hubs.select(F.col("hash_key").alias("parent")), "parent", "left_anti"), "orphan_satellite", "error"),
        issue(sats.where("hashdiff is not null").join(hashes.select(F.col("name").alias("hashdiff")), "hashdiff", "left_anti"), "undeclared_hashdiff", "error"),
        issue(entities.where(F.arrays_overlap(F.transform("payload", F.lower), F.array(*map(F.lit, technical)))), "technical_payload", "warning"),
        issue(entities.where((F.col("kind") == "eff_sat") & (F.col("strategy") == "append")), "append_on_merged_kind", "error"),
        issue(entities.where((F.col("strategy") == "append") & F.col("on_schema_change").isNull()), "no_on_schema_change", "warning"),
    ]
    return reduce(DataFrame.unionByName, found)


def snapshot(spark: SparkSession, catalog: DataFrame, snapshot_id: str) -> DataFrame:
    return catalog.withColumn("snapshot_id", F.lit(snapshot_id))
