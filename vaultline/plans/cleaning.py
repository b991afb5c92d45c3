"""Plan tables: merging, cleaning, voting and pruning of modelling plans, many plans at once.

hubs: system_id, run_id, name, source_table, business_keys, hash_key, confidence;
links: system_id, run_id, name, source_table, hash_key, fk_columns, confidence;
sats: system_id, run_id, name, source_table, parent_hub, hash_key, hashdiff, payload, confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLAN = ["system_id", "run_id"]
TECHNICAL = ["load_dts", "record_source", "cdc_flag", "ingested_at"]


def in_order(items: Column, value: str) -> Column:
    """The values of collected (pos, value) structs by position."""
    return F.transform(F.array_sort(items), lambda x: x[value])


def merge_named(df: DataFrame, list_column: str, keys: list[str] = (*PLAN, "name")) -> DataFrame:
    """One row per name: the first source table, the greatest confidence, the union of list members by first occurrence."""
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("source_table", F.col(list_column).cast("string")))
    rows = df.withColumn("_row", order)
    members = rows.select(*keys, "_row", F.posexplode(list_column).alias("_pos", "_member"))
    firsts = members.groupBy(*keys, "_member").agg(F.min(F.struct("_row", "_pos")).alias("_at"))
    lists = firsts.groupBy(*keys).agg(in_order(F.collect_list(F.struct("_at", "_member")), "_member").alias(list_column))
    heads = rows.groupBy(*keys).agg(F.min_by("source_table", "_row").alias("source_table"), F.max("confidence").alias("confidence"))
    return heads.join(lists, list(keys), "left")


def clean_payload(sats: DataFrame, hubs: DataFrame, links: DataFrame, technical: list[str] = TECHNICAL) -> DataFrame:
    """Satellites without payload columns that are their hub's key, a link's key of the same table, or technical."""
    keys = hubs.select(*PLAN, "source_table", F.explode("business_keys").alias("column_name"))
    fks = links.select(*PLAN, "source_table", F.explode("fk_columns").alias("column_name"))
    drop = keys.unionByName(fks).withColumn("column_name", F.lower("column_name")).distinct()
    at = [*PLAN, "name"]
    exploded = sats.select(*at, "source_table", F.posexplode("payload").alias("pos", "original")).withColumn("column_name", F.lower("original"))
    kept = exploded.where(~F.col("column_name").isin(technical)).join(drop, [*PLAN, "source_table", "column_name"], "left_anti")
    lists = kept.groupBy(*at).agg(in_order(F.collect_list(F.struct("pos", "original")), "original").alias("_payload"))
    return sats.join(lists, at, "left").withColumn("payload", F.coalesce("_payload", F.array().cast("array<string>"))).drop("_payload")


def enforce(hubs: DataFrame, links: DataFrame, sats: DataFrame, most: int = 3) -> DataFrame:
    """The satellites that may stay: no hub's or link's name, a known parent, a payload, at most ``most`` for each hub."""
    taken = hubs.select(*PLAN, "name").unionByName(links.select(*PLAN, "name")).distinct()
    own = sats.where(F.size("payload") > 0).join(taken, [*PLAN, "name"], "left_anti")
    own = own.join(hubs.select(*PLAN, F.col("hash_key").alias("parent_hub")).distinct(), [*PLAN, "parent_hub"], "left_semi")
    rank = F.row_number().over(Window.partitionBy(*PLAN, "parent_hub").orderBy("name"))
    return own.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank").select(*sats.columns)


def split_meta(sats: DataFrame) -> DataFrame:
    """subgroup and change_velocity from a satellite name's last part."""
    suffix = F.regexp_extract("name", "_(details|operational|measurements)$", 1)
    velocity = F.when(suffix == "measurements", "high").when(suffix == "operational", "medium").when(suffix == "details", "low")
    return sats.withColumns({"subgroup": F.when(suffix != "", suffix), "change_velocity": velocity})


def merge_plans(batches: DataFrame, hubs: DataFrame | None = None) -> DataFrame:
    """One row per name over batches (column ``batch``), the earliest batch's; satellites whose parent no hub has are dropped."""
    rest = [c for c in batches.columns if c not in (*PLAN, "name")]
    best = batches.groupBy(*PLAN, "name").agg(F.min_by(F.struct(*rest), F.struct("batch", "source_table")).alias("_row"))
    out = best.select(*PLAN, "name", *(F.col(f"_row.{c}").alias(c) for c in rest))
    return out if hubs is None else out.join(hubs.select(*PLAN, F.col("hash_key").alias("parent_hub")).distinct(), [*PLAN, "parent_hub"], "left_semi")


def named_objects(hubs: DataFrame, links: DataFrame, sats: DataFrame) -> DataFrame:
    one = lambda df, kind: df.select(*PLAN, F.lit(kind).alias("kind"), F.lower("name").alias("name"))
    return one(hubs, "hub").unionByName(one(links, "link")).unionByName(one(sats, "sat"))


def fingerprint(objects: DataFrame) -> DataFrame:
    """A hash of each plan's sorted names by kind."""
    names = F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "kind", F.lower("name")))), "|")
    return objects.groupBy(*PLAN).agg(F.sha2(names, 256).alias("fingerprint"), F.count("*").alias("n_objects"))


def vote(prints: DataFrame, confidence: DataFrame) -> DataFrame:
    """Each system's winning run: the most frequent fingerprint, then the greatest sum of confidences, then the least run."""
    n = F.count("*").over(Window.partitionBy("system_id", "fingerprint"))
    rows = prints.join(confidence, PLAN, "left").withColumns({"votes": n, "total": F.coalesce("total", F.lit(0.0))})
    rank = F.row_number().over(Window.partitionBy("system_id").orderBy(F.desc("votes"), F.desc("total"), "run_id"))
    return rows.withColumn("_r", rank).where("_r = 1").select("system_id", "run_id", "fingerprint", "votes")


def prune_links(links: DataFrame, hubs: DataFrame) -> DataFrame:
    """Links with two distinct hubs at least, no unresolved key, and no other link (of a lesser name) over the same hubs."""
    keys = links.select(*PLAN, "name", F.explode(F.array_distinct("fk_columns")).alias("hash_key"))
    known = hubs.select(*PLAN, "hash_key", F.lit(1).alias("hit")).distinct()
    checked = keys.join(known, [*PLAN, "hash_key"], "left").groupBy(*PLAN, "name").agg(F.count("*").alias("n"), F.count("hit").alias("found"), F.array_join(F.array_sort(F.collect_set("hash_key")), "|").alias("hubs"))
    rank = F.row_number().over(Window.partitionBy(*PLAN, "hubs").orderBy("name"))
    kept = checked.where((F.col("n") >= 2) & (F.col("n") == F.col("found"))).withColumn("_r", rank).where("_r = 1")
    return links.join(kept.select(*PLAN, "name"), [*PLAN, "name"], "left_semi")


def restore_keys(new: DataFrame, old: DataFrame) -> DataFrame:
    """Reviewed hubs with the business keys that their namesakes had before."""
    before = old.select(*PLAN, "name", F.col("business_keys").alias("_keys"))
    return new.join(before, [*PLAN, "name"], "left").withColumn("business_keys", F.coalesce("_keys", "business_keys")).drop("_keys")


def shrink_ok(old: DataFrame, new: DataFrame, share: float = 0.7, tolerated: int = 1) -> DataFrame:
    """Whether a reviewed plan keeps enough of each class: ``share`` of it, or all but ``tolerated``."""
    count = lambda df, n: df.groupBy(*PLAN, "kind").agg(F.count("*").alias(n))
    both = count(old, "before").join(count(new, "after"), [*PLAN, "kind"], "left").na.fill(0, ["after"])
    ok = (F.col("after") >= share * F.col("before")) | (F.col("before") - F.col("after") <= tolerated)
    return both.groupBy(*PLAN).agg(F.bool_and(ok).alias("accepted"))


def explode_plan(hubs: DataFrame, links: DataFrame, sats: DataFrame) -> DataFrame:
    """One example row per object: kind, name, source table and its columns."""
    one = lambda df, kind, c: df.select(*PLAN, F.lit(kind).alias("kind"), "name", "source_table", F.array_join(c, ",").alias("columns"))
    return one(hubs, "hub", "business_keys").unionByName(one(links, "link", "fk_columns")).unionByName(one(sats, "sat", "payload"))
