"""Scores of modelling plans: conformance, coverage, grounding, gold models, studies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultline.plans.cleaning import PLAN, TECHNICAL, named_objects

# Types of issues, names and suffixes of keys that are surrogates.
ISSUES = [
    "naming", "hash_key_naming", "surrogate_business_key", "link_under_two_hubs", "link_fk_unresolved", "satellite_orphan", "satellite_empty_payload", "payload_key_leak",
    "hub_without_satellite", "empty_plan",
]
SURROGATE_KEYS = ["id", "sys_id", "guid", "uuid", "pk", "oid", "sk", "rowid"]
SURROGATE_SUFFIXES = ["_id", "_sk", "_key", "_guid", "_uuid"]


def rules_of(df: DataFrame, kind: str, rules: list[tuple[str, Column]]) -> DataFrame:
    cells = [F.struct(F.lit(n).alias("issue"), F.coalesce(bad, F.lit(True)).alias("bad")) for n, bad in rules]
    return df.select(*PLAN, F.lit(kind).alias("kind"), "name", F.inline(F.array(*cells)))


def surrogate(key: Column) -> Column:
    name = F.lower(key)
    return reduce(Column.__or__, (name.endswith(x) for x in SURROGATE_SUFFIXES), name.isin(SURROGATE_KEYS))


def all_plans(hubs: DataFrame, links: DataFrame, sats: DataFrame, plans: DataFrame | None = None) -> DataFrame:
    """Every plan that has an object, and those of ``plans`` (which may have none)."""
    return reduce(DataFrame.unionByName, (df.select(*PLAN) for df in (hubs, links, sats, plans) if df is not None)).distinct()


def checks(
    hubs: DataFrame, links: DataFrame, sats: DataFrame, technical: list[str] = TECHNICAL, plans: DataFrame | None = None, parent: str = "hash_key", hub: str = "hub_", link: str = "link_",
    sat: tuple[str, ...] = ("sat_", "eff_sat_"), key: str = "HK_", diff: str = "HD_",
) -> DataFrame:
    """Every rule of every object: kind, name, issue, bad. A plan has one rule (kind plan, no name), a hub and a link four, a
    satellite five. ``parent`` is the column of hubs that ``parent_hub`` holds. Prefixes are parameters."""
    found = hubs.select(*PLAN, F.lit(True).alias("_hubs")).distinct()
    owned = sats.select(*PLAN, F.col("parent_hub").alias(parent), F.lit(True).alias("_described")).distinct()
    cells = links.select(*PLAN, "name", F.explode("fk_columns").alias("hash_key")).join(hubs.select(*PLAN, "hash_key", F.lit(True).alias("_known")).distinct(), [*PLAN, "hash_key"], "left")
    loose = cells.where(F.col("_known").isNull()).select(*PLAN, "name", F.lit(True).alias("_loose")).distinct()
    lower = lambda c: F.transform(c, F.lower)
    keys = hubs.groupBy(*PLAN, F.col(parent).alias("parent_hub")).agg(F.flatten(F.collect_list(lower("business_keys"))).alias("_keys"))
    leak = F.arrays_overlap(lower("payload"), F.concat(F.coalesce("_keys", F.array().cast("array<string>")), F.array(*map(F.lit, technical))))
    starts = lambda column, prefixes: reduce(Column.__or__, (F.col(column).startswith(p) for p in prefixes))
    return (
        rules_of(all_plans(hubs, links, sats, plans).join(found, PLAN, "left").withColumn("name", F.lit("")), "plan", [("empty_plan", F.col("_hubs").isNull())])
        .unionByName(rules_of(hubs.join(owned, [*PLAN, parent], "left"), "hub", [
            ("naming", ~starts("name", [hub])), ("hash_key_naming", ~starts("hash_key", [key])),
            ("surrogate_business_key", (F.size("business_keys") > 0) & F.forall("business_keys", surrogate)), ("hub_without_satellite", F.col("_described").isNull()),
        ]))
        .unionByName(rules_of(links.join(loose, [*PLAN, "name"], "left"), "link", [
            ("naming", ~starts("name", [link])), ("hash_key_naming", ~starts("hash_key", [key])), ("link_under_two_hubs", F.size("fk_columns") < 2), ("link_fk_unresolved", F.col("_loose").isNotNull()),
        ]))
        .unionByName(rules_of(sats.join(keys, [*PLAN, "parent_hub"], "left"), "sat", [
            ("naming", ~starts("name", list(sat))), ("hash_key_naming", ~starts("hashdiff", [diff])), ("satellite_orphan", F.col("_keys").isNull()),
            ("satellite_empty_payload", F.size("payload") == 0), ("payload_key_leak", leak),
        ]))
    )


def conformance(checked: DataFrame) -> DataFrame:
    return checked.groupBy(*PLAN).agg(F.round(F.avg((~F.col("bad")).cast("int")), 6).alias("conformance"), F.sum(F.col("bad").cast("int")).cast("long").alias("n_issues"))


def issues_by_type(checked: DataFrame) -> DataFrame:
    """How often each issue occurs, zero included."""
    types = F.broadcast(checked.sparkSession.createDataFrame([(i,) for i in ISSUES], "issue string"))
    return types.join(checked.where("bad").groupBy("issue").agg(F.count("*").alias("n")), "issue", "left").na.fill(0, ["n"])


def coverage(objects: DataFrame, tables: DataFrame) -> DataFrame:
    """Per plan, the share of its system's source tables with an object, and the uncovered ones. objects: PLAN, source_table."""
    plans = objects.select(*PLAN).distinct()
    wanted = plans.join(tables.select("system_id", "source_table").distinct(), "system_id")
    used = objects.select(*PLAN, "source_table", F.lit(1).alias("hit")).distinct()
    both = wanted.join(used, [*PLAN, "source_table"], "left")
    missing = F.array_join(F.array_sort(F.collect_list(F.when(F.col("hit").isNull(), F.col("source_table")))), ",")
    return both.groupBy(*PLAN).agg(F.round(F.count("hit") / F.count("*"), 4).alias("coverage"), missing.alias("uncovered"))


def blast_radius(hubs: DataFrame, links: DataFrame, sats: DataFrame) -> DataFrame:
    """How many links and satellites depend on each hub."""
    used = links.select(*PLAN, F.explode(F.array_distinct("fk_columns")).alias("hash_key")).unionByName(sats.select(*PLAN, F.col("parent_hub").alias("hash_key")))
    counts = used.groupBy(*PLAN, "hash_key").agg(F.count("*").alias("radius"))
    return hubs.select(*PLAN, "name", "hash_key").join(counts, [*PLAN, "hash_key"], "left").na.fill(0, ["radius"])


def hotspots(radius: DataFrame, n: int) -> DataFrame:
    return radius.orderBy(F.desc("radius"), "name", *PLAN).limit(n)


def weighted_impact(wrong: DataFrame, radius: DataFrame) -> DataFrame:
    """Sum over wrong objects (PLAN, name) of one plus their radius."""
    joined = wrong.join(radius.select(*PLAN, "name", "radius"), [*PLAN, "name"], "left")
    return joined.groupBy(*PLAN).agg(F.sum(1 + F.coalesce("radius", F.lit(0))).cast("long").alias("weighted_impact"))


def references(hubs: DataFrame, links: DataFrame, sats: DataFrame) -> DataFrame:
    """Every table and column that a plan names: kind, source_table, column_name (null for the table itself)."""
    objects = [hubs, links, sats]
    none = F.lit(None).cast("string")
    tables = [df.select(*PLAN, F.lit("table").alias("kind"), F.lower("source_table").alias("source_table"), none.alias("column_name")) for df in objects]
    columns = [
        df.select(*PLAN, F.lit(kind).alias("kind"), F.lower("source_table").alias("source_table"), F.explode(c).alias("column_name")).withColumn("column_name", F.lower("column_name"))
        for df, kind, c in ((hubs, "key", "business_keys"), (sats, "payload", "payload"))
    ]
    return reduce(DataFrame.unionByName, tables + columns)


def grounding(refs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Shares of references that exist; fabricated tables and keys are structural. catalog: system_id, table_name, column_name."""
    tables = catalog.select("system_id", F.lower("table_name").alias("source_table"), F.lit(1).alias("t")).distinct()
    columns = catalog.select("system_id", F.lower("table_name").alias("source_table"), F.lower("column_name").alias("column_name"), F.lit(1).alias("c")).distinct()
    joined = refs.join(tables, ["system_id", "source_table"], "left").join(columns, ["system_id", "source_table", "column_name"], "left")
    known = F.when(F.col("kind") == "table", F.col("t").isNotNull()).otherwise(F.col("c").isNotNull())
    n = lambda c: F.sum(c.cast("int")).cast("long")
    return joined.withColumn("known", known).groupBy(*PLAN).agg(
        F.count("*").alias("n_references"), F.round(F.avg(F.col("known").cast("int")), 4).alias("grounding"), F.round(F.avg((~F.col("known")).cast("int")), 4).alias("hallucination"),
        n(~F.col("known") & (F.col("kind") != "payload")).alias("structural"), n(~F.col("known") & (F.col("kind") == "payload")).alias("fabricated_payload"),
    )


def matched(hubs: DataFrame, gold: DataFrame, plans: DataFrame | None = None) -> DataFrame:
    """Plan hubs and gold hubs side by side, joined by source table and set of keys; gold for each of ``plans`` (those with hubs)."""
    at = lambda df: df.withColumns({"t": F.lower("source_table"), "k": F.array_join(F.array_sort(F.array_distinct(F.transform("business_keys", F.lower))), ",")})
    mine = at(hubs).groupBy(*PLAN, "t", "k").agg(F.min(F.lower("name")).alias("plan_name"))
    runs = (hubs if plans is None else plans).select(*PLAN).distinct()
    theirs = runs.join(at(gold).groupBy("system_id", "t", "k").agg(F.min(F.lower("name")).alias("gold_name")), "system_id")
    return mine.join(theirs, [*PLAN, "t", "k"], "full")


def grade(hubs: DataFrame, gold: DataFrame, drop: str | None = None) -> DataFrame:
    """Precision, recall and F1 of hubs against gold, and naming adherence among matches. ``drop``: a gold source table to leave out."""
    kept = gold if drop is None else gold.where(F.lower("source_table") != drop.lower())
    p, g = F.col("plan_name").isNotNull(), F.col("gold_name").isNotNull()
    n = lambda c: F.sum(c.cast("int"))
    hit, plan, want = n(p & g), n(p), n(g)
    none = lambda c: F.nullif(c, F.lit(0))
    return matched(hubs, kept).groupBy(*PLAN).agg(
        F.round(hit / none(plan), 4).alias("precision"), F.round(hit / none(want), 4).alias("recall"), F.round(2 * hit / none(plan + want), 4).alias("f1"),
        F.round(n(p & g & (F.col("plan_name") == F.col("gold_name"))) / none(hit), 4).alias("naming"),
    )


def correction(hubs: DataFrame, gold: DataFrame, sizes: DataFrame) -> DataFrame:
    """Steps from a plan to gold: hubs to add, delete and rename, and differences in links and satellites.

    sizes: PLAN, links, sats, gold_links, gold_sats. ``from_scratch`` is gold's number of objects.
    """
    p, g = F.col("plan_name").isNotNull(), F.col("gold_name").isNotNull()
    n = lambda c: F.sum(c.cast("int")).cast("long")
    own = matched(hubs, gold).groupBy(*PLAN).agg(n(g & ~p).alias("adds"), n(p & ~g).alias("deletes"), n(p & g & (F.col("plan_name") != F.col("gold_name"))).alias("renames"), n(g).alias("gold_hubs"))
    both = own.join(sizes, PLAN)
    steps = F.col("adds") + F.col("deletes") + F.col("renames") + F.abs(F.col("links") - F.col("gold_links")) + F.abs(F.col("sats") - F.col("gold_sats"))
    return both.select(*PLAN, "adds", "deletes", "renames", steps.alias("steps"), (F.col("gold_hubs") + F.col("gold_links") + F.col("gold_sats")).alias("from_scratch"))


def link_ratio(links: DataFrame, gold_links: DataFrame) -> DataFrame:
    own = links.groupBy(*PLAN).agg(F.count("*").alias("n"))
    gold = gold_links.groupBy("system_id").agg(F.count("*").alias("want"))
    return own.join(gold, "system_id").select(*PLAN, F.round(F.col("n") / F.col("want"), 4).alias("link_ratio"))


def evaluate(hubs: DataFrame, links: DataFrame, sats: DataFrame, gold: DataFrame, catalog: DataFrame) -> DataFrame:
    """One wide row of metrics per plan."""
    objects = named_objects(hubs, links, sats)
    sizes = objects.groupBy(*PLAN).agg(*(F.sum((F.col("kind") == k).cast("int")).cast("long").alias(f"n_{k}s") for k in ("hub", "link", "sat")))
    tables = [conformance(checks(hubs, links, sats)), grounding(references(hubs, links, sats), catalog), grade(hubs, gold)]
    return reduce(lambda a, b: a.join(b, PLAN, "left"), tables, sizes)


def aggregate(metrics: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Means over runs of metrics of 0 or more, to four places; runs without a metric do not count for it. Millionths are summed and
    rounded as whole numbers, so neither the order of rows nor binary fractions matter."""
    millionths = lambda n: F.sum(F.round(F.col(n) * 1_000_000).cast("long"))
    mean = lambda n: F.floor((2 * millionths(n) + 100 * F.count(n)) / F.nullif(200 * F.count(n), F.lit(0))) / 10_000
    return metrics.groupBy(*by).agg(F.count("*").alias("n_runs"), *(mean(n).alias(n) for n in names))


def ablation_summary(records: DataFrame) -> DataFrame:
    """Per arm: cases, mean score and mean latency."""
    return records.groupBy("arm").agg(F.count("*").alias("n"), F.countDistinct("case_id").alias("cases"), F.round(F.avg("score"), 4).alias("score"), F.round(F.avg("latency"), 4).alias("latency"))


def summarise(records: DataFrame) -> DataFrame:
    """Per system and condition: mean value (3 places) and summed histogram counts of ``issues`` (a map)."""
    means = records.groupBy("system_id", "condition").agg(F.round(F.avg("value"), 3).alias("mean_value"), F.count("*").alias("n"))
    counts = records.select("system_id", "condition", F.explode("issues").alias("issue", "k")).groupBy("system_id", "condition", "issue").agg(F.sum("k").alias("k"))
    text = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "issue", F.col("k").cast("string")))), ",")
    return means.join(counts.groupBy("system_id", "condition").agg(text.alias("histogram")), ["system_id", "condition"], "left")


def shift(raw: DataFrame, reviewed: DataFrame, keys: list[str]) -> DataFrame:
    """Per issue (keys, n): resolved, introduced, persisted and net between two reports."""
    both = raw.withColumnRenamed("n", "before").join(reviewed.withColumnRenamed("n", "after"), keys, "full").na.fill(0, ["before", "after"])
    zero = F.lit(0)
    return both.select(
        *keys, F.greatest(F.col("before") - F.col("after"), zero).cast("long").alias("resolved"), F.greatest(F.col("after") - F.col("before"), zero).cast("long").alias("introduced"),
        F.least("before", "after").cast("long").alias("persisted"), (F.col("after") - F.col("before")).cast("long").alias("net"),
    )


def counted(level: str, reason: str, n: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), F.lit(reason).alias("reason"), n.cast("long").alias("n"))


def verdict(checked: DataFrame, ground: DataFrame, hubs: DataFrame, gold: DataFrame, link_counts: DataFrame | None = None) -> DataFrame:
    """APPROVE, REVIEW or REJECT of every checked plan, with its reasons and how often each applies.

    REJECT: tables or keys that the source lacks, or no hubs. REVIEW: payload columns that the source lacks, any other broken
    convention, and against gold: missed or spurious entities, other names, more links (PLAN, links, gold_links) than gold has; a
    system without gold is never better than REVIEW. APPROVE: nothing of these.
    """
    plans = checked.select(*PLAN).distinct()
    conventions = checked.where("bad").groupBy(*PLAN, "issue").agg(F.count("*").alias("n"))
    rejecting = F.col("issue") == "empty_plan"
    rows = [conventions.select(*PLAN, F.when(rejecting, "REJECT").otherwise("REVIEW").alias("level"), F.when(rejecting, "no hubs").otherwise(F.concat(F.lit("convention "), "issue")).alias("reason"), "n")]

    def reasons(df: DataFrame, *cells: Column) -> None:
        rows.append(df.select(*PLAN, F.inline(F.array(*cells))).where("n > 0"))

    reasons(ground, counted("REJECT", "fabricated structure", F.col("structural")), counted("REVIEW", "fabricated payload", F.col("fabricated_payload")))
    known = gold.select("system_id").distinct()
    p, g = F.col("plan_name").isNotNull(), F.col("gold_name").isNotNull()
    sides = matched(hubs.join(known, "system_id", "left_semi"), gold, plans).groupBy(*PLAN).agg(F.count_if(~p).alias("missed"), F.count_if(~g).alias("spurious"), F.count_if(p & g & (F.col("plan_name") != F.col("gold_name"))).alias("renamed"))
    reasons(sides, counted("REVIEW", "missed entity", F.col("missed")), counted("REVIEW", "spurious entity", F.col("spurious")), counted("REVIEW", "naming against gold", F.col("renamed")))
    if link_counts is not None:
        reasons(link_counts.join(known, "system_id", "left_semi"), counted("REVIEW", "over-linking", F.col("links") - F.col("gold_links")))
    reasons(plans.join(known, "system_id", "left_anti"), counted("REVIEW", "no gold", F.lit(1)))
    listed = lambda level: F.array_join(F.array_sort(F.collect_list(F.when(F.col("level") == level, F.concat("reason", F.lit(" "), F.col("n").cast("string"))))), "; ")
    told = reduce(DataFrame.unionByName, rows).groupBy(*PLAN).agg(listed("REJECT").alias("blocking"), listed("REVIEW").alias("review"))
    out = plans.join(told, PLAN, "left").na.fill("", ["blocking", "review"])
    return out.withColumn("verdict", F.when(F.col("blocking") != "", "REJECT").when(F.col("review") != "", "REVIEW").otherwise("APPROVE"))
