"""Queries of schema drift, plan tables, scores and statistics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultline.plans import cleaning as pl
from vaultline.plans import drift as dr
from vaultline.plans import scoring as ev
from vaultline.plans import stats
from vaultline.queries.bindings import Registry, projected, table, with_sql
from vaultline.queries.loads import shared_path
from vaultline.sources import sinks

CATS = with_sql("cat_v1", "cat_v2")
BOTH = "both_ AS (SELECT DISTINCT table_name FROM cat_v1 INTERSECT SELECT DISTINCT table_name FROM cat_v2)"
DIFF = "diff AS (SELECT table_name, column_name, CASE WHEN a.raw_dtype IS NULL THEN 'added' WHEN b.raw_dtype IS NULL THEN 'removed' ELSE 'type_changed' END AS change, a.raw_dtype AS old_dtype, b.raw_dtype AS new_dtype, coalesce(a.is_key, b.is_key, false) AS is_key FROM cat_v1 a FULL JOIN cat_v2 b USING (table_name, column_name) WHERE table_name IN (SELECT table_name FROM both_) AND (a.raw_dtype IS NULL OR b.raw_dtype IS NULL OR lower(a.raw_dtype) <> lower(b.raw_dtype)))"
RISK = "CASE WHEN change IN ('removed', 'type_changed', 'table_removed') AND is_key THEN 'HIGH' WHEN change IN ('removed', 'type_changed', 'table_removed') THEN 'MEDIUM' ELSE 'LOW' END"
TABLES_SQL = f"levels AS (SELECT table_name, max(CASE {RISK} WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) AS level, count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'removed') AS removed, count(*) FILTER (WHERE change = 'type_changed') AS type_changed FROM diff GROUP BY table_name), names AS (SELECT table_name, bool_or(old) AS was, bool_or(NOT old) AS now FROM (SELECT table_name, true AS old FROM cat_v1 UNION SELECT table_name, false FROM cat_v2) GROUP BY table_name), changes AS (SELECT category, table_name, CASE WHEN category = 'ORPHANED' THEN 'MEDIUM' WHEN level = 3 THEN 'HIGH' WHEN level = 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed, coalesce(type_changed, 0) AS type_changed FROM (SELECT *, CASE WHEN NOT was THEN 'NEW' WHEN NOT now THEN 'ORPHANED' WHEN level IS NULL THEN 'UNCHANGED' ELSE 'DRIFT' END AS category FROM names LEFT JOIN levels USING (table_name)))"
ATOMIC = f"atomic AS (SELECT *, {RISK} AS risk FROM (SELECT * FROM diff UNION ALL SELECT table_name, NULL, CASE category WHEN 'NEW' THEN 'table_added' ELSE 'table_removed' END, NULL, NULL, false FROM changes WHERE category IN ('NEW', 'ORPHANED')))"
ALL = f"{CATS}, {BOTH}, {DIFF}, {TABLES_SQL}, {ATOMIC} "
IMPACT = "CASE WHEN change IN ('added', 'table_added') THEN 'additive' WHEN change IN ('removed', 'table_removed', 'type_changed') THEN 'breaking' ELSE 'cosmetic' END"
SYSTEM = "substring(table_name, 1, 2)"


def cats(s: SparkSession, d: str) -> list[DataFrame]:
    return projected(s, d, "cat_v1", "cat_v2")


def changes(s: SparkSession, d: str) -> DataFrame:
    return dr.table_changes(*cats(s, d))


def atomic(s: SparkSession, d: str) -> DataFrame:
    return dr.atomic_changes(*cats(s, d))


def drift(r: Registry) -> None:
    named = "CASE o_orderkey % 6 WHEN 0 THEN 'hub_' WHEN 1 THEN 'LNK_' WHEN 2 THEN 'eff_sat_' WHEN 3 THEN 'pit_' WHEN 4 THEN 'fct_' ELSE 'x' END || CAST(o_orderkey AS STRING)"
    vault = lambda s, d: table(s, d, "orders").select(F.expr(named).alias("name"))
    r.add("dr1_entity_kind", lambda s, d: vault(s, d).select("name", dr.entity_kind(F.col("name")).alias("kind")), f"SELECT {named} AS name, CASE o_orderkey % 6 WHEN 0 THEN 'hub' WHEN 1 THEN 'link' WHEN 2 THEN 'eff_sat' WHEN 3 THEN 'pit' WHEN 4 THEN 'fact' ELSE 'unknown' END AS kind FROM orders")
    r.add("dr2_snapshot", lambda s, d: dr.snapshot(s, cats(s, d)[0], "v1").unionByName(dr.snapshot(s, cats(s, d)[1], "v2")).groupBy("snapshot_id", "table_name").agg(F.count("*").alias("columns")), CATS + "SELECT snapshot_id, table_name, count(*) AS columns FROM (SELECT *, 'v1' AS snapshot_id FROM cat_v1 UNION ALL SELECT *, 'v2' FROM cat_v2) GROUP BY ALL")
    r.add("dr3_stem", lambda s, d: vault(s, d).select("name", dr.stem(F.col("name")).alias("stem")), f"SELECT {named} AS name, CASE WHEN o_orderkey % 6 = 5 THEN 'x' ELSE '' END || CAST(o_orderkey AS VARCHAR) AS stem FROM orders")

    def targets(s: SparkSession, d: str) -> DataFrame:
        c = table(s, d, "customer")
        bronze = c.select(F.concat(F.lit("brz_"), F.lower("c_mktsegment"), F.col("c_nationkey").cast("string")).alias("table_name"))
        vault = c.where("c_custkey % 3 > 0").select(F.concat(F.when(F.col("c_custkey") % 3 == 1, "sat_").otherwise("hub_"), F.lower("c_mktsegment"), F.col("c_nationkey").cast("string")).alias("table_name"))
        return dr.match_targets(bronze, vault)

    r.add("dr4_match_targets", targets, "WITH v AS (SELECT DISTINCT lower(c_mktsegment) || CAST(c_nationkey AS VARCHAR) AS stem, c_custkey % 3 = 1 AS sat FROM customer WHERE c_custkey % 3 > 0), b AS (SELECT DISTINCT lower(c_mktsegment) || CAST(c_nationkey AS VARCHAR) AS stem FROM customer) SELECT 'brz_' || b.stem AS table_name, CASE WHEN bool_or(NOT sat) THEN 'hub_' || b.stem WHEN bool_or(sat) THEN 'sat_' || b.stem END AS target FROM b LEFT JOIN v USING (stem) GROUP BY b.stem")
    r.add("dr5_column_diff", lambda s, d: dr.column_diff(*cats(s, d)), f"{CATS}, {BOTH}, {DIFF} SELECT * FROM diff")
    r.add("dr6_table_changes", changes, ALL + "SELECT * FROM changes")
    r.add("dr7_atomic", atomic, ALL + "SELECT * FROM atomic")
    r.add("dr8_impact", lambda s, d: dr.impact(atomic(s, d)).select("table_name", "column_name", "change", "impact"), ALL + f"SELECT table_name, column_name, change, {IMPACT} AS impact FROM atomic")
    width = lambda s, d: table(s, d, "part").select(F.lit("t").alias("table_name"), F.col("p_name").alias("column_name"), F.lit("type_changed").alias("change"), F.expr("CASE p_size % 4 WHEN 0 THEN 'int' WHEN 1 THEN 'bigint' WHEN 2 THEN 'string' ELSE 'FLOAT' END").alias("old_dtype"), F.expr("CASE p_partkey % 4 WHEN 0 THEN 'bigint' WHEN 1 THEN 'decimal(38,0)' WHEN 2 THEN 'int' ELSE 'double' END").alias("new_dtype"), (F.col("p_partkey") % 5 == 0).alias("is_key"), "p_partkey")
    pairs = ", ".join(f"('{a}', '{b}')" for a, b in dr.LOSSLESS)
    r.add("dr9_widening", lambda s, d: dr.impact(width(s, d), widening=True).select("p_partkey", "old_dtype", "new_dtype", "impact"), f"SELECT p_partkey, old_dtype, new_dtype, CASE WHEN p_partkey % 5 <> 0 AND (lower(old_dtype), new_dtype) IN ({pairs}) THEN 'cosmetic' ELSE 'breaking' END AS impact FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'int' WHEN 1 THEN 'bigint' WHEN 2 THEN 'string' ELSE 'FLOAT' END AS old_dtype, CASE p_partkey % 4 WHEN 0 THEN 'bigint' WHEN 1 THEN 'decimal(38,0)' WHEN 2 THEN 'int' ELSE 'double' END AS new_dtype FROM part)")
    label = lambda c: f"CASE {c} % 3 WHEN 0 THEN 'additive' WHEN 1 THEN 'breaking' ELSE 'cosmetic' END"
    judged = lambda s, d: table(s, d, "orders").select(F.col("o_orderpriority").alias("system_id"), F.expr(label("o_orderkey")).alias("expert"), F.expr(label("o_custkey")).alias("predicted"))
    JUDGED = f"WITH j AS (SELECT o_orderpriority AS system_id, {label('o_orderkey')} AS expert, {label('o_custkey')} AS predicted FROM orders) "
    hit = "count(*) FILTER (WHERE expert = 'breaking' AND predicted = 'breaking')"
    r.add("dr10_score", lambda s, d: dr.score_impacts(judged(s, d), ["system_id"]), JUDGED + f"SELECT system_id, count(*) AS n, round(avg(CAST(expert = predicted AS INT)), 4) AS accuracy, CAST(sum(CASE WHEN expert = predicted THEN 0 WHEN expert = 'breaking' THEN 5 ELSE 1 END) AS BIGINT) AS cost, round({hit} / nullif(count(*) FILTER (WHERE expert = 'breaking'), 0), 4) AS breaking_recall, round({hit} / nullif(count(*) FILTER (WHERE predicted = 'breaking'), 0), 4) AS breaking_precision FROM j GROUP BY system_id")
    r.add("dr10_confusion", lambda s, d: dr.confusion(judged(s, d), dr.IMPACTS), JUDGED + "SELECT expert, " + ", ".join(f"count(*) FILTER (WHERE predicted = '{x}') AS {x}" for x in dr.IMPACTS) + " FROM j GROUP BY expert")
    r.add("dr11_actionable", lambda s, d: dr.actionable(changes(s, d), cats(s, d)[1]).select("table_name", "column_name", "category"), ALL + "SELECT table_name, column_name, category FROM cat_v2 JOIN changes USING (table_name) WHERE category IN ('NEW', 'DRIFT')")
    r.add("dr11_skipped", lambda s, d: dr.skipped(changes(s, d)), ALL + "SELECT category, count(*) AS n_tables, string_agg(table_name, ',' ORDER BY table_name) FILTER (WHERE r <= 3) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY table_name) AS r FROM changes WHERE category NOT IN ('NEW', 'DRIFT')) GROUP BY category")
    signals = lambda s, d: dr.risk_snapshot(changes(s, d).withColumn("system_id", F.expr(SYSTEM)), dr.impact(atomic(s, d)).withColumn("system_id", F.expr(SYSTEM)), orphans=True)
    SIG = ALL + f", one AS (SELECT substr(table_name, 1, 2) AS system_id, count(*) FILTER (WHERE category = 'NEW') AS new_, count(*) FILTER (WHERE category = 'ORPHANED') AS orphaned, coalesce(count(*) FILTER (WHERE category = 'DRIFT') / nullif(count(*) FILTER (WHERE category IN ('DRIFT', 'UNCHANGED')), 0), 0) AS share FROM changes GROUP BY 1), broken AS (SELECT substr(table_name, 1, 2) AS system_id, count(*) FILTER (WHERE {IMPACT} = 'breaking') AS breaking FROM atomic GROUP BY 1), sig AS (SELECT o.*, coalesce(breaking, 0) AS breaking FROM one o LEFT JOIN broken USING (system_id)), signals AS (SELECT system_id, 'many_new_tables' AS signal, 'MEDIUM' AS severity, CAST(new_ AS DOUBLE) AS value FROM sig WHERE new_ > 15 UNION ALL SELECT system_id, 'drift_share', 'MEDIUM', share FROM sig WHERE share > 0.4 UNION ALL SELECT system_id, 'breaking_change', 'HIGH', breaking FROM sig WHERE breaking > 0 UNION ALL SELECT system_id, 'orphans', 'LOW', orphaned FROM sig WHERE orphaned > 0) "
    r.add("dr12_risk_snapshot", signals, SIG + "SELECT * FROM signals")
    plan = lambda s, d: dr.risk_plan(projected(s, d, "plan_hubs")[0].where("system_id <> 's3'"), projected(s, d, "plan_hubs")[0])
    r.add("dr13_risk_plan", plan, with_sql("plan_hubs") + "SELECT 's3' AS system_id, 'empty_plan' AS signal, 'HIGH' AS severity, 0.0::DOUBLE AS value UNION ALL SELECT system_id, 'low_confidence', 'MEDIUM', avg(CAST(confidence < 0.6 AS INT)) FROM plan_hubs WHERE system_id <> 's3' GROUP BY 1 HAVING avg(CAST(confidence < 0.6 AS INT)) > 0.4")
    issues = lambda s, d: table(s, d, "orders").where("o_orderkey % 5 < 2").select(F.col("o_custkey").cast("string").alias("system_id"), F.when(F.col("o_orderstatus") == "F", "error").otherwise("warning").alias("level"))
    ISS = "WITH i AS (SELECT CAST(o_custkey AS VARCHAR) AS system_id, count(*) FILTER (WHERE o_orderstatus = 'F') AS e, count(*) FILTER (WHERE o_orderstatus <> 'F') AS w FROM orders WHERE o_orderkey % 5 < 2 GROUP BY 1) "
    r.add("dr14_risk_validation", lambda s, d: dr.risk_validation(issues(s, d), 3), ISS + "SELECT system_id, 'errors' AS signal, 'HIGH' AS severity, CAST(e AS DOUBLE) AS value FROM i WHERE e > 0 UNION ALL SELECT system_id, 'many_warnings', 'MEDIUM', w FROM i WHERE w > 3")
    r.add("dr15_gate", lambda s, d: dr.recommend_gate(signals(s, d)), SIG + "SELECT system_id, CASE WHEN count(*) FILTER (WHERE severity = 'HIGH') > 0 OR count(*) FILTER (WHERE severity = 'MEDIUM') >= 2 THEN 'pause' ELSE 'proceed' END AS recommendation, CASE WHEN bool_or(severity = 'HIGH') THEN 'HIGH' WHEN bool_or(severity = 'MEDIUM') THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM signals GROUP BY 1")

    def spec(s: SparkSession, d: str) -> DataFrame:
        c = table(s, d, "customer")
        refs = c.select(F.concat(F.lit("stg_"), F.lower("c_mktsegment")).alias("stage"), F.concat(F.lit("e"), (F.col("c_custkey") % 50).cast("string")).alias("entity"), F.concat(F.lit("C"), (F.col("c_custkey") % 30).cast("string")).alias("column_name"), (F.col("c_custkey") % 11 == 0).alias("is_literal"), (F.col("c_custkey") % 2 == 0).alias("in_derived"))
        have = c.where("c_custkey % 3 > 0").select(F.concat(F.lit("stg_"), F.lower("c_mktsegment")).alias("stage"), F.concat(F.lit("c"), (F.col("c_custkey") % 20).cast("string")).alias("column_name"))
        return dr.validate_spec(refs, have, c.where("c_mktsegment <> 'MACHINERY'").select(F.concat(F.lit("stg_"), F.lower("c_mktsegment")).alias("stage")))

    r.add("dr16_validate_spec", spec, "WITH refs AS (SELECT 'stg_' || lower(c_mktsegment) AS stage, 'e' || CAST(c_custkey % 50 AS VARCHAR) AS entity, 'C' || CAST(c_custkey % 30 AS VARCHAR) AS column_name, c_custkey % 11 = 0 AS lit, c_custkey % 2 = 0 AS der FROM customer), have AS (SELECT DISTINCT 'stg_' || lower(c_mktsegment) AS stage, 'c' || CAST(c_custkey % 20 AS VARCHAR) AS column_name FROM customer WHERE c_custkey % 3 > 0) SELECT DISTINCT stage, entity, column_name, 'unknown_column' AS issue FROM refs WHERE stage <> 'stg_machinery' AND NOT lit AND (stage, lower(column_name)) NOT IN (SELECT (stage, column_name) FROM have) UNION SELECT stage, entity, column_name, 'unknown_stage' FROM refs WHERE stage = 'stg_machinery' UNION SELECT stage, entity, column_name, 'misplaced_literal' FROM refs WHERE stage <> 'stg_machinery' AND lit AND NOT der")

    def structure(s: SparkSession, d: str) -> DataFrame:
        hubs, sats = projected(s, d, "plan_hubs", "plan_sats")
        n = F.regexp_extract("name", "([0-9]+)", 1).cast("long")
        e = sats.select(F.col("name").alias("entity"), F.when(n % 7 == 0, "eff_sat").otherwise("sat").alias("kind"), F.col("parent_hub").alias("parent"), "hashdiff", "payload", F.when(n % 3 == 0, "merge").otherwise("append").alias("strategy"), F.when(n % 2 == 0, "append_new_columns").alias("on_schema_change"))
        return dr.validate_structure(e, hubs, sats.where("hashdiff like 'HD%'").select(F.col("hashdiff").alias("name")), ["load_dts"])

    r.add("dr17_validate_structure", structure, with_sql("plan_hubs", "plan_sats") + ", e AS (SELECT *, CAST(regexp_extract(name, '([0-9]+)', 1) AS BIGINT) AS n FROM plan_sats) SELECT name AS entity, 'orphan_satellite' AS issue, 'error' AS level FROM e WHERE parent_hub NOT IN (SELECT hash_key FROM plan_hubs) UNION ALL SELECT name, 'undeclared_hashdiff', 'error' FROM e WHERE hashdiff NOT LIKE 'HD%' UNION ALL SELECT name, 'technical_payload', 'warning' FROM e WHERE list_contains(payload, 'load_dts') UNION ALL SELECT name, 'append_on_merged_kind', 'error' FROM e WHERE n % 7 = 0 AND n % 3 <> 0 UNION ALL SELECT name, 'no_on_schema_change', 'warning' FROM e WHERE n % 3 <> 0 AND n % 2 <> 0")


PLANS = with_sql("plan_hubs", "plan_links", "plan_sats")
OBJECTS = ", objects AS (SELECT system_id, run_id, 'hub' AS kind, lower(name) AS name FROM plan_hubs UNION ALL SELECT system_id, run_id, 'link', lower(name) FROM plan_links UNION ALL SELECT system_id, run_id, 'sat', lower(name) FROM plan_sats), prints AS (SELECT system_id, run_id, sha256(string_agg(DISTINCT kind || ':' || name, '|' ORDER BY kind || ':' || name)) AS fingerprint, count(*) AS n_objects FROM objects GROUP BY ALL)"


def three(s: SparkSession, d: str) -> list[DataFrame]:
    return projected(s, d, "plan_hubs", "plan_links", "plan_sats")


#: Runs that agree: names reduced so that several runs have one fingerprint.
SAME = "SELECT 's' || CAST(c_nationkey AS STRING) AS system_id, CAST(c_custkey % 8 AS INT) AS run_id, 'hub' AS kind, 'h' || CAST(CASE WHEN c_custkey % 8 < 5 THEN c_nationkey ELSE c_custkey % 8 END AS STRING) AS name FROM customer"


def agreeing(s: SparkSession, d: str) -> DataFrame:
    table(s, d, "customer").createOrReplaceTempView("customer")
    return pl.fingerprint(s.sql(SAME))


SAME_PRINTS = f"WITH prints AS (SELECT system_id, run_id, sha256(string_agg(DISTINCT kind || ':' || name, '|' ORDER BY kind || ':' || name)) AS fingerprint FROM ({SAME}) GROUP BY ALL) "


def plans(r: Registry) -> None:
    def doubled(s: SparkSession, d: str) -> DataFrame:
        (h,) = projected(s, d, "plan_hubs")
        return pl.merge_named(h.withColumn("name", F.concat(F.lit("h"), (F.length("hash_key")).cast("string"))), "business_keys").withColumn("business_keys", F.array_join("business_keys", ","))

    r.add("pl1_merge_named", doubled, with_sql("plan_hubs") + ", rows_ AS (SELECT system_id, run_id, 'h' || CAST(length(hash_key) AS VARCHAR) AS name, source_table, business_keys, confidence, row_number() OVER (PARTITION BY system_id, run_id, length(hash_key) ORDER BY source_table, '[' || array_to_string(business_keys, ', ') || ']') AS rn FROM plan_hubs), cells AS (SELECT system_id, run_id, name, rn, unnest(business_keys) AS m, generate_subscripts(business_keys, 1) AS pos FROM rows_), firsts AS (SELECT system_id, run_id, name, m, min(rn * 1000 + pos) AS at_ FROM cells GROUP BY ALL), lists AS (SELECT system_id, run_id, name, string_agg(m, ',' ORDER BY at_) AS business_keys FROM firsts GROUP BY ALL) SELECT system_id, run_id, name, arg_min(source_table, rn) AS source_table, max(confidence) AS confidence, any_value(l.business_keys) AS business_keys FROM rows_ JOIN lists l USING (system_id, run_id, name) GROUP BY system_id, run_id, name")
    drop = "drop_ AS (SELECT system_id, run_id, source_table, lower(unnest(business_keys)) AS c FROM plan_hubs UNION SELECT system_id, run_id, source_table, lower(unnest(fk_columns)) FROM plan_links)"
    CLEAN = PLANS + f", {drop}, cells AS (SELECT system_id, run_id, name, source_table, unnest(payload) AS c, generate_subscripts(payload, 1) AS pos FROM plan_sats), kept AS (SELECT * FROM cells x WHERE lower(c) NOT IN ('load_dts', 'record_source', 'cdc_flag', 'ingested_at') AND NOT EXISTS (SELECT 1 FROM drop_ y WHERE y.system_id = x.system_id AND y.run_id = x.run_id AND y.source_table = x.source_table AND y.c = lower(x.c))) SELECT p.system_id, p.run_id, p.name, coalesce(string_agg(k.c, ',' ORDER BY pos), '') AS payload FROM plan_sats p LEFT JOIN kept k USING (system_id, run_id, name) GROUP BY ALL"
    r.add("pl2_clean_payload", lambda s, d: pl.clean_payload(three(s, d)[2], three(s, d)[0], three(s, d)[1]).select("system_id", "run_id", "name", F.array_join("payload", ",").alias("payload")), CLEAN)
    r.add("pl3_enforce", lambda s, d: pl.enforce(*three(s, d)).select("system_id", "run_id", "name", "parent_hub"), PLANS + "SELECT system_id, run_id, name, parent_hub FROM (SELECT p.*, row_number() OVER (PARTITION BY p.system_id, p.run_id, parent_hub ORDER BY p.name) AS n FROM plan_sats p JOIN plan_hubs h ON h.system_id = p.system_id AND h.run_id = p.run_id AND h.hash_key = p.parent_hub) WHERE n <= 3")
    r.add("pl4_split_meta", lambda s, d: pl.split_meta(three(s, d)[2]).select("name", "subgroup", "change_velocity"), PLANS + "SELECT name, nullif(regexp_extract(name, '_(details|operational|measurements)$', 1), '') AS subgroup, CASE regexp_extract(name, '_(details|operational|measurements)$', 1) WHEN 'measurements' THEN 'high' WHEN 'operational' THEN 'medium' WHEN 'details' THEN 'low' END AS change_velocity FROM plan_sats")

    def merged(s: SparkSession, d: str) -> DataFrame:
        hubs, _, sats = three(s, d)
        part = sats.select("system_id", "run_id", F.concat(F.lit("n"), F.length("name").cast("string"), "parent_hub").alias("name"), "source_table", "parent_hub", F.regexp_extract("name", "([0-9]+)", 1).cast("int").alias("batch"))
        return pl.merge_plans(part, hubs).select("system_id", "run_id", "name", "parent_hub", "batch")

    r.add("pl5_merge_plans", merged, PLANS + ", b AS (SELECT system_id, run_id, 'n' || CAST(length(name) AS VARCHAR) || parent_hub AS name, parent_hub, CAST(regexp_extract(name, '([0-9]+)', 1) AS INT) AS batch FROM plan_sats) SELECT system_id, run_id, name, parent_hub, min(batch) AS batch FROM b WHERE (system_id, run_id, parent_hub) IN (SELECT (system_id, run_id, hash_key) FROM plan_hubs) GROUP BY ALL")
    r.add("pl6_fingerprint", lambda s, d: pl.fingerprint(pl.named_objects(*three(s, d))), PLANS + OBJECTS + " SELECT * FROM prints")

    def voted(s: SparkSession, d: str) -> DataFrame:
        return pl.vote(agreeing(s, d), projected(s, d, "plan_hubs")[0].groupBy("system_id", "run_id").agg(F.round(F.sum("confidence"), 4).alias("total")))

    r.add("pl7_vote", voted, with_sql("plan_hubs") + "," + SAME_PRINTS[5:] + ", total AS (SELECT system_id, run_id, round(sum(confidence), 4) AS total FROM plan_hubs GROUP BY ALL), ranked AS (SELECT p.*, count(*) OVER (PARTITION BY system_id, fingerprint) AS votes, coalesce(total, 0) AS total FROM prints p LEFT JOIN total USING (system_id, run_id)) SELECT system_id, run_id, fingerprint, votes FROM (SELECT *, row_number() OVER (PARTITION BY system_id ORDER BY votes DESC, total DESC, run_id) AS n FROM ranked) WHERE n = 1")
    r.add("pl8_prune_links", lambda s, d: pl.prune_links(three(s, d)[1], three(s, d)[0]).select("system_id", "run_id", "name"), PLANS + ", cells AS (SELECT DISTINCT system_id, run_id, name, unnest(fk_columns) AS k FROM plan_links), c AS (SELECT x.system_id, x.run_id, x.name, count(*) AS n, count(h.hash_key) AS found, string_agg(k, '|' ORDER BY k) AS hubs FROM cells x LEFT JOIN (SELECT DISTINCT system_id, run_id, hash_key FROM plan_hubs) h ON h.system_id = x.system_id AND h.run_id = x.run_id AND h.hash_key = k GROUP BY ALL) SELECT system_id, run_id, name FROM (SELECT *, row_number() OVER (PARTITION BY system_id, run_id, hubs ORDER BY name) AS rn FROM c WHERE n >= 2 AND n = found) WHERE rn = 1")

    def restored(s: SparkSession, d: str) -> DataFrame:
        (h,) = projected(s, d, "plan_hubs")
        reviewed = h.withColumn("business_keys", F.array(F.lit("changed")))
        return pl.restore_keys(reviewed, h.where("confidence < 0.6")).select("system_id", "run_id", "name", F.array_join("business_keys", ",").alias("business_keys"))

    r.add("pl9_restore_keys", restored, with_sql("plan_hubs") + "SELECT system_id, run_id, name, CASE WHEN confidence < 0.6 THEN array_to_string(business_keys, ',') ELSE 'changed' END AS business_keys FROM plan_hubs")

    def shrunk(s: SparkSession, d: str) -> DataFrame:
        objects = pl.named_objects(*three(s, d))
        return pl.shrink_ok(objects, objects.where("length(name) % 2 = 0 or kind = 'hub'"))

    r.add("pl10_shrink_ok", shrunk, PLANS + OBJECTS + ", counts AS (SELECT system_id, run_id, kind, count(*) AS b, count(*) FILTER (WHERE length(name) % 2 = 0 OR kind = 'hub') AS a FROM objects GROUP BY ALL) SELECT system_id, run_id, bool_and(a >= 0.7 * b OR b - a <= 1) AS accepted FROM counts GROUP BY ALL")


CHECKS = """, hub_keys AS (SELECT system_id, run_id, hash_key AS parent_hub, list_transform(flatten(list(business_keys)), lambda x: lower(x)) AS ks FROM plan_hubs GROUP BY ALL),
loose AS (SELECT DISTINCT l.system_id, l.run_id, l.name FROM (SELECT system_id, run_id, name, unnest(fk_columns) AS k FROM plan_links) l WHERE NOT EXISTS (SELECT 1 FROM plan_hubs h WHERE h.system_id = l.system_id AND h.run_id = l.run_id AND h.hash_key = l.k)),
every AS (SELECT system_id, run_id FROM plan_hubs UNION SELECT system_id, run_id FROM plan_links UNION SELECT system_id, run_id FROM plan_sats),
checked AS (
SELECT system_id, run_id, 'plan' AS kind, '' AS name, 'empty_plan' AS issue, NOT EXISTS (SELECT 1 FROM plan_hubs h WHERE h.system_id = e.system_id AND h.run_id = e.run_id) AS bad FROM every e
UNION ALL SELECT system_id, run_id, 'hub', name, 'naming', name NOT LIKE 'hub!_%' ESCAPE '!' FROM plan_hubs
UNION ALL SELECT system_id, run_id, 'hub', name, 'hash_key_naming', hash_key NOT LIKE 'HK!_%' ESCAPE '!' FROM plan_hubs
UNION ALL SELECT system_id, run_id, 'hub', name, 'surrogate_business_key', len(business_keys) > 0 AND len(list_filter(business_keys, lambda k: NOT regexp_matches(lower(k), '^(id|sys_id|guid|uuid|pk|oid|sk|rowid)$|_(id|sk|key|guid|uuid)$'))) = 0 FROM plan_hubs
UNION ALL SELECT system_id, run_id, 'hub', name, 'hub_without_satellite', (system_id, run_id, hash_key) NOT IN (SELECT (system_id, run_id, parent_hub) FROM plan_sats) FROM plan_hubs
UNION ALL SELECT system_id, run_id, 'link', name, 'naming', name NOT LIKE 'link!_%' ESCAPE '!' FROM plan_links
UNION ALL SELECT system_id, run_id, 'link', name, 'hash_key_naming', hash_key NOT LIKE 'HK!_%' ESCAPE '!' FROM plan_links
UNION ALL SELECT system_id, run_id, 'link', name, 'link_under_two_hubs', len(fk_columns) < 2 FROM plan_links
UNION ALL SELECT system_id, run_id, 'link', name, 'link_fk_unresolved', (system_id, run_id, name) IN (SELECT (system_id, run_id, name) FROM loose) FROM plan_links
UNION ALL SELECT system_id, run_id, 'sat', name, 'naming', NOT regexp_matches(name, '^(eff_)?sat_') FROM plan_sats
UNION ALL SELECT system_id, run_id, 'sat', name, 'hash_key_naming', hashdiff NOT LIKE 'HD!_%' ESCAPE '!' FROM plan_sats
UNION ALL SELECT s.system_id, s.run_id, 'sat', s.name, 'satellite_orphan', ks IS NULL FROM plan_sats s LEFT JOIN hub_keys k USING (system_id, run_id, parent_hub)
UNION ALL SELECT system_id, run_id, 'sat', name, 'satellite_empty_payload', len(payload) = 0 FROM plan_sats
UNION ALL SELECT s.system_id, s.run_id, 'sat', s.name, 'payload_key_leak', list_has_any(list_transform(payload, lambda x: lower(x)), list_concat(coalesce(ks, []), ['load_dts', 'record_source', 'cdc_flag', 'ingested_at'])) FROM plan_sats s LEFT JOIN hub_keys k USING (system_id, run_id, parent_hub))"""
RADIUS = ", used AS (SELECT system_id, run_id, unnest(list_distinct(fk_columns)) AS hash_key FROM plan_links UNION ALL SELECT system_id, run_id, parent_hub FROM plan_sats), counts AS (SELECT system_id, run_id, hash_key, count(*) AS radius FROM used GROUP BY ALL), radius AS (SELECT h.system_id, h.run_id, h.name, h.hash_key, coalesce(c.radius, 0) AS radius FROM plan_hubs h LEFT JOIN counts c USING (system_id, run_id, hash_key))"
GOLD = with_sql("plan_hubs", "gold_hubs") + ", mine AS (SELECT system_id, run_id, t, k, min(lower(name)) AS p FROM (SELECT *, lower(source_table) AS t, array_to_string(list_sort(list_distinct(list_transform(business_keys, lambda x: lower(x)))), ',') AS k FROM plan_hubs) GROUP BY ALL), theirs AS (SELECT DISTINCT system_id, lower(source_table) AS t, array_to_string(list_sort(list_distinct(list_transform(business_keys, lambda x: lower(x)))), ',') AS k FROM gold_hubs), want AS (SELECT system_id, run_id, t, k, true AS g FROM theirs JOIN (SELECT DISTINCT system_id, run_id FROM plan_hubs) USING (system_id)), m AS (SELECT system_id, run_id, t, k, p, g FROM mine FULL JOIN want USING (system_id, run_id, t, k)) "
GRADE = "round(count(*) FILTER (WHERE p IS NOT NULL AND g) / nullif(count(p), 0), 4) AS precision, round(count(*) FILTER (WHERE p IS NOT NULL AND g) / nullif(count(g), 0), 4) AS recall, round(2 * count(*) FILTER (WHERE p IS NOT NULL AND g) / nullif(count(p) + count(g), 0), 4) AS f1"
REFS = ", refs AS (SELECT system_id, run_id, 'table' AS kind, lower(source_table) AS t, NULL AS c FROM (SELECT system_id, run_id, source_table FROM plan_hubs UNION ALL SELECT system_id, run_id, source_table FROM plan_links UNION ALL SELECT system_id, run_id, source_table FROM plan_sats) UNION ALL SELECT system_id, run_id, 'key', lower(source_table), lower(unnest(business_keys)) FROM plan_hubs UNION ALL SELECT system_id, run_id, 'payload', lower(source_table), lower(unnest(payload)) FROM plan_sats), known AS (SELECT r.*, CASE WHEN kind = 'table' THEN (system_id, t) IN (SELECT (system_id, lower(table_name)) FROM catalog) ELSE (system_id, t, c) IN (SELECT (system_id, lower(table_name), lower(column_name)) FROM catalog) END AS ok FROM refs r)"


def written(s: SparkSession, d: str, *names: str) -> list[DataFrame]:
    """Projections that are written once, for plans that read them many times: links and satellites are joins of large tables."""
    return [sinks.as_table(df, shared_path(s, n)) for n, df in zip(names, projected(s, d, *names))]


def metrics(s: SparkSession, d: str) -> DataFrame:
    hubs, links, sats, gold, cat = written(s, d, "plan_hubs", "plan_links", "plan_sats", "gold_hubs", "catalog")
    return ev.evaluate(hubs, links, sats, gold, cat)


def scores(r: Registry) -> None:
    checked = lambda s, d: ev.checks(*three(s, d))
    r.add("ev1_conformance", lambda s, d: ev.conformance(checked(s, d)), PLANS + CHECKS + " SELECT system_id, run_id, round(avg(CAST(NOT bad AS INT)), 6) AS conformance, count(*) FILTER (WHERE bad) AS n_issues FROM checked GROUP BY ALL")
    r.add("ev2_issues", lambda s, d: ev.issues_by_type(checked(s, d)), PLANS + CHECKS + ", types AS (SELECT unnest([" + ", ".join(f"'{i}'" for i in ev.ISSUES) + "]) AS issue) SELECT issue, count(*) FILTER (WHERE bad) AS n FROM types LEFT JOIN checked USING (issue) GROUP BY issue")

    def covered(s: SparkSession, d: str) -> DataFrame:
        hubs, sats = projected(s, d, "plan_hubs", "plan_sats")
        return ev.coverage(sats.select("system_id", "run_id", "source_table"), hubs.select("system_id", "source_table"))

    r.add("ev3_coverage", covered, PLANS + ", plans_ AS (SELECT DISTINCT system_id, run_id FROM plan_sats), want AS (SELECT * FROM plans_ JOIN (SELECT DISTINCT system_id, source_table FROM plan_hubs) USING (system_id)), used AS (SELECT DISTINCT system_id, run_id, source_table, 1 AS hit FROM plan_sats) SELECT system_id, run_id, round(count(hit) / count(*), 4) AS coverage, coalesce(string_agg(source_table, ',' ORDER BY source_table) FILTER (WHERE hit IS NULL), '') AS uncovered FROM want LEFT JOIN used USING (system_id, run_id, source_table) GROUP BY ALL")
    r.add("ev4_blast_radius", lambda s, d: ev.blast_radius(*three(s, d)), PLANS + RADIUS + " SELECT * FROM radius")
    r.add("ev4_hotspots", lambda s, d: ev.hotspots(ev.blast_radius(*three(s, d)), 20), PLANS + RADIUS + " SELECT * FROM radius ORDER BY radius DESC, name, system_id, run_id LIMIT 20")

    def weighted(s: SparkSession, d: str) -> DataFrame:
        radius = ev.blast_radius(*three(s, d))
        return ev.weighted_impact(checked(s, d).where("bad").select("system_id", "run_id", "name").distinct(), radius)

    r.add("ev5_weighted_impact", weighted, PLANS + CHECKS + RADIUS + ", wrong AS (SELECT DISTINCT system_id, run_id, name FROM checked WHERE bad) SELECT system_id, run_id, CAST(sum(1 + coalesce(radius, 0)) AS BIGINT) AS weighted_impact FROM wrong LEFT JOIN (SELECT system_id, run_id, name, radius FROM radius) USING (system_id, run_id, name) GROUP BY ALL")
    G = "count(*) AS n_references, round(avg(CAST(ok AS INT)), 4) AS grounding, round(avg(CAST(NOT ok AS INT)), 4) AS hallucination, count(*) FILTER (WHERE NOT ok AND kind <> 'payload') AS structural, count(*) FILTER (WHERE NOT ok AND kind = 'payload') AS fabricated_payload"
    CAT = with_sql("plan_hubs", "plan_links", "plan_sats", "catalog")
    r.add("ev6_grounding", lambda s, d: ev.grounding(ev.references(*three(s, d)), projected(s, d, "catalog")[0]), CAT + REFS + f" SELECT system_id, run_id, {G} FROM known GROUP BY ALL")
    r.add("ev7_grade", lambda s, d: ev.grade(*projected(s, d, "plan_hubs", "gold_hubs")).drop("naming"), GOLD + f"SELECT system_id, run_id, {GRADE} FROM m GROUP BY ALL")
    r.add("ev7_link_ratio", lambda s, d: ev.link_ratio(three(s, d)[1], projected(s, d, "gold_hubs")[0]), with_sql("plan_links", "gold_hubs") + "SELECT l.system_id, run_id, round(n / want, 4) AS link_ratio FROM (SELECT system_id, run_id, count(*) AS n FROM plan_links GROUP BY ALL) l JOIN (SELECT system_id, count(*) AS want FROM gold_hubs GROUP BY ALL) g USING (system_id)")

    def corrected(s: SparkSession, d: str) -> DataFrame:
        hubs, links, sats, gold = projected(s, d, "plan_hubs", "plan_links", "plan_sats", "gold_hubs")
        n = lambda df, c: df.groupBy("system_id", "run_id").agg(F.count("*").alias(c))
        sizes = n(links, "links").join(n(sats, "sats"), ["system_id", "run_id"]).withColumns({"gold_links": F.lit(10), "gold_sats": F.lit(8)})
        return ev.correction(hubs, gold, sizes).select("system_id", "run_id", "adds", "deletes", "from_scratch")

    r.add("ev8_correction", corrected, GOLD.replace("WITH ", with_sql("plan_links", "plan_sats").rstrip() + ", ", 1) + "SELECT system_id, run_id, count(*) FILTER (WHERE g AND p IS NULL) AS adds, count(*) FILTER (WHERE p IS NOT NULL AND g IS NULL) AS deletes, count(g) + 18 AS from_scratch FROM m WHERE (system_id, run_id) IN (SELECT (system_id, run_id) FROM plan_links) GROUP BY ALL")
    r.add("ev9_grade_dropped", lambda s, d: ev.grade(*projected(s, d, "plan_hubs", "gold_hubs"), drop="BUILDING").drop("naming"), GOLD.replace("FROM gold_hubs)", "FROM gold_hubs WHERE source_table <> 'BUILDING')") + f"SELECT system_id, run_id, {GRADE} FROM m GROUP BY ALL")
    wide = with_sql("plan_hubs", "plan_links", "plan_sats", "catalog") + OBJECTS + CHECKS + REFS + "," + GOLD[GOLD.index(" mine AS"):] + f", sizes AS (SELECT system_id, run_id, count(*) FILTER (WHERE kind = 'hub') AS n_hubs, count(*) FILTER (WHERE kind = 'link') AS n_links, count(*) FILTER (WHERE kind = 'sat') AS n_sats FROM objects GROUP BY ALL), conf AS (SELECT system_id, run_id, round(avg(CAST(NOT bad AS INT)), 6) AS conformance, count(*) FILTER (WHERE bad) AS n_issues FROM checked GROUP BY ALL), ground AS (SELECT system_id, run_id, {G} FROM known GROUP BY ALL), graded AS (SELECT system_id, run_id, {GRADE} FROM m GROUP BY ALL), wide AS (SELECT * FROM sizes LEFT JOIN conf USING (system_id, run_id) LEFT JOIN ground USING (system_id, run_id) LEFT JOIN graded USING (system_id, run_id))"
    wide = wide.replace("WITH ", with_sql("gold_hubs").rstrip() + ", ", 1)
    r.add("ev10_evaluate", lambda s, d: metrics(s, d).drop("naming"), wide + " SELECT * FROM wide")
    r.add("ev11_aggregate", lambda s, d: ev.aggregate(metrics(s, d), ["system_id"], ["conformance", "grounding", "f1"]), wide + " SELECT system_id, count(*) AS n_runs, " + ", ".join(f"floor((2 * sum(CAST(round({m} * 1000000) AS BIGINT)) + 100 * count({m})) / nullif(200 * count({m}), 0)) / 10000 AS {m}" for m in ("conformance", "grounding", "f1")) + " FROM wide GROUP BY system_id")
    records = lambda s, d: table(s, d, "orders").select(F.col("o_orderpriority").alias("arm"), (F.col("o_custkey") % 100).alias("case_id"), F.round(F.col("o_totalprice") / 1000, 3).alias("score"), (F.col("o_orderkey") % 60).alias("latency"))
    r.add("ev12_ablation", lambda s, d: ev.ablation_summary(records(s, d)), "SELECT o_orderpriority AS arm, count(*) AS n, count(DISTINCT o_custkey % 100) AS cases, round(avg(round(o_totalprice / 1000, 3)), 4) AS score, round(avg(o_orderkey % 60), 4) AS latency FROM orders GROUP BY 1")

    def summary(s: SparkSession, d: str) -> DataFrame:
        o = table(s, d, "orders")
        return ev.summarise(o.select(F.col("o_orderstatus").alias("system_id"), F.col("o_orderpriority").alias("condition"), (F.col("o_orderkey") % 1000).alias("value"), F.create_map(F.concat(F.lit("i"), (F.col("o_orderkey") % 3).cast("string")), F.col("o_custkey") % 5).alias("issues")))

    r.add("ev13_summarise", summary, "WITH o AS (SELECT o_orderstatus AS system_id, o_orderpriority AS condition, o_orderkey % 1000 AS value, 'i' || CAST(o_orderkey % 3 AS VARCHAR) AS issue, o_custkey % 5 AS k FROM orders), c AS (SELECT system_id, condition, issue, sum(k) AS k FROM o GROUP BY ALL) SELECT system_id, condition, round(avg(value), 3) AS mean_value, count(*) AS n, any_value(h.histogram) AS histogram FROM o JOIN (SELECT system_id, condition, string_agg(issue || ':' || CAST(k AS VARCHAR), ',' ORDER BY issue) AS histogram FROM c GROUP BY ALL) h USING (system_id, condition) GROUP BY system_id, condition")
    hist = lambda s, d, m: table(s, d, "orders").where(f"o_orderkey % 2 = {m}").groupBy(F.col("o_orderpriority").alias("issue"), (F.col("o_custkey") % 40).alias("run")).agg(F.count("*").alias("n"))
    hsql = lambda m: f"SELECT o_orderpriority AS issue, o_custkey % 40 AS run, count(*) AS n FROM orders WHERE o_orderkey % 2 = {m} GROUP BY ALL"
    r.add("ev14_shift", lambda s, d: ev.shift(hist(s, d, 0), hist(s, d, 1), ["issue", "run"]), f"SELECT issue, run, greatest(b - a, 0) AS resolved, greatest(a - b, 0) AS introduced, least(a, b) AS persisted, a - b AS net FROM (SELECT issue, run, coalesce(x.n, 0) AS b, coalesce(y.n, 0) AS a FROM ({hsql(0)}) x FULL JOIN ({hsql(1)}) y USING (issue, run))")

    def judged(s: SparkSession, d: str) -> DataFrame:
        hubs, links, sats, gold, cat = written(s, d, "plan_hubs", "plan_links", "plan_sats", "gold_hubs", "catalog")
        gold = gold.where("system_id <> 's5'")
        expected = gold.groupBy("system_id").agg(F.count("*").alias("gold_links"))
        produced = links.groupBy("system_id", "run_id").agg(F.count("*").alias("links")).join(expected, "system_id")
        return ev.verdict(ev.checks(hubs, links, sats), ev.grounding(ev.references(hubs, links, sats), cat), hubs, gold, produced)

    VERDICT = """, want_ AS (SELECT system_id, run_id, t, k, g FROM (SELECT system_id, lower(source_table) AS t, array_to_string(list_sort(list_distinct(list_transform(business_keys, lambda x: lower(x)))), ',') AS k, min(lower(name)) AS g FROM gold_hubs WHERE system_id <> 's5' GROUP BY ALL) JOIN every USING (system_id)),
have_ AS (SELECT system_id, run_id, t, k, p FROM mine WHERE system_id IN (SELECT system_id FROM want_)),
sides AS (SELECT system_id, run_id, count(*) FILTER (WHERE p IS NULL) AS missed, count(*) FILTER (WHERE g IS NULL) AS spurious, count(*) FILTER (WHERE p <> g) AS renamed FROM have_ FULL JOIN want_ USING (system_id, run_id, t, k) GROUP BY ALL),
reasons AS (
SELECT system_id, run_id, CASE issue WHEN 'empty_plan' THEN 'REJECT' ELSE 'REVIEW' END AS level, CASE issue WHEN 'empty_plan' THEN 'no hubs' ELSE 'convention ' || issue END AS reason, count(*) AS n FROM checked WHERE bad GROUP BY ALL
UNION ALL SELECT system_id, run_id, 'REJECT', 'fabricated structure', structural FROM ground UNION ALL SELECT system_id, run_id, 'REVIEW', 'fabricated payload', fabricated_payload FROM ground
UNION ALL SELECT system_id, run_id, 'REVIEW', 'missed entity', missed FROM sides UNION ALL SELECT system_id, run_id, 'REVIEW', 'spurious entity', spurious FROM sides UNION ALL SELECT system_id, run_id, 'REVIEW', 'naming against gold', renamed FROM sides
UNION ALL SELECT l.system_id, run_id, 'REVIEW', 'over-linking', n - w FROM (SELECT system_id, run_id, count(*) AS n FROM plan_links GROUP BY ALL) l JOIN (SELECT system_id, count(*) AS w FROM gold_hubs WHERE system_id <> 's5' GROUP BY 1) USING (system_id)
UNION ALL SELECT system_id, run_id, 'REVIEW', 'no gold', 1 FROM every WHERE system_id NOT IN (SELECT system_id FROM gold_hubs WHERE system_id <> 's5')),
told AS (SELECT system_id, run_id, coalesce(string_agg(reason || ' ' || CAST(n AS VARCHAR), '; ' ORDER BY reason || ' ' || CAST(n AS VARCHAR)) FILTER (WHERE level = 'REJECT'), '') AS blocking, coalesce(string_agg(reason || ' ' || CAST(n AS VARCHAR), '; ' ORDER BY reason || ' ' || CAST(n AS VARCHAR)) FILTER (WHERE level = 'REVIEW'), '') AS review FROM reasons WHERE n > 0 GROUP BY ALL)
SELECT system_id, run_id, coalesce(blocking, '') AS blocking, coalesce(review, '') AS review, CASE WHEN blocking <> '' THEN 'REJECT' WHEN review <> '' THEN 'REVIEW' ELSE 'APPROVE' END AS verdict FROM every LEFT JOIN told USING (system_id, run_id)"""
    r.add("ev15_verdict", judged, wide + VERDICT)


def statistics(r: Registry) -> None:
    KAPPA = "SELECT CAST(n AS BIGINT) AS n, CAST(n - agree AS BIGINT) AS disagreements, round(agree / n, 6) AS agreement, round(CASE WHEN pe >= 1 THEN 1.0 ELSE (agree / n - pe) / (1 - pe) END, 6) AS kappa"
    r.add("st1_kappa", lambda s, d: stats.kappa(*projected(s, d, "raters")), with_sql("raters") + f"{KAPPA} FROM (SELECT count(*) AS n, count(*) FILTER (WHERE a = b) AS agree, (SELECT sum(na * nb) FROM (SELECT a AS l, count(*) AS na FROM raters GROUP BY 1) JOIN (SELECT b AS l, count(*) AS nb FROM raters GROUP BY 1) USING (l)) / (count(*) * count(*)) AS pe FROM raters)")
    r.add("st1_distribution", lambda s, d: stats.label_distribution(projected(s, d, "raters")[0], "a"), with_sql("raters") + "SELECT CAST(a AS VARCHAR) AS label, count(*) AS n FROM raters GROUP BY 1")
    r.add("st2_gold_labels", lambda s, d: stats.gold_labels(projected(s, d, "gold_hubs")[0], projected(s, d, "plan_hubs")[0].select("system_id", "source_table").distinct()), with_sql("plan_hubs", "gold_hubs") + "SELECT system_id, source_table, CASE count(g.n) WHEN 0 THEN 'exclude' WHEN 1 THEN 'hub' ELSE 'split' END AS label FROM (SELECT DISTINCT system_id, source_table FROM plan_hubs) t LEFT JOIN (SELECT system_id, source_table, 1 AS n FROM gold_hubs) g USING (system_id, source_table) GROUP BY ALL")
    r.add("st3_majority", lambda s, d: stats.majority(table(s, d, "conversations").select("conv_id", "role", "turn"), "conv_id", "role", "turn"), "WITH c AS (SELECT conv_id, role, count(*) AS votes, min(turn) AS f FROM conversations GROUP BY ALL) SELECT conv_id, role, votes FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY votes DESC, f) AS n FROM c) WHERE n = 1")
    panel = lambda s, d: table(s, d, "orders").groupBy(F.col("o_custkey").alias("item"), F.col("o_orderpriority").alias("rater")).agg(F.max("o_orderstatus").alias("label"))
    P = "WITH l AS (SELECT o_custkey AS item, o_orderpriority AS rater, max(o_orderstatus) AS label FROM orders GROUP BY ALL), p AS (SELECT x.rater AS rater_a, y.rater AS rater_b, x.label AS a, y.label AS b FROM l x JOIN l y ON x.item = y.item AND x.rater < y.rater), t AS (SELECT rater_a, rater_b, count(*) AS n, count(*) FILTER (WHERE a = b) AS agree FROM p GROUP BY ALL), e AS (SELECT rater_a, rater_b, sum(na * nb) AS c FROM (SELECT rater_a, rater_b, a AS l, count(*) AS na FROM p GROUP BY ALL) JOIN (SELECT rater_a, rater_b, b AS l, count(*) AS nb FROM p GROUP BY ALL) USING (rater_a, rater_b, l) GROUP BY ALL) "
    r.add("st4_kappa_panel", lambda s, d: stats.kappa_panel(panel(s, d), "item", "rater", "label"), P + KAPPA.replace("SELECT ", "SELECT rater_a, rater_b, ", 1) + " FROM (SELECT rater_a, rater_b, n, agree, c / (n * n) AS pe FROM t JOIN e USING (rater_a, rater_b))")

    monthly = "SELECT o_orderpriority AS g, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INT) AS m, floor((2 * sum(CAST(round(o_totalprice * 100) AS BIGINT)) + count(*)) / (2 * count(*))) / 100 AS v FROM orders GROUP BY 1, 2"

    def interval(s: SparkSession, d: str) -> DataFrame:
        table(s, d, "orders").createOrReplaceTempView("orders")
        return rounded(stats.bootstrap_ci(s.sql(monthly), "g", "v", ["m"]))

    rounded = lambda df: df.withColumns({c: F.round(c, 6) for c in ("mean", "low", "high")})
    HEX = lambda c, n: f"CAST('0x' || substr(md5({c}), 1, {n}) AS BIGINT)"

    def boot_sql(rows: str, order: str, iterations: int) -> str:
        """Parts rows_, sizes, means and ends over a relation of (g, v and order columns): picks up to 1000 values, else Poisson weights."""
        draw = HEX("concat_ws('|', g, k, i, 42)", 12)
        weight = " + ".join(f"CAST(u >= {round(2**48 * sum(math.exp(-1) / math.factorial(x) for x in range(j + 1)))} AS INT)" for j in range(14))
        return f"rows_ AS (SELECT g, CAST(v AS DECIMAL(18,6)) AS v, row_number() OVER (PARTITION BY g ORDER BY v, {order}) - 1 AS i FROM {rows}), sizes AS (SELECT g, count(*) AS n, CAST(sum(v) AS DOUBLE) / count(*) AS mean FROM rows_ GROUP BY g), numbers AS (SELECT g, k, i, n, v, {draw} AS u FROM (SELECT g, i, n, v, unnest(range({iterations})) AS k FROM rows_ JOIN sizes USING (g))), picks AS (SELECT g, k, u % n AS i FROM numbers WHERE n <= 1000), means AS (SELECT g, k, CAST(sum(v) AS DOUBLE) / count(*) AS m FROM picks JOIN rows_ USING (g, i) GROUP BY ALL UNION ALL SELECT g, k, CAST(sum(v * w) AS DOUBLE) / sum(w) AS m FROM (SELECT g, k, v, {weight} AS w FROM numbers WHERE n > 1000) GROUP BY ALL), ends AS (SELECT g, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM means GROUP BY g)"

    r.add("st5_bootstrap_ci", interval, f"WITH base AS ({monthly}), {boot_sql('base', 'm', 10_000)} SELECT g, n, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high FROM sizes JOIN ends USING (g)")
    prices = "SELECT o_orderpriority AS g, o_orderkey AS m, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders"

    def of_rows(s: SparkSession, d: str) -> DataFrame:
        table(s, d, "orders").createOrReplaceTempView("orders")
        return rounded(stats.bootstrap_ci(s.sql(prices), "g", "v", ["m"], 200))

    r.add("st5_bootstrap_rows", of_rows, f"WITH base AS ({prices}), {boot_sql('base', 'm', 200)} SELECT g, n, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high FROM sizes JOIN ends USING (g)")
    pairs = lambda s, d: stats.paired(projected(s, d, "study")[0], "price", "off", "on")
    yearly = lambda s, d: pairs(s, d).where("seed div 12 = 1996").withColumn("d", F.col("vb") - F.col("va"))
    PAIRS = with_sql("study") + ", pairs AS (SELECT a.system_id, a.seed, a.value AS va, b.value AS vb, CAST(b.value - a.value AS DECIMAL(18,6)) AS d FROM study a JOIN study b USING (system_id, seed) WHERE a.condition = 'off' AND b.condition = 'on'), "
    FLIP = PAIRS + "rows_ AS (SELECT *, row_number() OVER (PARTITION BY system_id ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY system_id) AS n, sum(d) OVER (PARTITION BY system_id) AS observed FROM pairs WHERE seed // 12 = 1996), flips AS (SELECT system_id, n, observed, k, sum(CASE WHEN (k >> i) & 1 = 0 THEN d ELSE -d END) AS s FROM rows_, unnest(range(CAST(1 << n AS BIGINT))) t(k) GROUP BY ALL) SELECT system_id, n, round(CAST(observed AS DOUBLE) / n, 6) AS mean_difference, round(count(*) FILTER (WHERE abs(s) >= abs(observed)) / count(*), 6) AS p_value FROM flips GROUP BY system_id, n, observed"
    r.add("st6_permutation", lambda s, d: stats.permutation_test(yearly(s, d), ["system_id"]), FLIP)

    def flip_sql(extreme: str, iterations: int) -> str:
        """Parts flipped and test over pairs: all flips up to 18 pairs, else hashed draws."""
        sign = f"CASE WHEN n <= 18 THEN (k >> i) & 1 ELSE {HEX("concat_ws('|', system_id, k, i, 42)", 4)} % 2 END"
        return f"placed AS (SELECT *, row_number() OVER (PARTITION BY system_id ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY system_id) AS n, sum(d) OVER (PARTITION BY system_id) AS observed FROM pairs), flipped AS (SELECT system_id, n, observed, k, sum(CASE WHEN {sign} = 0 THEN d ELSE -d END) AS s FROM (SELECT *, unnest(range(CASE WHEN n <= 18 THEN CAST(1 << least(n, 18) AS BIGINT) ELSE {iterations} END)) AS k FROM placed) GROUP BY ALL), test AS (SELECT system_id, n, round(CAST(observed AS DOUBLE) / n, 6) AS mean_difference, round(CASE WHEN n <= 18 THEN hits / flips ELSE (hits + 1) / (flips + 1) END, 6) AS p_value FROM (SELECT system_id, n, observed, count(*) FILTER (WHERE {extreme}) AS hits, count(*) AS flips FROM flipped GROUP BY ALL))"

    r.add("st6_permutation_sampled", lambda s, d: stats.permutation_test(pairs(s, d).withColumn("d", F.col("vb") - F.col("va")), ["system_id"], "greater"), PAIRS + flip_sql("s >= observed", 20_000) + " SELECT system_id, n, mean_difference, p_value FROM test")
    sided = lambda s, d: table(s, d, "orders").select("o_orderpriority", F.when(F.col("o_orderkey") % 3 == 0, "a").otherwise("b").alias("side"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    DELTA = "WITH x AS (SELECT o_orderpriority, o_orderkey % 3 = 0 AS a, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders), c AS (SELECT o_orderpriority, v, count(*) FILTER (WHERE a) AS na, count(*) FILTER (WHERE NOT a) AS nb FROM x GROUP BY ALL), w AS (SELECT *, coalesce(sum(nb) OVER (PARTITION BY o_orderpriority ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c), t AS (SELECT o_orderpriority, sum(na) AS n_a, sum(nb) AS n_b, sum(na * below) AS more, sum(na * nb) AS same FROM w GROUP BY 1), z AS (SELECT *, (more - (n_a * n_b - more - same)) / (n_a * n_b) AS x FROM t) SELECT o_orderpriority, CAST(n_a AS BIGINT) AS n_a, CAST(n_b AS BIGINT) AS n_b, round(x, 6) AS delta, CASE WHEN abs(x) < 0.147 THEN 'negligible' WHEN abs(x) < 0.33 THEN 'small' WHEN abs(x) < 0.474 THEN 'medium' ELSE 'large' END AS magnitude FROM z"
    r.add("st7_cliffs_delta", lambda s, d: stats.cliffs_delta(sided(s, d), ["o_orderpriority"], "side", "v"), DELTA)
    EFFECT = "effect AS (SELECT system_id, round(x, 6) AS delta, CASE WHEN abs(x) < 0.147 THEN 'negligible' WHEN abs(x) < 0.33 THEN 'small' WHEN abs(x) < 0.474 THEN 'medium' ELSE 'large' END AS magnitude FROM (SELECT a.system_id, (count(*) FILTER (WHERE b.vb > a.va) - count(*) FILTER (WHERE b.vb < a.va)) / count(*) AS x FROM pairs a JOIN pairs b USING (system_id) GROUP BY 1)), means_ AS (SELECT system_id, count(*) AS n, round(CAST(sum(CAST(va AS DECIMAL(18,6))) AS DOUBLE) / count(*), 6) AS mean_a, round(CAST(sum(CAST(vb AS DECIMAL(18,6))) AS DOUBLE) / count(*), 6) AS mean_b FROM pairs GROUP BY 1)"
    COMPARE = PAIRS + flip_sql("abs(s) >= abs(observed)", 20_000) + ", diffs AS (SELECT system_id AS g, seed, d AS v FROM pairs), " + boot_sql("diffs", "seed", 2000) + ", " + EFFECT + ", compared AS (SELECT m.system_id, m.n, mean_a, mean_b, mean_difference, p_value, delta, magnitude, round(low, 6) AS low, round(high, 6) AS high FROM means_ m JOIN test USING (system_id) JOIN effect USING (system_id) JOIN ends ON ends.g = m.system_id)"
    r.add("st8_compare", lambda s, d: stats.compare(pairs(s, d)), COMPARE + " SELECT * FROM compared")
    r.add("st9_significance", lambda s, d: stats.significance(projected(s, d, "study")[0].where("system_id <> 'P' or condition = 'on'"), "price", "off", "on"), COMPARE + " SELECT DISTINCT s.system_id, c.* EXCLUDE (system_id), CASE WHEN c.n IS NULL THEN 'no common seed' END AS note FROM study s LEFT JOIN (SELECT * FROM compared WHERE system_id <> 'P') c USING (system_id)")
    r.add("st10_self_consistency", lambda s, d: stats.self_consistency(agreeing(s, d)), SAME_PRINTS + "SELECT system_id, round(max(n) / sum(n), 6) AS self_consistency FROM (SELECT system_id, fingerprint, count(*) AS n FROM prints GROUP BY ALL) GROUP BY 1")
    r.add("st11_idempotency", lambda s, d: stats.idempotency(agreeing(s, d)), SAME_PRINTS + "SELECT system_id, round(coalesce(avg(CAST(fingerprint = f AS INT)) FILTER (WHERE run_id <> r), 1.0), 6) AS idempotency FROM prints JOIN (SELECT system_id, arg_min(fingerprint, run_id) AS f, min(run_id) AS r FROM prints GROUP BY 1) USING (system_id) GROUP BY 1")


def register(r: Registry) -> None:
    drift(r)
    plans(r)
    scores(r)
    statistics(r)
