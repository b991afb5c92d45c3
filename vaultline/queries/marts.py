"""Queries of the business vault, data quality and profiling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultline.functions import rules
from vaultline.operators import business_vault as bv
from vaultline.operators import profiling as pr
from vaultline.operators import quality as dq
from vaultline.operators import raw_vault as rv
from vaultline.queries.bindings import END, TABLES, Registry, diff_sql, projected, stg_li, stg_orders, table, with_sql
from vaultline.queries.loads import eff_part, hub_customer, sat_priority, sat_status, shared_path
from vaultline.sources import bronze, sinks
from vaultline.sources.versioned import COMPRESSION, VersionedTable

TODAY = "2002-01-01"
KINDS = {"ECONOMY": "basic", "STANDARD": "basic", "PROMO": "special"}


def months(s: SparkSession) -> DataFrame:
    return bv.as_of_dates(s, "1995-01-01", "2001-12-31", "month")


def customer_pit(s: SparkSession, d: str) -> DataFrame:
    return bv.pit(hub_customer(s, d), months(s), [("status", sat_status(s, d), "o_orderdate"), ("priority", sat_priority(s, d), "o_orderdate")], "hk_customer")


def customer_bridge(s: SparkSession, d: str, at: object = None) -> DataFrame:
    orders = rv.load_link(stg_orders(s, d), "hk_order_customer", ["hk_order", "hk_customer"], "o_orderdate", "record_source").drop("o_orderdate", "record_source")
    held = bv.active(eff_part(s, d), at).select("hk_part_supplier", "hk_part", "hk_supplier")
    staged = rv.touched(stg_li(s, d), held, "hk_part_supplier")  # few relationships are active: others are left away where lines are read
    lines = rv.load_link(staged, "hk_order_part_supplier", ["hk_order", "hk_part", "hk_supplier"], "l_shipdate", "record_source").drop("l_shipdate", "record_source")
    lines = lines.join(held.select("hk_part", "hk_supplier").distinct(), ["hk_part", "hk_supplier"], "left_semi")
    return bv.bridge(hub_customer(s, d), "hk_customer", [(orders, "hk_order_customer", "hk_customer", None), (lines, "hk_order_part_supplier", "hk_order", None)], at)


LINK_LINES = "SELECT DISTINCT hk_order_part_supplier, hk_order, hk_part, hk_supplier FROM stg_li"
BRIDGE = with_sql("link_oc", "stg_li", "eff_part")


def revenue(s: SparkSession, d: str) -> DataFrame:
    """Revenue by market segment and month, over the vault: links, hubs and the dimension."""
    dims = bv.dim(hub_customer(s, d), "hk_customer", ["o_custkey"], [])
    customers = table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    rows = stg_orders(s, d).select("hk_customer", "price", F.last_day("o_orderdate").cast("timestamp_ntz").alias("month_end"))
    return bv.fact(rows, [(dims.join(customers, "o_custkey"), "hk_customer")], ["c_mktsegment", "month_end"], {"revenue": F.sum("price").cast("decimal(38,2)"), "orders": F.count("*")})


REVENUE = with_sql("stg_orders") + "SELECT c_mktsegment, CAST(last_day(o_orderdate) AS TIMESTAMP) AS month_end, CAST(sum(price) AS DECIMAL(38,2)) AS revenue, count(*) AS orders FROM stg_orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL"


def business(r: Registry) -> None:
    r.add("bv1_as_of_days", lambda s, d: bv.as_of_dates(s, "1995-01-01", "1996-12-31").join(table(s, d, "orders").agg(F.min("o_orderdate").alias("m")), F.col("as_of_date") >= F.col("m")).select("as_of_date"),
          "SELECT CAST(x AS TIMESTAMP) AS as_of_date FROM (SELECT unnest(generate_series(DATE '1995-01-01', DATE '1996-12-31', INTERVAL 1 DAY)) AS x) WHERE x >= (SELECT min(o_orderdate) FROM orders)")
    r.add("bv1_business_days", lambda s, d: bv.as_of_dates(s, "1995-01-01", "1995-12-31", business_days=True).join(table(s, d, "orders").select(F.col("o_orderdate").alias("as_of_date")).distinct(), "as_of_date"),
          "SELECT DISTINCT o_orderdate AS as_of_date FROM orders WHERE year(o_orderdate) = 1995 AND dayofweek(o_orderdate) NOT IN (0, 6)")
    r.add("bv2_pit", customer_pit, with_sql("pit_customer") + "SELECT * FROM pit_customer")

    def since(s: SparkSession, d: str) -> DataFrame:
        """The hub's keys and the versions' dates are written once, for both runs; the second overwrites the dates after its mark."""
        once = lambda df, name: sinks.as_table(df, shared_path(s, name), COMPRESSION)
        path, hub = shared_path(s, "pit"), once(hub_customer(s, d).select("hk_customer"), "hub")
        sats = [(n, once(sat(s, d).select("hk_customer", "o_orderdate"), f"sat-{n}"), "o_orderdate") for n, sat in (("status", sat_status), ("priority", sat_priority))]
        early = months(s).where(F.col("as_of_date") <= F.lit("2001-06-30 00:00:00").cast("timestamp_ntz"))
        sinks.overwrite_partitions(bv.pit_dates(hub, early, sats, "hk_customer"), path, ["as_of_date"], COMPRESSION)
        later = bv.pit_since(hub, months(s), sats, "hk_customer", "2001-05-31 00:00:00", dates=True)
        stored = sinks.overwrite_partitions(later, path, ["as_of_date"], COMPRESSION)
        return bv.pit_of_dates(stored.withColumn("as_of_date", F.col("as_of_date").cast("timestamp_ntz")), sats, "hk_customer")

    r.add("bv3_pit_incremental", since, with_sql("pit_customer") + "SELECT * FROM pit_customer")

    def carried(s: SparkSession, d: str) -> DataFrame:
        """The hub's keys and satellites written once; dates go on from the snapshot of the last one before, and are stored as runs."""
        path, hub = shared_path(s, "pit"), sinks.as_table(hub_customer(s, d).select("hk_customer"), shared_path(s, "hub"))
        sats = [(n, sinks.as_table(sat(s, d), shared_path(s, f"sat-{n}")), "o_orderdate") for n, sat in (("status", sat_status), ("priority", sat_priority))]
        edges = ["1997-12-31 00:00:00", "1999-12-31 00:00:00"]
        early, middle = (months(s).where(F.col("as_of_date") <= F.lit(e).cast("timestamp_ntz")) for e in edges)
        stored = VersionedTable(s, path)
        stored.append(bv.pit_runs(hub, early, sats, "hk_customer"))
        for spine, edge in ((middle, edges[0]), (months(s), edges[1])):
            stored.append(bv.pit_since(hub, spine, sats, "hk_customer", edge, bv.runs_state(stored.read(), edge), runs=True))
        return bv.pit_of_runs(stored.read(), months(s), sats, "hk_customer")

    r.add("bv3_pit_carried", carried, with_sql("pit_customer") + "SELECT * FROM pit_customer")
    r.add("bv4_bridge", customer_bridge, BRIDGE + f"SELECT o.hk_order, o.hk_customer, o.hk_order_customer, l.hk_order_part_supplier, l.hk_part, l.hk_supplier FROM link_oc o JOIN ({LINK_LINES}) l USING (hk_order) WHERE (l.hk_part, l.hk_supplier) IN (SELECT (hk_part, hk_supplier) FROM eff_part WHERE end_date = {END})")
    moment = "TIMESTAMP '1999-03-31 00:00:00'"
    r.add("bv4_bridge_as_of", lambda s, d: customer_bridge(s, d, F.lit("1999-03-31 00:00:00").cast("timestamp_ntz")), BRIDGE + f"SELECT o.hk_order, o.hk_customer, o.hk_order_customer, l.hk_order_part_supplier, l.hk_part, l.hk_supplier FROM link_oc o JOIN ({LINK_LINES}) l USING (hk_order) WHERE (l.hk_part, l.hk_supplier) IN (SELECT (hk_part, hk_supplier) FROM eff_part WHERE start_date <= {moment} AND {moment} < end_date)")
    r.add("bv5_dim", lambda s, d: bv.dim(hub_customer(s, d), "hk_customer", ["o_custkey"], [(sat_status(s, d), "o_orderdate", ["o_orderstatus"]), (sat_priority(s, d), "o_orderdate", ["o_orderpriority"])]),
          with_sql("hub_customer", "sat_status", "sat_priority") + "SELECT h.hk_customer, h.o_custkey, s.o_orderstatus, p.o_orderpriority FROM hub_customer h LEFT JOIN (SELECT hk_customer, arg_max(o_orderstatus, o_orderdate) AS o_orderstatus FROM sat_status GROUP BY 1) s USING (hk_customer) LEFT JOIN (SELECT hk_customer, arg_max(o_orderpriority, o_orderdate) AS o_orderpriority FROM sat_priority GROUP BY 1) p USING (hk_customer)")
    r.add("bv5_dim_as_of", lambda s, d: bv.dim_as_of(customer_pit(s, d), hub_customer(s, d), "hk_customer", ["o_custkey"], [("status", sat_status(s, d), "o_orderdate", ["o_orderstatus"]), ("priority", sat_priority(s, d).withColumnRenamed("o_orderpriority", "priority"), "o_orderdate", ["priority"])]).select("o_custkey", "as_of_date", "o_orderstatus", "priority"),
          with_sql("pit_customer") + "SELECT h.o_custkey, as_of_date, s.o_orderstatus, p.o_orderpriority AS priority FROM pit_customer t JOIN hub_customer h USING (hk_customer) LEFT JOIN sat_status s ON s.hk_customer = t.hk_customer AND s.o_orderdate = t.status_ldts LEFT JOIN sat_priority p ON p.hk_customer = t.hk_customer AND p.o_orderdate = t.priority_ldts")

    def lines(s: SparkSession, d: str) -> DataFrame:
        parts = table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
        rows = stg_li(s, d).join(stg_orders(s, d).select("hk_order", "hk_customer"), "hk_order")
        return bv.fact(rows, [(parts, "l_partkey"), (parts, "l_partkey"), (hub_customer(s, d).select("hk_customer", "o_custkey"), "hk_customer")], ["o_custkey", "p_brand"], {"quantity": F.sum("quantity").cast("decimal(38,2)"), "lines": F.count("*")})

    r.add("bv6_fact", lines, "SELECT o_custkey, p_brand, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS quantity, count(*) AS lines FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY o_custkey, p_brand")
    r.add("bv7_fact_measures", revenue, REVENUE)
    derived = lambda: {"priority_class": F.expr("CASE WHEN o_orderpriority < '3' THEN 'fast' ELSE 'slow' END")}
    r.add("bv8_bv_sat", lambda s, d: bv.bv_sat(sat_status(s, d), "hk_customer", derived(), "o_orderdate", "record_source"),
          with_sql("sat_status") + f", rules_ AS (SELECT hk_customer, o_orderdate, record_source, CASE WHEN o_orderpriority < '3' THEN 'fast' ELSE 'slow' END AS priority_class FROM sat_status), hashed AS (SELECT *, {diff_sql('priority_class')} AS bv_hashdiff FROM rules_) SELECT hk_customer, bv_hashdiff, priority_class, o_orderdate, record_source FROM (SELECT *, lag(bv_hashdiff) OVER (PARTITION BY hk_customer ORDER BY o_orderdate) AS b FROM hashed) WHERE b IS DISTINCT FROM bv_hashdiff")
    r.add("bv8_user_rules", lambda s, d: sat_status(s, d).select("hk_customer", "o_orderdate", *(c.alias(n) for n, c in bv.checked_rules(sat_status(s, d), {"closed": "o_orderstatus = 'F'", "code": "substr(o_orderpriority, 1, 1)"}).items())),
          with_sql("sat_status") + "SELECT hk_customer, o_orderdate, o_orderstatus = 'F' AS closed, substr(o_orderpriority, 1, 1) AS code FROM sat_status")
    nxt = "lead(o_orderdate) OVER (PARTITION BY hk_customer ORDER BY o_orderdate)"
    r.add("bv9_scd2", lambda s, d: bv.scd2(sat_status(s, d), "hk_customer", ["o_orderstatus", "o_orderpriority"], "o_orderdate", deleted=F.col("o_orderstatus") == "P"),
          with_sql("sat_status") + f"SELECT hk_customer, o_orderstatus, o_orderpriority, o_orderdate AS valid_from, coalesce({nxt}, {END}) AS valid_to, {nxt} IS NULL AS is_current, o_orderstatus = 'P' AS is_deleted FROM sat_status")
    dates = ["1996-01-01 00:00:00", "1998-06-15 00:00:00", "2001-01-01 00:00:00"]

    def moments(s: SparkSession, d: str) -> DataFrame:
        return bv.as_of_each(sat_status(s, d), "hk_customer", "o_orderdate", ["o_orderstatus"], {t: F.lit(t).cast("timestamp_ntz") for t in dates})

    r.add("bv10_as_of", moments, with_sql("sat_status") + " UNION ALL ".join(f"SELECT hk_customer, max(o_orderdate) AS o_orderdate, arg_max(o_orderstatus, o_orderdate) AS o_orderstatus, '{t}' AS at FROM sat_status WHERE o_orderdate <= TIMESTAMP '{t}' GROUP BY hk_customer" for t in dates))
    r.add("bv11_current", lambda s, d: bv.current(sat_status(s, d).withColumn("gone", F.col("o_orderstatus") == "P"), "hk_customer", "o_orderdate", ["o_orderstatus"], "gone"),
          with_sql("sat_status") + "SELECT hk_customer, o_orderdate, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY hk_customer ORDER BY o_orderdate DESC) AS n FROM sat_status) WHERE n = 1 AND o_orderstatus <> 'P'")


def derivations(r: Registry) -> None:
    kv = lambda: F.when(F.col("p_partkey") % 10 > 0, F.col("p_size") * 3)
    r.add("bv12_voltage_tier", lambda s, d: table(s, d, "part").select("p_partkey", rules.voltage_tier(kv()).alias("tier")), "SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN p_size * 3 >= 110 THEN 'EHV' WHEN p_size * 3 >= 36 THEN 'HV' WHEN p_size * 3 >= 1 THEN 'MV' ELSE 'LV' END AS tier FROM part")
    r.add("bv13_vendor", lambda s, d: table(s, d, "part").select("p_partkey", rules.vendor(F.concat(F.lit("  "), "p_brand", F.lit(" "))).alias("vendor")), "SELECT p_partkey, upper(trim(p_brand)) AS vendor FROM part")
    words = lambda: F.when(F.col("event_type") == "view", " Active ").when(F.col("event_type") == "click", "TRUE").when(F.col("event_type") == "error", "Out of Service").when(F.col("event_type") == "signup", None).otherwise("0")
    r.add("bv14_state", lambda s, d: table(s, d, "events").select("event_id", rules.state(words()).alias("state")), "SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'in_service' WHEN event_type IN ('error', 'purchase') THEN 'out_of_service' ELSE 'unknown' END AS state FROM events")
    today = lambda: F.lit("2025-01-01").cast("date")
    age = "date_diff('day', CAST(o_orderdate - to_months(CAST(o_orderkey % 400 AS INT)) AS DATE), DATE '2025-01-01') / 365.0"
    r.add("bv15_age", lambda s, d: table(s, d, "orders").withColumn("t", F.expr("add_months(o_orderdate, -cast(o_orderkey % 400 as int))")).select("o_orderkey", rules.age_band("t", today()).alias("band"), rules.age_years("t", today()).alias("years")),
          f"SELECT o_orderkey, CASE WHEN {age} < 10 THEN 'new' WHEN {age} < 25 THEN 'mid' WHEN {age} < 50 THEN 'aged' ELSE 'legacy' END AS band, CAST(floor({age}) AS BIGINT) AS years FROM orders")
    phases = lambda: F.when(F.col("p_size") % 4 == 0, "ABC").when(F.col("p_size") % 4 == 1, "3").when(F.col("p_size") % 4 == 2, "A")
    r.add("bv16_three_phase", lambda s, d: table(s, d, "part").select("p_partkey", rules.three_phase(phases()).alias("three_phase")), "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false END AS three_phase FROM part")
    day = lambda: F.lit("2001-09-01").cast("date")
    n = "date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-09-01')"
    r.add("bv17_incident", lambda s, d: table(s, d, "orders").select("o_orderkey", rules.severity("o_orderpriority").alias("severity"), rules.aging("o_orderdate", day()).alias("aging"), rules.breached("o_orderdate", "o_orderpriority", day()).alias("is_breached")),
          f"SELECT o_orderkey, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'CRITICAL' WHEN '2' THEN 'HIGH' WHEN '3' THEN 'MEDIUM' ELSE 'LOW' END AS severity, CASE WHEN {n} <= 7 THEN 'NEW' WHEN {n} <= 30 THEN 'RECENT' WHEN {n} <= 90 THEN 'AGED' ELSE 'STALE' END AS aging, {n} > CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 1 WHEN '2' THEN 3 WHEN '3' THEN 7 ELSE 30 END AS is_breached FROM orders")
    r.add("bv18_equipment", lambda s, d: table(s, d, "part").select("p_partkey", rules.category("p_type", KINDS).alias("category")), "SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 'basic' WHEN p_type = 'PROMO' THEN 'special' ELSE 'other' END AS category FROM part")
    r.add("bv18_lifecycle", lambda s, d: table(s, d, "orders").select("o_orderkey", rules.lifecycle("o_orderstatus").alias("stage")), "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'planned' WHEN 'P' THEN 'in_progress' WHEN 'F' THEN 'complete' ELSE 'unknown' END AS stage FROM orders")
    patterns = [("starts_with_digit", "^[0-9]"), ("key", "^k[0-9]"), ("urgent", "urgent|high"), ("technical", "^load_")]

    def detected(s: SparkSession, d: str) -> DataFrame:
        (sats,) = projected(s, d, "plan_sats")
        first = sats.groupBy("system_id", "run_id", "parent_hub").agg(F.min_by("payload", "name").alias("payload"))
        return bv.detect_rules(first, s.createDataFrame(patterns, "rule string, pattern string"))

    r.add("bv19_detect_rules", detected, with_sql("plan_sats") + ", firsts AS (SELECT parent_hub, arg_min(payload, name) AS payload FROM plan_sats GROUP BY system_id, run_id, parent_hub), cells AS (SELECT parent_hub, unnest(payload) AS column_name, generate_subscripts(payload, 1) AS pos FROM firsts), rules_ AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in patterns) + ") v(rule, pattern)) SELECT parent_hub, rule, arg_min(column_name, pos) AS column_name FROM cells, rules_ WHERE regexp_matches(lower(column_name), pattern) GROUP BY parent_hub, rule")
    r.add("bv20_derive_pits", lambda s, d: bv.derive_pits(*projected(s, d, "plan_sats")).withColumn("satellites", F.array_join("satellites", ",")),
          with_sql("plan_sats") + "SELECT system_id, run_id, parent_hub, string_agg(DISTINCT name, ',' ORDER BY name) AS satellites FROM plan_sats GROUP BY ALL HAVING count(DISTINCT name) >= 2")
    r.add("bv21_derive_bridges", lambda s, d: bv.derive_bridges(*projected(s, d, "plan_links", "plan_hubs")).withColumn("hubs", F.array_join("hubs", ",")),
          with_sql("plan_links", "plan_hubs") + ", cells AS (SELECT system_id, run_id, name, unnest(fk_columns) AS hash_key, generate_subscripts(fk_columns, 1) AS pos FROM plan_links) SELECT c.system_id, c.run_id, c.name, string_agg(h.name, ',' ORDER BY pos) AS hubs FROM cells c JOIN plan_hubs h ON h.system_id = c.system_id AND h.run_id = c.run_id AND h.hash_key = c.hash_key GROUP BY ALL HAVING count(*) >= 2")


def results(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    status = F.when(F.col("o_orderkey") % 2 == 0, F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "error").otherwise("skipped")).otherwise(F.when(F.col("o_orderstatus") == "F", "pass").when(F.col("o_orderstatus") == "O", "fail").otherwise("skipped"))
    return o.select(F.col("o_orderpriority").alias("project"), F.col("o_orderkey").cast("string").alias("unique_id"), F.when(F.col("o_orderkey") % 2 == 0, "model").otherwise("test").alias("resource_type"), status.alias("status"))


RESULTS = "WITH results AS (SELECT o_orderpriority AS project, CASE WHEN o_orderkey % 2 = 0 THEN 'model' ELSE 'test' END AS resource_type, CASE WHEN o_orderkey % 2 = 0 THEN CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'error' ELSE 'skipped' END ELSE CASE o_orderstatus WHEN 'F' THEN 'pass' WHEN 'O' THEN 'fail' ELSE 'skipped' END END AS status FROM orders) "
RATES = "count(*) AS n_results, round(count(*) FILTER (WHERE resource_type = 'model' AND status = 'success') / nullif(count(*) FILTER (WHERE resource_type = 'model' AND status <> 'skipped'), 0), 4) AS model_rate, round(count(*) FILTER (WHERE resource_type = 'test' AND status = 'pass') / nullif(count(*) FILTER (WHERE resource_type = 'test' AND status <> 'skipped'), 0), 4) AS test_rate"


def quality(r: Registry) -> None:
    holes = lambda s, d: stg_orders(s, d).select("hk_customer", F.when(F.col("o_orderkey") % 7 > 0, F.col("hk_order")).alias("hk_order"), "o_orderdate")
    r.add("dq1_not_null", lambda s, d: dq.check_not_null(holes(s, d), ["hk_customer", "hk_order", "o_orderdate"]),
          "SELECT 'hk_customer' AS column_name, CAST(0 AS BIGINT) AS failures, 'pass' AS status UNION ALL SELECT 'hk_order', count(*) FILTER (WHERE o_orderkey % 7 = 0), 'fail' FROM orders UNION ALL SELECT 'o_orderdate', 0, 'pass'")
    r.add("dq2_unique", lambda s, d: dq.check_unique(table(s, d, "orders"), ["o_custkey"]), "SELECT o_custkey, count(*) AS copies FROM orders GROUP BY 1 HAVING count(*) > 1")
    r.add("dq3_unique_combination", lambda s, d: dq.check_unique(table(s, d, "orders"), ["o_custkey", "o_orderdate"]), "SELECT o_custkey, o_orderdate, count(*) AS copies FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
    r.add("dq4_hash_format", lambda s, d: dq.check_hash_format(stg_orders(s, d).select(F.when(F.col("o_orderkey") % 5 == 0, "bad").otherwise(F.col("hk_order")).alias("h")), "h"), "SELECT count(*) AS n_rows, count(*) FILTER (WHERE o_orderkey % 5 = 0) AS failures FROM orders")
    r.add("dq5_row_counts", lambda s, d: dq.row_counts({t: table(s, d, t) for t in TABLES} | {"empty": table(s, d, "region").where("false")}),
          " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows, 'OK' AS status FROM {t}" for t in TABLES) + " UNION ALL SELECT 'empty', 0, 'WARN'")
    r.add("dq6_versions", lambda s, d: dq.check_versions(hub_customer(s, d), sat_status(s, d), "hk_customer", "o_custkey", 8), with_sql("hub_customer", "sat_status") + "SELECT o_custkey, count(s.hk_customer) AS versions, count(s.hk_customer) >= 8 AS passed FROM hub_customer h LEFT JOIN sat_status s USING (hk_customer) GROUP BY o_custkey")
    r.add("dq7_orphans", lambda s, d: dq.check_orphans(table(s, d, "lineitem").select("l_orderkey", "l_linenumber"), table(s, d, "orders").where("o_orderkey % 4 > 0").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey"),
          "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 > 0)")
    r.add("dq8_pass_rates", lambda s, d: dq.pass_rates(results(s, d), ["project"]), RESULTS + f"SELECT project, {RATES} FROM results GROUP BY project")
    r.add("dq8_outcomes", lambda s, d: dq.outcome_counts(results(s, d), ["success", "error", "pass", "fail", "skipped"]), RESULTS + "SELECT resource_type, " + ", ".join(f"count(*) FILTER (WHERE status = '{x}') AS {x}" for x in ("success", "error", "pass", "fail", "skipped")) + " FROM results GROUP BY 1")
    r.add("dq9_sweep_rates", lambda s, d: dq.sweep_rates(results(s, d)), RESULTS + f"SELECT count(*) AS projects, round(avg(model_rate), 4) AS model_rate, round(avg(test_rate), 4) AS test_rate FROM (SELECT project, {RATES} FROM results GROUP BY project)")
    r.add("dq10_reconcile", lambda s, d: dq.reconcile(table(s, d, "orders"), "o_custkey", hub_customer(s, d).where("o_custkey % 9 > 0"), "o_custkey", (F.col("o_custkey") % 10), "bucket"),
          "SELECT o_custkey % 10 AS bucket, count(DISTINCT o_custkey) AS source_keys, count(DISTINCT o_custkey) FILTER (WHERE o_custkey % 9 > 0) AS hub_keys, count(DISTINCT o_custkey) - count(DISTINCT o_custkey) FILTER (WHERE o_custkey % 9 > 0) AS difference FROM orders GROUP BY 1")

    def audit(s: SparkSession, d: str) -> DataFrame:
        e = table(s, d, "events")
        return dq.audit_log(e, F.concat(F.lit("m"), F.col("user_id").cast("string")), F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "signup", "STARTED").otherwise("SUCCESS"), F.col("event_id"), F.col("ts"))

    r.add("dq11_audit_status", lambda s, d: dq.audit_status(audit(s, d)), "WITH log AS (SELECT 'm' || CAST(user_id AS VARCHAR) AS model, CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'STARTED' ELSE 'SUCCESS' END AS status, event_id AS n_rows, ts FROM events) SELECT model, arg_max(status, ts) AS status, arg_max(n_rows, ts) AS n_rows, max(ts) AS logged_at, min(ts) AS started FROM log GROUP BY model")


def profile_sql(name: str, columns: list[str]) -> str:
    one = lambda c: f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_nulls, count(DISTINCT {c}) AS n_distinct FROM {name}"
    inner = " UNION ALL ".join(map(one, columns))
    ratio = "CASE WHEN n_rows - n_nulls = 0 THEN 0.0::DOUBLE ELSE round(n_distinct / (n_rows - n_nulls), 6) END"
    return f"SELECT *, CASE WHEN n_rows = 0 THEN 0.0::DOUBLE ELSE round(n_nulls / n_rows, 6) END AS null_rate, {ratio} AS cardinality_ratio, n_rows > 0 AND n_nulls = 0 AND {ratio} >= 0.99 AS is_likely_key FROM ({inner})"


COLUMNS = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate"],
}
NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


def catalog(s: SparkSession, d: str) -> DataFrame:
    return bronze.discover(s, {t: table(s, d, t) for t in TABLES})


def profiles(s: SparkSession, d: str) -> DataFrame:
    return dq.union_all([pr.profile(table(s, d, t)).withColumn("table_name", F.lit(t)) for t in NAMES])


CATALOG_SQL = "catalog_ AS (SELECT table_name, column_name, ordinal_position AS ordinal, data_type FROM information_schema.columns WHERE table_name IN (" + ", ".join(f"'{t}'" for t in TABLES) + "))"
NAMES_SQL = with_sql("catalog_names", "catalog_profiles")
KEYED = "keyed AS (SELECT *, CASE WHEN lower(column_name) IN ('mrid', 'id', 'uuid') THEN 0 WHEN regexp_matches(lower(column_name), '_(mrid|id|key|uuid)$') THEN 1 END AS tier FROM catalog_names), found AS (SELECT table_name, arg_min(column_name, tier * 10000000 + ordinal) AS business_key FROM keyed GROUP BY table_name)"
SYSTEM = "(lower(column_name) IN ('record_source', 'load_date', 'load_datetime', 'load_ts', 'loaded_at', 'dl_loaded_at', 'dl_load_date', 'dl_load_ts', 'ingestion_timestamp', 'ingest_ts', 'etl_load_ts', '_loaded_at', 'created_at', 'updated_at', 'modified_at', 'deleted_at', 'sys_created_on', 'sys_updated_on', 'sys_mod_count') OR regexp_matches(lower(column_name), '^(__[$]|_dl_|dl__)'))"
HINTED = "CASE WHEN coalesce(is_likely_key, false) THEN 0 WHEN lower(column_name) IN ('mrid', 'sys_id', 'guid', 'uuid', 'uid') THEN 1 WHEN regexp_matches(lower(column_name), '(id|_key)$') THEN 2 ELSE 3 END"
FULL = {
    "region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "customer": COLUMNS["customer"], "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"], "orders": COLUMNS["orders"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
}
DOUBLES = {"c_acctbal", "s_acctbal", "p_retailprice", "o_totalprice", "l_quantity", "l_extendedprice", "l_discount", "l_tax"}
FKS = "SELECT DISTINCT c.table_name, c.column_name, p.table_name AS parent_table FROM catalog_ c JOIN (SELECT DISTINCT table_name, regexp_replace(table_name, 's$', '') AS stem FROM catalog_) p ON c.table_name <> p.table_name AND regexp_replace(lower(c.column_name), '^[a-z]_', '') IN (p.stem || '_id', p.stem || 'id', p.stem || '_key', p.stem || 'key')"


def profiling(r: Registry) -> None:
    for t in ("customer", "orders", "events"):
        r.add(f"pr1_profile_{t}", lambda s, d, t=t: pr.profile(table(s, d, t)), profile_sql(t, COLUMNS[t]))
    r.add("pr1_profile_empty", lambda s, d: pr.profile(table(s, d, "region").where("r_regionkey < 0")), "SELECT column_name, CAST(0 AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_nulls, CAST(0 AS BIGINT) AS n_distinct, 0.0::DOUBLE AS null_rate, 0.0::DOUBLE AS cardinality_ratio, false AS is_likely_key FROM (VALUES ('r_regionkey'), ('r_name')) v(column_name)")
    money = lambda: F.col("c_acctbal").cast("decimal(18,2)")  # noqa: E731  engines print doubles in their own ways
    sample = lambda s, d: pr.profile(table(s, d, "customer").withColumn("c_acctbal", money()), samples=5).select("column_name", F.array_join("samples", "|").alias("samples"))
    few = lambda c, v: f"SELECT '{c}' AS column_name, string_agg(v, '|' ORDER BY v) AS samples FROM (SELECT DISTINCT substr(CAST({v} AS VARCHAR), 1, 200) AS v FROM customer ORDER BY v LIMIT 5)"
    r.add("pr2_samples", sample, " UNION ALL ".join(few(c, "CAST(c_acctbal AS DECIMAL(18,2))" if c == "c_acctbal" else c) for c in COLUMNS["customer"]))

    def sketched(s: SparkSession, d: str) -> DataFrame:
        """Sketches of each month's orders, merged; the last column holds them against the exact counts."""
        o = table(s, d, "orders").withColumn("month", F.trunc("o_orderdate", "month"))
        parts = sinks.as_table(pr.part_profiles(o, "month"), shared_path(s, "profiles"))
        exact = pr.profile(o.drop("month")).select("column_name", F.col("n_distinct").alias("exact"))
        return pr.merged_profile(parts).join(exact, "column_name").select("column_name", "n_rows", "n_nulls", "null_rate", (F.abs(F.col("n_distinct") - F.col("exact")) <= F.greatest("n_distinct_error", F.lit(1))).alias("within_error"))

    r.add("pr1_profile_sketches", sketched, " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_nulls, round((count(*) - count({c})) / count(*), 6) AS null_rate, true AS within_error FROM orders" for c in COLUMNS["orders"]))
    r.add("pr3_likely_keys", lambda s, d: profiles(s, d).where(pr.likely_key(pr.is_system(F.col("column_name")))).select("table_name", "column_name"), " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name FROM {t} HAVING count(*) > 0 AND count({c}) = count(*) AND round(count(DISTINCT {c}) / count(*), 6) >= 0.99" for t, cs in FULL.items() for c in cs))
    r.add("pr4_profile_subset", lambda s, d: pr.profile(table(s, d, "lineitem"), ["l_partkey", "l_linenumber"]), profile_sql("lineitem", ["l_partkey", "l_linenumber"]))
    named = lambda s, d: projected(s, d, "catalog_names")[0]
    kinds = "CASE WHEN regexp_matches(t, '^(timestamp|datetime)') THEN 'timestamp' WHEN starts_with(t, 'date') THEN 'date' WHEN starts_with(t, 'uuid') THEN 'uuid' WHEN starts_with(t, 'json') THEN 'json' WHEN starts_with(t, 'bool') THEN 'boolean' WHEN regexp_matches(t, '^(varchar|char|string|text)') THEN 'string' WHEN regexp_matches(t, '^(bigint|int|smallint|tinyint|long)') THEN 'integer' WHEN regexp_matches(t, '^(decimal|numeric|double|float)') THEN 'float' ELSE 'unknown' END"
    r.add("pr5_infer_type", lambda s, d: named(s, d).select("ordinal", "raw_dtype", pr.infer_type(F.col("raw_dtype")).alias("kind")), NAMES_SQL + f"SELECT ordinal, raw_dtype, {kinds} AS kind FROM (SELECT *, lower(trim(raw_dtype)) AS t FROM catalog_names)")
    override = lambda: F.when(F.col("column_name") == "name", True).when(F.col("column_name") == "load_ts", False)
    r.add("pr6_is_system", lambda s, d: named(s, d).select("ordinal", "column_name", pr.is_system(F.col("column_name")).alias("by_name"), pr.is_system(F.col("column_name"), override()).alias("is_system")), NAMES_SQL + f"SELECT ordinal, column_name, {SYSTEM} AS by_name, CASE column_name WHEN 'name' THEN true WHEN 'load_ts' THEN false ELSE {SYSTEM} END AS is_system FROM catalog_names")
    r.add("pr7_detect_bk", lambda s, d: pr.detect_bk(named(s, d)).select("table_name", "business_key"), NAMES_SQL + f", {KEYED} SELECT * FROM found")
    r.add("pr8_pick_bk", lambda s, d: pr.pick_bk(*projected(s, d, "catalog_names", "catalog_profiles")).select("table_name", "business_key", "rank"), NAMES_SQL + f", ranked AS (SELECT table_name, column_name, ordinal, CASE WHEN NOT {SYSTEM} THEN {HINTED} END AS tier FROM catalog_names LEFT JOIN catalog_profiles USING (table_name, column_name)) SELECT table_name, arg_min(column_name, tier * 10000000 + ordinal) AS business_key, min(tier) AS rank FROM ranked GROUP BY table_name")
    r.add("pr9_detect_fk", lambda s, d: pr.detect_fk(catalog(s, d)).select("table_name", "column_name", "parent_table"), f"WITH {CATALOG_SQL} {FKS}")

    def included(s: SparkSession, d: str) -> DataFrame:
        pairs = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("orders", "o_orderkey", "customer", "c_custkey")]
        return dq.union_all([pr.inclusion(table(s, d, a), b, table(s, d, c), k).withColumn("pair", F.lit(f"{a}.{b}>{c}.{k}")) for a, b, c, k in pairs])

    inc = lambda a, b, c, k: f"SELECT count(*) AS child_values, count(*) FILTER (WHERE {b} IN (SELECT {k} FROM {c})) AS found, count(*) = count(*) FILTER (WHERE {b} IN (SELECT {k} FROM {c})) AS included, '{a}.{b}>{c}.{k}' AS pair FROM (SELECT DISTINCT {b} FROM {a})"
    r.add("pr10_inclusion", included, " UNION ALL ".join([inc("orders", "o_custkey", "customer", "c_custkey"), inc("lineitem", "l_orderkey", "orders", "o_orderkey"), inc("customer", "c_nationkey", "nation", "n_nationkey"), inc("orders", "o_orderkey", "customer", "c_custkey")]))
    whole = {t: FULL[t] for t in ("orders", "lineitem", "part", "customer", "supplier", "nation")}
    cell = lambda c: f"'t' || strftime({c}, '%Y-%m-%d %H:%M:%S')" if c.endswith("date") else f"'d' || CAST({c} AS VARCHAR)" if c in DOUBLES else f"'i' || CAST({c} AS VARCHAR)" if c.endswith(("key", "number", "size")) else f"'s' || {c}"
    held = " UNION ALL ".join(f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, {cell(c)} AS v FROM {t} WHERE {c} IS NOT NULL" for t, cs in whole.items() for c in cs)
    r.add("pr10_inclusions", lambda s, d: pr.inclusions({t: table(s, d, t) for t in whole}),
          f"WITH held AS ({held}), sizes AS (SELECT t, c, count(*) AS child_values FROM held GROUP BY t, c), both_ AS (SELECT a.t AS child_table, a.c AS child_column, b.t AS parent_table, b.c AS parent_column, count(*) AS found FROM held a JOIN held b USING (v) WHERE (a.t, a.c) <> (b.t, b.c) GROUP BY ALL) SELECT child_table, child_column, parent_table, parent_column, child_values, found, found = child_values AS included FROM both_ JOIN sizes ON t = child_table AND c = child_column")
    keys = lambda s, d: pr.detect_bk(named(s, d)).select("table_name", F.col("business_key").alias("column_name"))
    classed = lambda s, d: pr.classify_columns(named(s, d), keys(s, d), projected(s, d, "catalog_profiles")[0])
    changing = "'^(status|state|connected|flag|active|enabled|in_service|operational|heartbeat|is_[a-z0-9_]+|has_[a-z0-9_]+|current_[a-z0-9_]+|last_[a-z0-9_]+_at)$|_(status|state|flag|state_at)$'"
    measures = "'_(reading|value|kw|kwh|kva|mva|mvar|amps?|volts?|celsius|fahrenheit|pressure|temperature|count|total)$|^(load|measured?)_[a-z0-9_]+$'"
    never = "'^(load_dts|load_date|record_source|cdc_flag|effective_from|start_date|end_date|dl_[a-z0-9_]+|__[a-z0-9_]+)$'"
    payload = f"payload AS (SELECT n.*, {kinds} AS kind FROM (SELECT *, lower(trim(raw_dtype)) AS t FROM catalog_names LEFT JOIN catalog_profiles USING (table_name, column_name) WHERE NOT {SYSTEM} AND NOT regexp_matches(lower(column_name), {never}) AND NOT coalesce(is_likely_key OR cardinality_ratio >= 0.95, false)) n WHERE (table_name, lower(column_name)) NOT IN (SELECT (table_name, lower(business_key)) FROM found WHERE business_key IS NOT NULL))"
    buckets = f"{KEYED}, {payload}, classed AS (SELECT table_name, ordinal, column_name, CASE WHEN regexp_matches(lower(column_name), {changing}) THEN 'operational' WHEN regexp_matches(lower(column_name), {measures}) AND kind IN ('integer', 'float') THEN 'measurements' ELSE 'details' END AS bucket FROM payload)"
    r.add("pr11_classify", lambda s, d: classed(s, d).select("table_name", "ordinal", "column_name", "bucket"), NAMES_SQL + f", {buckets} SELECT table_name, ordinal, column_name, bucket FROM classed")
    own = lambda b: f"coalesce(string_agg(column_name, ',' ORDER BY ordinal) FILTER (WHERE bucket = '{b}'), '') AS {b}"
    n = lambda b: f"count(*) FILTER (WHERE bucket = '{b}')"
    r.add("pr12_split_hint", lambda s, d: pr.split_hint(classed(s, d)).drop("system_id"), NAMES_SQL + f", {buckets} SELECT table_name, {own('details')}, {own('operational')}, {own('measurements')}, greatest({n('operational')}, {n('measurements')}) >= 2 AND {n('details')} >= 1 AS split, CASE WHEN {n('measurements')} >= 2 THEN 'high' WHEN {n('operational')} >= 2 THEN 'medium' ELSE 'low' END AS velocity FROM classed GROUP BY table_name")
    cs = ["o_orderstatus", "o_orderpriority"]
    r.add("pr13_change_rate", lambda s, d: pr.change_rate(table(s, d, "orders"), "o_custkey", "o_orderdate", cs, ["o_orderkey"]), " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(avg(CAST({c} IS DISTINCT FROM b AS INT)), 6) AS change_rate FROM (SELECT {c}, lag({c}) OVER w AS b, row_number() OVER w AS v FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE v > 1" for c in cs))
    flags = " UNION ALL ".join(f"SELECT '{t}' AS table_name, column_name, is_likely_key FROM ({profile_sql(t, cs)})" for t, cs in FULL.items())
    MODEL = f"WITH {CATALOG_SQL.replace(', '.join(repr(t) for t in TABLES), ', '.join(repr(t) for t in NAMES))}, flags AS ({flags}), keys_ AS (SELECT table_name, arg_min(column_name, {HINTED} * 1000 + ordinal) AS column_name FROM catalog_ LEFT JOIN flags USING (table_name, column_name) GROUP BY table_name), fks AS ({FKS}) SELECT 'hub' AS kind, 'hub_' || table_name AS name, table_name AS source_table, column_name AS columns FROM keys_ UNION ALL SELECT DISTINCT 'link', 'link_' || table_name || '_' || parent_table, table_name, table_name || ',' || parent_table FROM fks UNION ALL SELECT 'sat', 'sat_' || table_name, table_name, string_agg(column_name, ',' ORDER BY ordinal) FROM catalog_ WHERE (table_name, column_name) NOT IN (SELECT (table_name, column_name) FROM keys_) AND (table_name, column_name) NOT IN (SELECT (table_name, column_name) FROM fks) GROUP BY table_name"
    r.add("pr14_infer_model", lambda s, d: pr.infer_model(catalog(s, d).where(F.col("table_name").isin(NAMES)), profiles(s, d)), MODEL)


def register(r: Registry) -> None:
    business(r)
    derivations(r)
    quality(r)
    profiling(r)
