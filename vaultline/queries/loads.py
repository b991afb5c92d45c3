"""Queries of sources, staging and the raw vault."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vaultline.functions.hashing import hash_key, hashdiff, pack
from vaultline.operators import raw_vault as rv
from vaultline.operators import staging as st
from vaultline.queries.bindings import END, GHOST, PARTS, TABLES, Registry, diff_sql, key_sql, projected, stg_events, stg_li, stg_orders, table, with_sql
from vaultline.sources import bronze, sinks
from vaultline.sources.versioned import VersionedTable

MID = "1998-01-01 00:00:00"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see: under spark.checkpoint.dir, or the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/vaultline-{name}-{uuid.uuid4().hex}"


def old_new(df: DataFrame, ts: str) -> tuple[DataFrame, DataFrame]:
    mark = F.lit(MID).cast("timestamp_ntz")
    return df.where(F.col(ts) <= mark), df.where(F.col(ts) > mark)


def sources(r: Registry) -> None:
    casts = {"o_orderkey": "int", "o_custkey": "bigint", "o_totalprice": "decimal(18,2)", "o_orderdate": "timestamp_ntz", "o_orderstatus": "string"}
    r.add("src1_read_bronze", lambda s, d: bronze.read_bronze(s, f"{d}/orders.parquet", casts),
          "SELECT CAST(o_orderkey AS INT) AS o_orderkey, o_custkey, CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice, o_orderdate, o_orderstatus FROM orders")
    dirty = {"o_orderkey": "int", "o_orderstatus": "int", "o_orderpriority": "string"}
    r.add("src1_read_bronze_dirty", lambda s, d: bronze.read_bronze(s, f"{d}/orders.parquet", dirty, strict=False),
          "SELECT CAST(o_orderkey AS INT) AS o_orderkey, TRY_CAST(o_orderstatus AS INT) AS o_orderstatus, o_orderpriority FROM orders")

    def increment(s: SparkSession, d: str) -> DataFrame:
        o = table(s, d, "orders")
        return bronze.incremental_scan(o, old_new(o, "o_orderdate")[0], "o_orderdate").select("o_orderkey", "o_orderdate")

    r.add("src2_incremental_scan", increment, f"SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders WHERE o_orderdate <= TIMESTAMP '{MID}')")
    r.add("src3_stamp", lambda s, d: bronze.stamp(table(s, d, "events").select("event_id", "ts"), "EVENTS", F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")),
          "SELECT event_id, ts, 'EVENTS' AS record_source, TIMESTAMP '2024-02-01 00:00:00' AS ingested_at FROM events")

    def landed(s: SparkSession, d: str) -> DataFrame:
        path = shared_path(s, "land")
        first, rest = old_new(table(s, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus"), "o_orderdate")
        bronze.land(first, path, "overwrite")
        bronze.land(rest, path, "append")
        return s.read.parquet(path)

    r.add("src4_land_overwrite_append", landed, "SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders")
    names = "SELECT * FROM (VALUES " + ", ".join(f"('{t}')" for t in sorted(TABLES)) + ") v(table_name)"

    def found(s: SparkSession, d: str) -> DataFrame:
        return bronze.discover(s, {t: table(s, d, t) for t in TABLES})

    columns = "SELECT 'main' AS system_id, table_name, ordinal_position AS ordinal, column_name FROM information_schema.columns WHERE table_name IN (" + ", ".join(f"'{t}'" for t in TABLES) + ")"
    r.add("src7_discover", lambda s, d: found(s, d).select("system_id", "table_name", "ordinal", "column_name"), columns)

    def database(s: SparkSession, d: str) -> DataFrame:
        name = f"vaultline_{uuid.uuid4().hex[:12]}"
        bronze.ensure_db(s, name)
        table(s, d, "nation").write.saveAsTable(f"{name}.nation")
        out = bronze.discover_database(s, name).select("table_name", "ordinal", "column_name", "raw_dtype")
        s.sql(f"DROP SCHEMA `{name}` CASCADE")
        return out

    r.add("src6_database_discovery", database, "SELECT * FROM (VALUES ('nation', 1, 'n_nationkey', 'int'), ('nation', 2, 'n_name', 'string'), ('nation', 3, 'n_regionkey', 'int')) v(table_name, ordinal, column_name, raw_dtype)")

    def declared(s: SparkSession, d: str) -> DataFrame:
        n = table(s, d, "nation")
        own = n.select(F.col("n_regionkey").cast("string").alias("system_id"), F.col("n_name").alias("table_name"), F.when(F.col("n_nationkey") % 2 == 0, "own").alias("catalog"), F.lit(None).cast("string").alias("schema_name"))
        systems = table(s, d, "region").select(F.col("r_regionkey").cast("string").alias("system_id"), F.lower("r_name").alias("catalog"), F.lit("raw").alias("schema_name"))
        return bronze.discover_declared(own, systems).select("system_id", "table_name", "catalog", "schema_name")

    r.add("src8_discover_declared", declared, "SELECT CAST(n_regionkey AS VARCHAR) AS system_id, n_name AS table_name, CASE WHEN n_nationkey % 2 = 0 THEN 'own' ELSE lower(r_name) END AS catalog, 'raw' AS schema_name FROM nation JOIN region ON r_regionkey = n_regionkey")
    kept = lambda s, d, **k: bronze.filter_tables(found(s, d), **k).select("table_name").distinct()
    r.add("src9_filter_tables", lambda s, d: kept(s, d, include=[".*s", "NATION"], exclude=["orders|labels"]), f"SELECT table_name FROM ({names}) WHERE regexp_full_match(table_name, '.*s|nation') AND table_name NOT IN ('orders', 'labels')")
    r.add("src9_filter_list", lambda s, d: kept(s, d, include=["x"], tables=["Orders", "part"]), f"SELECT table_name FROM ({names}) WHERE table_name IN ('orders', 'part')")
    r.add("src10_hidden", lambda s, d: kept(s, d, hidden=["LABELS", "benchmark"]), f"SELECT table_name FROM ({names}) WHERE table_name NOT IN ('labels', 'benchmark')")


def materialised(r: Registry) -> None:
    def view(s: SparkSession, d: str) -> DataFrame:
        return sinks.materialise("staging", stg_orders(s, d).select("hk_customer", "o_orderkey"), f"stg_{uuid.uuid4().hex[:8]}")

    r.add("snk1_view", view, with_sql("stg_orders") + "SELECT hk_customer, o_orderkey FROM stg_orders")

    def full(s: SparkSession, d: str) -> DataFrame:
        path = shared_path(s, "table")
        df = stg_orders(s, d).select("hk_customer", "o_orderkey")
        sinks.as_table(df, path)
        return sinks.as_table(df, path)

    r.add("snk2_table", full, with_sql("stg_orders") + "SELECT hk_customer, o_orderkey FROM stg_orders")

    def twice(s: SparkSession, d: str) -> DataFrame:
        path, stg = shared_path(s, "hub"), stg_orders(s, d)
        load = lambda batch, old: rv.load_hub(batch, "hk_customer", ["o_custkey"], "o_orderdate", "record_source", old)
        first, rest = old_new(stg, "o_orderdate")
        hub = sinks.append_new(load(first, None), path)
        hub = sinks.append_new(load(rest, hub), path)
        return sinks.append_new(load(stg, hub), path)

    r.add("snk3_append_new", twice, with_sql("hub_customer") + "SELECT * FROM hub_customer")

    def merged(s: SparkSession, d: str) -> DataFrame:
        o = table(s, d, "orders").select("o_orderkey", "o_orderstatus")
        delta = o.where("o_orderkey % 2 = 1 OR o_orderkey % 3 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
        return sinks.merge_on(o.where("o_orderkey % 2 = 0"), delta, ["o_orderkey"])

    r.add("snk4_merge_on", merged, "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")

    def swapped(s: SparkSession, d: str) -> DataFrame:
        """Three versions of a table in yearly folders, each merged with the one before and then made current."""
        o = table(s, d, "orders").select("o_orderkey", "o_orderstatus", F.year("o_orderdate").alias("y"))
        stored = VersionedTable(s, shared_path(s, "merge"), ["y"])
        for rows, status in (("o_orderkey % 2 = 0", "o_orderstatus"), ("o_orderkey % 2 = 1 OR y = 1996", "'odd or 1996'"), ("o_orderkey % 5 = 0 AND y > 1996", "'fifth'")):
            stored.merge(o.where(rows).withColumn("o_orderstatus", F.expr(status)), ["o_orderkey", "y"])
        return stored.read()

    r.add("snk4_merge_versions", swapped, "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 AND y > 1996 THEN 'fifth' WHEN o_orderkey % 2 = 1 OR y = 1996 THEN 'odd or 1996' ELSE o_orderstatus END AS o_orderstatus, y FROM (SELECT *, CAST(year(o_orderdate) AS INT) AS y FROM orders)")

    def parted(s: SparkSession, d: str) -> DataFrame:
        path = shared_path(s, "parts")
        o = table(s, d, "orders").select("o_orderkey", "o_orderpriority", F.year("o_orderdate").alias("y"))
        sinks.overwrite_partitions(o, path, ["y"])
        return sinks.overwrite_partitions(o.where("y = 1996").withColumn("o_orderpriority", F.lit("new")), path, ["y"])

    r.add("snk5_overwrite_partitions", parted, "SELECT o_orderkey, CASE WHEN year(o_orderdate) = 1996 THEN 'new' ELSE o_orderpriority END AS o_orderpriority, CAST(year(o_orderdate) AS INT) AS y FROM orders")

    def evolving(s: SparkSession, d: str) -> DataFrame:
        first, rest = old_new(table(s, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus"), "o_orderdate")
        return sinks.append_evolving(first.drop("o_orderstatus"), rest)

    r.add("snk6_append_evolving", evolving, f"SELECT o_orderkey, o_orderdate, CASE WHEN o_orderdate > TIMESTAMP '{MID}' THEN o_orderstatus END AS o_orderstatus FROM orders")

    def laid(s: SparkSession, d: str) -> DataFrame:
        path = shared_path(s, "layout")
        sinks.layout(table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity"), ["l_partkey"]).write.parquet(path)
        return s.read.parquet(path)

    r.add("snk7_layout", laid, "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem")

    def curved(s: SparkSession, d: str) -> DataFrame:
        rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.trunc("l_shipdate", "year").alias("ship_year"))
        return sinks.write_layout(rows, shared_path(s, "layout"), ["l_partkey", "l_suppkey"], "ship_year")

    r.add("snk7_layout_partitioned", curved, "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(date_trunc('year', l_shipdate) AS DATE) AS ship_year FROM lineitem")

    def deduped(s: SparkSession, d: str) -> DataFrame:
        return sinks.deduplicated(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate"), ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey"])

    r.add("snk_deduplicated", deduped, "SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC) AS r FROM lineitem) WHERE r = 1")

    def strategies(s: SparkSession, d: str) -> DataFrame:
        """Every kind of entity materialised as its strategy says, those that replace or merge twice."""
        o, stg = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.year("o_orderdate").alias("y")), stg_orders(s, d)
        even, third = o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 3 = 0")
        loads = {
            "bronze": [even, third], "staging": [stg], "hub": [rv.load_hub(stg, "hk_customer", ["o_custkey"], "o_orderdate", "record_source")],
            "link": [rv.load_link(stg, "hk_order_customer", ["hk_order", "hk_customer"], "o_orderdate", "record_source")], "sat": [sat_status(s, d)],
            "eff_sat": [even, third], "bv_sat": [o.select("o_custkey", "o_orderstatus").distinct()], "pit": [o, even.where("y = 1996")],
            "bridge": [o, third], "dim": [even], "fact": [third],
        }
        counts = []
        for kind, batches in loads.items():
            at = f"snk8_{kind}" if sinks.STRATEGY[kind] == "view" else shared_path(s, kind)
            for df in batches:
                stored = sinks.materialise(kind, df, at, ["y"], ["o_orderkey", "y"])
            counts.append(stored.agg(F.count("*").alias("n_rows")).withColumns({"kind": F.lit(kind), "strategy": F.lit(sinks.STRATEGY[kind])}))
        return reduce(DataFrame.unionByName, counts)

    n = lambda kind, how, source, where="true": f"SELECT '{kind}' AS kind, '{how}' AS strategy, count(*) AS n_rows FROM {source} WHERE {where}"
    even, third = "o_orderkey % 2 = 0", "o_orderkey % 3 = 0"
    KINDS = [
        "SELECT 'bronze' AS kind, 'append' AS strategy, count(*) FILTER (WHERE o_orderkey % 2 = 0) + count(*) FILTER (WHERE o_orderkey % 3 = 0) AS n_rows FROM orders", n("staging", "view", "orders"),
        n("hub", "append", "hub_customer"), n("link", "append", "link_oc"), n("sat", "append", "sat_status"), n("eff_sat", "merge", "orders", f"{even} OR {third}"),
        n("bv_sat", "append", "(SELECT DISTINCT o_custkey, o_orderstatus FROM orders)"), n("pit", "overwrite_partitions", "orders", f"year(o_orderdate) <> 1996 OR {even}"),
        n("bridge", "table", "orders", third), n("dim", "view", "orders", even), n("fact", "view", "orders", third),
    ]
    r.add("snk8_strategy", strategies, with_sql("hub_customer", "link_oc", "sat_status") + " UNION ALL ".join(KINDS))


def staged(r: Registry) -> None:
    def full(s: SparkSession, d: str) -> DataFrame:
        return st.stage(
            table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"),
            derived=[st.Derived("is_final", expr="o_orderstatus = 'F'"), st.Derived("load_dts", source="o_orderdate"), st.Derived("record_source", literal="ORDERS")],
            nulls=st.Nulls(required=["o_custkey"]), hashed=[st.Hashed("hk_customer", ["o_custkey"]), st.Hashed("hd_order", ["o_orderstatus", "o_orderdate"], diff=True)],
            ranked=[st.Ranked("version", ["o_custkey"], ["o_orderdate", "o_orderkey"])],
        )

    r.add("stg1_stage", full, f"SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, o_orderdate, o_orderstatus = 'F' AS is_final, o_orderdate AS load_dts, 'ORDERS' AS record_source, o_custkey AS o_custkey_original, {key_sql('o_custkey')} AS hk_customer, {diff_sql('o_orderstatus', 'o_orderdate')} AS hd_order, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version FROM orders")
    r.add("stg2_derived_expr", lambda s, d: st.stage(table(s, d, "orders").select("o_orderkey", "o_totalprice"), [st.Derived("size", expr="CASE WHEN o_totalprice >= 200000 THEN 'big' ELSE 'small' END"), st.Derived("doubled", expr="o_orderkey * 2")], include_source=False),
          "SELECT CASE WHEN o_totalprice >= 200000 THEN 'big' ELSE 'small' END AS size, o_orderkey * 2 AS doubled FROM orders")
    r.add("stg3_derived_source", lambda s, d: st.stage(table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), [st.Derived("tag", source=["o_orderstatus", "o_orderpriority"]), st.Derived("again", source="o_orderkey")]).select("o_orderkey", "tag", "again"),
          "SELECT o_orderkey, concat_ws(' ', o_orderstatus, o_orderpriority) AS tag, o_orderkey AS again FROM orders")
    r.add("stg4_derived_literal", lambda s, d: st.stage(table(s, d, "customer").select("c_custkey"), [st.Derived("record_source", literal="CRM"), st.Derived("tenant", literal=7)]), "SELECT c_custkey, 'CRM' AS record_source, 7 AS tenant FROM customer")
    flag = lambda: F.when(F.col("event_type") == "error", "D").when(F.col("event_type") == "signup", "I").otherwise("U")
    r.add("stg5_derive_cdc", lambda s, d: st.derive_cdc(table(s, d, "events").select("event_id", "ts", "event_type"), flag(), "ts"),
          f"SELECT event_id, ts, event_type, CASE event_type WHEN 'error' THEN 'D' WHEN 'signup' THEN 'I' ELSE 'U' END AS cdc_flag, event_type = 'error' AS is_deleted, ts AS effective_from, ts AS start_date, CASE WHEN event_type = 'error' THEN ts ELSE {END} END AS end_date FROM events")
    holes = lambda s, d: table(s, d, "events").select("event_id", F.when(F.col("event_id") % 3 > 0, F.col("user_id")).alias("user_id"), F.when(F.col("event_id") % 5 > 0, F.get_json_object("props", "$.k")).alias("k"))
    r.add("stg6_replace_nulls", lambda s, d: st.replace_nulls(holes(s, d), ["user_id"], ["k"]),
          "SELECT event_id, coalesce(CAST(u AS VARCHAR), '-1') AS user_id, coalesce(k, '-2') AS k, u AS user_id_original, k AS k_original FROM (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN user_id END AS u, CASE WHEN event_id % 5 > 0 THEN json_extract_string(props, '$.k') END AS k FROM events)")
    c = lambda s, d: table(s, d, "customer")
    r.add("stg7_hash_key", lambda s, d: c(s, d).select("c_custkey", hash_key(["c_custkey"]).alias("hk"), hash_key(["c_name"], "sha256").alias("hk_sha")), f"SELECT c_custkey, {key_sql('c_custkey')} AS hk, sha256(upper(trim(c_name))) AS hk_sha FROM customer")
    r.add("stg8_hash_key_composite", lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", hash_key(["l_orderkey", "l_linenumber", "l_partkey"]).alias("hk")), f"SELECT l_orderkey, l_linenumber, {key_sql('l_orderkey', 'l_linenumber', 'l_partkey')} AS hk FROM lineitem")
    r.add("stg9_hash_of_hashes", lambda s, d: stg_orders(s, d).select("o_orderkey", hash_key(["hk_order", "hk_customer"]).alias("hk")), with_sql("stg_orders") + f"SELECT o_orderkey, {key_sql('hk_order', 'hk_customer')} AS hk FROM stg_orders")
    r.add("stg10_hashdiff", lambda s, d: stg_orders(s, d).select("o_orderkey", hashdiff(["o_orderstatus", "price", "o_orderdate"]).alias("hd")), with_sql("stg_orders") + f"SELECT o_orderkey, {diff_sql('o_orderstatus', 'price', 'o_orderdate')} AS hd FROM stg_orders")
    r.add("stg11_ranked", lambda s, d: st.stage(table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"), ranked=[st.Ranked("r", ["o_custkey"], ["o_orderdate"]), st.Ranked("dr", ["o_custkey"], ["o_orderpriority"], dense=True)]).select("o_orderkey", "r", "dr"),
          "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS r, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr FROM orders")

    def specs(s: SparkSession, d: str) -> DataFrame:
        hubs, links, sats = projected(s, d, "plan_hubs", "plan_links", "plan_sats")
        out = st.staging_specs(hubs, links, sats)
        return out.select("source_table", "step", "name", F.array_join("columns", ",").alias("columns"))

    r.add("stg12_staging_specs", specs, with_sql("plan_hubs", "plan_links", "plan_sats") + """, need AS (
      SELECT source_table, hash_key FROM plan_hubs UNION SELECT source_table, parent_hub FROM plan_sats
      UNION SELECT source_table, unnest(fk_columns) FROM plan_links)
    SELECT source_table, 0 AS step, hash_key AS name, array_to_string(business_keys, ',') AS columns FROM need JOIN (SELECT hash_key, business_keys FROM plan_hubs) USING (hash_key)
    UNION ALL SELECT source_table, 1, hash_key, array_to_string(fk_columns, ',') FROM plan_links
    UNION ALL SELECT source_table, 2, hashdiff, array_to_string(payload, ',') FROM plan_sats""")


HUB = ("hk_customer", ["o_custkey"], "o_orderdate", "record_source")
SAT = ("hk_customer", "hd_status", ["o_orderstatus", "o_orderpriority"], "o_orderdate", "record_source")
PRIORITY = ("hk_customer", "hd_priority", ["o_orderpriority"], "o_orderdate", "record_source")
EFF = ("hk_part_supplier", "hk_part", ["hk_supplier"], "l_shipdate", "record_source")


def hub_customer(s: SparkSession, d: str) -> DataFrame:
    return rv.load_hub(stg_orders(s, d), *HUB)


def sat_status(s: SparkSession, d: str) -> DataFrame:
    return rv.load_sat(stg_orders(s, d), *SAT)


def sat_priority(s: SparkSession, d: str) -> DataFrame:
    return rv.load_sat(stg_orders(s, d), *PRIORITY)


def eff_part(s: SparkSession, d: str) -> DataFrame:
    return rv.load_eff_sat(stg_li(s, d), *EFF)


def batches(df: DataFrame, ts: str, edges: list[str]) -> list[DataFrame]:
    cuts = [None, *(F.lit(e).cast("timestamp_ntz") for e in edges), None]
    return [df.where((F.lit(True) if a is None else F.col(ts) > a) & (F.lit(True) if b is None else F.col(ts) <= b)) for a, b in zip(cuts, cuts[1:])]


def raw_vault(r: Registry) -> None:
    r.add("rv1_hub", hub_customer, with_sql("hub_customer") + "SELECT * FROM hub_customer")

    def two_sources(s: SparkSession, d: str) -> DataFrame:
        c = table(s, d, "customer").select(hash_key(["c_custkey"]).alias("hk_customer"), "c_custkey", F.lit("1990-01-01 00:00:00").cast("timestamp_ntz").alias("o_orderdate"), F.lit("CRM").alias("record_source")).where("c_custkey % 2 = 0")
        return rv.load_hub([stg_orders(s, d), c], "hk_customer", [["o_custkey"], ["c_custkey"]], "o_orderdate", "record_source")

    r.add("rv2_hub_sources", two_sources, with_sql("stg_orders") + f""", both_ AS (
      SELECT hk_customer, o_custkey, o_orderdate, record_source FROM stg_orders
      UNION ALL SELECT {key_sql('c_custkey')}, c_custkey, TIMESTAMP '1990-01-01 00:00:00', 'CRM' FROM customer WHERE c_custkey % 2 = 0)
    SELECT hk_customer, o_custkey, o_orderdate, record_source FROM (SELECT *, row_number() OVER (PARTITION BY hk_customer ORDER BY o_orderdate, record_source) AS r FROM both_) WHERE r = 1""")
    r.add("rv3_hub_composite", lambda s, d: rv.load_hub(stg_li(s, d).withColumn("hk_line", hash_key(["l_orderkey", "l_linenumber"])), "hk_line", ["l_orderkey", "l_linenumber"], "l_shipdate", "record_source"),
          with_sql("stg_li") + f"SELECT {key_sql('l_orderkey', 'l_linenumber')} AS hk_line, l_orderkey, l_linenumber, min(l_shipdate) AS l_shipdate, 'LINEITEM' AS record_source FROM stg_li GROUP BY l_orderkey, l_linenumber")
    r.add("rv4_link", lambda s, d: rv.load_link(stg_orders(s, d), "hk_order_customer", ["hk_order", "hk_customer"], "o_orderdate", "record_source"), with_sql("link_oc") + "SELECT * FROM link_oc")
    r.add("rv4_link_part_supplier", lambda s, d: rv.load_link(stg_li(s, d), "hk_part_supplier", ["hk_part", "hk_supplier"], "l_shipdate", "record_source"),
          with_sql("stg_li") + "SELECT hk_part_supplier, hk_part, hk_supplier, min(l_shipdate) AS l_shipdate, 'LINEITEM' AS record_source FROM stg_li GROUP BY hk_part_supplier, hk_part, hk_supplier")
    r.add("rv5_link_nary", lambda s, d: rv.load_link(stg_li(s, d), "hk_order_part_supplier", ["hk_order", "hk_part", "hk_supplier"], "l_shipdate", "record_source"),
          with_sql("stg_li") + "SELECT hk_order_part_supplier, hk_order, hk_part, hk_supplier, min(l_shipdate) AS l_shipdate, 'LINEITEM' AS record_source FROM stg_li GROUP BY hk_order_part_supplier, hk_order, hk_part, hk_supplier")

    def chained(s: SparkSession, d: str) -> DataFrame:
        e = stg_events(s, d)
        before = F.lag("hk_user").over(Window.partitionBy("event_type").orderBy("event_id"))
        e = e.withColumn("hk_before", before).withColumn("hk_pair", hash_key(["hk_before", "hk_user"]))
        return rv.load_link(e, "hk_pair", ["hk_before", "hk_user"], "ts", "record_source", roles=["hk_parent", "hk_child"])

    r.add("rv6_link_self", chained, with_sql("stg_events") + f""", pairs AS (SELECT *, lag(hk_user) OVER (PARTITION BY event_type ORDER BY event_id) AS hk_before FROM stg_events)
    SELECT {key_sql('hk_before', 'hk_user')} AS hk_pair, hk_before AS hk_parent, hk_user AS hk_child, min(ts) AS ts, 'EVENTS' AS record_source FROM pairs WHERE hk_before IS NOT NULL GROUP BY hk_before, hk_user""")

    def link_sources(s: SparkSession, d: str) -> DataFrame:
        o = stg_orders(s, d)
        li = table(s, d, "lineitem").join(table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
        li = li.select(hash_key(["l_orderkey", "o_custkey"]).alias("hk_order_customer"), hash_key(["l_orderkey"]).alias("hk_order"), hash_key(["o_custkey"]).alias("hk_customer"), F.col("l_shipdate").alias("o_orderdate"), F.lit("LINEITEM").alias("record_source"))
        return rv.load_link([o, li], "hk_order_customer", ["hk_order", "hk_customer"], "o_orderdate", "record_source")

    r.add("rv7_link_sources", link_sources, with_sql("stg_orders") + f""", both_ AS (
      SELECT hk_order_customer, hk_order, hk_customer, o_orderdate, record_source FROM stg_orders
      UNION ALL SELECT {key_sql('l_orderkey', 'o_custkey')}, {key_sql('l_orderkey')}, {key_sql('o_custkey')}, l_shipdate, 'LINEITEM' FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
    SELECT hk_order_customer, hk_order, hk_customer, o_orderdate, record_source FROM (SELECT *, row_number() OVER (PARTITION BY hk_order_customer ORDER BY o_orderdate, record_source) AS r FROM both_) WHERE r = 1""")
    r.add("rv8_sat", sat_status, with_sql("sat_status") + "SELECT * FROM sat_status")
    r.add("rv8_sat_events", lambda s, d: rv.load_sat(stg_events(s, d), "hk_user", "hd_type", ["event_type"], "ts", "record_source"),
          with_sql("stg_events") + "SELECT hk_user, hd_type, event_type, ts, record_source FROM (SELECT *, lag(hd_type) OVER (PARTITION BY hk_user ORDER BY ts) AS b FROM stg_events) WHERE b IS DISTINCT FROM hd_type")

    def in_batches(s: SparkSession, d: str) -> DataFrame:
        path = shared_path(s, "sat")
        stored = None
        for batch in batches(stg_orders(s, d), "o_orderdate", ["1996-06-30 00:00:00", "1998-01-01 00:00:00", "2000-01-01 00:00:00"]):
            stored = sinks.append_new(rv.load_sat(batch, *SAT, existing=stored), path)
        return stored

    r.add("rv9_sat_incremental", in_batches, with_sql("sat_status") + "SELECT * FROM sat_status")

    def split(s: SparkSession, d: str) -> DataFrame:
        stg = stg_orders(s, d)
        out = None
        for name, diff, payload in (("state", "hd_state", "o_orderstatus"), ("priority", "hd_priority", "o_orderpriority")):
            one = rv.load_sat(stg, "hk_customer", diff, [payload], "o_orderdate", "record_source").select(F.lit(name).alias("satellite"), "hk_customer", F.col(diff).alias("hashdiff"), F.col(payload).alias("value"), "o_orderdate")
            out = one if out is None else out.unionByName(one)
        return out

    half = lambda n, hd, c: f"SELECT '{n}' AS satellite, hk_customer, hd AS hashdiff, v AS value, o_orderdate FROM (SELECT *, lag(hd) OVER (PARTITION BY hk_customer ORDER BY o_orderdate) AS b FROM (SELECT hk_customer, o_orderdate, max({hd}) AS hd, arg_max({c}, {hd}) AS v FROM stg_orders GROUP BY hk_customer, o_orderdate)) WHERE b IS DISTINCT FROM hd"
    r.add("rv10_sat_split", split, with_sql("stg_orders") + half("state", "hd_state", "o_orderstatus") + " UNION ALL " + half("priority", "hd_priority", "o_orderpriority"))
    r.add("rv11_eff_sat", eff_part, with_sql("eff_part") + "SELECT * FROM eff_part")

    def hot(s: SparkSession, d: str) -> DataFrame:
        """A third of all rows under one driving key, in stretches of the date."""
        one = F.when(F.col("l_linenumber") % 3 == 0, F.lit("hot")).otherwise(F.col("hk_part"))
        return rv.load_eff_sat(stg_li(s, d).withColumn("hk_part", one), *EFF, stretches=16)

    hot_events = "SELECT CASE WHEN l_linenumber % 3 = 0 THEN 'hot' ELSE hk_part END AS hk_part, l_shipdate AS start_date, max(hk_part_supplier) AS hk_part_supplier, arg_max(hk_supplier, hk_part_supplier) AS hk_supplier, 'LINEITEM' AS record_source FROM stg_li GROUP BY 1, 2"
    r.add("rv11_eff_sat_hot", hot, with_sql("stg_li") + f", eff_events AS ({hot_events}), eff AS ({PARTS['eff_part'][1]}) SELECT * FROM eff")

    def eff_batches(s: SparkSession, d: str) -> DataFrame:
        stored, path = None, shared_path(s, "eff")
        for batch in batches(stg_li(s, d), "l_shipdate", ["1997-01-01 00:00:00", "1999-06-01 00:00:00"]):
            stored = sinks.materialise("eff_sat", rv.load_eff_sat(batch, *EFF, existing=stored), path, keys=["hk_part", "start_date"])
        return stored

    r.add("rv11_eff_sat_incremental", eff_batches, with_sql("eff_part") + "SELECT * FROM eff_part")

    def eff_deleted(s: SparkSession, d: str) -> DataFrame:
        return rv.load_eff_sat(stg_events(s, d), "hd_type", "hk_user", ["event_type"], "ts", "record_source", deleted=F.col("event_type") == "error")

    r.add("rv12_eff_sat_deleted", eff_deleted, with_sql("stg_events") + f""", state AS (SELECT *, CASE WHEN event_type <> 'error' THEN hd_type END AS st FROM stg_events),
    runs_ AS (SELECT *, lag(st) OVER (PARTITION BY hk_user ORDER BY ts) AS b FROM state),
    ends AS (SELECT *, coalesce(lead(ts) OVER (PARTITION BY hk_user ORDER BY ts), {END}) AS end_date FROM runs_ WHERE st IS DISTINCT FROM b)
    SELECT hd_type, hk_user, event_type, ts AS start_date, end_date, ts AS effective_from, record_source FROM ends WHERE st IS NOT NULL""")
    r.add("rv13_with_ghost", lambda s, d: rv.with_ghost(hub_customer(s, d), "hk_customer", "o_orderdate"), with_sql("hub_customer") + f"SELECT * FROM hub_customer UNION ALL SELECT {GHOST}, NULL, TIMESTAMP '1900-01-01 00:00:00', NULL")
    r.add("rv13_no_ghost", lambda s, d: rv.no_ghost(rv.with_ghost(hub_customer(s, d), "hk_customer", "o_orderdate"), "hk_customer"), with_sql("hub_customer") + "SELECT * FROM hub_customer")

    def whole(s: SparkSession, d: str) -> DataFrame:
        spec = rv.VaultSpec(
            {"orders": lambda sp: stg_orders(sp, d), "li": lambda sp: stg_li(sp, d)},
            [
                ("sat_status", "sat", lambda g, old: rv.load_sat(g["orders"], *SAT, existing=old)), ("eff_part", "eff_sat", lambda g, old: rv.load_eff_sat(g["li"], *EFF, existing=old)),
                ("hub_customer", "hub", lambda g, old: rv.load_hub(g["orders"], *HUB, existing=old)), ("link_oc", "link", lambda g, old: rv.load_link(g["orders"], "hk_order_customer", ["hk_order", "hk_customer"], "o_orderdate", "record_source", old)),
            ],
        )
        from vaultline.operators.quality import row_counts

        return row_counts(rv.load_vault(s, spec))

    names = ["hub_customer", "link_oc", "sat_status", "eff_part"]
    r.add("rv14_load_vault", whole, with_sql(*names) + " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows, CASE WHEN count(*) > 0 THEN 'OK' ELSE 'WARN' END AS status FROM {n}" for n in names))

    def stored(s: SparkSession, d: str) -> DataFrame:
        """Two batches, the second of which holds all rows, into stored tables; then what each of them has."""
        path = shared_path(s, "vault")
        loaders = [
            ("hub_customer", "hub", lambda g, old: rv.load_hub(g["orders"], *HUB, existing=old)),
            ("link_oc", "link", lambda g, old: rv.load_link(g["orders"], "hk_order_customer", ["hk_order", "hk_customer"], "o_orderdate", "record_source", old)),
            ("sat_status", "sat", lambda g, old: rv.load_sat(g["orders"], *SAT, existing=old)), ("sat_priority", "sat", lambda g, old: rv.load_sat(g["orders"], *PRIORITY, existing=old)),
            ("eff_part", "eff_sat", lambda g, old: rv.load_eff_sat(g["li"], *EFF, existing=old)),
        ]
        of_orders = ["hk_customer", "o_custkey", "hk_order_customer", "hk_order", "hd_status", "o_orderstatus", "o_orderpriority", "hd_priority", "o_orderdate", "record_source"]
        of_li = ["hk_part_supplier", "hk_part", "hk_supplier", "l_shipdate", "record_source"]
        for part in (0, None):
            first = lambda df, ts, part=part: df if part is None else old_new(df, ts)[0]
            sources_ = {"orders": lambda sp, first=first: first(stg_orders(sp, d), "o_orderdate").select(*of_orders), "li": lambda sp, first=first: first(stg_li(sp, d), "l_shipdate").select(*of_li)}
            spec = rv.VaultSpec(sources_, loaders if part is None else loaders[::-1], {"eff_part": ["hk_part", "start_date"]})
            failed = rv.run_vault(s, spec, path).where("status <> 'OK'").collect()
            if failed:
                raise RuntimeError(str(failed))
        digests = [VersionedTable(s, f"{path}/{n}").read().agg(F.count("*").alias("n_rows"), F.count_distinct(pack(F.col(k))).alias("n_keys")).withColumn("entity", F.lit(n)) for n, k in KEYS.items()]
        return reduce(DataFrame.unionByName, digests)

    KEYS = {"hub_customer": "hk_customer", "link_oc": "hk_order_customer", "sat_status": "hd_status", "sat_priority": "hd_priority", "eff_part": "hk_part_supplier"}
    r.add("rv14_run_vault", stored, with_sql(*KEYS) + " UNION ALL ".join(f"SELECT count(*) AS n_rows, count(DISTINCT {k}) AS n_keys, '{n}' AS entity FROM {n}" for n, k in KEYS.items()))

    def same_as(s: SparkSession, d: str) -> DataFrame:
        p = table(s, d, "part").select("p_name", "p_brand", "p_partkey", F.lit("2000-01-01 00:00:00").cast("timestamp_ntz").alias("load_dts"), F.lit("PART").alias("record_source"))
        first = p.groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("master"))
        pairs = p.join(first, ["p_name", "p_brand"]).where("master <> p_partkey").withColumns({"hk_master": hash_key(["master"]), "hk_duplicate": hash_key(["p_partkey"])})
        return rv.load_same_as(pairs.withColumn("hk_same", hash_key(["master", "p_partkey"])), "hk_same", "hk_master", "hk_duplicate", "load_dts", "record_source")

    r.add("rv15_same_as", same_as, f"SELECT {key_sql('master', 'p_partkey')} AS hk_same, {key_sql('master')} AS hk_master, {key_sql('p_partkey')} AS hk_duplicate, TIMESTAMP '2000-01-01 00:00:00' AS load_dts, 'PART' AS record_source FROM (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS master FROM part) WHERE master <> p_partkey")

    def ma_batches(s: SparkSession, d: str) -> DataFrame:
        rows, stored_ = stg_li(s, d).withColumn("hd_line", hashdiff(["l_linenumber", "l_partkey", "quantity"])), VersionedTable(s, shared_path(s, "ma"))
        for batch in batches(rows, "l_shipdate", ["1996-12-31 00:00:00", "1999-06-30 00:00:00"]):
            stored_.append(rv.load_ma_sat(batch, "hk_order", "hd_line", ["l_linenumber", "l_partkey", "quantity"], "l_shipdate", "record_source", stored_.read()))
        return stored_.read()

    ma = f"{diff_sql('l_linenumber', 'l_partkey', 'quantity')}"
    r.add("rv16_ma_sat", lambda s, d: rv.load_ma_sat(stg_li(s, d).withColumn("hd_line", hashdiff(["l_linenumber", "l_partkey", "quantity"])), "hk_order", "hd_line", ["l_linenumber", "l_partkey", "quantity"], "l_shipdate", "record_source"),
          with_sql("stg_li") + f""", rows_ AS (SELECT DISTINCT hk_order, {ma} AS hd_line, l_linenumber, l_partkey, quantity, l_shipdate, record_source FROM stg_li),
    sets AS (SELECT hk_order, l_shipdate, md5(string_agg(hd_line, '||' ORDER BY hd_line)) AS set_hashdiff FROM rows_ GROUP BY hk_order, l_shipdate),
    changed AS (SELECT * FROM (SELECT *, lag(set_hashdiff) OVER (PARTITION BY hk_order ORDER BY l_shipdate) AS b FROM sets) WHERE b IS DISTINCT FROM set_hashdiff)
    SELECT hk_order, set_hashdiff, hd_line, l_linenumber, l_partkey, quantity, l_shipdate, record_source FROM rows_ JOIN changed USING (hk_order, l_shipdate)""")
    r.add("rv16_ma_sat_incremental", ma_batches, r.sql["rv16_ma_sat"])
    extract = lambda s, d, lo, hi: rv.one_per_load(stg_orders(s, d).where(f"year(o_orderdate) between {lo} and {hi}").select("hk_customer", "hd_state", F.lit(0).alias("k")), "hk_customer", "k", "hd_state")
    sql = lambda lo, hi: f"SELECT hk_customer, max(hd_state) AS hd FROM stg_orders WHERE year(o_orderdate) BETWEEN {lo} AND {hi} GROUP BY hk_customer"
    r.add("rv17_status_sat", lambda s, d: rv.load_status_sat(extract(s, d, 1995, 1996), extract(s, d, 1997, 1998), "hk_customer", "hd_state", F.lit("1999-01-01 00:00:00").cast("timestamp_ntz")),
          with_sql("stg_orders") + f"SELECT hk_customer, status, TIMESTAMP '1999-01-01 00:00:00' AS load_dts FROM (SELECT hk_customer, CASE WHEN a.hd IS NULL THEN 'I' WHEN b.hd IS NULL THEN 'D' WHEN a.hd <> b.hd THEN 'U' END AS status FROM ({sql(1995, 1996)}) a FULL JOIN ({sql(1997, 1998)}) b USING (hk_customer)) WHERE status IS NOT NULL")
    r.add("rv18_record_tracking", lambda s, d: rv.load_record_tracking(stg_events(s, d), "hk_user", "ts", F.lit("2024-01-31").cast("date"), 2),
          with_sql("stg_events") + "SELECT hk_user, max(ts) AS last_seen, count(*) AS times_seen, date_diff('day', CAST(max(ts) AS DATE), DATE '2024-01-31') <= 2 AS is_active FROM stg_events GROUP BY hk_user")


def register(r: Registry) -> None:
    sources(r)
    materialised(r)
    staged(r)
    raw_vault(r)
