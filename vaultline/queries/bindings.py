"""How the operators are bound to the supplied tables, and the SQL text of the same bindings.

A projection is a query in SQL that Spark and DuckDB both understand; Spark runs it over temporary views.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultline.functions.hashing import hash_key, hashdiff
from vaultline.operators.staging import Hashed, stage

Query = Callable[[SparkSession, str], DataFrame]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"two queries named {name}")
        self.queries[name] = query
        if sql is not None:
            self.sql[name] = sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def norm_sql(*columns: str) -> str:
    return "concat_ws('||', " + ", ".join(f"coalesce(upper(trim(CAST({c} AS VARCHAR))), '^NULL^')" for c in columns) + ")"


def diff_sql(*columns: str) -> str:
    return f"md5({norm_sql(*columns)})"


def key_sql(*columns: str) -> str:
    return f"CASE WHEN coalesce({', '.join(f'CAST({c} AS VARCHAR)' for c in columns)}) IS NOT NULL THEN {diff_sql(*columns)} END"


END = "TIMESTAMP '9999-12-31 00:00:00'"
GHOST = "'" + "0" * 32 + "'"
GHOST_DATE = "TIMESTAMP '1900-01-01 00:00:00'"


def with_sql(*parts: str) -> str:
    """A WITH clause of named parts, each after those it needs."""
    out: list[str] = []

    def visit(name: str) -> None:
        for need in PARTS[name][0]:
            visit(need)
        text = f"{name} AS ({PARTS[name][1]})"
        if text not in out:
            out.append(text)

    for p in parts:
        visit(p)
    return "WITH " + ", ".join(out) + " "


#: Column names and types that meet and miss each rule of names.
SAMPLE_NAMES = """mrid id uuid Site_MRID order_id part_key row_uuid sys_id guid uid customerid site_guid rowkey name identity
record_source load_date load_datetime load_ts loaded_at dl_loaded_at dl_load_date dl_load_ts ingestion_timestamp ingest_ts etl_load_ts _loaded_at created_at
Updated_At modified_at deleted_at sys_created_on sys_updated_on sys_mod_count __$start_lsn _dl_batch dl__run _private load_dts cdc_flag effective_from start_date
end_date dl_run __seq status order_status state grid_state connected is_open has_alarm late_flag flag active enabled in_service operational current_phase
last_seen_at heartbeat grid_state_at meter_reading face_value out_kw out_kwh out_kva out_mva out_mvar out_amp out_amps out_volt out_volts out_celsius
out_fahrenheit oil_pressure oil_temperature error_count grand_total load_factor measure_a measured_b statuses total value""".split()
SAMPLE_TYPES = [
    "TIMESTAMP_NTZ", "datetime2", "date", " uuid ", "jsonb", "boolean", "varchar(20)", "CHAR(1)", "string", "text", "bigint", "int4", "smallint", "tinyint", "long",
    "decimal(10,2)", "NUMERIC", "double", "float8", "geometry", "array<int>", "interval",
]


def one_of(column: str, values: list[str]) -> str:
    """SQL that picks a value by a column's remainder."""
    return f"CASE {column} % {len(values)} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


#: name -> (parts that it needs, SQL). Parts above the line are for DuckDB alone; projections are for both engines.
PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "stg_orders": ((), f"SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, CAST(o_totalprice AS DECIMAL(18,2)) AS price, o_orderdate, {key_sql('o_custkey')} AS hk_customer, {key_sql('o_orderkey')} AS hk_order, {key_sql('o_orderkey', 'o_custkey')} AS hk_order_customer, {diff_sql('o_orderstatus', 'o_orderpriority')} AS hd_status, {diff_sql('o_orderstatus')} AS hd_state, {diff_sql('o_orderpriority')} AS hd_priority, 'ORDERS' AS record_source FROM orders"),
    "stg_li": ((), f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS DECIMAL(18,2)) AS quantity, CAST(l_extendedprice AS DECIMAL(18,2)) AS price, l_shipdate, {key_sql('l_orderkey')} AS hk_order, {key_sql('l_partkey')} AS hk_part, {key_sql('l_suppkey')} AS hk_supplier, {key_sql('l_partkey', 'l_suppkey')} AS hk_part_supplier, {key_sql('l_orderkey', 'l_partkey', 'l_suppkey')} AS hk_order_part_supplier, 'LINEITEM' AS record_source FROM lineitem"),
    "stg_events": ((), f"SELECT event_id, user_id, ts, event_type, {key_sql('user_id')} AS hk_user, {diff_sql('event_type')} AS hd_type, 'EVENTS' AS record_source FROM events"),
    "hub_customer": (("stg_orders",), "SELECT hk_customer, o_custkey, o_orderdate, record_source FROM (SELECT *, row_number() OVER (PARTITION BY hk_customer ORDER BY o_orderdate, record_source, o_custkey) AS r FROM stg_orders) WHERE r = 1"),
    "link_oc": (("stg_orders",), "SELECT hk_order_customer, hk_order, hk_customer, o_orderdate, record_source FROM (SELECT *, row_number() OVER (PARTITION BY hk_order_customer ORDER BY o_orderdate, hk_order, hk_customer) AS r FROM stg_orders) WHERE r = 1"),
    "one_status": (("stg_orders",), "SELECT hk_customer, o_orderdate, max(hd_status) AS hd_status, arg_max(o_orderstatus, hd_status) AS o_orderstatus, arg_max(o_orderpriority, hd_status) AS o_orderpriority, 'ORDERS' AS record_source FROM stg_orders GROUP BY hk_customer, o_orderdate"),
    "sat_status": (("one_status",), "SELECT hk_customer, hd_status, o_orderstatus, o_orderpriority, o_orderdate, record_source FROM (SELECT *, lag(hd_status) OVER (PARTITION BY hk_customer ORDER BY o_orderdate) AS b FROM one_status) WHERE b IS DISTINCT FROM hd_status"),
    "one_priority": (("stg_orders",), "SELECT hk_customer, o_orderdate, max(hd_priority) AS hd_priority, arg_max(o_orderpriority, hd_priority) AS o_orderpriority, 'ORDERS' AS record_source FROM stg_orders GROUP BY hk_customer, o_orderdate"),
    "sat_priority": (("one_priority",), "SELECT hk_customer, hd_priority, o_orderpriority, o_orderdate, record_source FROM (SELECT *, lag(hd_priority) OVER (PARTITION BY hk_customer ORDER BY o_orderdate) AS b FROM one_priority) WHERE b IS DISTINCT FROM hd_priority"),
    "eff_events": (("stg_li",), "SELECT hk_part, l_shipdate AS start_date, max(hk_part_supplier) AS hk_part_supplier, arg_max(hk_supplier, hk_part_supplier) AS hk_supplier, 'LINEITEM' AS record_source FROM stg_li GROUP BY hk_part, l_shipdate"),
    "eff_part": (("eff_events",), f"SELECT hk_part_supplier, hk_part, hk_supplier, start_date, coalesce(lead(start_date) OVER (PARTITION BY hk_part ORDER BY start_date), {END}) AS end_date, start_date AS effective_from, record_source FROM (SELECT *, lag(hk_part_supplier) OVER (PARTITION BY hk_part ORDER BY start_date) AS b FROM eff_events) WHERE b IS DISTINCT FROM hk_part_supplier"),
    "months": ((), "SELECT CAST(last_day(m) AS TIMESTAMP) AS as_of_date FROM (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 MONTH)) AS m)"),
    "pit_customer": (("hub_customer", "sat_status", "sat_priority", "months"), f"SELECT g.hk_customer, g.as_of_date, coalesce(s.o_orderdate, {GHOST_DATE}) AS status_ldts, CASE WHEN s.o_orderdate IS NULL THEN {GHOST} ELSE g.hk_customer END AS status_pk, coalesce(p.o_orderdate, {GHOST_DATE}) AS priority_ldts, CASE WHEN p.o_orderdate IS NULL THEN {GHOST} ELSE g.hk_customer END AS priority_pk FROM (SELECT hk_customer, as_of_date FROM hub_customer, months) g ASOF LEFT JOIN sat_status s ON g.hk_customer = s.hk_customer AND g.as_of_date >= s.o_orderdate ASOF LEFT JOIN sat_priority p ON g.hk_customer = p.hk_customer AND g.as_of_date >= p.o_orderdate"),
    # ---- projections, understood by both engines
    "cat_v1": ((), "SELECT 't' || CAST(p_partkey % 200 AS STRING) AS table_name, 'c' || CAST(p_partkey AS STRING) AS column_name, p_type AS raw_dtype, p_partkey % 20 = 0 AS is_key FROM part"),
    "cat_v2": ((), "SELECT 't' || CAST(p_partkey % 200 AS STRING) AS table_name, 'c' || CAST(p_partkey AS STRING) AS column_name, CASE WHEN p_partkey % 7 = 0 THEN p_brand ELSE p_type END AS raw_dtype, p_partkey % 20 = 0 AS is_key FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 200 <> 7 AND p_partkey % 200 < 180 OR p_partkey % 200 >= 190 UNION ALL SELECT 't' || CAST(p_partkey % 180 AS STRING), 'n' || CAST(p_partkey AS STRING), p_type, false FROM part WHERE p_partkey % 13 = 0 AND p_partkey % 180 <> 7 UNION ALL SELECT 'x' || CAST(p_size AS STRING), 'c' || CAST(p_partkey AS STRING), p_type, false FROM part WHERE p_partkey % 17 = 0"),
    "runs": ((), "SELECT c_nationkey AS n, c_custkey % 8 AS r, min(c_custkey) AS lo, max(c_custkey) AS hi FROM customer GROUP BY c_nationkey, c_custkey % 8"),
    "plan_hubs": ((), "SELECT 's' || CAST(c_nationkey AS STRING) AS system_id, CAST(c_custkey % 8 AS INT) AS run_id, CASE WHEN c_custkey % 19 = 0 THEN 'h_' ELSE 'hub_' END || CAST(c_custkey AS STRING) AS name, c_mktsegment AS source_table, split(CASE WHEN c_custkey % 11 = 0 THEN 'Sys_ID' WHEN c_custkey % 13 = 0 THEN 'acct_sk' ELSE 'k' || CAST(c_custkey % 5 AS STRING) END || CASE WHEN c_custkey % 3 = 0 THEN ',m' || CAST(c_custkey % 7 AS STRING) ELSE '' END, ',') AS business_keys, CASE WHEN c_custkey % 9 = 0 THEN 'X_' ELSE 'HK_' END || CAST(c_custkey AS STRING) AS hash_key, CAST(0.45 + 0.2 * (c_custkey % 3) AS DOUBLE) AS confidence FROM customer"),
    "plan_links": (("runs",), "SELECT 's' || CAST(c_nationkey AS STRING) AS system_id, CAST(c_custkey % 8 AS INT) AS run_id, CASE WHEN o_orderkey % 29 = 0 THEN 'lnk_' ELSE 'link_' END || CAST(o_orderkey AS STRING) AS name, o_orderpriority AS source_table, CASE WHEN o_orderkey % 31 = 0 THEN 'L_' ELSE 'HK_L_' END || CAST(o_orderkey AS STRING) AS hash_key, split('HK_' || CAST(o_custkey AS STRING) || CASE WHEN o_orderkey % 37 = 0 THEN '' WHEN o_orderkey % 4 = 0 THEN ',HK_' || CAST(o_custkey AS STRING) WHEN o_orderkey % 4 = 1 THEN ',HK_none' WHEN o_orderkey % 4 = 2 THEN ',HK_' || CAST(lo AS STRING) ELSE ',HK_' || CAST(hi AS STRING) END, ',') AS fk_columns, CAST(0.8 AS DOUBLE) AS confidence FROM orders JOIN customer ON o_custkey = c_custkey JOIN runs ON n = c_nationkey AND r = c_custkey % 8"),
    "plan_sats": ((), "SELECT 's' || CAST(c_nationkey AS STRING) AS system_id, CAST(c_custkey % 8 AS INT) AS run_id, CASE WHEN o_orderkey % 8 = 1 THEN 'eff_sat_' WHEN o_orderkey % 17 = 0 THEN 's_' ELSE 'sat_' END || CAST(o_orderkey AS STRING) || CASE WHEN o_orderkey % 5 = 0 THEN '_details' WHEN o_orderkey % 5 = 1 THEN '_operational' WHEN o_orderkey % 5 = 2 THEN '_measurements' ELSE '' END AS name, c_mktsegment AS source_table, 'HK_' || CAST(c_custkey AS STRING) AS parent_hub, CASE WHEN o_orderkey % 10 = 0 THEN 'X_' ELSE 'HD_' END || CAST(o_orderkey AS STRING) AS hashdiff, split(o_orderstatus || ',' || o_orderpriority || CASE WHEN o_orderkey % 4 = 0 THEN ',k' || CAST(c_custkey % 5 AS STRING) ELSE '' END || CASE WHEN o_orderkey % 6 = 0 THEN ',load_dts' ELSE '' END, ',') AS payload, CAST(0.7 AS DOUBLE) AS confidence FROM orders JOIN customer ON o_custkey = c_custkey"),
    "gold_hubs": ((), "SELECT 's' || CAST(c_nationkey AS STRING) AS system_id, c_mktsegment AS source_table, split('k' || CAST((c_custkey + CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END) % 5 AS STRING) || CASE WHEN c_custkey % 3 = 0 THEN ',m' || CAST(c_custkey % 7 AS STRING) ELSE '' END, ',') AS business_keys, CASE WHEN c_custkey % 7 = 0 THEN 'gold_' ELSE 'hub_' END || CAST(c_custkey AS STRING) AS name FROM customer WHERE c_custkey % 2 = 0"),
    "catalog": ((), "SELECT DISTINCT 's' || CAST(c_nationkey AS STRING) AS system_id, c_mktsegment AS table_name, 'k' || CAST(c_custkey % 5 AS STRING) AS column_name FROM customer WHERE c_mktsegment <> 'MACHINERY' UNION SELECT DISTINCT 's' || CAST(c_nationkey AS STRING), c_mktsegment, o_orderstatus FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment <> 'MACHINERY'"),
    "catalog_names": ((), f"SELECT 's' AS system_id, 't' || CAST(p_partkey % 40 AS STRING) AS table_name, CAST(p_partkey AS INT) AS ordinal, {one_of('p_partkey', SAMPLE_NAMES)} AS column_name, {one_of('p_size', SAMPLE_TYPES)} AS raw_dtype FROM part"),
    "catalog_profiles": (("catalog_names",), "SELECT table_name, column_name, max(ordinal % 37) = 0 AS is_likely_key, CAST(max(ordinal) % 20 AS DOUBLE) / 20 AS cardinality_ratio FROM catalog_names GROUP BY table_name, column_name"),
    "approvals": ((), "SELECT 'p' || CAST(o_custkey AS STRING) AS plan_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS version, CASE WHEN o_orderstatus = 'F' THEN 'approved' WHEN o_orderstatus = 'P' THEN 'rejected' WHEN o_orderkey % 2 = 0 THEN 'draft' ELSE 'changes_requested' END AS status, o_orderpriority AS actor, o_orderdate AS decided_at, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'because' END AS comment, concat('{\"errors\": ', CAST(o_orderkey % 3 AS STRING), '}') AS validation_json FROM orders"),
    "raters": ((), "SELECT doc_id AS item, quality AS a, toxic AS b FROM labels"),
    "study": ((), "SELECT o_orderstatus AS system_id, CASE WHEN o_orderkey % 2 = 0 THEN 'off' ELSE 'on' END AS condition, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INT) AS seed, 'price' AS metric, floor((2 * sum(CAST(round(o_totalprice * 100) AS BIGINT)) + count(*)) / (2 * count(*))) / 100 AS value FROM orders GROUP BY 1, 2, 3"),
}


def projected(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """Projections as DataFrames."""
    for t in TABLES:
        if any(f"FROM {t}" in with_sql(n) or f"JOIN {t}" in with_sql(n) for n in names):
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    return [spark.sql(with_sql(n) + f"SELECT * FROM {n}") for n in names]


def stg_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.col("o_totalprice").cast("decimal(18,2)").alias("price"), "o_orderdate")
    hashed = [
        Hashed("hk_customer", ["o_custkey"]), Hashed("hk_order", ["o_orderkey"]), Hashed("hk_order_customer", ["o_orderkey", "o_custkey"]),
        Hashed("hd_status", ["o_orderstatus", "o_orderpriority"], diff=True), Hashed("hd_state", ["o_orderstatus"], diff=True), Hashed("hd_priority", ["o_orderpriority"], diff=True),
    ]
    return stage(df, hashed=hashed).withColumn("record_source", F.lit("ORDERS"))


def stg_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("decimal(18,2)").alias("quantity"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price"), "l_shipdate")
    hashed = [
        Hashed("hk_order", ["l_orderkey"]), Hashed("hk_part", ["l_partkey"]), Hashed("hk_supplier", ["l_suppkey"]),
        Hashed("hk_part_supplier", ["l_partkey", "l_suppkey"]), Hashed("hk_order_part_supplier", ["l_orderkey", "l_partkey", "l_suppkey"]),
    ]
    return stage(df, hashed=hashed).withColumn("record_source", F.lit("LINEITEM"))


def stg_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return df.withColumns({"hk_user": hash_key(["user_id"]), "hd_type": hashdiff(["event_type"]), "record_source": F.lit("EVENTS")})
