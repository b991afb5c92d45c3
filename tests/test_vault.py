"""Hand-worked results for a switch swap in a grid, and properties of the loads."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vaultline.functions.hashing import END_OF_TIME, hash_key, hashdiff
from vaultline.operators import business_vault as bv
from vaultline.operators import quality as dq
from vaultline.operators import raw_vault as rv
from vaultline.sources import sinks

START = datetime(2024, 1, 15, 8)
NODES = [("CN-001", "I", 0, "a"), ("CN-001", "U", 90, "b"), ("CN-001", "U", 240, "c"), ("CN-002", "I", 0, "a"), ("CN-003", "I", 0, "a"), ("CN-004", "I", 0, "a")]
EQUIPMENT = [
    ("CE-SW-001", "I", 0, True, "InService"), ("CE-SW-001", "U", 90, False, "OutOfService"), ("CE-SW-001", "D", 150, False, "Retired"), ("CE-SW-002", "I", 120, False, "Commissioned"),
    ("CE-SW-002", "U", 180, True, "InService"), ("CE-LN-001", "I", 0, True, "InService"), ("CE-LN-002", "I", 0, True, "InService"), ("CE-TX-001", "I", 0, True, "InService"),
]
TERMINALS = [(f"TM-00{k}", "I", 0, f"CE-{k}", f"CN-00{k % 4 + 1}", True) for k in range(1, 8)]
TERMINALS += [(f"TM-00{k}", "U", 90, f"CE-{k}", f"CN-00{k % 4 + 1}", False) for k in (1, 2)]
TERMINALS += [(f"TM-00{k}", "D", 150, f"CE-{k}", f"CN-00{k % 4 + 1}", False) for k in (1, 2)]
TERMINALS += [("TM-008", "I", 120, "CE-SW-002", "CN-001", True), ("TM-009", "I", 120, "CE-SW-002", "CN-002", True)]
UPDATES = [("TM-008", "U", 300, "CE-SW-002", "CN-004", True), ("TM-009", "U", 300, "CE-SW-002", "CN-003", True)]


def at(minutes):
    return START + timedelta(minutes=minutes)


def terminals(spark, rows):
    df = spark.createDataFrame([(m, f, at(t), e, n, c, "CIM") for m, f, t, e, n, c in rows], "mrid string, cdc_flag string, load_dts timestamp_ntz, ce string, cn string, connected boolean, record_source string")
    return df.withColumns({"hk_terminal": hash_key(["mrid"]), "hk_ce": hash_key(["ce"]), "hk_cn": hash_key(["cn"]), "hk_link": hash_key(["mrid", "ce", "cn"]), "hd": hashdiff(["connected"])})


def equipment(spark):
    df = spark.createDataFrame([(m, f, at(t), s, a, "CIM") for m, f, t, s, a in EQUIPMENT], "mrid string, cdc_flag string, load_dts timestamp_ntz, in_service boolean, asset_status string, record_source string")
    return df.withColumns({"hk": hash_key(["mrid"]), "hd": hashdiff(["in_service", "asset_status"])})


LINK = ("hk_link", ["hk_terminal", "hk_ce", "hk_cn"], "load_dts", "record_source")


def effectivity(stg, existing=None):
    return rv.load_eff_sat(stg, "hk_link", "hk_terminal", ["hk_ce", "hk_cn"], "load_dts", "record_source", deleted=F.col("cdc_flag") == "D", existing=existing)


def test_hubs_links_and_satellites(spark):
    base, update = terminals(spark, TERMINALS), terminals(spark, UPDATES)
    assert rv.load_hub(base, "hk_terminal", ["mrid"], "load_dts", "record_source").count() == 9
    assert rv.load_hub(equipment(spark), "hk", ["mrid"], "load_dts", "record_source").count() == 5
    link = rv.load_link(base, *LINK)
    assert link.count() == 9 and rv.load_link(update, *LINK, existing=link).count() == 2
    sat = rv.load_sat(equipment(spark), "hk", "hd", ["in_service", "asset_status"], "load_dts", "record_source")
    versions = {r["mrid"]: r["versions"] for r in dq.check_versions(rv.load_hub(equipment(spark), "hk", ["mrid"], "load_dts", "record_source"), sat, "hk", "mrid", 2).collect()}
    assert sat.count() == 8 and versions["CE-SW-001"] == 3 and versions["CE-SW-002"] == 2
    details = rv.load_sat(base, "hk_terminal", "hd", ["connected"], "load_dts", "record_source")
    assert details.count() == 11
    assert rv.load_sat(update, "hk_terminal", "hd", ["connected"], "load_dts", "record_source", existing=details).count() == 0


def test_node_satellite(spark):
    df = spark.createDataFrame([(m, at(t), d, "CIM") for m, _, t, d in NODES], "mrid string, load_dts timestamp_ntz, d string, record_source string").withColumns({"hk": hash_key(["mrid"]), "hd": hashdiff(["d"])})
    assert rv.load_sat(df, "hk", "hd", ["d"], "load_dts", "record_source").count() == 6


def test_effectivity_closes_by_delete_and_by_change(spark, tmp_path):
    base = sinks.as_table(effectivity(terminals(spark, TERMINALS)), f"{tmp_path}/base")
    still = F.col("end_date") == F.lit(END_OF_TIME).cast("timestamp_ntz")
    assert base.count() == 9 and base.where(still).count() == 7
    assert {r["end_date"] for r in base.where(~still).collect()} == {at(150)}
    delta = effectivity(terminals(spark, UPDATES), base)
    after = sinks.merge_on(base, delta, ["hk_terminal", "start_date"])
    assert after.count() == 11 and after.where(still).count() == 7
    whole = effectivity(terminals(spark, TERMINALS + UPDATES))
    assert after.select(*whole.columns).exceptAll(whole).count() == 0
    closed = after.where(F.col("end_date") == F.lit(str(at(300))).cast("timestamp_ntz"))
    assert closed.count() == 2 and {r["start_date"] for r in closed.collect()} == {at(120)}


def test_value_that_returns_is_a_version(spark):
    df = spark.createDataFrame([("k", at(t), v, "S") for t, v in ((0, "A"), (1, "B"), (2, "A"), (3, "A"))], "hk string, load_dts timestamp_ntz, v string, record_source string").withColumn("hd", hashdiff(["v"]))
    assert rv.load_sat(df, "hk", "hd", ["v"], "load_dts", "record_source").count() == 3


def test_ties_keep_the_grain(spark):
    df = spark.createDataFrame([("k", at(0), v, "S") for v in "ABC"] + [(None, at(0), "A", "S")], "hk string, load_dts timestamp_ntz, v string, record_source string").withColumn("hd", hashdiff(["v"]))
    rows = rv.load_sat(df, "hk", "hd", ["v"], "load_dts", "record_source").collect()
    assert len(rows) == 1 and rows[0]["hd"] == max(r["hd"] for r in df.collect())


def test_loading_twice_is_loading_once(spark):
    base = terminals(spark, TERMINALS)
    hub = rv.load_hub(base, "hk_terminal", ["mrid"], "load_dts", "record_source")
    assert rv.load_hub(base, "hk_terminal", ["mrid"], "load_dts", "record_source", hub).count() == 0
    link = rv.load_link(base, *LINK)
    assert rv.load_link(base, *LINK, existing=link).count() == 0
    sat = rv.load_sat(base, "hk_terminal", "hd", ["connected"], "load_dts", "record_source")
    assert rv.load_sat(base, "hk_terminal", "hd", ["connected"], "load_dts", "record_source", existing=sat).count() == 0


def test_order_of_rows_does_not_matter(spark):
    base = terminals(spark, TERMINALS)
    mixed = base.orderBy(F.xxhash64("mrid", "load_dts")).repartition(5)
    for load in (effectivity, lambda s: rv.load_link(s, *LINK), lambda s: rv.load_sat(s, "hk_terminal", "hd", ["connected"], "load_dts", "record_source")):
        assert load(base).exceptAll(load(mixed)).count() == 0


def test_history_intervals_join_without_gaps(spark):
    sat = rv.load_sat(equipment(spark), "hk", "hd", ["asset_status"], "load_dts", "record_source")
    rows = bv.scd2(rv.with_ghost(sat, "hk", "load_dts"), "hk", ["asset_status"], "load_dts").orderBy("hk", "valid_from").collect()
    assert len(rows) == 8 and sum(r["is_current"] for r in rows) == 5
    for a, b in zip(rows, rows[1:]):
        assert a["hk"] != b["hk"] or a["valid_to"] == b["valid_from"]


def test_ghost_key(spark):
    hub = rv.load_hub(equipment(spark), "hk", ["mrid"], "load_dts", "record_source")
    assert rv.with_ghost(hub, "hk").where(F.col("hk") == "0" * 32).count() == 1
    assert rv.no_ghost(rv.with_ghost(hub, "hk"), "hk").count() == hub.count()


def test_hash_of_nulls(spark):
    row = spark.createDataFrame([(None, " a ", None)], "x string, y string, z int").select(hash_key(["x", "z"]).alias("none"), hash_key(["x", "y"]).alias("some"), hashdiff(["x", "z"]).alias("diff")).first()
    import hashlib

    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert row["none"] is None and row["some"] == md5("^NULL^||A") and row["diff"] == md5("^NULL^||^NULL^")


def test_unknown_rule_column_fails(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(Exception, match="(?i)unresolved"):
        bv.checked_rules(df, {"r": "b + 1"})
