"""How often loads shuffle their rows, and that this changes no result."""

import pytest
from pyspark.sql import functions as F

from vaultline.functions.running import neighbours
from vaultline.operators import raw_vault as rv


def shuffles(df, *names):
    """Shuffles in the plan that carry all the named columns' rows."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    return sum("Exchange hashpartitioning" in line for line in plan.splitlines())


@pytest.fixture(scope="module")
def stg(spark):
    ids = spark.range(4000)
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string"))
    at = F.timestamp_seconds(F.lit(1_000_000) + F.floor(F.col("id") / 2) * 60).cast("timestamp_ntz")
    return ids.select(key.alias("hk"), (F.col("id") % 7).cast("string").alias("hd"), F.col("id").alias("v"), at.alias("load_dts"), F.lit("S").alias("src"))


def test_a_load_shuffles_its_rows_once(stg):
    assert shuffles(rv.load_sat(stg, "hk", "hd", ["v"], "load_dts", "src")) == 1
    assert shuffles(rv.load_eff_sat(stg, "hd", "hk", ["v"], "load_dts", "src")) == 1
    assert shuffles(rv.load_ma_sat(stg, "hk", "hd", ["v"], "load_dts", "src")) == 1


def test_only_hot_keys_are_dealt_out(spark):
    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 20_000).alias("g"), F.col("id").alias("t"))
    from vaultline.functions.running import dealt

    cut = dealt(df, ["g"], "t", 16)
    assert cut.where("_stretch > 0").select("g").distinct().collect() == [(-1,)]
    assert cut.where("g = -1").select("_stretch").distinct().count() == 16
    both = [{tuple(r) for r in neighbours(df, ["g"], ["t"], {"b": "t"}, {"a": "t"}, n).collect()} for n in (1, 16)]
    assert both[0] == both[1] and len(both[0]) == 60_000


def test_open_rows_of_other_keys_stay_out(spark, stg):
    old, new = stg.where("v < 2000"), stg.where("v >= 2000 and hk in ('1', 'hot')")
    stored = rv.load_eff_sat(old, "hd", "hk", ["v"], "load_dts", "src").localCheckpoint()
    for n in (1, 8):
        added = rv.load_eff_sat(new, "hd", "hk", ["v"], "load_dts", "src", existing=stored, stretches=n)
        assert {r[0] for r in added.select("hk").distinct().collect()} == {"1", "hot"}


def test_a_merge_computes_its_delta_once(spark, tmp_path):
    from vaultline.sources.versioned import VersionedTable

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    t = VersionedTable(spark, f"{tmp_path}/t")
    t.append(spark.range(100).withColumn("v", F.lit("a")))
    t.merge(spark.range(50, 150).mapInArrow(counted, "id long").withColumn("v", F.lit("b")), ["id"])
    assert seen.value == 100
    assert t.read().groupBy("v").count().orderBy("v").collect() == [("a", 50), ("b", 100)]


def test_several_moments_are_one_pass(spark, stg):
    from vaultline.operators import business_vault as bv

    moments = {str(n): F.timestamp_seconds(F.lit(1_000_000 + n * 60)).cast("timestamp_ntz") for n in (-1, 0, 20, 5000)}
    got = bv.as_of_each(rv.load_sat(stg, "hk", "hd", ["v"], "load_dts", "src"), "hk", "load_dts", ["v"], moments)
    assert shuffles(got, "hk") == 1
    sat = rv.load_sat(stg, "hk", "hd", ["v"], "load_dts", "src").localCheckpoint()
    want = {(*r, n) for n, at in moments.items() for r in bv.as_of(sat, "hk", "load_dts", ["v"], at).collect()}
    assert {tuple(r) for r in got.collect()} == want and len(want) > 51


def test_a_model_profiles_its_tables_once(spark, sf):
    from vaultline.operators import profiling as pr
    from vaultline.queries import marts

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    profiles = marts.profiles(spark, sf).select("table_name", "column_name", "is_likely_key")
    watched = profiles.mapInArrow(counted, profiles.schema)
    pr.infer_model(marts.catalog(spark, sf).where(F.col("table_name").isin(marts.NAMES)), watched).collect()
    assert seen.value == sum(map(len, marts.FULL.values()))
