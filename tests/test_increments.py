"""Increments that read little of what is stored: Bloom filters, point-in-time tables carried forward, a vault from one staging."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from vaultline.functions.bloom import bloom, maybe_in
from vaultline.functions.hashing import hash_key, hashdiff
from vaultline.operators import business_vault as bv
from vaultline.operators import raw_vault as rv
from vaultline.queries import registry
from vaultline.sources.versioned import VersionedTable

START = datetime(2024, 1, 1)
GHOST = datetime(1900, 1, 1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bloom_filter_holds_back_no_key_and_few_pass(spark):
    keys = spark.range(3000).select(F.md5(F.col("id").cast("string")).alias("k")).union(spark.sql("SELECT CAST(NULL AS STRING)"))
    others = spark.range(100_000, 140_000).select(F.md5(F.col("id").cast("string")).alias("k"))
    f = bloom(keys, "k", 2)  # about 22 bits a key
    assert f.count() == 2 and f.selectExpr("max(size(_bloom_bits))").first()[0] == 512
    assert maybe_in(keys, f, "k", 2).count() == 3000
    assert maybe_in(others, f, "k", 2).count() < 400  # one in a hundred
    assert maybe_in(others, bloom(keys.where("false"), "k", 2), "k", 2).count() == 0


def versions(spark, rows):
    df = spark.createDataFrame([(k, START + timedelta(hours=t), v, "S") for k, t, v in rows], "k string, load_dts timestamp_ntz, v string, src string")
    return df.withColumns({"hk": hash_key(["k"]), "hd": hashdiff(["v"])}).select("hk", "hd", "k", "v", "load_dts", "src")


SAT = ("hk", "hd", ["v"], "load_dts", "src")


def test_small_batch_touches_little_of_history(spark, tmp_path):
    history = [(f"k{i}", t, f"v{t % 3}") for i in range(2000) for t in range(5)]
    stored = VersionedTable(spark, f"{tmp_path}/sat")
    stored.append(rv.load_sat(versions(spark, history), *SAT))
    batch = versions(spark, [("k7", 9, "new"), ("k8", 9, f"v{4 % 3}"), ("k9", 2, "late"), ("new", 9, "first")])
    loaded = rv.load_sat(batch, *SAT, existing=stored.read())
    assert sorted((r["hk"], r["hd"]) for r in loaded.collect()) == sorted((r["hk"], r["hd"]) for r in batch.where("k in ('k7', 'new')").collect())
    assert rv.touched(stored.read(), batch, "hk").count() <= 5 * 5  # three keys of five versions, and hardly any other of the 10,000 rows
    text = plan(loaded)
    assert "_bloom_block" in text and "BroadcastExchange" in text
    hub = rv.load_hub(versions(spark, history), "hk", ["k"], "load_dts", "src")
    new = rv.load_hub(batch, "hk", ["k"], "load_dts", "src", hub)
    assert [r["k"] for r in new.collect()] == ["new"] and "_bloom_block" in plan(new)


def test_multi_active_sets_in_batches(spark):
    rnd = random.Random(3)
    rows = [(f"k{rnd.randint(0, 5)}", t // 4, f"v{rnd.randint(0, 1)}") for t in range(120)]
    whole = rv.load_ma_sat(versions(spark, rows), *SAT)
    stored = None
    for lo, hi in ((0, 9), (9, 10), (10, 31), (5, 31)):  # the last one repeats
        batch = versions(spark, [r for r in rows if lo <= r[1] < hi])
        new = rv.load_ma_sat(batch, *SAT, existing=stored)
        stored = new.cache() if stored is None else stored.union(new).cache()
    assert stored.count() == whole.count() and stored.exceptAll(whole).count() == 0


def brute_pit(keys, days, sats):
    out = set()
    for k in keys:
        for d in days:
            row = [k, d]
            for sat in sats:
                seen = [t for key, t in sat if key == k and t <= d]
                row += [max(seen), k] if seen else [GHOST, "0" * 32]
            out.add(tuple(row))
    return out


@pytest.fixture(scope="module")
def history(spark):
    rnd = random.Random(1)
    keys = [f"key{i}" for i in range(30)]
    at = lambda: START + timedelta(hours=rnd.randint(-300, 1200))
    sats = [[(rnd.choice([*keys, "not in the hub"]), at()) for _ in range(200)] + [("key1", at()) for _ in range(300)], [(rnd.choice(keys[:10]), at()) for _ in range(40)], []]
    days = sorted({START + timedelta(days=rnd.randint(0, 40)) for _ in range(25)})
    frames = [(f"s{i}", spark.createDataFrame(s, "hk string, load_dts timestamp_ntz"), "load_dts") for i, s in enumerate(sats)]
    hub = spark.createDataFrame([(k,) for k in keys], "hk string")
    return keys, days, sats, frames, hub, spark.createDataFrame([(d,) for d in days], "as_of_date timestamp_ntz")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_pit_equals_brute_force(history):
    keys, days, sats, frames, hub, spine = history
    got = rows(bv.pit(hub, spine, frames, "hk"))
    assert len(got) == len(keys) * len(days) and set(got) == brute_pit(keys, days, sats)
    assert set(rows(bv.pit(hub, spine, frames[:1], "hk"))) == brute_pit(keys, days, sats[:1])
    assert rows(bv.pit(hub, spine.where("false"), frames, "hk")) == []


def test_pit_takes_one_shuffle_by_key_for_all_satellites(spark, history):
    _, _, _, frames, hub, spine = history
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan(bv.pit(hub, spine, frames, "hk"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert text.count("Exchange hashpartitioning(hk#") == 2 and text.count("_slot#") > 0 and "SortMergeJoin" not in text
    assert sum("_slot" in line for line in text.splitlines() if "Exchange hashpartitioning(hk#" in line) == 1  # the other one combines by (key, date)


def test_pit_goes_on_from_a_snapshot_without_older_versions(history):
    keys, days, sats, frames, hub, spine = history
    edge = days[11]
    state = bv.pit_state(bv.pit(hub, spine, frames, "hk"), str(edge))
    old = F.col("load_dts") <= F.lit(str(edge)).cast("timestamp_ntz")
    broken = [(n, s.withColumn("load_dts", F.when(old, F.lit("1850-01-01 00:00:00").cast("timestamp_ntz")).otherwise(F.col("load_dts"))), t) for n, s, t in frames]
    got = rows(bv.pit_since(hub, spine, broken, "hk", str(edge), state))
    assert set(got) == brute_pit(keys, [d for d in days if d > edge], sats) and len(got) == len(keys) * len(days[12:])
    assert set(rows(bv.pit_since(hub, spine, frames, "hk", str(edge)))) == set(got)


def test_snapshot_mark_reaches_the_scan(spark, history, tmp_path):
    _, days, _, frames, hub, spine = history
    frames[0][1].write.parquet(f"{tmp_path}/s0")
    stored = [("s0", spark.read.parquet(f"{tmp_path}/s0"), "load_dts")]
    state = bv.pit_state(bv.pit(hub, spine, stored, "hk"), str(days[11]))
    text = bv.pit_since(hub, spine, stored, "hk", str(days[11]), state)._jdf.queryExecution().toString()
    assert "GreaterThan(load_dts" in text


@pytest.fixture
def spec(spark):
    scans = spark.sparkContext.accumulator(0)

    def stage(sp):
        def counted(batches):
            for b in batches:
                scans.add(b.num_rows)
                yield b

        df = versions(sp, [(f"k{i % 50}", i // 50, f"v{i % 7}") for i in range(400)]).coalesce(2)
        return df.mapInArrow(counted, df.schema)

    entities = [
        ("sat", "sat", lambda g, old: rv.load_sat(g["s"], *SAT, existing=old)),
        ("hub", "hub", lambda g, old: rv.load_hub(g["s"], "hk", ["k"], "load_dts", "src", old)),
        ("eff", "eff_sat", lambda g, old: rv.load_eff_sat(g["s"], "hd", "hk", ["v"], "load_dts", "src", existing=old)),
    ]
    return rv.VaultSpec({"s": stage}, entities, {"eff": ["hk", "start_date"]}), scans


def test_vault_stages_once_and_loads_twice_alike(spark, spec, tmp_path):
    spec, scans = spec
    first = {r["entity"]: r for r in rv.run_vault(spark, spec, f"{tmp_path}/v").collect()}
    assert scans.value == 400  # each staged row once, for three entities
    assert {n: r["status"] for n, r in first.items()} == {"hub": "OK", "sat": "OK", "eff": "OK"} and first["hub"]["n_rows"] == 50
    kept = {n: VersionedTable(spark, f"{tmp_path}/v/{n}").read() for n in first}
    before = {n: sorted(rows(df)) for n, df in kept.items()}
    again = {r["entity"]: r["n_rows"] for r in rv.run_vault(spark, spec, f"{tmp_path}/v").collect()}
    assert again["hub"] == 0 and again["sat"] == 0 and scans.value == 800
    assert {n: sorted(rows(VersionedTable(spark, f"{tmp_path}/v/{n}").read())) for n in first} == before


def test_failure_of_one_leaves_the_others_whole(spark, spec, tmp_path):
    spec, _ = spec
    rv.run_vault(spark, spec, f"{tmp_path}/v")
    broken = lambda g, old: rv.load_sat(g["s"], *SAT, existing=old).withColumn("v", F.raise_error(F.lit("lost")).cast("string"))
    more = [("sat", "sat", lambda g, old: broken(g, None)), *spec.entities[1:], ("none", "sat", lambda g, old: g["t"]), ("link", "link", lambda g, old: g["s"].select("hk", "v"))]

    def fails(sp):
        raise OSError("no such source")

    outcome = {r["entity"]: r for r in rv.run_vault(spark, rv.VaultSpec(spec.stages | {"t": fails}, more, spec.merge_keys), f"{tmp_path}/v").collect()}
    assert {n: r["status"] for n, r in outcome.items()} == {"hub": "OK", "eff": "OK", "link": "OK", "sat": "FAILED", "none": "FAILED"}
    assert outcome["none"]["error"] == "no such source" and outcome["link"]["n_rows"] == 400
    assert VersionedTable(spark, f"{tmp_path}/v/sat").numbers() == [1] and VersionedTable(spark, f"{tmp_path}/v/sat").read().count() > 50


@pytest.mark.parametrize("stretches", [1, 2, 16])
def test_neighbours_in_stretches(spark, stretches):
    from vaultline.functions.running import neighbours

    rnd = random.Random(7)
    data = [("hot", t, rnd.choice([None, "a", "b"])) for t in range(200)] + [(None, t, "n") for t in range(0, 200, 50)] + [(f"k{t}", t, "x") for t in range(20)]
    df = spark.createDataFrame(data, "g string, t int, v string").repartition(5)
    got = {tuple(r) for r in neighbours(df, ["g"], ["t"], {"b": "v", "bt": "t"}, {"a": "v"}, stretches).select("g", "t", "v", "b", "bt", "a").collect()}
    want = set()
    for key in {g for g, _, _ in data}:
        own = sorted((t, v) for g, t, v in data if g == key)
        for i, (t, v) in enumerate(own):
            b, a = own[i - 1] if i else (None, None), own[i + 1] if i + 1 < len(own) else (None, None)
            want.add((key, t, v, b[1], b[0], a[1]))
    assert got == want


def test_a_hot_key_is_split_over_tasks_with_the_same_result(spark):
    rnd = random.Random(11)
    data = [("hot" if rnd.random() < 0.4 else f"k{rnd.randint(0, 200)}", t, f"v{rnd.randint(0, 2)}") for t in range(4000)]
    stg = versions(spark, data)
    one, many = (rv.load_eff_sat(stg, "hd", "hk", ["v"], "load_dts", "src", stretches=n) for n in (1, 32))
    assert one.count() == many.count() and one.exceptAll(many).count() == 0
    assert rv.load_sat(stg, *SAT).exceptAll(rv.load_sat(stg, *SAT, stretches=8)).count() == 0
    assert sorted(rows(rv.load_ma_sat(stg, *SAT))) == sorted(rows(rv.load_ma_sat(stg, *SAT, stretches=8)))
    sat = rv.load_sat(stg, *SAT)
    assert bv.scd2(sat, "hk", ["v"], "load_dts").exceptAll(bv.scd2(sat, "hk", ["v"], "load_dts", stretches=8)).count() == 0
    from vaultline.functions.running import stretched

    per_task = stretched(stg, "load_dts", 32).groupBy("hk", "_stretch").count().agg(F.max("count")).first()[0]
    assert per_task < 0.05 * 4000  # of the key that has two fifths of the rows


def test_stored_runs_are_fewer_than_dates_and_lay_out_as_the_table(spark, sf, monkeypatch):
    from vaultline.queries import marts

    made = []
    monkeypatch.setattr(marts, "VersionedTable", lambda *a: made.append(VersionedTable(*a)) or made[-1])
    rows = lambda df: {tuple(r) for r in df.collect()}
    queries = registry.queries()
    got, want = queries["bv3_pit_carried"](spark, sf), queries["bv2_pit"](spark, sf)
    assert got.columns == want.columns and got.count() == want.count() and rows(got) == rows(want)
    assert 0 < made[0].read().count() * 4 < got.count()
    sats = [(n, None, None) for n in ("status", "priority")]
    few = marts.months(spark).where("month(as_of_date) = 6")
    assert rows(bv.pit_of_runs(made[0].read(), few, sats, "hk_customer")) == rows(want.where("month(as_of_date) = 6"))


def test_stored_dates_hold_load_dates_alone_and_versions_are_computed_once(spark, sf, monkeypatch):
    from vaultline.queries import marts

    seen, made = spark.sparkContext.accumulator(0), []
    sat, write = marts.sat_status, marts.sinks.overwrite_partitions
    schema, versions = sat(spark, sf).schema, sat(spark, sf).count()

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    def noted(df, path, *rest):
        out = write(df, path, *rest)
        made.append((out.columns, {(f.parent.name, f.name) for f in Path(path.removeprefix("file:")).glob("*/*.parquet")}))
        return out

    monkeypatch.setattr(marts, "sat_status", lambda s, d: sat(s, d).mapInArrow(counted, schema))
    monkeypatch.setattr(marts.sinks, "overwrite_partitions", noted)
    queries = registry.queries()
    got = queries["bv3_pit_incremental"](spark, sf)
    assert seen.value == versions  # two runs read them
    monkeypatch.undo()
    want = queries["bv2_pit"](spark, sf)
    assert got.columns == want.columns and sorted(rows(got)) == sorted(rows(want))
    (columns, first), (_, second) = made
    assert columns == ["hk_customer", "status_ldts", "priority_ldts", "as_of_date"]  # the satellites' keys follow from these
    assert all(name.endswith(".zstd.parquet") for _, name in first | second)
    kept = {f for f in first if f[0] < "as_of_date=2001-06"}
    assert kept == {f for f in second if f[0] < "as_of_date=2001-06"} and first & second == kept and len({f[0] for f in second}) == 84


def test_stored_dates_lay_out_as_the_table(history):
    keys, days, sats, frames, hub, spine = history
    stored = bv.pit_dates(hub, spine, frames, "hk")
    assert stored.columns == ["hk", "as_of_date", *(f"{n}_ldts" for n, _, _ in frames)]
    assert set(rows(bv.pit_of_dates(stored, frames, "hk"))) == brute_pit(keys, days, sats)
    later = bv.pit_since(hub, spine, frames, "hk", str(days[11]), dates=True)
    assert set(rows(bv.pit_of_dates(later, frames, "hk"))) == brute_pit(keys, days[12:], sats)
