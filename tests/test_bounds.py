"""Work that grows with the input and not faster, with unchanged results."""

import glob
import random
import shutil
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vaultline.functions.hashing import pack, unpack
from vaultline.operators import raw_vault as rv
from vaultline.sources.versioned import VersionedTable
from vaultline.streaming import streams

EVENTS = "key string, ts timestamp_ntz, hashdiff string"
START = datetime(2024, 1, 1)


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, streams.ROCKSDB)
    yield
    spark.conf.unset(name)


@pytest.mark.parametrize("ttl", [None, 24])
def test_keys_share_the_state_of_their_bucket(spark, rocksdb, tmp_path, ttl):
    rnd, source, want, last = random.Random(5), tmp_path / "src", [], {}
    source.mkdir()
    for b in range(3):
        rows = sorted({(f"k{rnd.randrange(300)}" if rnd.random() > 0.02 else None, 10 * b + rnd.randrange(10) + 40 * (b == 2)) for _ in range(600)}, key=str)
        rows = [(k, h, rnd.choice("xy")) for k, h in rows]
        for k, h, v in sorted(rows, key=lambda r: r[1]):
            before, at = last.get(k, (None, h))
            if v != before or ttl is not None and h - at >= ttl:
                want.append((k or "", h, v))
            last[k] = (v, h)
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.createDataFrame([(k, START + timedelta(hours=h), v) for k, h, v in rows], EVENTS).coalesce(1).write.mode("overwrite").parquet(folder)
        shutil.copy(glob.glob(f"{folder}/part-*")[0], f"{source}/{b:05d}.parquet")
    stream = streams.stream_bronze(spark, str(source), spark.createDataFrame([], EVENTS).schema)
    args = ("key", "ts", "hashdiff")
    changes = streams.stream_changes(stream, *args, buckets=16) if ttl is None else streams.stream_changes_expiring(stream, *args, "90 days", ttl * 3_600_000, buckets=16)
    q = streams.append_stream(changes, f"{tmp_path}/out", f"{tmp_path}/ckpt")
    q.awaitTermination()
    got = sorted((r["key"] or "", int((r["ts"].replace(tzinfo=None) - START).total_seconds() // 3600), r["hashdiff"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == sorted(want)
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(rows) <= 16 * (1 if ttl is None else 3)  # a value, and a timer in two orders


def test_digests_travel_as_bytes(spark, tmp_path):
    texts = [None, "", "a" * 32, "A" * 32, "a" * 31, "0" * 64, "f" * 40, "\x01" + "a" * 31, "é", "g" * 32]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("p", pack(F.col("t")))
    got = df.select("t", unpack(F.col("p")).alias("back"), F.octet_length("p").alias("n")).collect()
    assert all(r["t"] == r["back"] for r in got) and {r["t"]: r["n"] for r in got}["a" * 32] == 17
    assert df.where("p is not null").agg(F.count_distinct("p")).first()[0] == len(texts) - 1

    at = F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("load_dts")
    link = F.when(F.col("id") % 5 == 0, F.concat(F.lit("k"), (F.col("id") % 20).cast("string"))).otherwise(F.md5((F.col("id") % 77).cast("string"))).alias("lk")
    stg = spark.range(2000).select(link, F.md5((F.col("id") % 11).cast("string")).alias("hk"), (F.col("id") % 7).alias("fk"), at, F.lit("S").alias("src"))
    new, eff = rv.load_link(stg, "lk", ["hk", "fk"], "load_dts", "src"), rv.load_eff_sat(stg, "lk", "hk", ["fk"], "load_dts", "src")
    for made in (new, eff):
        assert "unhex" in made._jdf.queryExecution().executedPlan().toString() and dict(made.dtypes)["lk"] == "string"
    first = {}
    for r in stg.orderBy("load_dts", "hk", "fk").collect():
        first.setdefault(r["lk"], (r["lk"], r["hk"], r["fk"], r["load_dts"], "S"))
    assert sorted(map(tuple, new.collect())) == sorted(first.values())
    assert rv.load_link(stg, "lk", ["hk", "fk"], "load_dts", "src", existing=new.localCheckpoint()).count() == 0

    stored = VersionedTable(spark, f"{tmp_path}/eff")
    for part in ("load_dts < timestamp_ntz '1970-01-01 12:00:00'", "load_dts >= timestamp_ntz '1970-01-01 06:00:00'"):
        stored.merge(rv.load_eff_sat(stg.where(part), "lk", "hk", ["fk"], "load_dts", "src", existing=stored.read()), ["hk", "start_date"])
    assert sorted(map(tuple, stored.read().collect())) == sorted(map(tuple, eff.collect()))


def test_elements_of_one_set_alone_are_no_prefix(spark):
    import numpy as np

    from vaultline.llm import near_dedup as nd

    draw = np.random.default_rng(3)
    common = draw.integers(1 << 40, 1 << 62, 40, dtype=np.uint64)
    sets = [np.sort(np.concatenate((common[:30], common[30 + k % 2 * 5 :][:5], draw.integers(1 << 40, 1 << 62, 25, dtype=np.uint64)))) for k in range(200)]
    nodes = spark.createDataFrame([(k, k, bytearray(x.tobytes())) for k, x in enumerate(sets)], "node long, label long, elements binary").repartition(7)
    shared = nd.recurring(nodes)
    assert shared[nd.place_of(common)].all() and shared.sum() < 60
    rows = nd.prefixes(nodes, nd.rare_first(nodes), 0.5, shared)
    assert 200 <= rows.count() < 2000  # 31 of 60 elements are rare enough, 25 of them of one set alone
    want = {(a, b) for a in range(200) for b in range(a) if len(np.intersect1d(sets[a], sets[b])) >= 0.4 * len(np.union1d(sets[a], sets[b]))}
    got = {tuple(sorted(r, reverse=True)) for r in nd.remaining_pairs(nodes, 0.4).collect()}
    assert want and want <= got
