"""Forms that read, shuffle or keep less than the plain ones, against these."""

import glob
import hashlib
import random
import shutil
import tempfile
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from vaultline.operators import profiling as pr
from vaultline.operators import similarity
from vaultline.plans import stats
from vaultline.streaming import streams

START = datetime(2024, 1, 1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- profiles


def test_merged_sketches_are_within_their_error(spark):
    df = spark.range(40_000).select(F.col("id").alias("key"), (F.col("id") % 7).cast("string").alias("few"), F.when(F.col("id") % 3 == 0, F.col("id") % 9000).alias("some"), F.array(F.col("id") % 50).alias("nested"), (F.col("id") % 4).cast("int").alias("day"))
    merged = {r["column_name"]: r for r in pr.merged_profile(pr.part_profiles(df, "day")).collect()}
    exact = {r["column_name"]: r for r in pr.profile(df.drop("day")).collect()}
    assert merged.keys() == exact.keys()
    for c, r in merged.items():
        assert (r["n_rows"], r["n_nulls"], r["null_rate"]) == (exact[c]["n_rows"], exact[c]["n_nulls"], exact[c]["null_rate"])
        assert abs(r["n_distinct"] - exact[c]["n_distinct"]) <= max(1, r["n_distinct_error"]) and r["n_distinct_error"] <= 0.02 * r["n_distinct"] + 1
    assert merged["key"]["is_likely_key"] and not merged["some"]["is_likely_key"] and merged["few"]["n_distinct"] == 7


def test_a_new_part_is_merged_and_not_recomputed(spark, tmp_path):
    df = spark.range(9000).select("id", (F.col("id") % 3000).alias("v"), (F.col("id") % 3).alias("day"))
    pr.part_profiles(df.where("day < 2"), "day").write.parquet(f"{tmp_path}/p")
    pr.part_profiles(df.where("day = 2"), "day").write.mode("append").parquet(f"{tmp_path}/p")
    got, exact = ({r["column_name"]: r for r in p.collect()} for p in (pr.merged_profile(spark.read.parquet(f"{tmp_path}/p")), pr.profile(df.drop("day"))))
    assert got.keys() == exact.keys() and all(r["n_rows"] == 9000 and abs(r["n_distinct"] - exact[c]["n_distinct"]) <= r["n_distinct_error"] for c, r in got.items())
    assert "Expand" not in plan(pr.part_profiles(df, "day"))


def test_least_values_of_each_task(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["", "b" * 300, None, "a", "é", "zz"]), rnd.randint(0, 40)) for _ in range(500)]
    got = {r["column_name"]: r["samples"] for r in pr.sample_values(spark.createDataFrame(rows, "a string, b int").repartition(7), ["a", "b"], 4).collect()}
    shown = {"<empty>" if a == "" else a[:200] for a, _ in rows if a is not None}
    assert got["a"] == sorted(shown, key=str.encode)[:4] and got["b"] == sorted({str(b) for _, b in rows})[:4]


def test_all_inclusions_equal_the_pairwise_ones(spark):
    rnd = random.Random(2)
    parent = spark.createDataFrame([(i, f"n{i % 20}", i / 2) for i in range(50)], "id int, name string, half double")
    child = spark.createDataFrame([(rnd.randint(0, 49), rnd.choice(["n1", "n2", None]), 99) for _ in range(80)], "ref long, tag string, other int")
    tables = {"p": parent, "c": child}
    got = {(r["child_table"], r["child_column"], r["parent_table"], r["parent_column"]): (r["child_values"], r["found"], r["included"]) for r in pr.inclusions(tables).collect()}
    for a, x in ((t, c) for t in tables for c in tables[t].columns):
        for b, y in ((t, c) for t in tables for c in tables[t].columns):
            kinds = {tables[a].schema[x].dataType.typeName(), tables[b].schema[y].dataType.typeName()}
            if (a, x) != (b, y) and len(kinds - {"integer", "long"}) in (0, len(kinds)) and (len(kinds) == 1 or kinds == {"integer", "long"}):
                r = pr.inclusion(tables[a], x, tables[b], y).first()
                assert got.get((a, x, b, y), (r["child_values"], 0, False)) == (r["child_values"], r["found"], r["included"]), (a, x, b, y)
    assert got["c", "ref", "p", "id"][2] and got["c", "tag", "p", "name"] == (2, 2, True) and ("p", "half", "p", "id") not in got


# ---- resampling


def number(digits, *parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:digits], 16)


def test_bootstrap_by_picks_and_by_weights(spark):
    rnd = random.Random(4)
    groups = {"small": [rnd.randint(0, 99) for _ in range(30)], "large": [rnd.randint(0, 99) for _ in range(stats.SMALL + 200)], "one": [5]}
    rows = [(g, float(v), i) for g, vs in groups.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "g string, v double, m int").repartition(5)
    got = {r["g"]: r for r in stats.bootstrap_ci(df, "g", "v", ["m"], iterations=40).collect()}
    for g, vs in groups.items():
        vs, n = sorted(vs), len(vs)
        means = []
        for k in range(40):
            u = [number(12, g, k, i, 42) for i in range(n)]
            if n <= stats.SMALL:
                means.append(sum(vs[x % n] for x in u) / n)
            else:
                w = [sum(x >= t for t in stats.POISSON) for x in u]
                means.append(sum(a * b for a, b in zip(vs, w)) / sum(w))
        assert got[g]["n"] == n and np.allclose([got[g]["low"], got[g]["high"]], np.quantile(means, [0.025, 0.975]), rtol=1e-9)


def test_weights_have_the_law_of_a_bootstrap(spark):
    """Mean and variance 1; and the interval of many values is that of the normal law."""
    w = spark.range(50_000).select(stats.poisson_weight(stats.drawn_number(12, F.col("id"))).alias("w")).agg(F.avg("w"), F.var_samp("w"), F.max("w")).first()
    assert abs(w[0] - 1) < 0.02 and abs(w[1] - 1) < 0.05 and w[2] <= 14
    values = np.random.default_rng(5).normal(10, 3, 4000)
    r = stats.bootstrap_ci(spark.createDataFrame([("g", float(v), i) for i, v in enumerate(values)], "g string, v double, m int"), "g", "v", ["m"], iterations=400).first()
    half = 1.96 * values.std() / 4000**0.5
    assert abs((r["high"] - r["low"]) / 2 / half - 1) < 0.15 and r["low"] < values.mean() < r["high"]


def test_resampling_joins_no_rows_with_draws(spark):
    df = spark.createDataFrame([("g", float(i), i) for i in range(60)], "g string, v double, m int")
    for out in (stats.bootstrap_ci(df, "g", "v", ["m"], 10), stats.permutation_test(df.withColumnRenamed("v", "d"), ["g"], iterations=10)):
        text = plan(out)
        windows = [line for line in text.splitlines() if "row_number()" in line]
        assert not windows and "g#" in text


def test_permutation_of_many_pairs(spark):
    rnd = random.Random(6)
    ds = [rnd.randint(-5, 7) for _ in range(50)]
    r = stats.permutation_test(spark.createDataFrame([("s", float(d)) for d in ds], "g string, d double").repartition(4), ["g"], "greater", 300).first()
    placed = sorted(ds)
    sums = [sum(d if number(4, "s", k, i, 42) % 2 == 0 else -d for i, d in enumerate(placed)) for k in range(300)]
    assert r["p_value"] == round((sum(s >= sum(ds) for s in sums) + 1) / 301, 6) and r["n"] == 50


# ---- vectors by inverted lists


def clustered(spark, n=3000, d=32, k=100):
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(k, d))
    return spark.createDataFrame([(i, (centres[i % k] + 0.15 * rnd.normal(size=d)).tolist()) for i in range(n)], "vec_id long, embedding array<double>").repartition(4)


def recall_and_share(base, asked, k, **options):
    exact = similarity.cosine_topk(base, asked, k).select("query_id", "neighbour")
    found = similarity.lists_topk(base, asked, k, **options)
    met = found.where("rank = 1").agg(F.sum("compared")).first()[0]
    return exact.intersect(found.select("query_id", "neighbour")).count() / exact.count(), met / (asked.count() * base.count())


def test_lists_prune_clustered_vectors(spark):
    base = clustered(spark)
    recall, share = recall_and_share(base, base.where("vec_id % 50 = 0"), 5)
    assert recall >= 0.9 and share < 0.1


def test_lists_find_neighbours_of_vectors_without_clusters(spark, sf):
    base = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    recall, share = recall_and_share(base, base.where("vec_id % 10 = 0"), 5)
    assert recall >= 0.9 and share <= 1


def test_all_probed_is_exact_and_every_row_is_listed(spark):
    base = clustered(spark, 500).unionByName(spark.createDataFrame([(900, [0.0] * 32), (901, None), (3, [1.0] * 32)], "vec_id long, embedding array<double>"))
    asked = base.where("vec_id % 50 = 3")
    index = similarity.fit_lists(base, 4)
    rows = similarity.listed(base, index)
    assert rows.count() == 501
    every = similarity.ListIndex(index.centroids, len(index.centroids), 1.0)
    exact = similarity.cosine_topk(base, asked, 4).select("query_id", "neighbour", "score")
    got = similarity.probe_topk(rows, asked, every, 4, limit=2000)
    assert got.count() == exact.count() and exact.exceptAll(got.select("query_id", "neighbour", "score")).count() == 0
    none = base.where("false")
    assert similarity.lists_topk(none, asked, 3).count() == 0 and similarity.lists_topk(base, none, 3).count() == 0


def test_unprobed_lists_are_not_read(spark, tmp_path):
    base = clustered(spark)
    index = similarity.fit_lists(base, 5)
    similarity.listed(base, index).write.partitionBy("list").parquet(f"{tmp_path}/index")
    out = similarity.probe_topk(spark.read.parquet(f"{tmp_path}/index").select("id", "unit", "list"), base.where("vec_id = 7"), index, 5)
    assert "PartitionFilters: [list#" in plan(out).replace("isnotnull(list", "list") and out.count() == 5


# ---- streams


@pytest.fixture
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


EVENTS = "key string, ts timestamp_ntz, hashdiff string"


def arrive(spark, folder, rows):
    at = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame([(k, None if h is None else START + timedelta(hours=h), v) for k, h, v in rows], EVENTS).coalesce(1).write.mode("overwrite").parquet(at)
    shutil.copy(glob.glob(f"{at}/part-*")[0], f"{folder}/{len(glob.glob(f'{folder}/*')):05d}.parquet")


def test_state_ends_after_silence(spark, rocksdb, tmp_path):
    source = tmp_path / "src"
    source.mkdir()
    spark.createDataFrame([], EVENTS)
    state = []
    batches = [
        [("a", 0, "x"), ("b", 0, "x"), ("a", 1, "x"), ("a", 2, "y"), (None, 1, "n"), ("z", None, "no time")],
        [("a", 5, "y"), ("c", 30, "x")],
        [("b", 40, "x"), ("c", 41, "x"), ("a", 3, "late")],  # b begins anew after 40 hours; a's row is before the watermark
        [("d", 90, "x")],
        [("d", 91, "x")],
    ]
    for rows in batches:
        arrive(spark, source, rows)
        changes = streams.stream_changes_expiring(streams.stream_bronze(spark, str(source), spark.createDataFrame([], EVENTS).schema), "key", "ts", "hashdiff", "1 hour", 24 * 3_600_000)
        q = streams.append_stream(changes, f"{tmp_path}/out", f"{tmp_path}/ckpt")
        q.awaitTermination()
        state.append([p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]][-1])
    got = sorted((r["key"] or "", int((r["ts"].replace(tzinfo=None) - START).total_seconds() // 3600), r["hashdiff"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("", 1, "n"), ("a", 0, "x"), ("a", 2, "y"), ("b", 0, "x"), ("b", 40, "x"), ("c", 30, "x"), ("d", 90, "x")]
    assert state[0] > 0 and state[-1] < max(state)  # keys that fell silent are forgotten


def test_split_stream_equals_the_batch_form_and_repeats_safely(spark, tmp_path):
    source = tmp_path / "src"
    source.mkdir()
    rnd = random.Random(9)
    batches = [[(f"k{b}-{i}", rnd.choice([None, rnd.randint(0, 100)]), "v") for i in range(30)] for b in range(4)]
    for rows in batches:
        arrive(spark, source, rows)
    stream = lambda: streams.stream_bronze(spark, str(source), spark.createDataFrame([], EVENTS).schema)
    streams.stream_split(stream(), "ts", f"{tmp_path}/out", f"{tmp_path}/c1").awaitTermination()

    def found():
        return {late: sorted(r["key"] for r in spark.read.parquet(f"{tmp_path}/out/{name}").collect()) for late, name in ((False, "new"), (True, "late"))}

    want, mark = {False: [], True: []}, None
    for rows in batches:
        for k, h, _ in rows:
            want[h is None or mark is not None and h <= mark].append(k)
        mark = max([h for _, h, _ in rows if h is not None] + ([] if mark is None else [mark]))
    assert found() == {late: sorted(keys) for late, keys in want.items()}
    streams.stream_split(stream(), "ts", f"{tmp_path}/out", f"{tmp_path}/c2").awaitTermination()  # every batch once more
    assert found() == {late: sorted(keys) for late, keys in want.items()}


def test_exact_profiles_group_single_values(spark):
    from vaultline.operators import profiling

    rows = [(0.0, "a", 1, None, b"\xff"), (-0.0, "", 1, None, b"\xfe"), (float("nan"), None, 2, None, None), (float("nan"), "a", None, None, b"\xff")]
    df = spark.createDataFrame(rows, "x double, t string, i int, none date, b binary").withColumn("at", F.timestamp_seconds(1_000_000 + F.col("i")))
    got = {r["column_name"]: (r["n_rows"], r["n_nulls"], r["n_distinct"]) for r in profiling.profile(df).collect()}
    want = df.agg(*(F.struct(F.count("*"), F.count("*") - F.count(c), F.countDistinct(c)).alias(c) for c in df.columns)).first().asDict()
    assert got == {c: tuple(v) for c, v in want.items()}
    assert {tuple(r)[1:4] for r in profiling.profile(df.where("false")).collect()} == {(0, 0, 0)}
    plan = profiling.profile(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan  # whose groups are as wide as the row
