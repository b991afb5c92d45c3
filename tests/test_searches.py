"""Searches and resampling whose pairs of rows stay in their tasks."""

import tracemalloc
from decimal import Decimal
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from vaultline.operators import similarity
from vaultline.plans import stats


def shuffled_rows(spark, df):
    """Rows that all stages of a run have written to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def total():
        stages = store.stageList(None, False, False, none, None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = total()
    df.write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(n for s, n in total().items() if s not in before)


def test_tokens_shared_by_all_make_no_pairs(spark):
    """2,000 names that share one token, 200 targets: 400,000 pairs, of which hardly any is shuffled."""
    names = spark.range(2000).select("id", F.concat(F.lit("hub_same_t"), F.col("id") % 500, F.lit("_"), F.col("id") % 11).alias("name"), (F.col("id") % 2).alias("kind"))
    asked = names.where("id % 10 = 0")
    found = similarity.lexical_topk(names, asked, 3, ["hub_"])
    assert shuffled_rows(spark, found) < 40_000
    rows = [(r["id"], r["name"], r["kind"], {t for t in r["name"][4:].split("_") if len(t) >= 2}) for r in names.collect()]
    want = set()
    for i, _, kind, tokens in rows:
        if i % 10 == 0:
            scored = sorted((-len(tokens & other), name, j) for j, name, k, other in rows if k == kind and j != i and tokens & other)[:3]
            want |= {(i, j, name, -s, n + 1) for n, (s, name, j) in enumerate(scored)}
    assert {tuple(r) for r in found.select("target_id", "example_id", "example", "score", "rank").collect()} == want
    blocks = similarity.lexical_topk(names, asked, 3, ["hub_"], limit=2000)
    assert {tuple(r) for r in blocks.select("target_id", "example_id", "example", "score", "rank").collect()} == want


def test_ids_may_be_texts(spark):
    names = spark.createDataFrame([("a", "hub_red_car", 1), ("b", "hub_red_bus", 1), ("b", "hub_red_bus", 1), ("c", None, 1), ("d", "hub_red_bus", None)], "id string, name string, kind int")
    assert [tuple(r)[:4] for r in similarity.lexical_topk(names, names.where("id = 'a'"), 4, ["hub_"]).collect()] == [("a", "b", "hub_red_bus", 1)]


def test_candidates_of_signs_stay_in_their_tasks(spark):
    draw = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(draw.normal(size=(3000, 64)))]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    asked = base.where("vec_id % 10 = 0")
    for tables, bits in ((20, 4), (4, 10)):
        found = similarity.lsh_topk(base, asked, 5, tables=tables, bits=bits)
        assert shuffled_rows(spark, found) < 3000 + 4 * 5 * 300 + 100
        units = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
        keys = similarity.signs(np.array(list(units.values())), tables, bits, 7)
        for q in (0, 990, 2990):
            near = [j for j in units if j != q and (keys[q] == keys[j]).any()]
            want = sorted((-round(float(units[q] @ units[j]), 6), j) for j in near)[:5]
            got = [(-r["score"], r["neighbour"]) for r in found.where(F.col("query_id") == q).orderBy("rank").collect()]
            assert [j for _, j in got] == [j for _, j in want]


def test_weights_of_texts_and_of_numbers_agree(spark):
    u = F.substring(F.md5(F.col("id").cast("string")), 1, 12)
    df = spark.range(50_000).select(stats.weight_of(u).alias("a"), stats.poisson_weight(stats.drawn_number(12, F.col("id"))).alias("b"))
    assert df.where("a <> b").count() == 0


def test_sums_of_large_groups_are_exact(spark):
    """Values at the ends of what they may be, of both signs."""
    v = F.when(F.col("id") % 2 == 0, F.lit(Decimal("999999999999.999999"))).otherwise(-F.lit(Decimal("999999999998.000001")))
    df = spark.range(1500).select(F.lit("g").alias("g"), v.alias("v"), "id")
    got = stats.bootstrap_ci(df, "g", "v", ["id"], 20).first()
    placed = [r["v"] for r in df.orderBy("v", "id").collect()]
    weights = spark.range(1500).crossJoin(spark.range(20).withColumnRenamed("id", "k")).select("k", "id", stats.poisson_weight(stats.drawn_number(12, F.lit("g"), F.col("k"), F.col("id"), F.lit(42))).alias("w"))
    sums, sizes = [Decimal(0)] * 20, [0] * 20
    for k, i, w in weights.collect():
        sums[k] += w * placed[i]
        sizes[k] += w
    means = [float(s) / n for s, n in zip(sums, sizes)]
    assert np.allclose((got["low"], got["high"]), np.percentile(means, (2.5, 97.5)), rtol=1e-12, atol=0)


def test_a_bridge_shuffles_active_links_only(spark):
    from vaultline.operators import business_vault as bv

    end = F.lit("9999-12-31").cast("timestamp_ntz")
    hub = spark.range(500).select(F.col("id").cast("string").alias("hk"))
    link = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("lk"), (F.col("id") % 500).cast("string").alias("hk"))
    eff = spark.range(20).select(F.md5((F.col("id") * 7).cast("string")).alias("lk"), F.lit("2000-01-01").cast("timestamp_ntz").alias("start_date"), end.alias("end_date"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = bv.bridge(hub, "hk", [(link, "lk", "hk", eff)])
        assert shuffled_rows(spark, found) < 3000
        assert found.count() == 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_dates_are_laid_out_after_marks_are_sorted(spark):
    from vaultline.operators import business_vault as bv

    hub = spark.range(30).select(F.col("id").cast("string").alias("hk"))
    at = F.timestamp_seconds(F.lit(946_684_800) + F.col("id") * 86_400 * 5).cast("timestamp_ntz")
    sat = spark.range(200).select((F.col("id") % 40).cast("string").alias("hk"), at.alias("t"))
    out = bv.pit(hub, bv.as_of_dates(spark, "2000-01-01", "2002-06-30"), [("a", sat, "t"), ("b", sat.where("hk % 2 = 0"), "t")], "hk")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode(slice") < plan.index("Window [")  # the window reads marks; dates come above it
    assert out.count() == 30 * 912
    want = out.alias("p").join(sat.alias("s"), F.expr("p.hk = s.hk and s.t <= p.as_of_date"), "left").groupBy("p.hk", "p.as_of_date", "a_ldts").agg(F.max("t").alias("t"))
    assert want.where("not (coalesce(t, timestamp_ntz '1900-01-01 00:00:00') <=> a_ldts)").count() == 0


def test_a_task_holds_a_bounded_matrix(spark):
    rnd, n, asked, k = np.random.default_rng(3), 8000, 700, 4
    rows = rnd.permuted(np.tile([0.5] * 4 + [0.0] * 4, (n, 1)), axis=1) * rnd.choice([-1, 1], (n, 8))  # exact scores, many of them equal
    vectors, ids = rows[:asked], np.arange(asked)
    batch = pa.record_batch([pa.array(np.arange(n)), pa.array(list(rows), pa.list_(pa.float64()))], ["id", "unit"])
    scores = np.round(vectors @ rows.T, 6)
    scores[ids, ids] = -np.inf
    want = {(q, int(i)): scores[q, i] for q in range(asked) for i in np.lexsort((np.arange(n), -scores[q]))[:k]}
    del scores
    index = similarity.ListIndex(rows[::40], 160, 1.0)
    probed = similarity.probed_lists(vectors, index)
    assert (probed.sum(axis=0) == 160).all()
    near = (rows @ index.centroids.T).argmax(axis=1).astype(np.int32)
    every = np.packbits(np.ones_like(probed), axis=1)
    runs = [
        (similarity._best_of(SimpleNamespace(value=(ids, vectors)), k), batch),
        (similarity._probed(SimpleNamespace(value=(ids, vectors, every)), k), batch.append_column("list", pa.array(near))),
    ]
    for run, own in runs:
        tracemalloc.start()
        (out,) = run(iter([own]))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        got = {(q, i): s for q, i, s in zip(*(out.column(c).to_pylist() for c in range(3)))}
        assert got == want
        assert peak < 80 << 20
