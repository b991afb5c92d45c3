"""Versioned tables and file layouts."""

import pytest
from pyspark.sql import functions as F

from vaultline.functions.search import below, lower_bound
from vaultline.sources import sinks
from vaultline.sources.versioned import Conflict, VersionedTable


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def made(spark, values, schema="k long, v string, y int"):
    return spark.createDataFrame(values, schema)


def test_two_merges_in_a_row(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t")
    assert t.read() is None and t.version() is None
    t.merge(made(spark, [(1, "a", 1), (2, "a", 1), (None, "n", 1)]), ["k"])
    t.merge(made(spark, [(2, "b", 1), (3, "b", 2)]), ["k"])
    t.merge(t.read().where("k = 3").withColumn("v", F.lit("c")), ["k"])  # computed from the table itself
    assert rows(t.read()) == [(1, "a", 1), (2, "b", 1), (3, "c", 2), (None, "n", 1)]
    assert rows(t.read(2)) == [(1, "a", 1), (2, "b", 1), (3, "b", 2), (None, "n", 1)] and t.read(9) is None
    assert t.read().schema == made(spark, []).schema


def test_failed_job_leaves_the_old_version(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t")
    t.merge(made(spark, [(1, "a", 1), (2, "a", 1)]), ["k"])
    broken = spark.range(200).repartition(4).select(F.col("id").alias("k"), F.when(F.col("id") < 199, "x").otherwise(F.raise_error(F.lit("lost"))).alias("v"), F.lit(1).alias("y"))
    with pytest.raises(Exception, match="lost"):
        t.merge(broken, ["k"])
    assert t.numbers() == [1] and rows(t.read()) == [(1, "a", 1), (2, "a", 1)]
    t.merge(made(spark, [(2, "b", 1)]), ["k"])
    assert rows(t.read()) == [(1, "a", 1), (2, "b", 1)]


def test_second_writer_of_a_version_fails(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t")
    t.replace(made(spark, [(1, "a", 1)]))
    other, delta = VersionedTable(spark, f"{tmp_path}/t"), made(spark, [(1, "late", 1)])
    write = other._write
    other._write = lambda df, keep, number: (t.merge(made(spark, [(1, "first", 1)]), ["k"]), write(df, keep, number))
    with pytest.raises(Conflict):
        other.merge(delta, ["k"])
    assert rows(t.read()) == [(1, "first", 1)] and t.numbers() == [1, 2]


def test_only_touched_partitions_are_rewritten(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t", ["y"])
    t.merge(made(spark, [(k, "a", y) for k in range(4) for y in (1, 2, None)]), ["k", "y"])
    before = set(t.version().folders)
    t.merge(made(spark, [(0, "b", 2), (9, "b", None), (7, "b", 3)]), ["k", "y"])
    after = set(t.version().folders)
    assert {f.split("/")[1] for f in before & after} == {"y=1"} and len(before) == 3 and len(after) == 4
    want = [(k, "b" if (k, y) == (0, 2) else "a", y) for k in range(4) for y in (1, 2, None)] + [(9, "b", None), (7, "b", 3)]
    assert rows(t.read()) == sorted(want, key=str)
    t.append(made(spark, [(5, "c", 2)]))
    t.merge(made(spark, [(5, "d", 2)]), ["k", "y"])
    assert rows(t.read().where("k = 5")) == [(5, "d", 2)] and t.read().count() == 15


def test_expiry_keeps_what_kept_versions_name(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t", ["y"])
    for k in range(4):
        t.merge(made(spark, [(1, f"v{k}", 1), (k, "x", 10 + k)]), ["k", "y"])
    old = t.read(3)
    gone = t.expire(keep=2)
    assert {f.split("/")[1] for f in gone} == {"y=1"} and len(gone) == 2
    assert t.numbers() == [3, 4] and t.read(1) is None
    assert rows(old.where("y = 1")) == [(1, "v2", 1)] and rows(t.read().where("y = 1")) == [(1, "v3", 1)] and t.read().count() == 5


def test_new_and_missing_columns(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t")
    t.append(made(spark, [(1, "a", 1)]))
    t.append(spark.createDataFrame([(2, 0.5)], "k long, z double"))
    assert rows(t.read()) == [(1, "a", 1, None), (2, None, None, 0.5)]
    t.merge(spark.createDataFrame([(1, 2.5)], "k long, z double"), ["k"])
    assert rows(t.read()) == [(1, None, None, 2.5), (2, None, None, 0.5)]
    t.replace(t.read().where("false"))
    assert t.read().collect() == [] and t.read().columns == ["k", "v", "y", "z"]


def test_materialise_merges_with_what_is_stored(spark, tmp_path):
    at = f"{tmp_path}/eff"
    sinks.materialise("eff_sat", made(spark, [(1, "open", 1), (2, "open", 1)]), at, keys=["k"])
    out = sinks.materialise("eff_sat", made(spark, [(2, "closed", 1), (3, "open", 1)]), at, keys=["k"])
    assert rows(out) == [(1, "open", 1), (2, "closed", 1), (3, "open", 1)]


def test_searches_equal_a_count(spark):
    edges = [1.0, 2.0, 2.5, 7.0, 9.0]
    df = spark.range(0, 24).select((F.col("id") / 2).alias("x")).union(spark.sql("SELECT CAST(NULL AS DOUBLE)"))
    got = df.select("x", below(F.col("x"), edges).alias("tree"), lower_bound(F.array(*map(F.lit, edges)), F.col("x")).alias("search"), lower_bound(F.array().cast("array<double>"), F.col("x")).alias("none")).collect()
    for r in got:
        n = sum(e < r["x"] for e in edges) if r["x"] is not None else 0
        assert r["tree"] == n and r["search"] == n and r["none"] == 0


def files_with(spark, path, column, value):
    """Files whose range of a column (by its rows) holds a value: those that a reader cannot skip."""
    ranges = spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    return ranges.where((F.col("lo") <= value) & (F.col("hi") >= value)).count(), ranges.count()


def test_curve_lets_readers_skip_files_by_each_key(spark, tmp_path):
    grid = spark.range(65_536).select(F.col("id").alias("i"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("a"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(50)).cast("double").alias("b"), F.concat(F.lit("n"), F.lpad(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(900)).cast("string"), 3, "0")).alias("c"))
    sinks.write_layout(grid, f"{tmp_path}/z", ["a", "b", "c"], parts=64)
    for column, value in (("a", 321), ("b", 17.0), ("c", "n444")):
        hit, n = files_with(spark, f"{tmp_path}/z", column, value)
        assert n >= 60 and hit <= 0.6 * n, (column, hit, n)
    sinks.write_layout(grid, f"{tmp_path}/s", ["a"], parts=64)
    assert files_with(spark, f"{tmp_path}/s", "b", 17.0)[0] >= 60  # a plain sort skips by its first key alone
    assert spark.read.parquet(f"{tmp_path}/z").exceptAll(grid).count() == 0


def test_partition_folders_are_skipped(spark, tmp_path):
    df = spark.range(5000).select("id", F.expr("date '2024-01-01' + cast(id % 5 as int)").alias("day"), (F.col("id") % 97).alias("a"), (F.col("id") % 89).alias("b"))
    out = sinks.write_layout(df, f"{tmp_path}/p", ["a", "b"], "day")
    one = out.where("day = date '2024-01-03'")
    assert all("day=2024-01-03" in f for f in one.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]) and one.count() == 1000
    assert "PartitionFilters: [isnotnull(day" in one._jdf.queryExecution().executedPlan().toString()
