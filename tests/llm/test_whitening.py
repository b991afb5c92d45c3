import numpy as np
import pytest
from pyspark.sql import functions as F

from vaultline.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, deviation string, component int, whitened string"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "x", "d", 1, "w") for i, v in zip(ids, vectors)], SCHEMA).repartition(3)


def exact(vectors, components=32):
    """By brute force: integers, then the whole covariance and its eigenvectors."""
    x = np.floor(64 * np.asarray(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return n, ((n * x - sums) ** 2).sum(axis=1), centred @ vectors / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def compare(rows, vectors, components=32):
    n, deviation, whitened, explained = exact(vectors, components)
    k = whitened.shape[1]
    got = np.zeros_like(whitened)
    assert len(rows) == n * k and {r["n"] for r in rows} == {n}
    for r in rows:
        assert r["deviation"] == deviation[r["vec_id"]] and abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9 and r["identity_error"] < 1e-9
        got[r["vec_id"], r["component"] - 1] = r["whitened"]
    sign = np.sign((got * whitened).sum(axis=0))
    assert np.abs(got * sign - whitened).max() < 1e-6


@pytest.mark.parametrize("kind", ["flat", "falling", "wide"])
def test_equals_brute_force(spark, kind):
    draw = np.random.default_rng(3)
    d = 96 if kind == "wide" else 64
    vectors = draw.standard_normal((700, d)) * (1 if kind == "flat" else 0.93 ** np.arange(d)) + 3
    compare(whitening.op12(table(spark, vectors)).collect(), vectors)


def test_fewer_dimensions_and_two_steps(spark, monkeypatch):
    monkeypatch.setattr(whitening, "DIRECT", 1)
    vectors = np.random.default_rng(4).standard_normal((300, 5)) * [9, 4, 3, 2, 1]
    compare(whitening.op12(table(spark, vectors)).collect(), vectors)


def test_rank_below_components(spark):
    draw = np.random.default_rng(5)
    vectors = np.repeat(draw.integers(-30, 30, (200, 10)), 6, axis=1)  # rank 10 of 60, exactly
    rows = whitening.op12(table(spark, vectors)).collect()
    assert {r["component"] for r in rows} == set(range(1, 11)) and len(rows) == 2000
    w = np.zeros((200, 10))
    for r in rows:
        w[r["vec_id"], r["component"] - 1] = r["whitened"]
    assert np.abs(w.T @ w / 200 - np.eye(10)).max() < 1e-9


def test_odd_rows(spark):
    draw = np.random.default_rng(6)
    good = draw.standard_normal((120, 6))
    bad = [None, [], [float("nan")] * 6, [1, 2, 3, None, 5, 6], [float("inf")] + [0] * 5, [-float("inf")] * 6, [1, 2, 3]]
    rows = whitening.op12(table(spark, [*good, *bad])).collect()
    compare(rows, good)
    twice = whitening.op12(table(spark, [*good, *good[:1], good[1]], [*range(120), 0, None])).collect()
    assert len(twice) == 122 * 6 and sum(r["vec_id"] is None for r in twice) == 6
    huge = whitening.op12(table(spark, [*good, [1e30, -1e30, 0, 0, 0, 0]])).collect()
    assert len(huge) == 121 * len({r["component"] for r in huge})
    assert {r["deviation"] is None for r in huge if r["vec_id"] == 120} == {True}


def test_nothing_varies(spark):
    for vectors in ([], [None, []], [[1, 2]], [[1, 2]] * 9):
        out = whitening.op12(table(spark, vectors))
        assert out.collect() == [] and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_query_on_the_whole_table(spark, sf):
    from vaultline.llm.queries import queries

    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").select("embedding").toPandas().embedding
    ids = [r[0] for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").select("vec_id").collect()]
    place = F.create_map(*(F.lit(x) for i, v in enumerate(ids) for x in (v, i)))
    compare(queries()["op12_embedding_whitening"](spark, sf).withColumn("vec_id", place[F.col("vec_id")]).collect(), np.stack(vectors))


def test_few_passes(spark):
    """A flat spectrum is the hardest; the filter needs some dozens of passes and certifies its vectors."""
    vectors = np.random.default_rng(3).standard_normal((700, 64))
    fitted = whitening.fit(whitening.integer_vectors(table(spark, vectors)).cache())
    assert fitted.passes < 80 and fitted.residual < 1e-12
