"""PCA whitening of vectors by Chebyshev-filtered subspace iteration.

The covariance V is never formed. Every step multiplies it with a block Q of some more columns than components are wanted, in one
pass over the rows: the sum over all rows x of (x - mean) ((x - mean) Q), a sum of one small matrix a task. An iteration is

1. Rayleigh-Ritz: the eigenvectors of Q'VQ turn Q; the residuals |Vq - eq| of the wanted columns certify them;
2. a Chebyshev polynomial of V, by its three-term recurrence, one pass a degree: it stays within 1 on the unwanted part of the
   spectrum, from its lower end up to the block's least Ritz value, and grows fast above;
3. QR of the filtered block.

The lower end of the spectrum comes from a Lanczos vector that travels as one more column of the passes. What the driver holds is
dimension x block; rows stay in their tasks.

Cases: rows whose vector is null or holds a null, NaN or infinite entry are left out, as are empty vectors and those of another length
than most vectors have (of two such lengths the longer counts); entries beyond 2^25 either way are taken as 2^25. Null and repeated ids
keep their rows. Components whose eigenvalue is 0 (below 1e-12 of the first) can't be whitened and are left out; with fewer dimensions
than components there are as many components as dimensions; no rows give no rows. A deviation beyond the range of a long is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultline.llm.shared import SETTINGS, written

DEGREE = 8
#: Residual of a certified eigenpair, relative to the first eigenvalue; and what is accepted where rounding allows no less.
TOLERANCE, ACCEPTED = 1e-13, 1e-10
MOST_ITERATIONS = 200
#: Tasks whose sums the driver adds up by itself; those of more are added in a first step by tasks.
DIRECT = 64


def integer_vectors(df: DataFrame, column: str = "embedding", rest: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """The columns ``rest`` and ``x``: floor(64 c) + 1000000 of each entry c, of the rows that have a whole, finite vector."""
    bound = float(1 << 31)
    entry = lambda c: F.floor(F.greatest(F.least(64 * c.cast("double"), F.lit(bound)), F.lit(-bound))).cast("long") + 1_000_000
    finite = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.where(F.col(column).isNotNull() & (F.size(column) > 0) & finite).select(*rest, F.transform(column, entry).alias("x"))


def of_one_length(vectors: DataFrame) -> DataFrame:
    lengths = vectors.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return vectors.where(F.size("x") == (lengths["d"] if lengths else 0))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


class Covariance:
    """V of the rows of ``vectors``, known by its products with blocks of columns."""

    def __init__(self, vectors: DataFrame):
        self.x = vectors.select("x")
        sums = {r["pos"]: r for r in self.x.select(F.posexplode("x")).groupBy("pos").agg(F.sum("col").alias("s"), F.count("*").alias("n")).collect()}
        self.d = len(sums)
        self.n = sums[0]["n"] if sums else 0
        self.sums = np.array([sums[i]["s"] for i in range(self.d)], np.int64)
        self.tasks = self.x.rdd.getNumPartitions() if self.d else 0
        self.trace = 0.0
        self.passes = 0

    def times(self, q: np.ndarray) -> np.ndarray:
        d, mean, width = self.d, self.sums / self.n, q.shape[1]

        def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, squares = np.zeros((d, width)), 0.0
            for batch in batches:
                if batch.num_rows:
                    x = matrix(batch, d) - mean
                    total += x.T @ (x @ q)
                    squares += float(np.vdot(x, x))
            yield pa.record_batch([pa.array([np.append(total.ravel(), squares).tobytes()], pa.binary())], ["v"])

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(d * width + 1)
            for batch in batches:
                for one in batch.column(0).to_pylist():
                    total += np.frombuffer(one)
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["v"])

        parts = self.x.mapInArrow(products, "v binary")
        if self.tasks > DIRECT:
            parts = parts.repartition(int(self.tasks**0.5)).mapInArrow(added, "v binary")
        with small_batches(self.x.sparkSession):
            total = np.sum([np.frombuffer(r["v"]) for r in parts.collect()], axis=0)
        self.trace = total[-1] / self.n
        self.passes += 1
        return total[:-1].reshape(d, width) / self.n


class LowerEnd:
    """A Lanczos run of one vector, one step a pass: where the spectrum begins."""

    def __init__(self, d: int, draw: np.random.Generator):
        v = draw.standard_normal(d)
        self.basis, self.alpha, self.beta, self.low = [v / np.linalg.norm(v)], [], [], 0.0

    @property
    def column(self) -> np.ndarray:
        return self.basis[-1][:, None]

    def step(self, product: np.ndarray) -> None:
        if len(self.alpha) == len(self.basis):  # ended: the run spans an invariant space
            return
        v, known = self.basis[-1], np.array(self.basis)
        self.alpha.append(float(v @ product))
        rest = product - known.T @ (known @ product)
        rest -= known.T @ (known @ rest)
        size = float(np.linalg.norm(rest))
        values, vectors = np.linalg.eigh(np.diag(self.alpha) + np.diag(self.beta, 1) + np.diag(self.beta, -1))
        self.low = max(0.0, values[0] - 2 * size * abs(vectors[-1, 0]))
        if size > 1e-12 * max(abs(values[0]), abs(values[-1])) and len(self.basis) < len(v):
            self.beta.append(size)
            self.basis.append(rest / size)


@dataclass
class Whitening:
    n: int
    sums: np.ndarray
    #: One column a component, by falling eigenvalue.
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    #: The greatest residual |Vq - eq| of a component, relative to the first eigenvalue.
    residual: float
    passes: int


def filtered(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray, vq: np.ndarray, top: float, high: float, low: float, degree: int) -> np.ndarray:
    """A Chebyshev polynomial of V, small on [low, high], of the block q (vq: V q), scaled to 1 at ``top``."""
    half, centre = max((high - low) / 2, 1e-12 * top), (high + low) / 2
    first = s = half / (top - centre) if top > centre else 1.0
    before, now = q, (vq - centre * q) * (s / half)
    for _ in range(degree - 1):
        s_next = 1 / (2 / first - s)
        before, now = now, (times(now) - centre * now) * (2 * s_next / half) - (s * s_next) * before
        s = s_next
    return now


def fit(vectors: DataFrame, components: int = 32, degree: int = DEGREE, seed: int = 1) -> Whitening | None:
    """The leading eigenpairs of the covariance of ``vectors`` (with ``x``, all of one length); None where nothing varies."""
    v = Covariance(vectors)
    if not v.n:
        return None
    k = min(components, v.d)
    width = min(v.d, k + max(8, k // 2))
    draw = np.random.default_rng(seed)
    q, lower = np.linalg.qr(draw.standard_normal((v.d, width)))[0], LowerEnd(v.d, draw)

    def times(block: np.ndarray) -> np.ndarray:
        both = v.times(np.hstack([block, lower.column]))
        lower.step(both[:, -1])
        return both[:, :-1]

    best, worse = np.inf, 0
    for _ in range(MOST_ITERATIONS):
        vq = times(q)
        inner = q.T @ vq
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        if values[0] <= 0 or not v.trace:
            return None
        residual = float(np.linalg.norm(vq[:, :k] - q[:, :k] * values[:k], axis=0).max() / values[0])
        worse = worse + 1 if residual > best / 2 else 0
        best = min(best, residual)
        if residual <= TOLERANCE or residual <= ACCEPTED and worse > 1:
            break
        high = max(values[-1], 0.0)
        q = np.linalg.qr(filtered(times, q, vq, values[0], high, min(lower.low, high), degree))[0]
    else:
        raise ArithmeticError(f"residual {best:.2g} after {MOST_ITERATIONS} iterations")
    use = values[:k] > 1e-12 * values[0]
    q, vq, values = q[:, :k][:, use], vq[:, :k][:, use], values[:k][use]
    scale = np.sqrt(values)
    error = float(np.abs(q.T @ vq / np.outer(scale, scale) - np.eye(len(values))).max())
    return Whitening(v.n, v.sums, q, values, v.trace, error, residual, v.passes)


def whitened(vectors: DataFrame, fitted: Whitening) -> DataFrame:
    """``vectors`` with ``x`` replaced by ``deviation`` (sum of (n x - sums)^2) and ``whitened``, an array of a value for each component."""
    n, sums, d = fitted.n, fitted.sums, len(fitted.sums)
    turn, mean = fitted.components / np.sqrt(fitted.values), sums / n
    rest = [f for f in vectors.schema.fields if f.name != "x"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch, d)
            far = n * x - sums
            fits = (far.astype(float) ** 2).sum(axis=1) < 9.2e18
            deviation = pa.array((far * far).sum(axis=1), pa.int64(), mask=~fits)
            flat = pa.array(((x - mean) @ turn).ravel())
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * turn.shape[1])
            values = pa.ListArray.from_arrays(offsets, flat)
            yield pa.record_batch([*(batch.column(batch.schema.get_field_index(f.name)) for f in rest), deviation, values], [*(f.name for f in rest), "deviation", "whitened"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "deviation long", "whitened array<double>"])
    return vectors.mapInArrow(rows, schema)


def op12(embeddings: DataFrame, components: int = 32) -> DataFrame:
    vectors = written(of_one_length(integer_vectors(embeddings)), "vectors")
    fitted = fit(vectors, components)
    if fitted is None:
        return vectors.where("false").selectExpr("vec_id", "1 AS component", "0L AS n", "0L AS deviation", "0D AS whitened", "0D AS explained", "0D AS identity_error")
    share = F.array(*(F.lit(float(e)) for e in fitted.values / fitted.trace))
    each = whitened(vectors, fitted).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened", share[F.col("at")].alias("explained"), F.lit(fitted.identity_error).alias("identity_error"))
