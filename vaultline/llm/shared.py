"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: While a table is written: its shuffle files go when it ends, and batches for Python are bounded in bytes.
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode, where none is configured."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        jsc = context._jsc.sc()
        if jsc.getCheckpointDir().isEmpty():
            if not context.master.split("[")[0] == "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            import tempfile

            context.setCheckpointDir(tempfile.mkdtemp(prefix="vaultline-"))
        folder = jsc.getCheckpointDir().get()
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/vaultline-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet in the shared folder and reads it back.

    A lost executor then costs the tasks that were running and not the whole chain. The shuffle
    files of the write are dropped when it ends, since nothing reads them again.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession, n_bytes: int, per_part: int) -> int:
    """So many partitions that each holds about ``per_part`` bytes, at least the session's number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(n_bytes) // per_part))


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that the texts of each part hold about ``limit`` bytes (one text at least)."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
        if not len(sizes):
            continue
        part = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return ["" if t is None else t for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply, shift, xor)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class RangeHash:
    """64-bit hashes of any ranges of a symbol array, from one prefix sum.

    A range of at most ``BLOCK`` symbols is a polynomial modulo 2^64 behind a finaliser. Such polynomials of over a
    thousand terms have known collisions (Thue-Morse strings, whatever the base), so a longer range is hashed as the
    sequence of its blocks' finished hashes, again in blocks, until one is left.
    """

    BLOCK = 128
    BASES = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, symbols: np.ndarray, base: int = BASES[0]):
        n = len(symbols)
        self.base = base
        if base not in self._powers or len(self._powers[base][0]) < n + 1:
            size = 1 << int(n + 1).bit_length()
            steps = np.full(size + 1, base, np.uint64), np.full(size + 1, pow(base, -1, 1 << 64), np.uint64)
            for one in steps:
                one[0] = 1
            self._powers[base] = tuple(one.cumprod(dtype=np.uint64) for one in steps)
        self.inverse = self._powers[base][1]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * self._powers[base][0][:n], out=self.sums[1:])

    def short(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        raw = (self.sums[b] - self.sums[a]) * self.inverse[a]
        return mix(raw + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        long = np.flatnonzero(b - a > self.BLOCK)
        if not len(long):
            return self.short(a, b)
        out = self.short(a, np.minimum(b, a + self.BLOCK))
        n = -(-(b[long] - a[long]) // self.BLOCK)
        starts = np.repeat(a[long], n) + ragged(np.zeros(len(n), np.int64), n) * self.BLOCK
        blocks = self.short(starts, np.minimum(starts + self.BLOCK, np.repeat(b[long], n)))
        ends = np.cumsum(n)
        out[long] = mix(RangeHash(blocks, self.base).of(ends - n, ends) ^ mix((b[long] - a[long]).astype(np.uint64)))
        return out


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indexes starts[i], ..., starts[i] + lens[i] - 1 for every i, one after another."""
    total = int(lens.sum())
    ends = np.cumsum(lens)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lens), lens)


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` of the texts: their hashes, byte starts and ends in the
    joined UTF-8 buffer, and ``bounds`` (text i has words bounds[i] .. bounds[i + 1] - 1)."""
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(gap.astype(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    hashes = RangeHash(mix(data.astype(np.uint64) + np.uint64(1))).of(starts, ends)
    text_ends = np.cumsum(np.array([len(r) + 1 for r in raw], np.int64))
    bounds = np.concatenate(([0], np.searchsorted(starts, text_ends)))
    return hashes, starts, ends, bounds


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """The bytes of a text column, summed over all rows."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).cast("long")).first()[0]
