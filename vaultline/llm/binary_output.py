"""Token-id files with Elias-Fano document boundaries.

Each shard is two files in a shared folder. ``ids-<shard>.bin`` holds the ids of its documents one after
another, little-endian, in two bytes where the vocabulary allows it and else four.
``docs-<shard>.ef`` holds two Elias-Fano sequences: where each document ends and what its doc_id is.
A sequence of n values below u takes about n * (2 + log2(u / n)) bits: low bits are packed, high bits
stand in unary, and the position of every 256th one bit is kept so that ``select`` reads one short
stretch. Shards are ranges of doc_id, so files in name order are documents in doc_id order.

Cases: null doc_ids sort first; rows with equal doc_ids stay separate documents in any order; a null or
empty text gives the end id alone; an empty table gives no files. A task writes under a name of its
own and renames, so a repeated task leaves the same files.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from vaultline.llm.bpe import encoded_batches, encoder
from vaultline.llm.shared import new_path, parts, text_bytes

EVERY = 256


class EliasFano:
    """A non-decreasing sequence of integers from 0 up."""

    HEAD = struct.Struct("<QQB")

    def __init__(self, n: int, top: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.top, self.low_bits, self.low, self.high, self.samples = n, top, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, ((top + 1) // max(n, 1)).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, top, low_bits, low, np.packbits(bits, bitorder="little"), ones[::EVERY].astype(np.uint64))

    def to_bytes(self) -> bytes:
        body = [self.low.tobytes(), self.high.tobytes(), self.samples.astype("<u8").tobytes()]
        return self.HEAD.pack(self.n, self.top, self.low_bits) + b"".join(struct.pack("<Q", len(b)) + b for b in body)

    @classmethod
    def from_bytes(cls, raw: bytes, at: int = 0) -> tuple[EliasFano, int]:
        n, top, low_bits = cls.HEAD.unpack_from(raw, at)
        at += cls.HEAD.size
        body = []
        for kind in (np.uint8, np.uint8, np.dtype("<u8")):
            (size,) = struct.unpack_from("<Q", raw, at)
            body.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at + 8))
            at += 8 + size
        return cls(n, top, low_bits, *body), at

    def select(self, first: int, last: int) -> np.ndarray:
        """Values ``first`` to ``last - 1``."""
        if first >= last:
            return np.empty(0, np.int64)
        begin = int(self.samples[first // EVERY])
        end = int(self.samples[(last - 1) // EVERY + 1]) if (last - 1) // EVERY + 1 < len(self.samples) else len(self.high) * 8
        bits = np.unpackbits(self.high[begin // 8 : -(-end // 8)], bitorder="little")
        ones = np.flatnonzero(bits[begin % 8 :]) + begin
        skip = first - first // EVERY * EVERY
        high = ones[skip : skip + last - first] - np.arange(first, last)
        if not self.low_bits:
            return high
        from_bit, to_bit = first * self.low_bits, last * self.low_bits
        bits = np.unpackbits(self.low[from_bit // 8 : -(-to_bit // 8)], bitorder="little")[from_bit % 8 :]
        low = bits[: to_bit - from_bit].reshape(-1, self.low_bits).astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))
        return (high << self.low_bits) | low

    def __getitem__(self, i: int) -> int:
        return int(self.select(i, i + 1)[0])


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}" if folder.startswith("/") else folder.replace("file:/", "file:///", 1))


def id_type(tokenizer: str, end_id: int) -> str:
    return "<u2" if max(encoder(tokenizer).vocab.size - 1, end_id) < 1 << 16 else "<u4"


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int, shard_bytes: int = 32 << 20) -> list[tuple[int, int, int]]:
    """Writes the files; returns a (shard, documents, ids) row for each shard, a list as long as the list of files."""
    spark = docs.sparkSession
    n = parts(spark, text_bytes(docs), shard_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = opened(folder)
        shard, own = TaskContext.get().partitionId(), uuid.uuid4().hex
        lens: list[np.ndarray] = []
        doc_ids: list[np.ndarray] = []
        nulls = 0
        kind = np.dtype(id_type(tokenizer, end_id))
        out = None
        for batch, ids in encoded_batches(batches, tokenizer):
            if out is None:
                files.create_dir(root, recursive=True)
                out = files.open_output_stream(f"{root}/_{own}.bin")
            column = batch.column(0).cast(pa.int64())
            nulls += column.null_count
            doc_ids.append(column.drop_null().to_numpy())
            sizes = np.array([len(x) + 1 for x in ids], np.int64)
            flat = np.full(int(sizes.sum()), end_id, kind)
            keep = np.ones(len(flat), bool)
            keep[np.cumsum(sizes) - 1] = False
            flat[keep] = np.concatenate(ids)
            out.write(flat.tobytes())
            lens.append(sizes)
        if out is None:
            return
        out.close()
        ends, keys = np.cumsum(np.concatenate(lens)), np.concatenate(doc_ids)
        base = int(keys[0]) if len(keys) else 0
        index = struct.pack("<QqB", nulls, base, kind.itemsize) + EliasFano.of(ends).to_bytes() + EliasFano.of(keys - base).to_bytes()
        with files.open_output_stream(f"{root}/_{own}.ef") as f:
            f.write(index)
        for name, suffix in (("ids", "bin"), ("docs", "ef")):
            files.move(f"{root}/_{own}.{suffix}", f"{root}/{name}-{shard:06d}.{suffix}")
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "docs": pa.array([len(ends)], pa.int64()), "ids": pa.array([int(ends[-1])], pa.int64())})

    ranged = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    return sorted(map(tuple, ranged.mapInArrow(run, "shard int, docs long, ids long").collect()))


def read_token_files(spark: SparkSession, folder: str, shards: list[tuple[int, int, int]], step: int = 4096) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read from the files."""
    starts, at = [], 0
    for shard, _, ids in shards:
        starts.append((shard, at))
        at += ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = opened(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with files.open_input_file(f"{root}/docs-{row['shard']:06d}.ef") as f:
                    raw = f.read()
                nulls, base, width = struct.unpack_from("<QqB", raw)
                ends, at = EliasFano.from_bytes(raw, struct.calcsize("<QqB"))
                keys, _ = EliasFano.from_bytes(raw, at)
                with files.open_input_file(f"{root}/ids-{row['shard']:06d}.bin") as f:
                    for first in range(0, ends.n, step):
                        last = min(first + step, ends.n)
                        stop = ends.select(first, last)
                        begin = np.concatenate(([ends[first - 1] if first else 0], stop[:-1]))
                        ids = np.frombuffer(f.read(int(stop[-1] - begin[0]) * width), f"<u{width}").astype("<u4")
                        cuts = (begin - begin[0]).tolist(), (stop - begin[0]).tolist()
                        known = keys.select(max(first - nulls, 0), max(last - nulls, 0)) + base
                        doc_ids = [None] * (last - first - len(known)) + known.tolist()
                        columns = [
                            pa.array(doc_ids, pa.int64()),
                            pa.array(begin + row["start"], pa.int64()),
                            pa.array(stop - begin, pa.int64()),
                            pa.array([zlib.crc32(ids[a:b]) for a, b in zip(*cuts)], pa.int64()),
                        ]
                        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    shards_df = spark.createDataFrame(starts, "shard int, start long").repartition(max(len(starts), 1), "shard")
    return shards_df.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10(docs: DataFrame, tokenizer: str) -> DataFrame:
    folder = new_path(docs.sparkSession, "tokens")
    return read_token_files(docs.sparkSession, folder, write_token_files(docs, tokenizer, folder, end_id=2))
