"""Structured Streaming forms of the loads."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_bronze(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """An append stream over a folder of Parquet files with a declared schema."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def append_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What a target holds; an empty table before its first batch."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def stream_vault(stream: DataFrame, load: Callable[[DataFrame, DataFrame], DataFrame], target: str, schema: T.StructType, checkpoint: str) -> StreamingQuery:
    """A vault load per micro-batch. ``load`` gets the batch and what is stored from earlier batches.

    Each batch writes a folder named for its id and overwrites it, so a batch that is run again leaves the same rows once.
    """
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])

    def one(batch: DataFrame, batch_id: int) -> None:
        before = stored(batch.sparkSession, target, full).where(F.col("batch") < batch_id).drop("batch")
        load(batch, before).select(*schema.fieldNames()).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def update_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A stream of updated aggregates: each micro-batch's changed rows in a folder named for its id (see ``latest_update``)."""

    def one(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return df.writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_update(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Each key's row of the last micro-batch that changed it."""
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("batch")).alias("_row"))
    return last.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest))


def timed(stream: DataFrame, ts: str, watermark: str) -> DataFrame:
    """The stream with a watermark; event time has to be a timestamp for that."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)


def stream_hub_keys(stream: DataFrame, key: str, ts: str, watermark: str = "1 day") -> DataFrame:
    """First-seen keys of a stream."""
    return timed(stream, ts, watermark).select(key, ts).dropDuplicatesWithinWatermark([key])


#: A change detector keeps the states of so many buckets of keys, each as one value.
BUCKETS = 1024


class Changes(StatefulProcessor):
    """Emits rows whose hashdiff differs from their key's one before; each key's last one is state.

    Keys come in buckets, and a bucket's keys share one state value: a micro-batch reads and writes as many values as there are buckets,
    however many keys it has. With ``ttl_ms``, a key that was silent for so long is forgotten, and a bucket without keys has no state.
    """

    def __init__(self, ttl_ms: int | None = None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "keys array<string>, hashdiffs array<string>, micros array<long>, due long")

    def load(self) -> tuple[dict[str | None, tuple[str | None, int]], int | None]:
        """Each key's last hashdiff and time, and when the bucket's timer is due."""
        found = self.state.get() if self.state.exists() else None
        return ({}, None) if found is None else ({k: (d, m) for k, d, m in zip(*found[:3])}, found[3])

    def save(self, last: dict[str | None, tuple[str | None, int]], due: int | None) -> None:
        """Stores the bucket; its timer, due at ``due`` until now, is moved to when the first of its keys ends."""
        end = None if self.ttl_ms is None or not last else min(m for _, m in last.values()) // 1000 + self.ttl_ms + 1
        if end != due:
            if due is not None:
                self.handle.deleteTimer(due)
            if end is not None:
                self.handle.registerTimer(end)
        if last:
            self.state.update((list(last), [d for d, _ in last.values()], [m for _, m in last.values()], end))
        else:
            self.state.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows), ignore_index=True)  # one bucket's rows of one micro-batch
        batch["code"] = pd.factorize(batch["key"], use_na_sentinel=False)[0]
        batch = batch.sort_values(["code", "ts", "hashdiff"], kind="stable")
        codes, diffs = batch["code"].to_numpy(), batch["hashdiff"].to_numpy(dtype=object)
        keys = [None if pd.isna(k) else k for k in batch["key"]]
        first = np.flatnonzero(np.diff(codes, prepend=-1))
        final = np.append(first[1:], len(codes)) - 1
        last, due = self.load()
        known = [last.get(keys[i]) for i in first]
        before = np.concatenate(([None], diffs[:-1]))
        before[first] = [None if k is None else k[0] for k in known]
        changed = np.array([d != b for d, b in zip(diffs, before)])
        micros = np.zeros(len(codes), np.int64)
        if self.ttl_ms is not None:
            micros = pd.to_datetime(batch["ts"], utc=True).astype("datetime64[us, UTC]").astype("int64").to_numpy()
            since = np.diff(micros, prepend=0)
            since[first] = [self.ttl_ms * 1000 if k is None else micros[i] - k[1] for i, k in zip(first, known)]
            changed |= since >= self.ttl_ms * 1000
        for i, k in zip(final, known):
            last[keys[i]] = (diffs[i], int(micros[i]) if k is None else max(int(micros[i]), k[1]))
        self.save(last, due)
        yield batch.loc[changed, ["key", "ts", "hashdiff"]]

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, (last, _) = expiredTimerInfo.getExpiryTimeInMs(), self.load()
        now = max(now, timerValues.getCurrentWatermarkInMs())
        self.save({k: v for k, v in last.items() if v[1] // 1000 + self.ttl_ms + 1 > now}, None)
        return iter(())

    def close(self) -> None:
        pass


def by_bucket(rows: DataFrame, buckets: int) -> GroupedData:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).groupBy("bucket")


def stream_changes(stream: DataFrame, key: str, ts: str, diff: str, buckets: int = BUCKETS) -> DataFrame:
    """(key, ts, hashdiff) of each change. Needs the RocksDB state store."""
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(ts).alias("ts"), F.col(diff).alias("hashdiff"))
    return by_bucket(rows, buckets).transformWithStateInPandas(Changes(), "key string, ts timestamp_ntz, hashdiff string", "append", "none")


def stream_changes_expiring(stream: DataFrame, key: str, ts: str, diff: str, watermark: str, ttl_ms: int, buckets: int = BUCKETS) -> DataFrame:
    """(key, ts, hashdiff) of each change, with a state bounded by the keys of the last ``ttl_ms`` before the watermark.

    A key's rows after so long a silence begin anew: the first one is a change even if it repeats the last. Rows without a time and rows
    older than the watermark are dropped; rows within it, but older than their key's last, are compared with that last one. Null keys are
    one key. Needs the RocksDB state store.
    """
    rows = timed(stream.select(F.col(key).cast("string").alias("key"), F.col(ts).alias("ts"), F.col(diff).alias("hashdiff")).where("ts is not null"), "ts", watermark)
    return by_bucket(rows, buckets).transformWithStateInPandas(Changes(ttl_ms), "key string, ts timestamp, hashdiff string", "append", "EventTime")


def stream_split(stream: DataFrame, ts: str, path: str, checkpoint: str) -> StreamingQuery:
    """Per micro-batch, rows newer than the mark into ``path/new`` and all others (late, or without a time) into ``path/late``.

    The mark is the greatest time of all batches before. Each batch writes folders named for its id, its mark last, and reads the marks
    of lesser ids alone, so a batch that is run again, after whatever part of it failed, leaves the same rows once.
    """
    schema = T.StructType([T.StructField("mark", stream.schema[ts].dataType), T.StructField("batch", T.LongType())])

    def one(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            mark = stored(batch.sparkSession, f"{path}/marks", schema).where(F.col("batch") < batch_id).agg(F.max("mark")).first()[0]
            fresh = F.col(ts).isNotNull() if mark is None else F.coalesce(F.col(ts) > F.lit(mark), F.lit(False))
            batch.where(fresh).write.mode("overwrite").parquet(f"{path}/new/batch={batch_id}")
            batch.where(~fresh).write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
            latest = batch.agg(F.greatest(F.max(ts), F.lit(mark).cast(stream.schema[ts].dataType)).alias("mark"))
            latest.write.mode("overwrite").parquet(f"{path}/marks/batch={batch_id}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def volume(events: DataFrame, window: Column, kind: Column, by: list[str] = ()) -> DataFrame:
    """Rows inserted, updated and deleted per window (``F.window`` or ``F.session_window``) of a table or a stream with a watermark."""
    n = lambda c: F.sum((kind == c).cast("int")).cast("long")
    out = events.groupBy(window.alias("w"), *by).agg(F.count("*").alias("n_rows"), n("I").alias("inserted"), n("U").alias("updated"), n("D").alias("deleted"))
    return out.select(*by, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_rows", "inserted", "updated", "deleted")
