"""Tables of Parquet files in versions: a version is written beside the last one and becomes current by a small file, written last.

Folders under a table's path:

* ``data/commit=<id>/[partition=value/]*.parquet``: what one commit wrote;
* ``versions/<n>.json``: the folders and the schema of version n. Readers take the greatest n; a file is made under another name and
  renamed, so it is there as a whole or not at all.

A write whose job fails leaves files that no version names and the last version as it was. A second writer of the same version fails. A
reader that has resolved a version keeps its files until ``expire`` drops that version. A merge rewrites only the partitions that its
rows fall into where the partition columns are among the keys, and the whole table otherwise.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vaultline.functions.hashing import packed, unpacked

COMMIT = "commit"
#: Digests as text take half the room with it.
COMPRESSION = "zstd"


def merge_on(target: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """The target with the delta's rows in place of those of equal keys; keys that hold nulls equal none."""
    kept = target.join(delta.select(*keys).distinct(), keys, "left_anti").select(*target.columns)
    return kept.unionByName(delta, allowMissingColumns=True)


class Conflict(RuntimeError):
    """Another writer has made this version."""


@dataclass(frozen=True)
class Version:
    number: int
    #: Folders relative to ``data``, with their commit.
    folders: tuple[str, ...]
    schema: StructType
    partition: tuple[str, ...]


class VersionedTable:
    """A table at ``path``; ``partition`` columns (for a date, derive it before) name folders that readers can skip."""

    def __init__(self, spark: SparkSession, path: str, partition: tuple[str, ...] | list[str] = ()):
        self.spark, self.path, self.partition = spark, path.rstrip("/"), tuple(partition)
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        at = self._path(f"{self.path}/versions")
        if not self._fs.exists(at):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self, number: int | None = None) -> Version | None:
        """A version by its number, or the current one."""
        known = self.numbers()
        if not known or number is not None and number not in known:
            return None
        number = known[-1] if number is None else number
        stream = self._fs.open(self._path(f"{self.path}/versions/{number}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        saved = json.loads(text)
        return Version(number, tuple(saved["folders"]), StructType.fromJson(saved["schema"]), tuple(saved["partition"]))

    def read(self, number: int | None = None) -> DataFrame | None:
        """The rows of a version (the current one by default); None where there is none."""
        v = self.version(number)
        if v is None:
            return None
        if not v.folders:
            return self.spark.createDataFrame([], v.schema)
        return self._of(v, v.folders)

    def _of(self, v: Version, folders: tuple[str, ...] | list[str]) -> DataFrame:
        files = self.spark.read.schema(v.schema).option("basePath", f"{self.path}/data")
        return files.parquet(*(f"{self.path}/data/{f}" for f in folders)).select(*v.schema.names)

    def _leaves(self, folder: str, depth: int) -> list[str]:
        if depth == 0:
            return [folder]
        below = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.path}/data/{folder}")) if f.isDirectory()]
        return [leaf for name in sorted(below) if "=" in name for leaf in self._leaves(f"{folder}/{name}", depth - 1)]

    def _swap(self, number: int, folders: list[str], schema: StructType) -> Version:
        made = Version(number, tuple(folders), schema, self.partition)
        final, draft = self._path(f"{self.path}/versions/{number}.json"), self._path(f"{self.path}/versions/.draft-{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps({"folders": folders, "schema": json.loads(schema.json()), "partition": list(self.partition)}).encode()))
        finally:
            stream.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise Conflict(f"{self.path} has a version {number} by another writer")
        return made

    def _write(self, df: DataFrame, keep: list[str], number: int) -> Version:
        written, schema = self._put(df, number, keep)
        return self._swap(number, [*(f for f in keep if f not in written), *written], schema)

    def _put(self, df: DataFrame, number: int, keep: list[str] = ()) -> tuple[list[str], StructType]:
        """Writes rows that no version names yet, into the commit of this number among ``keep`` if that has begun; its folders and schema."""
        begun = [f.split("/")[0] for f in keep if f.startswith(f"{COMMIT}={number}-")]
        commit, out = begun[0] if begun else f"{COMMIT}={number}-{uuid.uuid4().hex}", self._ordered(df)
        (out.write.partitionBy(*self.partition) if self.partition else out.write).mode("append").parquet(f"{self.path}/data/{commit}", compression=COMPRESSION)
        return self._leaves(commit, len(self.partition)), out.schema

    def _ordered(self, df: DataFrame) -> DataFrame:
        """Partition columns last, as Parquet readers have them."""
        return df.select(*(c for c in df.columns if c not in self.partition), *self.partition)

    def replace(self, df: DataFrame) -> Version:
        """A new version of just these rows; they may be read from the table itself."""
        v = self.version()
        return self._write(self._ordered(df), [], v.number + 1 if v else 1)

    def append(self, df: DataFrame) -> Version:
        """A new version with these rows added; new columns are null in the rows before, missing ones in these."""
        v = self.version()
        if v is None:
            return self.replace(df)
        df = self.spark.createDataFrame([], v.schema).unionByName(df, allowMissingColumns=True)
        added, schema = self._put(df, v.number + 1)
        return self._swap(v.number + 1, [*v.folders, *added], schema)

    def merge(self, delta: DataFrame, keys: list[str]) -> Version:
        """A new version in which the delta's rows stand for those of equal keys. The delta is computed against the version before,
        and may be read from it; of its own rows of one key all are kept. It is written first, so that it is computed once: stored rows
        are compared with what was written."""
        v = self.version()
        if v is None:
            return self.replace(delta)
        stored, keep = self.read(v.number), []
        empty = self.spark.createDataFrame([], v.schema).unionByName(self.spark.createDataFrame([], delta.schema), allowMissingColumns=True)
        added, schema = self._put(empty.unionByName(delta, allowMissingColumns=True), v.number + 1)
        if not added:
            return self._swap(v.number + 1, list(v.folders), schema)
        new = self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*(f"{self.path}/data/{f}" for f in added))
        if self.partition and set(self.partition) <= set(keys):
            own = {f.split("/", 1)[1] for f in added}
            keep = [f for f in v.folders if f.split("/", 1)[1] not in own]
            old = [f for f in v.folders if f.split("/", 1)[1] in own]
            if not old:
                return self._swap(v.number + 1, [*keep, *added], schema)
            stored = self._of(v, old)
        moved = packed(stored, stored.columns).join(packed(new.select(*keys), keys).distinct(), keys, "left_anti")
        kept = unpacked(moved, stored, stored.columns).select(*stored.columns)
        return self._write(self._ordered(empty.unionByName(kept, allowMissingColumns=True)), [*keep, *added], v.number + 1)

    def expire(self, keep: int = 2) -> list[str]:
        """Drops all but the last ``keep`` versions, and the folders that no kept version names; returns these."""
        known = self.numbers()
        old, kept = known[:-keep], known[-keep:]
        used = {f for n in kept for f in self.version(n).folders}
        gone = sorted({f for n in old for f in self.version(n).folders} - used)
        for n in old:
            self._fs.delete(self._path(f"{self.path}/versions/{n}.json"), False)
        for f in gone:
            self._fs.delete(self._path(f"{self.path}/data/{f}"), True)
        return gone
