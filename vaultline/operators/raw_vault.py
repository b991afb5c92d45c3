"""Raw-vault loads. Every loader takes staged rows and, when given, what is already stored, and returns the rows to add."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from vaultline.functions.bloom import bloom, maybe_in
from vaultline.functions.hashing import END_OF_TIME, GHOST_KEY, packed, unpacked
from vaultline.functions.running import STRETCH, dealt, neighbours
from vaultline.sources.versioned import COMPRESSION, VersionedTable

Stages = DataFrame | list[DataFrame]


def end_of_time() -> Column:
    return F.lit(END_OF_TIME).cast("timestamp_ntz")


def united(stages: Stages, columns: list[list[str]], names: list[str]) -> DataFrame:
    frames = stages if isinstance(stages, list) else [stages]
    out = None
    for df, own in zip(frames, columns * len(frames) if len(columns) == 1 else columns):
        one = df.select(*(F.col(c).alias(n) for c, n in zip(own, names)))
        out = one if out is None else out.unionByName(one)
    return out


def first_seen(rows: DataFrame, pk: str, order: list[str], rest: list[str]) -> DataFrame:
    """The earliest row per key by ``order`` and then the remaining columns: an aggregate, so map tasks combine first."""
    best = rows.groupBy(pk).agg(F.min(F.struct(*order, *rest)).alias("_first"))
    return best.select(pk, *(F.col(f"_first.{c}").alias(c) for c in [*rest, *order]))


def touched(existing: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Of the stored rows those whose key the batch may hold: a Bloom filter of the batch's keys is tested where history is scanned,
    so a small batch neither shuffles nor aggregates what it doesn't touch."""
    return maybe_in(existing, bloom(batch.select(key), key), key)


def absent(rows: DataFrame, existing: DataFrame | None, key: str, batch: DataFrame | None = None) -> DataFrame:
    """Rows whose key is not stored; with ``batch``, the rows' source, stored keys outside of it are left away first."""
    if existing is None:
        return rows
    stored = existing.select(key)
    stored = stored if batch is None else touched(stored, batch, key)
    if rows.schema[key].dataType != stored.schema[key].dataType:  # the rows are packed
        stored = packed(stored, [key])
    return rows.join(stored, key, "left_anti")


def load_hub(stages: Stages, pk: str, nk: list[str] | list[list[str]], ldts: str, src: str, existing: DataFrame | None = None) -> DataFrame:
    """New hub rows: pk, natural key columns, load date, source. With several stages, ``nk`` may have a list for each."""
    per_stage = nk if nk and isinstance(nk[0], list) else [nk]
    names = per_stage[0]
    rows = united(stages, [[pk, *own, ldts, src] for own in per_stage], [pk, *names, ldts, src])
    return absent(first_seen(rows.where(F.col(pk).isNotNull()), pk, [ldts, src], names), existing, pk, rows)


def load_link(stages: Stages, pk: str, fks: list[str] | list[list[str]], ldts: str, src: str, existing: DataFrame | None = None, roles: list[str] | None = None) -> DataFrame:
    """New link rows; rows without all their hub keys are left out. ``roles`` rename the keys, as for a link of a hub to itself."""
    per_stage = fks if fks and isinstance(fks[0], list) else [fks]
    names = roles or per_stage[0]
    rows = united(stages, [[pk, *own, ldts, src] for own in per_stage], [pk, *names, ldts, src]).dropna(subset=[pk, *names])
    keys = [pk, *names]
    first = first_seen(packed(rows, keys), pk, [ldts, src], names)
    return unpacked(absent(first, existing, pk, rows), rows, keys)


def load_same_as(pairs: DataFrame, pk: str, master: str, duplicate: str, ldts: str, src: str, existing: DataFrame | None = None) -> DataFrame:
    """A link of two keys of one hub: the master and its duplicate."""
    return load_link(pairs, pk, [master, duplicate], ldts, src, existing)


def one_per_load(rows: DataFrame, pk: str | list[str], ldts: str, diff: str) -> DataFrame:
    """At most one row per (key, load date): of ties, the greatest hashdiff."""
    key = [pk, ldts] if isinstance(pk, str) else [*pk, ldts]
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(diff)).alias("_row"))
    return best.select(*key, *(F.col(f"_row.{c}").alias(c) for c in rest))


def latest(stored: DataFrame, pk: str, ldts: str, diff: str) -> DataFrame:
    return stored.groupBy(pk).agg(F.max(ldts).alias("_ldts"), F.max_by(diff, ldts).alias("_diff"))


def by_key(rows: DataFrame, pk: str, ldts: str, stretches: int, combine: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """``combine`` (an aggregate by key and date, given the columns that stand for the key) of rows that are shuffled by their key, once:
    aggregates, windows and joins by key follow without another shuffle. With ``stretches`` above 1 a hot key's rows, combined in map
    tasks first, are dealt out by their dates, and ``_stretch`` is one of the columns."""
    if stretches <= 1:
        return combine(rows.repartition(pk), [pk])
    cut, key = dealt(rows, [pk], ldts, stretches), [pk, STRETCH]
    hot = combine(cut.where(F.col(STRETCH) > 0), key)
    return combine(cut.where(F.col(STRETCH) == 0).unionByName(hot).repartition(*key), key)


def load_sat(stg: DataFrame, pk: str, diff: str, payload: list[str], ldts: str, src: str, eff: str | None = None, existing: DataFrame | None = None, stretches: int = 1) -> DataFrame:
    """Rows whose hashdiff differs from the version just before, in the batch or stored; of stored history only the heads of keys that
    the batch may hold are aggregated. With ``stretches`` above 1 a key's many versions are dealt out over so many tasks."""
    columns = list(dict.fromkeys([pk, diff, *payload, *([eff] if eff else []), ldts, src]))
    batch = by_key(stg.select(*columns).where(F.col(pk).isNotNull()), pk, ldts, stretches, lambda rows, key: one_per_load(rows, key, ldts, diff))
    if existing is not None:
        batch = batch.join(latest(touched(existing, stg, pk), pk, ldts, diff), pk, "left").where(F.col("_ldts").isNull() | (F.col(ldts) > F.col("_ldts")))
    else:
        batch = batch.withColumn("_diff", F.lit(None).cast("string"))
    before = F.coalesce("_before", "_diff")
    changed = neighbours(batch, [pk], [ldts], {"_before": diff}, {}, stretches).where(~before.eqNullSafe(F.col(diff)))
    return changed.select(*columns)


def load_eff_sat(stg: DataFrame, pk: str, dfk: str, sfks: list[str], ldts: str, src: str, deleted: Column | None = None, existing: DataFrame | None = None, stretches: int = 1) -> DataFrame:
    """Intervals of each driving key's relationship: another relationship, or a delete, closes the one before.

    With ``existing``, the touched driving keys' open rows rejoin the batch; merge the result on (driving key, start_date). With
    ``stretches`` above 1 the dates of a driving key that very many events have are dealt out over so many tasks.
    """
    gone = F.lit(False) if deleted is None else F.coalesce(deleted, F.lit(False))
    events = stg.where(F.col(dfk).isNotNull()).select(pk, dfk, *sfks, F.col(ldts).alias("start_date"), src, gone.alias("_gone"))
    if existing is not None:
        still = existing.where(F.col("end_date") == end_of_time()).select(pk, dfk, *sfks, "start_date", src, F.lit(False).alias("_gone"))
        still = touched(still, events, dfk)
        if stretches > 1:
            still = still.join(events.select(dfk).distinct(), dfk, "left_semi")
        events = events.withColumn("_new", F.lit(True)).unionByName(still.withColumn("_new", F.lit(stretches > 1)))
    else:
        events = events.withColumn("_new", F.lit(True))
    row = ["_gone", pk, *sfks, src]

    def combine(rows: DataFrame, key: list[str]) -> DataFrame:
        best = rows.groupBy(*key, "start_date").agg(F.max(F.struct(*row)).alias("_row"), F.max("_new").alias("_new"))
        return best.select(*key, "start_date", *(F.col(f"_row.{c}").alias(c) for c in row), "_new")

    keys = [pk, dfk, *sfks]
    one = by_key(packed(events, keys), dfk, "start_date", stretches, combine)
    if existing is not None and stretches <= 1:  # the Bloom filter lets some keys through that the batch has not
        one = one.withColumn("_new", F.max("_new").over(Window.partitionBy(dfk))).where("_new")
    one = one.drop("_new")
    state = one.withColumn("_state", F.when(~F.col("_gone"), F.col(pk)))
    runs = neighbours(state, [dfk], ["start_date"], {"_before": "_state"}, {}, stretches).where(~F.col("_state").eqNullSafe(F.col("_before")))
    closed = neighbours(runs, [dfk], ["start_date"], {}, {"_until": "start_date"}, stretches).withColumn("end_date", F.coalesce("_until", end_of_time()))
    return unpacked(closed.where(~F.col("_gone")), events, keys).select(pk, dfk, *sfks, "start_date", "end_date", F.col("start_date").alias("effective_from"), src)


def with_ghost(df: DataFrame, pk: str, ldts: str | None = None) -> DataFrame:
    """The table with one row for the unknown member: the ghost key, nulls and the earliest date."""
    ghost = df.sparkSession.range(1).select(
        *(
            F.lit(GHOST_KEY).alias(f.name) if f.name == pk
            else F.lit("1900-01-01 00:00:00").cast(f.dataType).alias(f.name) if f.name == ldts
            else F.lit(None).cast(f.dataType).alias(f.name)
            for f in df.schema.fields
        )
    )
    return df.unionByName(ghost)


def no_ghost(df: DataFrame, pk: str) -> DataFrame:
    return df.where(F.col(pk) != GHOST_KEY)


def load_ma_sat(stg: DataFrame, pk: str, diff: str, payload: list[str], ldts: str, src: str, existing: DataFrame | None = None, stretches: int = 1) -> DataFrame:
    """A set of rows per (key, load date); the whole set is stored when it differs from the set before, in the batch or stored.

    With ``existing``, sets of dates up to a key's last stored one are known already and left out; of stored history only the heads of
    keys that the batch may hold are aggregated. With ``stretches`` above 1 a key's many dates are dealt out over so many tasks.
    """
    rows = stg.select(pk, diff, *payload, ldts, src).where(F.col(pk).isNotNull())
    held = list(dict.fromkeys([diff, *payload, src]))
    one = by_key(rows, pk, ldts, stretches, lambda r, key: r.dropDuplicates([*key, ldts, diff]))
    key = [c for c in (pk, STRETCH) if c in one.columns]
    sets = one.groupBy(*key, ldts).agg(F.collect_list(F.struct(*held)).alias("_set"))
    sets = sets.withColumn("set_hashdiff", F.md5(F.array_join(F.array_sort(F.transform("_set", lambda x: x[diff])), "||")))
    if existing is not None:
        heads = latest(touched(existing, stg, pk), pk, ldts, "set_hashdiff")
        sets = sets.join(heads, pk, "left").where(F.col("_ldts").isNull() | (F.col(ldts) > F.col("_ldts")))
    else:
        sets = sets.withColumn("_diff", F.lit(None).cast("string"))
    before = F.coalesce("_before", "_diff")
    changed = neighbours(sets, [pk], [ldts], {"_before": "set_hashdiff"}, {}, stretches).where(~before.eqNullSafe(F.col("set_hashdiff")))
    each = changed.select(pk, ldts, "set_hashdiff", F.explode("_set").alias("_one"))
    return each.select(pk, "set_hashdiff", *(F.col(f"_one.{c}").alias(c) for c in [diff, *payload]), ldts, F.col(f"_one.{src}").alias(src))


def load_status_sat(previous: DataFrame, current: DataFrame, pk: str, diff: str, at: Column) -> DataFrame:
    """I, U or D for every key whose presence or hashdiff changed from one full extract to the next."""
    old = previous.select(pk, F.col(diff).alias("_old"), F.lit(True).alias("_was"))
    new = current.select(pk, F.col(diff).alias("_new"), F.lit(True).alias("_is"))
    flag = F.when(F.col("_was").isNull(), "I").when(F.col("_is").isNull(), "D").when(F.col("_old") != F.col("_new"), "U")
    return old.join(new, pk, "full").select(pk, flag.alias("status"), at.alias("load_dts")).where("status is not null")


def load_record_tracking(stg: DataFrame, pk: str, ldts: str, batch_date: Column, days: int) -> DataFrame:
    """When each key was last seen, and whether that is within ``days`` of the batch."""
    seen = stg.where(F.col(pk).isNotNull()).groupBy(pk).agg(F.max(ldts).alias("last_seen"), F.count("*").alias("times_seen"))
    return seen.withColumn("is_active", F.datediff(batch_date, F.col("last_seen")) <= days)


@dataclass
class VaultSpec:
    """A vault: how to stage each source, loaders by entity name and kind (hub, link, sat, eff_sat), and the keys that merged entities have."""

    stages: dict[str, Callable[[SparkSession], DataFrame]]
    entities: list[tuple[str, str, Callable[[Mapping[str, DataFrame], DataFrame | None], DataFrame]]] = field(default_factory=list)
    merge_keys: dict[str, list[str]] = field(default_factory=dict)


ORDER = {"hub": 0, "link": 1, "sat": 2, "eff_sat": 3}


def load_vault(spark: SparkSession, spec: VaultSpec, existing: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Lazy rows to add for each entity, in dependency order. Nothing is kept between entities, so each that is written stages its
    source anew; ``run_vault`` stages once and writes."""
    staged = {name: make(spark) for name, make in spec.stages.items()}
    stored = existing or {}
    return {name: load(staged, stored.get(name)) for name, _, load in sorted(spec.entities, key=lambda e: ORDER[e[1]])}


class Staged(dict[str, DataFrame]):
    """Staged sources; those that failed raise their own error when asked for."""

    def __init__(self, frames: dict[str, DataFrame], errors: dict[str, Exception]):
        super().__init__(frames)
        self.errors = errors

    def __missing__(self, name: str) -> DataFrame:
        raise self.errors.get(name) or KeyError(name)


def side_by_side(spark: SparkSession, tasks: dict[str, Callable[[], int]], workers: int) -> dict[str, int | Exception]:
    """Each task's result or error; so many run at once, and one that fails stops no other."""

    def tried(task: Callable[[], int]) -> int | Exception:
        try:
            return task()
        except Exception as e:  # noqa: BLE001  the caller has it in the outcome
            return e

    with ThreadPoolExecutor(max(1, workers)) as pool:
        running = {name: pool.submit(inheritable_thread_target(spark)(tried), task) for name, task in tasks.items()}
        return {name: r.result() for name, r in running.items()}


def run_vault(spark: SparkSession, spec: VaultSpec, path: str, workers: int = 4) -> DataFrame:
    """Loads one batch into the versioned tables under ``path`` and returns entity, kind, status (OK or FAILED), n_rows and error.

    Every source is staged once, into files that all its entities read. Hubs come first, then links, satellites and effectivity
    satellites; the writes of one kind run side by side. Each entity becomes current by itself, by its pointer: one that fails keeps its
    version, the others go on, and the batch can be run again, since loaders leave out what is stored.
    """
    work = f"{path}/_staging/{uuid.uuid4().hex}"
    frames: dict[str, DataFrame] = {}

    def stage(name: str) -> int:
        df = spec.stages[name](spark)
        df.write.parquet(f"{work}/{name}", compression=COMPRESSION)
        frames[name] = spark.read.schema(df.schema).parquet(f"{work}/{name}")
        return 0

    def load(name: str, kind: str, loader: Callable[[Mapping[str, DataFrame], DataFrame | None], DataFrame]) -> int:
        target, seen = VersionedTable(spark, f"{path}/{name}"), Observation()
        rows = loader(staged, target.read()).observe(seen, F.count("*").alias("n"))
        target.merge(rows, spec.merge_keys[name]) if name in spec.merge_keys else target.append(rows)
        return int(seen.get["n"])

    failed = side_by_side(spark, {name: partial(stage, name) for name in spec.stages}, workers)
    staged = Staged(frames, {name: e for name, e in failed.items() if isinstance(e, Exception)})
    out = []
    for kind in sorted(ORDER, key=ORDER.__getitem__):
        own = [e for e in spec.entities if e[1] == kind]
        done = side_by_side(spark, {e[0]: partial(load, *e) for e in own}, workers)
        out += [(n, kind, "FAILED", None, str(r).split("\n")[0]) if isinstance(r, Exception) else (n, kind, "OK", r, None) for n, r in done.items()]
    at = spark._jvm.org.apache.hadoop.fs.Path(work)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return spark.createDataFrame(out, "entity string, kind string, status string, n_rows long, error string")
