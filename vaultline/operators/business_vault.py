"""Business vault, star schema and history views over raw-vault tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vaultline.functions.hashing import GHOST_KEY, hashdiff, packed, unpacked
from vaultline.functions.running import neighbours
from vaultline.functions.search import lower_bound
from vaultline.operators.raw_vault import end_of_time, load_sat, no_ghost, touched

GHOST_DATE = "1900-01-01 00:00:00"
#: A satellite of a point-in-time table: name, rows, load-date column.
Sat = tuple[str, DataFrame, str]


def as_of_dates(spark: SparkSession, start: str, end: str, grain: str = "day", business_days: bool = False) -> DataFrame:
    """as_of_date from ``start`` to ``end``: each day, or the last day of each month."""
    if grain == "month":
        first = f"trunc(date '{start}', 'MM')"
        dates = spark.range(1).select(F.explode(F.expr(f"sequence({first}, date '{end}', interval 1 month)")).alias("m")).select(F.last_day("m").alias("d"))
    else:
        dates = spark.range(1).select(F.explode(F.expr(f"sequence(date '{start}', date '{end}', interval 1 day)")).alias("d"))
    if business_days:
        dates = dates.where(~F.dayofweek("d").isin(1, 7))
    return dates.select(F.col("d").cast("timestamp_ntz").alias("as_of_date"))


def pit(hub: DataFrame, spine: DataFrame, sats: list[Sat], pk: str, state: DataFrame | None = None) -> DataFrame:
    """For each hub key and date, each satellite's latest load date and key; ghost values where it has none yet.

    Versions of all satellites are one stream. A version finds the first of the spine's dates on or after it (binary search in the spine,
    which comes along as one array), of those that share key and date the latest counts, which map tasks combine, so neither many
    versions of a key nor many satellites add a shuffle; then the latest so far is carried from mark to mark, and each mark stands for the
    dates up to the next one, so what is sorted is marks and not keys x dates.

    ``state`` holds what earlier versions amount to: rows (pk, {name}_ldts) as of a date before the spine's first, as in ``pit_state``.
    """
    return pit_of_dates(pit_dates(hub, spine, sats, pk, state), sats, pk)


def pit_dates(hub: DataFrame, spine: DataFrame, sats: list[Sat], pk: str, state: DataFrame | None = None) -> DataFrame:
    """A point-in-time table in the form to store in folders of dates: a row for each key and date, with load dates that are null for satellites
    without a version. The satellites' keys follow from these, so that they are neither sorted by date nor written; ``pit_of_dates`` adds them."""
    days = F.slice("_days", F.col("_slot") + 1, F.col("_next") - F.col("_slot"))
    return marked(hub, spine, sats, pk, state).select(pk, F.explode(days).alias("as_of_date"), *(f"{n}_ldts" for n, _, _ in sats))


def marked(hub: DataFrame, spine: DataFrame, sats: list[Sat], pk: str, state: DataFrame | None = None) -> DataFrame:
    """pk, {name}_ldts, and the places ``_slot`` to before ``_next`` of the dates ``_days`` that they hold for. The key is shuffled as bytes."""
    names = [name for name, _, _ in sats]
    marks = hub.select(pk).withColumns({f"{n}_ldts": F.lit(None).cast("timestamp_ntz") for n in names}).withColumn("_hub", F.lit(1))
    for name, sat, ldts in sats:
        own = [F.col(ldts).cast("timestamp_ntz").alias(f"{n}_ldts") if n == name else F.lit(None).cast("timestamp_ntz").alias(f"{n}_ldts") for n in names]
        marks = marks.unionByName(sat.where(F.col(ldts).isNotNull()).select(pk, *own, F.lit(None).cast("int").alias("_hub")))
    if state is not None:
        known = [F.when(F.col(f"{n}_ldts") > F.lit(GHOST_DATE).cast("timestamp_ntz"), F.col(f"{n}_ldts")).alias(f"{n}_ldts") for n in names]
        marks = marks.unionByName(state.select(pk, *known, F.lit(0).alias("_hub")))
    days, texts, marks = spine.agg(F.array_sort(F.collect_set("as_of_date")).alias("_days")), marks, packed(marks, [pk])
    at = F.greatest(*(F.col(f"{n}_ldts") for n in names)) if len(names) > 1 else F.col(f"{names[0]}_ldts")
    slot = F.when(F.col("_hub") == 1, -1).when(F.col("_hub") == 0, 0).otherwise(lower_bound(F.col("_days"), at))
    placed = marks.crossJoin(F.broadcast(days)).withColumn("_slot", slot).where(F.col("_slot") < F.size("_days"))
    latest = placed.groupBy(pk, "_slot").agg(*(F.max(f"{n}_ldts").alias(f"{n}_ldts") for n in names))
    line = Window.partitionBy(pk).orderBy("_slot")
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    carried = latest.withColumns({f"{n}_ldts": F.max(f"{n}_ldts").over(so_far) for n in names} | {"_first": F.min("_slot").over(so_far), "_next": F.lead("_slot").over(line)})
    held = carried.where("_first = -1").crossJoin(F.broadcast(days)).withColumns({"_slot": F.greatest("_slot", F.lit(0)), "_next": F.coalesce("_next", F.size("_days"))})
    return unpacked(held.where("_slot < _next"), texts, [pk]).select(pk, *(f"{n}_ldts" for n in names), "_slot", "_next", "_days")


def pit_of_dates(rows: DataFrame, sats: list[Sat], pk: str) -> DataFrame:
    """The rows of ``pit`` from stored dates: load dates and keys of the satellites, with ghosts for those without a version."""
    ghost, own = F.lit(GHOST_DATE).cast("timestamp_ntz"), []
    for n, _, _ in sats:
        own += [F.coalesce(f"{n}_ldts", ghost).alias(f"{n}_ldts"), F.when(F.col(f"{n}_ldts").isNull(), GHOST_KEY).otherwise(F.col(pk)).alias(f"{n}_pk")]
    return rows.select(pk, "as_of_date", *own)


def pit_runs(hub: DataFrame, spine: DataFrame, sats: list[Sat], pk: str, state: DataFrame | None = None) -> DataFrame:
    """A point-in-time table in the form to store: a row for each run of dates (``from_date`` to ``until_date``) on which a key's load dates are the
    same, null for satellites without a version. A key has as many rows as marks, however many dates; ``pit_of_runs`` lays them out."""
    date = lambda place: F.element_at("_days", place)
    held = marked(hub, spine, sats, pk, state)
    return held.select(pk, date(F.col("_slot") + 1).alias("from_date"), date(F.col("_next")).alias("until_date"), *(f"{n}_ldts" for n, _, _ in sats))


def pit_of_runs(runs: DataFrame, spine: DataFrame, sats: list[Sat], pk: str) -> DataFrame:
    """The rows of ``pit`` from stored runs, on those of their spine's dates that ``spine`` has."""
    return pit_of_dates(runs.join(F.broadcast(spine), F.col("as_of_date").between(F.col("from_date"), F.col("until_date"))), sats, pk)


def runs_state(runs: DataFrame, at: str) -> DataFrame:
    """The snapshot that a next run carries forward: what stored runs say of one date."""
    day = F.lit(at).cast("timestamp_ntz")
    return runs.where((F.col("from_date") <= day) & (F.col("until_date") >= day))


def pit_state(pit_rows: DataFrame, at: str) -> DataFrame:
    """The snapshot that a next run carries forward: a stored point-in-time table's rows of one date."""
    return pit_rows.where(F.col("as_of_date") == F.lit(at).cast("timestamp_ntz"))


def pit_since(hub: DataFrame, spine: DataFrame, sats: list[Sat], pk: str, since: str, state: DataFrame | None = None, runs: bool = False, dates: bool = False) -> DataFrame:
    """The point-in-time rows (or ``runs`` or ``dates``, the forms to store) of dates after ``since``, to overwrite just their partitions.

    With ``state``, the snapshot of ``since``, satellites are read only after that date (a literal that reaches the scan); a version that
    was loaded late, with an older date than the snapshot, needs a run without it.
    """
    mark = F.lit(since).cast("timestamp_ntz")
    if state is not None:
        sats = [(name, sat.where(F.col(ldts) > mark), ldts) for name, sat, ldts in sats]
    return (pit_runs if runs else pit_dates if dates else pit)(hub, spine.where(F.col("as_of_date") > mark), sats, pk, state)


def active(eff_sat: DataFrame, as_of: Column | None = None) -> DataFrame:
    if as_of is None:
        return eff_sat.where(F.col("end_date") == end_of_time())
    return eff_sat.where((F.col("start_date") <= as_of) & (as_of < F.col("end_date")))


def bridge(hub: DataFrame, hub_pk: str, walk: list[tuple[DataFrame, str, str, DataFrame | None]], as_of: Column | None = None) -> DataFrame:
    """The hub's keys walked over links. A step is (link, link key, key to join from, effectivity satellite or None)."""
    out = hub.select(hub_pk)
    for link, link_pk, joint, eff in walk:
        own = link.select(*(c for c in link.columns if c == link_pk or c == joint or c not in out.columns))
        if eff is not None:
            held = active(eff, as_of).select(link_pk)
            own = touched(own, held, link_pk).join(held.distinct(), link_pk)  # a semi join would be moved below the filter of keys
        out = out.join(own, joint)
    return out


def latest_row(sat: DataFrame, pk: str, ldts: str, columns: list[str]) -> DataFrame:
    best = sat.groupBy(pk).agg(F.max_by(F.struct(*columns), F.col(ldts)).alias("_row"))
    return best.select(pk, *(F.col(f"_row.{c}").alias(c) for c in columns))


def dim(hub: DataFrame, pk: str, nk: list[str], sats: list[tuple[DataFrame, str, list[str]]]) -> DataFrame:
    """One row per business key with the current payload of each satellite (rows, load date, payload); keys alone without satellites."""
    out = hub.select(pk, *nk)
    for sat, ldts, payload in sats:
        out = out.join(latest_row(sat, pk, ldts, payload), pk, "left")
    return out


def dim_as_of(pit_rows: DataFrame, hub: DataFrame, pk: str, nk: list[str], sats: list[tuple[str, DataFrame, str, list[str]]]) -> DataFrame:
    """Dimension rows for every date of a point-in-time table: equi-joins on (key, load date)."""
    out = pit_rows.join(hub.select(pk, *nk), pk)
    for name, sat, ldts, payload in sats:
        own = sat.select(F.col(pk), F.col(ldts).alias(f"{name}_ldts"), *payload)
        out = out.join(own, [pk, f"{name}_ldts"], "left")
    return out


def fact(rows: DataFrame, dims: list[tuple[DataFrame, str]], grain: list[str], measures: dict[str, Column]) -> DataFrame:
    """Rows joined with dimensions, each once however often a self-link names it, aggregated to the grain."""
    seen: set[tuple[int, str]] = set()
    for d, key in dims:
        if (id(d), key) not in seen:
            seen.add((id(d), key))
            rows = rows.join(d, key)
    return rows.groupBy(*grain).agg(*(m.alias(n) for n, m in measures.items()))


def bv_sat(sat: DataFrame, pk: str, rules: dict[str, Column], ldts: str, src: str, existing: DataFrame | None = None) -> DataFrame:
    """Derived columns of a satellite with their own hashdiff, stored where they changed."""
    derived = sat.select(pk, ldts, src, *(r.alias(n) for n, r in rules.items())).withColumn("bv_hashdiff", hashdiff(list(rules)))
    return load_sat(derived, pk, "bv_hashdiff", list(rules), ldts, src, existing=existing)


def checked_rules(df: DataFrame, rules: dict[str, str]) -> dict[str, Column]:
    """User rules as SQL text; analysis fails here for a rule that names an unknown column."""
    for text in rules.values():
        df.select(F.expr(text)).schema  # noqa: B018
    return {n: F.expr(t) for n, t in rules.items()}


def scd2(sat: DataFrame, pk: str, payload: list[str], ldts: str, eff: str | None = None, deleted: Column | None = None, stretches: int = 1) -> DataFrame:
    """Versions with valid_from, valid_to, is_current; without ghosts. With ``stretches`` above 1 a key's many versions are dealt out over so many tasks."""
    start = eff or ldts
    rows = neighbours(no_ghost(sat, pk), [pk], list(dict.fromkeys([start, ldts])), {}, {"_until": start}, stretches)
    until = F.col("_until")
    return rows.select(pk, *payload, F.col(start).alias("valid_from"), F.coalesce(until, end_of_time()).alias("valid_to"), until.isNull().alias("is_current"), *([deleted.alias("is_deleted")] if deleted is not None else []))


def as_of(sat: DataFrame, pk: str, ldts: str, payload: list[str], at: Column) -> DataFrame:
    """Each key's version at a moment."""
    return latest_row(sat.where(F.col(ldts) <= at), pk, ldts, [ldts, *payload])


def as_of_each(sat: DataFrame, pk: str, ldts: str, payload: list[str], moments: dict[str, Column]) -> DataFrame:
    """``as_of`` several moments, each row with its moment's name ``at``: the satellite is read and aggregated once."""
    row = F.struct(ldts, *payload)
    latest = [F.max_by(F.when(F.col(ldts) <= at, row), F.when(F.col(ldts) <= at, F.col(ldts))).alias(f"_{i}") for i, at in enumerate(moments.values())]
    cells = [F.struct(F.col(f"_{i}").alias("_row"), F.lit(name).alias("at")) for i, name in enumerate(moments)]
    each = sat.groupBy(pk).agg(*latest).select(pk, F.inline(F.array(*cells))).where("_row is not null")
    return each.select(pk, *(F.col(f"_row.{c}").alias(c) for c in [ldts, *payload]), "at")


def current(sat: DataFrame, pk: str, ldts: str, payload: list[str], deleted: str | None = None) -> DataFrame:
    """Each key's latest version, unless that is a delete."""
    columns = [ldts, *payload, *([deleted] if deleted and deleted not in payload else [])]
    out = latest_row(sat, pk, ldts, columns)
    return out.where(~F.col(deleted)).select(pk, ldts, *payload) if deleted else out


def detect_rules(sats: DataFrame, rules: DataFrame) -> DataFrame:
    """The first payload column for each (hub, rule) whose name matches the rule's pattern.

    sats: parent_hub, payload; rules: rule, pattern (a list of some dozens).
    """
    columns = sats.select("parent_hub", F.posexplode("payload").alias("pos", "column_name"))
    found = columns.crossJoin(F.broadcast(rules)).where(F.expr("lower(column_name) rlike pattern"))
    return found.groupBy("parent_hub", "rule").agg(F.min(F.struct("pos", "column_name"))["column_name"].alias("column_name"))


def derive_pits(sats: DataFrame, least: int = 2) -> DataFrame:
    """Hubs with ``least`` satellites or more."""
    return sats.groupBy("system_id", "run_id", "parent_hub").agg(F.array_sort(F.collect_set("name")).alias("satellites")).where(F.size("satellites") >= least)


def derive_bridges(links: DataFrame, hubs: DataFrame, least: int = 2) -> DataFrame:
    """Links with ``least`` or more keys that belong to hubs; other keys are dropped."""
    keys = links.select("system_id", "run_id", "name", F.posexplode("fk_columns").alias("pos", "hash_key"))
    known = keys.join(hubs.select("system_id", "run_id", "hash_key", F.col("name").alias("hub")).distinct(), ["system_id", "run_id", "hash_key"])
    walk = F.transform(F.array_sort(F.collect_list(F.struct("pos", "hub"))), lambda x: x["hub"]).alias("hubs")
    return known.groupBy("system_id", "run_id", "name").agg(walk).where(F.size("hubs") >= least)
