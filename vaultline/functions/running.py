"""Running sums of groups that may be very large."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultline.functions.search import below

STRETCHES = 64


def as_number(df: DataFrame, column: str) -> Column:
    kind, value = dict(df.dtypes)[column], F.col(column)
    return value.cast("double") if kind.startswith(("int", "bigint", "double", "float", "decimal")) else F.unix_micros(value.cast("timestamp")).cast("double")


def stretched(df: DataFrame, column: str, stretches: int = STRETCHES) -> DataFrame:
    """``df`` with ``_stretch``: between which of its quantiles a number or a time lies. Equal values are in one stretch; nulls in the first."""
    number = as_number(df, column)
    edges = df.agg(F.percentile_approx(number, [k / stretches for k in range(1, stretches)], 10_000)).first()[0] or []
    return df.withColumn("_stretch", below(number, sorted(set(edges))))


def running_sums(df: DataFrame, by: list[str], order: list[str], sums: dict[str, str], stretches: int = STRETCHES) -> DataFrame:
    """``df`` with the sum of each column so far (``sums``: new name to column) in its group, by ``order``.

    The first order column (a number or a time) is cut at its quantiles, so that a large group is sorted by many tasks, stretch by
    stretch; what earlier stretches add up to is few rows. Rows of one value of that column stay together; nulls come first.
    """
    cut = stretched(df, order[0], stretches)
    parts = cut.groupBy(*by, "_stretch").agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    before = Window.partitionBy(*by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*(F.col(c).alias(f"_of_{c}") for c in (*by, "_stretch")), *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in sums))
    own = Window.partitionBy(*by, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"_of_{c}")), by, F.col("_stretch") == F.col("_of__stretch"))
    both = cut.withColumns({n: F.sum(c).over(own) for n, c in sums.items()}).join(offsets, same)
    return both.select(*df.columns, *((F.col(n) + F.col(f"_before_{n}")).alias(n) for n in sums))


#: At most so many keys are dealt out, each of which holds at least such a share of the rows; the sketch that finds them tracks so many.
HOT_KEYS, TRACKED = 1000, 10_000
STRETCH = "_stretch"


def dealt(df: DataFrame, by: list[str], column: str, stretches: int) -> DataFrame:
    """``df`` with ``_stretch``: 0 for rows of keys (``by``) that one task can hold, else 1 + between which quantiles ``column`` lies.

    Hot keys hold a thousandth of all rows or more. A sketch of bounded size finds them (frequent items of the keys' hashes) in the
    pass that finds the quantiles, so nothing is shuffled for it; a key that is dealt out without need does no harm.
    """
    number, key = as_number(df, column), F.xxhash64(*by)
    edges = F.percentile_approx(number, [k / stretches for k in range(1, stretches)], 10_000)
    top = F.call_function("approx_top_k", key, F.lit(HOT_KEYS), F.lit(TRACKED))
    found = df.agg(edges.alias("edges"), top.alias("top"), F.count("*").alias("n")).first()
    hot = [t["item"] for t in found["top"] or [] if t["item"] is not None and t["count"] * HOT_KEYS >= found["n"]]
    return df.withColumn(STRETCH, F.when(key.isin(hot), below(number, sorted(set(found["edges"] or []))) + 1).otherwise(0) if hot else F.lit(0))


def neighbours(df: DataFrame, by: list[str], order: list[str], before: dict[str, str], after: dict[str, str], stretches: int = 1) -> DataFrame:
    """``df`` with columns of each group's row before and of the row after (``before`` and ``after``: new name to column), by ``order``, which
    has no ties within a group; null at the ends.

    With ``stretches`` above 1 a hot group is no single task: its rows are sorted stretch by stretch of the first order column. Of each
    stretch only its two outer rows meet those of the group's other stretches, some thousands at most, which are broadcast: other
    groups have no part in that. Rows that are ``dealt`` already keep their stretches.
    """
    own = Window.partitionBy(*by).orderBy(*order)
    if stretches <= 1:
        return df.withColumns({n: F.lag(c).over(own) for n, c in before.items()} | {n: F.lead(c).over(own) for n, c in after.items()})
    cut = df if STRETCH in df.columns else dealt(df, by, order[0], stretches)
    own = Window.partitionBy(*by, STRETCH).orderBy(*order)
    outer = lambda pick, columns: pick(F.struct(F.lit(0).alias("_"), *dict.fromkeys(columns.values())), F.struct(*order))
    ends = cut.where(F.col(STRETCH) > 0).groupBy(*by, STRETCH).agg(outer(F.max_by, before).alias("_last"), outer(F.min_by, after).alias("_first"))
    line = Window.partitionBy(*by).orderBy(STRETCH)
    linked = ends.select(*(F.col(c).alias(f"_of_{c}") for c in (*by, STRETCH)), F.lag("_last").over(line).alias("_last"), F.lead("_first").over(line).alias("_first"))
    near = cut.withColumns({f"_near_{n}": F.lag(F.struct(c)).over(own) for n, c in before.items()} | {f"_near_{n}": F.lead(F.struct(c)).over(own) for n, c in after.items()})
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"_of_{c}")), by, F.col(STRETCH) == F.col(f"_of_{STRETCH}"))
    both = near.join(F.broadcast(linked), same, "left")
    value = lambda n, c, end: F.when(F.col(f"_near_{n}").isNotNull(), F.col(f"_near_{n}")[c]).otherwise(F.col(end)[c]).alias(n)
    return both.select(*df.columns, *(value(n, c, "_last") for n, c in before.items()), *(value(n, c, "_first") for n, c in after.items()))
