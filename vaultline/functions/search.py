"""How many edges of a sorted list lie below a value, by binary search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def below(value: Column, edges: list[float]) -> Column:
    """The number of ``edges`` (sorted, some hundreds at most) less than ``value``, as a balanced tree of comparisons; 0 for null."""

    def part(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value > edges[mid], part(mid + 1, hi)).otherwise(part(lo, mid))

    return part(0, len(edges))


def lower_bound(edges: Column, value: Column) -> Column:
    """The same for edges in an array column of any length, which is halved step by step."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(edges) + 1)).cast("int"))

    def halve(at: Column, _: Column) -> Column:
        mid = F.shiftright(at["lo"] + at["hi"], 1)
        up = F.get(edges, mid) < value
        return F.when(at["lo"] >= at["hi"], at).otherwise(F.struct(F.when(up, mid + 1).otherwise(at["lo"]).alias("lo"), F.when(up, at["hi"]).otherwise(mid).alias("hi")))

    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(edges).alias("hi")), halve, lambda at: at["lo"])
