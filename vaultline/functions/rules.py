"""Derivation rules of business-vault satellites, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vaultline.functions.hashing import named

# States and their spellings.
IN_SERVICE = ["true", "1", "yes", "y", "in service", "in_service", "inservice", "active", "energized"]
OUT_OF_SERVICE = ["false", "0", "no", "n", "out of service", "out_of_service", "outofservice", "retired", "inactive"]


def ladder(column: str | Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """The label of the first step whose bound the value reaches; null stays null."""
    value = named(column)
    out = F.when(value.isNull(), F.lit(None))
    for bound, label in steps:
        out = out.when(value >= bound, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def voltage_tier(column: str | Column) -> Column:
    return ladder(column, [(110, "EHV"), (36, "HV"), (1, "MV")], "LV")


def vendor(column: str | Column) -> Column:
    return F.upper(F.trim(named(column)))


def state(column: str | Column) -> Column:
    text = F.lower(F.trim(named(column).cast("string")))
    return F.when(text.isin(IN_SERVICE), "in_service").when(text.isin(OUT_OF_SERVICE), "out_of_service").otherwise("unknown")


def age_years(column: str | Column, today: Column) -> Column:
    """Whole years of 365 days."""
    return F.floor(F.datediff(today, named(column)) / F.lit(365)).cast("long")


def age_band(column: str | Column, today: Column) -> Column:
    years = F.datediff(today, named(column)) / F.lit(365)
    return F.when(years.isNull(), None).when(years < 10, "new").when(years < 25, "mid").when(years < 50, "aged").otherwise("legacy")


def three_phase(column: str | Column) -> Column:
    """Whether a count of phases is three, or a code names three phases (ABC)."""
    text = F.trim(named(column).cast("string"))
    number = text.try_cast("int")
    return F.when(text.isNull(), None).when(number.isNotNull(), number == 3).otherwise(text.rlike("(?i)^[abc]{3}n?$"))


def severity(priority: str | Column) -> Column:
    level = F.substring(F.trim(named(priority).cast("string")), 1, 1).try_cast("int")
    return F.when(level <= 1, "CRITICAL").when(level == 2, "HIGH").when(level == 3, "MEDIUM").when(level >= 4, "LOW")


def aging(opened: str | Column, today: Column) -> Column:
    days = F.datediff(today, named(opened))
    return F.when(days.isNull(), None).when(days <= 7, "NEW").when(days <= 30, "RECENT").when(days <= 90, "AGED").otherwise("STALE")


def breached(opened: str | Column, priority: str | Column, today: Column) -> Column:
    """Open longer than its severity allows: 1, 3, 7 or 30 days."""
    band = severity(priority)
    allowed = F.when(band == "CRITICAL", 1).when(band == "HIGH", 3).when(band == "MEDIUM", 7).otherwise(30)
    return F.datediff(today, named(opened)) > allowed


def category(kind: str | Column, names: dict[str, str], otherwise: str = "other") -> Column:
    """Equipment category of a type, by a table of names (upper case)."""
    text = F.upper(F.trim(named(kind)))
    pairs = F.create_map(*(F.lit(x) for pair in sorted(names.items()) for x in pair))
    return F.when(text.isNull(), None).otherwise(F.coalesce(F.try_element_at(pairs, text), F.lit(otherwise)))


def lifecycle(status: str | Column) -> Column:
    code = F.upper(F.trim(named(status).cast("string")))
    return F.when(code == "O", "planned").when(code == "P", "in_progress").when(code == "F", "complete").otherwise("unknown")
