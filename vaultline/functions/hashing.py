"""Hash keys and hashdiffs: normalised values joined in column order, then hashed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the vault conventions.
NULL_TOKEN = "^NULL^"
SEPARATOR = "||"
GHOST_KEY = "0" * 32
END_OF_TIME = "9999-12-31 00:00:00"


def named(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def norm(column: str | Column) -> Column:
    """Upper-cased, trimmed text of a value, with a token for null. Cast doubles to decimals first."""
    return F.coalesce(F.upper(F.trim(named(column).cast("string"))), F.lit(NULL_TOKEN))


def digest(text: Column, algorithm: str = "md5") -> Column:
    return F.md5(text) if algorithm == "md5" else F.sha2(text, 256)


def hashdiff(columns: list[str | Column], algorithm: str = "md5") -> Column:
    """A hash of all columns, never null."""
    return digest(F.concat_ws(SEPARATOR, *map(norm, columns)), algorithm)


def hash_key(columns: list[str | Column], algorithm: str = "md5") -> Column:
    """Like ``hashdiff``, but null where every column is null."""
    known = F.coalesce(*(named(c).cast("string") for c in columns)).isNotNull()
    return F.when(known, hashdiff(columns, algorithm))


def stable_id(columns: list[str | Column], length: int | None = None) -> Column:
    """A content id: trimmed, lower-case parts, joined by the unit separator, as SHA-1."""
    parts = [F.coalesce(F.lower(F.trim(named(c).cast("string"))), F.lit("")) for c in columns]
    full = F.sha1(F.concat_ws("\x1f", *parts))
    return full if length is None else F.substring(full, 1, length)


#: What md5, SHA-1 and SHA-256 look like.
DIGEST = "^([0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"


def pack(text: Column) -> Column:
    """A string as bytes, a digest as half as many: for shuffles. Distinct strings stay distinct, and two digests or two other strings
    keep their order."""
    return F.when(text.rlike(DIGEST), F.concat(F.lit(b"\x01"), F.unhex(text))).otherwise(F.concat(F.lit(b"\x00"), F.encode(text, "UTF-8")))


def unpack(data: Column) -> Column:
    rest = F.substring(data, 2, 2**31 - 1)
    return F.when(F.substring(data, 1, 1) == F.lit(b"\x01"), F.lower(F.hex(rest))).otherwise(F.decode(rest, "UTF-8"))


def packed(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with those of ``columns`` that are strings packed."""
    own = [c for c in dict.fromkeys(columns) if df.schema[c].dataType.typeName() == "string"]
    return df.withColumns({c: pack(F.col(c)) for c in own}) if own else df


def unpacked(df: DataFrame, like: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with those of ``columns`` unpacked that are strings in ``like``."""
    own = [c for c in dict.fromkeys(columns) if like.schema[c].dataType.typeName() == "string"]
    return df.withColumns({c: unpack(F.col(c)) for c in own}) if own else df
