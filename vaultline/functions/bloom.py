"""Blocked Bloom filters of a key column, built and tested by DataFrame functions alone.

A filter is a table of ``blocks`` rows at most, each with 512 longs (4 KB), so its size is bounded whatever the keys are, and it can be
broadcast. With few bits a key it lets more rows through; it never holds back a row whose key was put in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 512
PROBES = 4
#: 4 MB; at 1.6 million keys about one other key in forty passes.
BLOCKS = 1024
#: Names that tables hardly have.
BLOCK, BITS = "_bloom_block", "_bloom_bits"


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def places(key: Column) -> list[Column]:
    """The bits of a block that a key sets."""
    return [F.pmod(F.xxhash64(F.lit(i), key), F.lit(64 * WORDS)).cast("int") for i in range(1, PROBES + 1)]


def bloom(keys: DataFrame, key: str, blocks: int = BLOCKS) -> DataFrame:
    """The filter of a column's values that are not null; map tasks combine words before the shuffle."""
    set_ = keys.where(F.col(key).isNotNull()).select(block_of(F.col(key), blocks).alias(BLOCK), F.explode(F.array(*places(F.col(key)))).alias("at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(63))
    words = set_.groupBy(BLOCK, F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    by_word = words.groupBy(BLOCK).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0).cast("long")))
    return by_word.select(BLOCK, filled.alias(BITS))


def maybe_in(rows: DataFrame, filter_: DataFrame, key: str, blocks: int = BLOCKS) -> DataFrame:
    """The rows whose key may be among the filter's. Null keys are left out, as they equal none."""
    hit = [F.call_function("shiftright", F.get(BITS, F.shiftright(at, 6)), at.bitwiseAND(63)).bitwiseAND(1) == 1 for at in places(F.col(key))]
    test = hit[0] & hit[1] & hit[2] & hit[3]
    return rows.join(F.broadcast(filter_), (block_of(F.col(key), blocks) == F.col(BLOCK)) & test).select(*rows.columns)
