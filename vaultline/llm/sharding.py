"""A uniform shuffle of rows into shards of exact sizes, by a drawn communication matrix.

1. Rows fall into source partitions by a hash; their sizes are counted.
2. How many rows each source sends to each shard is drawn from the multivariate hypergeometric law with
   both margins given: a source's row count and the shards' target sizes, which differ by one at most.
3. Each source is permuted by a seeded hash; consecutive stretches of the drawn lengths go to the shards.
4. Each shard is permuted anew: its rows are ordered by a second hash, cut in ranges of that hash
   so that no task holds a whole shard, and the ranges' offsets make the slots gapless.

Given the matrix, every arrangement of rows is as likely as any other, so the result is a uniform
shuffle while only counts (sources x shards) meet in one place. All work on rows is DataFrame code.

Cases: a null text has size 1 and checksum 0; rows with equal doc_ids are placed one by one; an empty table
gives no rows; null doc_ids hash with the text's checksum, so they spread too.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_SOURCE = 1 << 16
MOST_SOURCES = 1 << 12


def communication_matrix(sources: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows: sources; columns: how many of a source's rows each shard takes. Column sums differ by one at most."""
    total = sum(sources)
    left = np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)
    draw = np.random.default_rng(seed)
    matrix = np.zeros((len(sources), shards), np.int64)
    for i, size in enumerate(sources):
        matrix[i] = draw.multivariate_hypergeometric(left, size, method="marginals")
        left -= matrix[i]
    return matrix


def shuffled_shards(df: DataFrame, shards: int, key: list[str], seed: int = 7, rows_per_source: int = ROWS_PER_SOURCE) -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard); columns of these two names are replaced."""
    spark = df.sparkSession
    mark = "_"  # own columns begin so, and none of the table's
    while any(c.startswith(mark) for c in df.columns):
        mark += "_"
    source, at, edges, place, stretch, offset = (mark + n for n in ("source", "at", "limits", "rank", "stretch", "offset"))
    total = df.count()
    n_sources = max(1, min(MOST_SOURCES, -(-total // rows_per_source)))  # the matrix on the driver stays small
    rank = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), *key)
    placed = df.withColumn(source, F.pmod(rank("source"), F.lit(n_sources)).cast("int"))
    counts = dict(map(tuple, placed.groupBy(source).count().collect()))
    matrix = communication_matrix([counts.get(i, 0) for i in range(n_sources)], shards, seed)
    limits = spark.createDataFrame([(i, row) for i, row in enumerate(matrix.cumsum(axis=1).tolist())], f"{source} int, {edges} array<long>")
    local = Window.partitionBy(source).orderBy(rank("local"), *key)
    sent = (
        placed.withColumn(at, F.row_number().over(local))
        .join(limits, source)
        .withColumn("shard", F.size(F.filter(edges, lambda x: x < F.col(at))))
        .drop(source, at, edges)
    )
    # ranges of the second hash: [0, 2^32) cut in equal stretches
    stretches = max(1, -(-total // (shards * rows_per_source // 4)))
    sent = sent.withColumn(place, rank("slot")).withColumn(
        stretch, F.floor(F.shiftrightunsigned(place, 32) * F.lit(stretches) / F.lit(1 << 32)).cast("int")
    )
    sizes = sent.groupBy("shard", stretch).count()
    before = Window.partitionBy("shard").orderBy(stretch).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", stretch, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(offset))
    within = Window.partitionBy("shard", stretch).orderBy(place, *key)
    return (
        sent.withColumn(at, F.row_number().over(within))
        .join(offsets, ["shard", stretch])
        .withColumn("slot", (F.col(offset) + F.col(at) - 1).cast("long"))
        .drop(place, stretch, at, offset)
    )


def op4(docs: DataFrame, shards: int = 16) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    placed = shuffled_shards(rows, shards, ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard"))
