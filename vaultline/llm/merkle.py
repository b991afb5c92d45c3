"""A Merkle manifest of a table: one binary tree per language, one over the languages, and each row's proof.

Every node covers an interval [lo, hi) of leaf ranks, and a node contains those whose intervals lie in its own. A tree is cut in
bands of 8 levels; a band's block holds at most 256 nodes and what lies above them up to the block's root, so a tree of n leaves
takes one shuffle for each factor of 256, each of a 256th of the rows before:

1. Rows are hashed where they are read, then ranked within their language by a range sort (a third of all rows under one doc_id is
   split like any others); only digests travel.
2. Containment by buckets: a node of rank r at the foot of a band lies in the block r >> 8, an equality of (language, block).
3. At each level the interval of the parent less the node's own leaves the sibling's interval, to the left or to the right, or nothing.
4. From the top down, a block hands the path above its root to the 256 nodes at its foot: no row meets its ancestors one by one.

Cases: a null field is hashed as ``-``; an empty text as ``0:``; null doc_ids come first; rows of one doc_id are ordered by their leaf,
identical rows in either order (their leaves are equal; each has its own place and proof); no rows give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultline.llm.shared import written

#: Levels to a band, so that a block has at most 2^LEVELS nodes at its foot.
LEVELS = 8
FIELDS = "doc_id", "source", "lang", "n_chars", "text"


def joined_hash(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 bytes' count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    return joined_hash(*(encoded(changed.get(f, F.col(f))) for f in FIELDS))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row."""
    return F.transform(F.array(value), use)[0]


def shift(how: str, value: Column, by: Column) -> Column:
    return F.call_function(f"shift{how}", value, by)


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` (with ``tree``) with ``rank`` (gapless from 0 within its tree, by ``order``, nulls first) and ``n``, the tree's rows."""
    spread = df.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange("tree", *order, "tie")
    spread = written(spread.withColumn("part", F.spark_partition_id()), name)
    own = Window.partitionBy("part", "tree").orderBy(*order, "tie")
    counts = spread.groupBy("part", "tree").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "tree", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"), F.sum("rows").over(Window.partitionBy("tree")).alias("n"))
    placed = spread.withColumn("own", F.row_number().over(own)).join(offsets, ["part", "tree"])
    return placed.select(*df.columns, (F.col("offset") + F.col("own") - 1).alias("rank"), "n")


def height(levels: int = LEVELS) -> Column:
    """How many levels a block has above its foot: all of a band where more than one block is left, else up to the root."""
    return F.when(F.col("n") > 1 << levels, levels).when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0)


def halved(nodes: Column) -> Column:
    """The digests one level up: of each two in a row, or of the last one alone."""
    pairs = F.sequence(F.lit(0), F.shiftright(F.size(nodes) - 1, 1))
    return F.transform(pairs, lambda j: joined_hash(F.get(nodes, 2 * j), F.coalesce(F.get(nodes, 2 * j + 1), F.lit(""))))


def tower(levels: int = LEVELS) -> Column:
    """A block's digests, one array a level, from its foot to its root."""
    steps = F.slice(F.array(*map(F.lit, range(levels))), F.lit(1), height(levels))
    foot = F.transform("members", lambda m: m["digest"])
    return F.aggregate(steps, F.array(foot), lambda acc, _: F.concat(acc, F.array(halved(F.element_at(acc, -1)))))


def siblings(tower: Column, i: Column, levels: int = LEVELS) -> Column:
    """Of the node at ``i`` in a block's foot and its ancestors: each one's sibling, to its left or right, or two empty strings."""
    n, one = F.size(F.get(tower, F.lit(0))), F.lit(1)

    def beside(k: Column) -> Column:
        lo, outer = shift("left", shift("right", i, k), k), shift("left", shift("right", i, k + 1), k + 1)
        hi, outer_hi = F.least(lo + shift("left", one, k), n), F.least(outer + shift("left", one, k + 1), n)
        at = lambda lo: F.get(F.get(tower, k), shift("right", lo, k))
        return F.struct(F.when(outer < lo, at(outer)).otherwise("").alias("left"), F.when(hi < outer_hi, at(hi)).otherwise("").alias("right"))

    return F.transform(F.slice(F.array(*map(F.lit, range(levels))), F.lit(1), height(levels)), beside)


def bands(leaves: DataFrame, rest: list[str], name: str, levels: int = LEVELS) -> list[DataFrame]:
    """leaves: tree, rank, n, digest and ``rest``. For each band from the leaves up its blocks: tree, block, n (nodes at the band's
    foot in the whole tree), members."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    out, rest = [], ["digest", *rest]
    while True:
        members = F.array_sort(F.collect_list(F.struct("rank", *rest))).alias("members")
        out.append(written(leaves.groupBy("tree", F.shiftright("rank", levels).alias("block")).agg(F.max("n").alias("n"), members), f"{name}-band"))
        if most <= 1 << levels:
            return out
        above = F.shiftright(F.col("n") - 1, levels) + 1
        leaves = out[-1].select("tree", F.col("block").alias("rank"), above.alias("n"), block_root(levels).alias("digest"))
        most, rest = -(-most // (1 << levels)), ["digest"]


def block_root(levels: int = LEVELS) -> Column:
    return F.element_at(F.element_at(tower(levels), -1), 1)


def roots(built: list[DataFrame], levels: int = LEVELS) -> DataFrame:
    return built[-1].select("tree", block_root(levels).alias("root"))


def nodes(built: list[DataFrame], levels: int = LEVELS) -> DataFrame:
    """Every node with its label: tree, level (0: leaves), lo, hi, digest. A node's ancestors are those that contain its interval."""
    out = None
    for b, blocks in enumerate(built):
        foot = F.shiftleft(F.lit(1).cast("long"), b * levels)
        tall = blocks.select("tree", "block", "n", F.posexplode(tower(levels)).alias("k", "digests")).where("k > 0" if b else "true")
        flat = tall.select("tree", "block", "n", "k", F.posexplode("digests").alias("j", "digest"))
        lo = (shift("left", F.col("block"), F.lit(levels)) + shift("left", F.col("j").cast("long"), F.col("k"))) * foot
        level = (F.col("k") + b * levels).alias("level")
        one = flat.select("tree", level, lo.alias("lo"), (lo + foot * shift("left", F.lit(1).cast("long"), F.col("k"))).alias("hi"), "digest")
        out = one if out is None else out.unionByName(one)
    leaves = built[0].groupBy("tree").agg(F.max("n").alias("leaves"))
    return out.join(leaves, "tree").select("tree", "level", "lo", F.least("hi", "leaves").alias("hi"), "digest")


def with_paths(built: list[DataFrame], above: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Each leaf's member columns with ``path``, its siblings from the leaf up. ``above``: tree, path (of the root onward) and further columns."""
    more = [c for c in above.columns if c not in ("tree", "path")]
    upper = above.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(built):
        numbered = F.transform("members", lambda m, i: F.struct(m.alias("member"), i.alias("i")))
        own = let(tower(levels), lambda t: F.transform(numbered, lambda m: F.struct(m["member"].alias("member"), siblings(t, m["i"], levels).alias("own"))))  # noqa: B023
        down = blocks.join(upper, ["tree", "block"]).select("tree", "path", *more, F.explode(own).alias("one"))
        down = down.select("tree", F.concat("one.own", "path").alias("path"), *more, "one.member")
        upper = down.select("tree", "path", *more, F.col("member.rank").alias("block"))
    return down.select("tree", "path", *more, "member.*")


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path lead to."""
    return F.aggregate(path, start, lambda acc, s: joined_hash(s["left"], acc, s["right"]))


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, lang, leaf, subroot, root, path (an array of (left, right) digests from the leaf to the root) and ``tampered_leaf``:
    the leaf of the row with 1 added to n_chars, where 7 divides the CRC-32 of doc_id."""
    number = docs.select(F.col("doc_id").cast("long"), "source", "lang", F.col("n_chars").cast("long"), "text")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, leaf(n_chars=F.col("n_chars") + 1))
    tree = F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-"))  # sorts nulls first
    leaves = ranked(number.select("doc_id", tree.alias("tree"), leaf().alias("digest"), tampered.alias("tampered_leaf")), ["doc_id", "digest"], "merkle-leaves")
    built = bands(leaves, ["doc_id", "tampered_leaf"], "merkle", levels)
    subroots = written(roots(built, levels), "merkle-subroots").select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("root").alias("digest"))
    top = bands(ranked(subroots, ["of"], "merkle-langs"), ["of"], "merkle-top", levels)
    start = roots(top, levels).withColumn("path", F.array().cast("array<struct<left:string,right:string>>"))
    above = with_paths(top, start, levels).select(F.col("of").alias("tree"), "path", "root", F.col("digest").alias("subroot"))
    lang = F.when(F.col("tree") != "-", F.expr("substring(tree, 2)")).alias("lang")
    return with_paths(built, above, levels).select("doc_id", lang, F.col("digest").alias("leaf"), "subroot", "root", "path", "tampered_leaf")


def op13(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    folded = manifest(docs, levels).withColumn("folded_root", fold(F.coalesce("tampered_leaf", "leaf"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
