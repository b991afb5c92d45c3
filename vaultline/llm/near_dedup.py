"""MinHash near-duplicate groups with dart signatures.

A document is the multiset of its five-word shingles: a shingle that occurs n times has weight n (``weighted=False``: 1). Every
shingle owns, per coordinate, an endless strip of weight times rank, where darts fall as a Poisson process that only the shingle
decides, cell by cell: units of weight, and ranks that double. A document looks at the darts inside its own weights up to a rank
at which each coordinate has one almost surely, about t (ln t + 4) darts in all whatever its size, and each coordinate keeps its
earliest dart. Two documents keep the same dart with a probability that is their weighted Jaccard similarity. Coordinates are
joined band by band, and every candidate is verified on the 64-bit hashes of its shingles.

1. Documents with equal multisets become one *node*, so groups of copies cost one row.
2. In a bucket of at most ``small`` nodes all pairs are candidates. In a larger one, its *pivot* (the node that meets the most
   others over all large buckets, so near the centre of its family) meets every node. Verified pairs are links; components of
   links are classes.
3. Large buckets whose nodes are still in several components are *contested*. Their nodes are compared across components by
   prefixes: two sets that are similar enough share one of their few rarest elements, and their parities (each element flips
   one of 512 bits) differ in no more bits than the sets may differ in elements. Pairs that do not are ruled out exactly,
   inside the join, and all others are verified. No pair of a bucket is left out, and a family of copies is not compared
   pairwise, as its copies are in one component by then.

Bands: 20 of 5 coordinates; a pair of similarity 0.8 shares no bucket with probability (1 - 0.8^5)^20 = 0.0004.

Cases: documents of one to four words are one shingle; null and empty texts have none, and each is a class of its own; a null
doc_id has a null class; rows that share a doc_id but not a text are classed each by its own text; ties take the least doc_id;
repeated rows are copies; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultline.llm.components import components
from vaultline.llm.shared import RangeHash, mix, sliced, texts_of, words_of, written

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 5
SMALL = 32
COMMON = 1 << 17
#: Places of the map of elements that recur (1 MB), and the pieces in which tasks send theirs.
PLACES, PIECES = 1 << 23, 64
FINEST = 13
PARITY = 8


def shingles(texts: list[str], size: int = SHINGLE, weighted: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Elements of all texts, sorted within each, and the index of the text that each belongs to. With ``weighted``, a shingle
    that occurs n times is n elements: one for each unit of its weight."""
    hashes, _, _, bounds = words_of(texts)
    counts = np.diff(bounds)
    first = np.arange(len(hashes))
    owner = np.repeat(np.arange(len(texts)), counts)
    left = bounds[1:][owner] - first
    start = (left >= size) | ((first == bounds[:-1][owner]) & (counts[owner] < size))
    first, owner = first[start], owner[start]
    grams = RangeHash(hashes).of(first, first + np.minimum(left[start], size))
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    if not weighted:
        return grams[new], owner[new]
    begin = np.flatnonzero(new)
    nth = np.arange(len(grams)) - begin[np.cumsum(new) - 1]
    grams = np.where(nth > 0, mix(grams + nth.astype(np.uint64)), grams)
    order = np.lexsort((grams, owner))
    return grams[order], owner[order]


@lru_cache(maxsize=64)
def poisson_limits(mean: float) -> np.ndarray:
    """P(N <= k) for k = 0, 1, ... until it is 1 to double precision."""
    top = int(mean + 12 * np.sqrt(mean) + 24)
    k = np.arange(1, top)
    return np.cumsum(np.exp(np.concatenate(([-mean], -mean + np.cumsum(np.log(mean) - np.log(k))))))


def unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def darts(elements: np.ndarray, reach: np.ndarray, level: int, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Darts of one cell of every element up to its ``reach``: index of the element, rank and the dart's 64 bits."""
    low, high = (0.0 if level == 0 else 2.0 ** (level - 1 - FINEST)), 2.0 ** (level - FINEST)
    salt = mix(np.array([level + 1], np.uint64))[0]
    cell = mix(elements ^ salt)
    number = np.searchsorted(poisson_limits(t * (high - low)), unit(cell), side="right")
    some = np.flatnonzero(number)
    index = np.repeat(some, number[some])
    nth = np.arange(len(index)) - np.repeat(np.cumsum(number[some]) - number[some], number[some])
    dart = mix(cell[index] + (nth + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    rank = low + (high - low) * unit(mix(dart ^ np.uint64(0x5851F42D4C957F2D)))
    ok = rank <= reach[index]
    return index[ok], rank[ok], dart[ok]


def signatures(elements: np.ndarray, owner: np.ndarray, n: int, t: int = BANDS * ROWS) -> np.ndarray:
    """An n x t matrix: the earliest dart of each coordinate; zeros for texts without elements."""
    out = np.zeros((n, t), np.uint64)
    size = np.bincount(owner, minlength=n)
    todo = np.flatnonzero(size)
    spread = np.log(t) + 4.0
    while len(todo):
        reach = np.zeros(n)
        reach[todo] = spread / size[todo]
        mine = np.flatnonzero(reach[owner] > 0)
        found = []
        level = 0
        while len(mine):
            index, rank, dart = darts(elements[mine], reach[owner[mine]], level, t)
            found.append((owner[mine[index]], rank, dart))
            mine = mine[reach[owner[mine]] > 2.0 ** (level - FINEST)]
            level += 1
        text, rank, dart = (np.concatenate(x) for x in zip(*found))
        slot = text * t + (dart >> np.uint64(20)).astype(np.int64) % t
        order = np.lexsort((dart, rank, slot))
        slot, dart = slot[order], dart[order]
        head = np.append(True, slot[1:] != slot[:-1]) if len(slot) else np.empty(0, bool)
        filled = np.zeros(n * t, bool)
        filled[slot[head]] = True
        full = filled.reshape(n, t).all(axis=1)
        values = np.zeros(n * t, np.uint64)
        values[slot[head]] = dart[head]
        done = todo[full[todo]]
        out[done] = values.reshape(n, t)[done]
        todo = todo[~full[todo]]
        spread *= 2  # a coordinate is empty: those documents look twice as far
    return out


def band_hashes(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n, t = signature.shape
    out = np.zeros((n, t // rows), np.uint64)
    for k in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + signature[:, k::rows])
    return out.view(np.int64)


SIGNED = "doc_id long, text_hash long, size int, set_a long, set_b long, bands array<long>"
SET = ["set_a", "set_b", "size"]
PARITIES = [f"parity_{k}" for k in range(PARITY)]


def set_hashes(elements: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of each text's elements, whatever their order."""
    out = []
    for salt in (1, 2):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(elements + np.uint64(salt)), dtype=np.uint64)))
        out.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return out


def signed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE, weighted: bool = True) -> DataFrame:
    """Per document: a hash of its text, its number of elements, two hashes of their set, and its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = texts_of(batch)
            n = len(texts)
            elements, owner = shingles(texts, size, weighted)
            bounds = np.searchsorted(owner, np.arange(n + 1))
            banded = band_hashes(signatures(elements, owner, n, bands * rows), rows)[np.diff(bounds) > 0]
            offsets = np.concatenate(([0], np.cumsum(np.where(np.diff(bounds) > 0, bands, 0)))).astype(np.int32)
            columns = [batch.column(0), batch.column(2), pa.array(np.diff(bounds), pa.int32()), *map(pa.array, set_hashes(elements, bounds))]
            columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(banded.ravel())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "size", "set_a", "set_b", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, SIGNED)


def distinct_sets(some: DataFrame) -> DataFrame:
    """A node for each distinct set: ``first``, the least doc_id that has it, the hash of a text of it, its bands, and ``node``:
    ``first``, or a hash where one doc_id is the first of several sets."""
    least = some.groupBy(*SET).agg(F.min(F.struct("doc_id", "text_hash")).alias("x"), F.first("bands").alias("bands"))
    sets = written(least.select(*SET, F.col("x.doc_id").alias("first"), F.col("x.text_hash").alias("text_hash"), "bands"), "sets")
    heads = sets.groupBy("first").agg(F.min(F.struct("set_a", "set_b")).alias("head"))
    own = F.struct("set_a", "set_b") == F.col("head")
    return sets.join(heads, "first").withColumn("node", F.when(own, F.col("first")).otherwise(F.xxhash64("first", "set_a", "set_b"))).drop("head")


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """Members (key, q) of the buckets of two or more nodes, with the bucket's size ``n``."""
    spread = nodes.select("node", "size", F.posexplode("bands"))
    rows = spread.select(F.xxhash64("pos", "col").alias("key"), F.struct("node", "size").alias("q"))
    return rows.join(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")


def ordered_pairs(df: DataFrame, similarity: float) -> DataFrame:
    """Distinct (a, b), a < b, of columns p, q; sizes that alone rule the similarity out are left away."""
    fits = F.least("p.size", "q.size") >= F.lit(similarity) * F.greatest("p.size", "q.size") - 1e-6
    return df.where(fits & (F.col("p.node") != F.col("q.node"))).select(F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b")).distinct()


def first_pairs(shared: DataFrame, small: int, similarity: float) -> DataFrame:
    """All pairs of small buckets; in large ones, the pivot against all nodes."""
    few = shared.where(F.col("n") <= small).select("key", "q")
    within = few.withColumnRenamed("q", "p").join(few, "key").where("p.node < q.node")
    large = shared.where(F.col("n") > small).withColumn("node", F.col("q.node"))
    weighed = large.join(large.groupBy("node").agg(F.sum("n").alias("meets")), "node")
    pivots = weighed.groupBy("key").agg(F.max_by("q", F.struct("meets", F.xxhash64("node"))).alias("p"))
    across = large.join(pivots, "key")
    return ordered_pairs(within.select("p", "q").unionByName(across.select("p", "q")), similarity)


def elements_of(docs: DataFrame, asked: DataFrame, size: int, weighted: bool) -> DataFrame:
    """node and its elements (eight bytes each, sorted) for the nodes ``asked`` (node, first, text_hash and the hashes of the set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of this task: a text that very many rows repeat under one doc_id is sent once
        for batch in sliced(batches):
            elements, owner = shingles(texts_of(batch), size, weighted)
            bounds = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            a, b = set_hashes(elements, bounds)
            node, want_a, want_b = (batch.column(k).to_numpy() for k in (1, 2, 3))
            own = [k for k in np.flatnonzero((a == want_a) & (b == want_b)).tolist() if node[k] not in seen and not seen.add(int(node[k]))]
            sets = [np.sort(elements[bounds[k] : bounds[k + 1]]).tobytes() for k in own]
            yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(sets, pa.binary())], ["node", "elements"])

    texts = docs.select(F.col("doc_id").cast("long").alias("first"), F.xxhash64("text").alias("text_hash"), "text")
    return texts.join(asked.hint("shuffle_hash"), ["first", "text_hash"]).select("text", "node", "set_a", "set_b").mapInArrow(run, "node long, elements binary")


def verified(pairs: DataFrame, elements: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose element sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate((x, y)), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                ok.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    of = lambda node, name: elements.select(F.col("node").alias(node), F.col("elements").alias(name)).hint("merge")
    both = pairs.join(of("b", "y"), "b").join(of("a", "x"), "a").select("a", "b", "x", "y")
    return both.mapInArrow(run, "a long, b long")


def contested(large: DataFrame, labels: DataFrame) -> DataFrame:
    """Nodes (node, label) of the large buckets that hold more than one component."""
    named = large.select("key", F.col("q.node").alias("node")).join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    several = named.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("greatest")).where("least <> greatest")
    return named.join(several.select("key"), "key", "left_semi").select("node", "label").distinct()


def rare_first(nodes: DataFrame, most: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` commonest elements of the nodes (elements), sorted, and their counts. They only order prefixes: any order is right,
    so elements that occur once in a batch are not counted there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, n = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own[n > 1].view(np.int64)), pa.array(n[n > 1], pa.int64())], ["token", "n"])

    counts = nodes.select("elements").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "token").limit(most).toArrow()
    tokens, n = top.column("token").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], n[order]


def place_of(elements: np.ndarray) -> np.ndarray:
    return (mix(elements) >> np.uint64(11)).astype(np.int64) % PLACES


def recurring(nodes: DataFrame) -> np.ndarray:
    """By ``place_of``: whether two or more nodes (elements) may hold an element of that place. An element of one node alone makes no
    pair; one of several is never missed, and a table with very many elements rules out fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(PLACES, bool), np.zeros(PLACES, bool)
        for batch in batches:
            own, n = np.unique(place_of(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64)), return_counts=True)
            twice[own[(n > 1) | once[own]]] = True
            once[own] = True
        sent = [[x.tobytes() for x in np.packbits(m).reshape(PIECES, -1)] for m in (once, twice)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), *(pa.array(x, pa.binary()) for x in sent)], ["piece", "once", "twice"])

    def both(pieces: pa.Table) -> pa.Table:
        once = twice = np.zeros(PLACES // PIECES // 8, np.uint8)
        for a, b in zip(pieces.column("once"), pieces.column("twice")):
            a, b = np.frombuffer(a.as_py(), np.uint8), np.frombuffer(b.as_py(), np.uint8)
            once, twice = once | a, twice | b | once & a
        return pa.table({"piece": pieces.column("piece").slice(0, 1), "twice": pa.array([twice.tobytes()], pa.binary())})

    found = nodes.select("elements").mapInArrow(run, "piece int, once binary, twice binary").groupBy("piece").applyInArrow(both, "piece int, twice binary").toArrow()
    bits = dict(zip(found.column("piece").to_pylist(), found.column("twice").to_pylist()))
    return np.unpackbits(np.frombuffer(b"".join(bits.get(k, bytes(PLACES // PIECES // 8)) for k in range(PIECES)), np.uint8)).astype(bool)


def parities(elements: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """An n x ``PARITY`` matrix of 64 bits each: every element of a set flips one bit. The bits in which two sets differ are at
    most the elements in which they differ."""
    width = 64 * PARITY
    bit = (mix(elements) >> np.uint64(17)).astype(np.int64) % width
    odd = (np.bincount(owner * width + bit, minlength=n * width) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).reshape(n, PARITY)


def prefixes(nodes: DataFrame, common: tuple[np.ndarray, np.ndarray], similarity: float, shared: np.ndarray) -> DataFrame:
    """The rarest elements of every node (node, label, elements) with their places. Two sets that are similar enough share an
    element among the first ``size - ceil(similarity size) + 1`` of the larger (all rows) and the fewer of the smaller (``short``).
    Of these, elements that no other node holds (see ``recurring``) are left out."""
    tokens, counts = common
    shared = np.packbits(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x, np.uint64) for x in batch.column(2).to_pylist()]
            size = np.array([len(x) for x in sets], np.int64)
            flat = np.concatenate([*sets, np.empty(0, np.uint64)])
            owner = np.repeat(np.arange(len(sets)), size)
            at = np.minimum(np.searchsorted(tokens, flat), max(len(tokens) - 1, 0))
            count = np.where(tokens[at] == flat, counts[at], 0) if len(tokens) else np.zeros(len(flat), np.int64)
            order = np.lexsort((flat, count, owner))
            place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            long = size - np.ceil(similarity * size - 1e-6).astype(np.int64) + 1
            short = size - np.ceil(2 * similarity / (1 + similarity) * size - 1e-6).astype(np.int64) + 1
            keep = place < long[owner]
            at = place_of(flat[order][keep])
            keep[keep] = (shared[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
            own = owner[keep]
            parity = parities(flat, owner, len(sets))[own]
            columns = [
                pa.array(flat[order][keep].view(np.int64)),
                batch.column(0).take(pa.array(own)),
                batch.column(1).take(pa.array(own)),
                pa.array(size[own], pa.int32()),
                pa.array(place[keep], pa.int32()),
                pa.array(place[keep] < short[own]),
                *(pa.array(parity[:, k]) for k in range(PARITY)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["token", "node", "label", "size", "place", "short", *PARITIES])

    schema = "token long, node long, label long, size int, place int, short boolean, " + ", ".join(f"{x} long" for x in PARITIES)
    return nodes.select("node", "label", "elements").mapInArrow(run, schema)


def remaining_pairs(nodes: DataFrame, similarity: float) -> DataFrame:
    """Every pair of contested nodes (node, label, elements) of two components that may be similar enough: exact, by prefixes of
    their sets.

    Under a token, pairs within its largest component are left out before they are formed, so one great class costs its
    size times that of the others and not its square. Texts of one template whose changes recur share rare elements without
    being similar; their parities tell, so that the join emits hardly more pairs than are similar."""
    rows = written(prefixes(nodes.repartition("node"), rare_first(nodes), similarity, recurring(nodes)), "prefixes")
    sizes = rows.groupBy("token", "label").agg(F.count("*").alias("n"), F.max("short").alias("s"))
    heads = sizes.groupBy("token").agg(F.max_by("label", F.struct("n", "label")).alias("head"), F.count("*").alias("labels"), F.max("s").alias("s"))
    asked = written(rows.join(heads.where("labels > 1 and s"), "token").withColumn("minor", F.col("label") != F.col("head")), "prefixes")
    t = similarity / (1 + similarity)
    apart = reduce(Column.__add__, (F.bit_count(F.col(f"p.{x}").bitwiseXOR(F.col(f"q.{x}"))) for x in PARITIES))
    fits = (
        (F.col("p.label") != F.col("q.label")) & (F.col("p.size") <= F.col("q.size")) & (F.col("p.size") >= similarity * F.col("q.size") - 1e-6)
        & (F.least(F.col("p.size") - F.col("p.place"), F.col("q.size") - F.col("q.place")) >= t * (F.col("p.size") + F.col("q.size")) - 1e-6)
        & (apart <= (1 - 2 * t) * (F.col("p.size") + F.col("q.size")) + 1e-6)
    )
    side = lambda name, which: asked.where(which).select("token", F.struct("node", "label", "size", "place", *PARITIES).alias(name))
    either = side("p", "short and minor").join(side("q", "true"), "token").where(fits).select("p", "q")
    mixed = side("p", "short and not minor").join(side("q", "minor"), "token").where(fits).select("p", "q")
    return ordered_pairs(either.unionByName(mixed), similarity)


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links: only the labels that the links join are a graph now."""
    of = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"l{end}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb"))
    joined = written(ends, "ends")
    roots = components(joined.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()).select(F.col("node").alias("label"), F.col("label").alias("root"))
    known = labels.unionByName(joined.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("la").alias("label")), F.struct(F.col("b").alias("node"), F.col("lb").alias("label")))).alias("x")).select("x.*")).distinct()
    return written(known.join(roots, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, weighted: bool = True, small: int = SMALL) -> DataFrame:
    """doc_id, text_hash, size, label (the same for all rows of a class; null without one) and class_id (the least doc_id of the
    class) of every row of ``docs``."""
    sets = written(signed(docs, bands, rows, SHINGLE, weighted), "signatures")
    nodes = written(distinct_sets(sets.where("doc_id is not null and size > 0")), "nodes")
    shared = written(shared_buckets(nodes), "buckets")
    large = shared.where(F.col("n") > small)
    pairs = written(first_pairs(shared, small, similarity), "pairs")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(large.select("q.node")).distinct()
    asked = nodes.select("node", "first", "text_hash", "set_a", "set_b").join(ends, "node", "left_semi")
    elements = written(elements_of(docs, asked, SHINGLE, weighted), "elements")
    labels = components(written(verified(pairs, elements, similarity), "links"))
    rest = written(contested(large, labels).join(elements, "node"), "contested")
    if not rest.isEmpty():
        links = written(verified(written(remaining_pairs(rest, similarity), "pairs"), elements, similarity), "links")
        if not links.isEmpty():
            labels = merged(labels, links)
    of_node = nodes.select(*SET, "first", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    heads = nodes.select("first", "node").join(labels, "node").groupBy("label").agg(F.min("first").alias("head"))
    classes = of_node.join(heads, "label", "left").select(*SET, "label", F.coalesce("head", "first").alias("class_id"))
    return sets.select("doc_id", "text_hash", *SET).join(classes, SET, "left").select("doc_id", "text_hash", "size", F.expr("if(doc_id is null, null, label)").alias("label"), F.expr("if(doc_id is null, null, coalesce(class_id, doc_id))").alias("class_id"))


def near_duplicates(docs: DataFrame, **options: object) -> DataFrame:
    """doc_id, class_id (the least doc_id of the document's class), n_shingles and label of every row of ``docs``; the label tells
    apart two classes that one doc_id heads with two texts."""
    return near_classes(docs, **options).select("doc_id", "class_id", F.col("size").cast("long").alias("n_shingles"), "label")


def op1(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)


def first_of_class(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: that of the least doc_id (then of the least text hash). Rows without a class stay."""
    rows = written(near_classes(docs).where("label is not null").select("doc_id", "text_hash", "label"), "classes")
    heads = rows.groupBy("label").agg(F.min(F.struct("doc_id", "text_hash")).alias("head"))
    gone = rows.join(heads, "label").where(F.struct("doc_id", "text_hash") != F.col("head")).select("doc_id", "text_hash").distinct()
    repeated = written(rows.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "text_hash"), "repeated")
    keyed = lambda df: df.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).hint("shuffle_hash")
    same = lambda df: (docs["doc_id"].cast("long") == df["_id"]) & (F.xxhash64(docs["text"]) == df["_hash"])
    gone, again = keyed(gone), keyed(repeated)
    stay = docs.join(gone, same(gone), "left_anti")
    if repeated.isEmpty():
        return stay
    once = stay.join(again, same(again), "left_semi").dropDuplicates(["doc_id", "text"])
    return stay.join(again, same(again), "left_anti").unionByName(once)
