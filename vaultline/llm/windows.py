"""Exact search for windows of symbols that also start in a document with a smaller doc_id.

Symbols are words or bytes. Every window of ``window`` symbols has one *anchor*: the ``gram`` symbols inside it
whose hash is least (of equals the one of the window before while it is inside, else the last, so a run of equal symbols has
few). Equal windows have equal anchors, and about two anchors in ``window - gram + 2`` symbols serve all windows. The windows of
one anchor occurrence are consecutive; together they are its *context*.

1. Anchors, as (anchor hash, context hash, document, place), go to buckets by anchor hash. Where two documents
   have the same context, all windows of the later one are found, and it is known where the earlier one has them. An anchor
   that documents share in different contexts is *contested*: only some windows may be equal there.
2. The contested contexts, one per distinct context, go to buckets as symbols, where ``solve`` finds each
   window that starts in an earlier document.
3. What was found by equal contexts counts as it is, or (with ``follow``) names passages to compare: a document's consecutive finds
   in one earlier document are one passage, which goes with that document's to a bucket of *it*, as symbols, and ``follow``
   finds the windows. An earlier document that very many copy is sent to several buckets, each with a part of them.
4. All finds are grouped by document and joined with the texts.

An anchor of more than ``HOT`` contested contexts is *hot*: its contexts do not meet in one bucket. Each of their windows goes
by (anchor hash, window hash) instead, where aggregates that combine in map tasks keep the least document, so
a passage that very many documents share within different surroundings makes no uneven bucket.

Map tasks settle copies within their own batch at once, so of a group of thousands of copies each batch sends
one. Nothing is capped; documents meet only in buckets of anchors, never pairwise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultline.llm.merkle import ranked
from vaultline.llm.shared import RangeHash, mix, parts, ragged, sliced, text_bytes, texts_of, words_of, written

#: Solves one bucket: (documents, contexts as one flat array, their bounds, window) to a flag for each place in the flat array.
Solve = Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]
#: Compares passages with an earlier document's: (its passages, the asked ones, window) to the flags of each asked passage.
Follow = Callable[[list[np.ndarray], list[np.ndarray], int], list[np.ndarray]]


HOT = 2048


@dataclass(frozen=True)
class Symbols:
    """Which symbols a text has; ``dtype`` is what a context is sent as."""

    words: bool
    window: int
    gram: int
    #: Bits of a document's number below its doc_id, where several texts share one (see ``numbered``).
    low: int = 0

    @property
    def dtype(self) -> np.dtype:
        return np.dtype("<u8" if self.words else "u1")

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.words:
            hashes, _, _, bounds = words_of(texts)
            return hashes, bounds
        raw = [t.encode() for t in texts]
        return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum(np.array([len(r) for r in raw], np.int64))))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


@dataclass
class Anchors:
    owner: np.ndarray  # index of the text
    first: np.ndarray  # place of the first window, in the batch
    count: np.ndarray  # number of windows
    key: np.ndarray
    context: np.ndarray


def anchors(symbols: np.ndarray, bounds: np.ndarray, kind: Symbols) -> Anchors:
    window, gram = kind.window, kind.gram
    n = len(symbols)
    empty = np.empty(0, np.int64)
    if n < window:
        return Anchors(empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64))
    hashes = RangeHash(symbols if kind.words else mix(np.arange(1, 257, dtype=np.uint64))[symbols])
    at = np.arange(n - gram + 1)
    grams = hashes.of(at, at + gram)
    low = np.uint64(0xFFFFFFFF)
    least = sliding_min((grams & ~low) | (low - at.astype(np.uint64)), window - gram + 1)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    start = np.flatnonzero(owner[: n - window + 1] == owner[window - 1 :])
    if not len(start):
        return Anchors(empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64))
    place = steady((low - (least[start] & low)).astype(np.int64), start, grams)
    head = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1))
    first = start[head]
    count = np.diff(np.append(head, len(start)))
    return Anchors(owner[first], first, count, grams[place[head]], hashes.of(first, first + count - 1 + window))


def steady(place: np.ndarray, start: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Places of the windows' anchors, where a window keeps its predecessor's anchor as long as that is inside it and no greater."""
    key = grams[place]
    same = (start[1:] == start[:-1] + 1) & (key[1:] == key[:-1])
    moved = np.flatnonzero(same & (place[1:] != place[:-1]))
    edges = np.flatnonzero(~same)
    last = len(start) - 1
    done = -1
    for m in moved.tolist():
        if m < done:
            continue  # in a stretch that is finished
        k = int(np.searchsorted(edges, m))
        i, done = (int(edges[k - 1]) + 1 if k else 0), int(edges[k]) if k < len(edges) else last
        while i <= done:
            j = min(done, i + int(place[i] - start[i]))
            place[i : j + 1] = place[i]
            i = j + 1
    return place


ROWS = "bucket int, found boolean, keys binary, contexts binary, docs binary, firsts binary, counts binary, refs binary, ref_firsts binary"
FINDS = "doc_id long, kind int, places binary"


def by_bucket(bucket: np.ndarray, columns: dict[str, np.ndarray], fixed: dict[str, object]) -> Iterator[dict[str, object]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts) if len(order) else ():
        yield fixed | {"bucket": int(bucket[part[0]])} | {k: v[part].tobytes() for k, v in columns.items()}


def batch_of(rows: list[dict], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in schema], [k for k, _ in schema])


ROW_TYPES = [("bucket", pa.int32()), ("found", pa.bool_()), *((k, pa.binary()) for k in ("keys", "contexts", "docs", "firsts", "counts", "refs", "ref_firsts"))]
FOUND = ("firsts", np.uint32), ("counts", np.uint8), ("refs", np.int64), ("ref_firsts", np.uint32)
FIND_TYPES = [("doc_id", pa.int64()), ("kind", pa.int32()), ("places", pa.binary())]


def anchor_rows(docs: DataFrame, kind: Symbols, buckets: int, refs: bool = True) -> DataFrame:
    """Anchors by bucket, and finds within batches (``refs``: with where the earlier document has them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            symbols, bounds = kind.of(texts_of(batch))
            a = anchors(symbols, bounds, kind)
            doc, first = ids[a.owner], (a.first - bounds[a.owner]).astype(np.uint32)
            context = a.context >> np.uint64(16)
            order = np.lexsort((doc, context, a.key))
            head = np.ones(len(order), bool)
            head[1:] = (a.key[order][1:] != a.key[order][:-1]) | (context[order][1:] != context[order][:-1])
            earliest = np.empty(len(order), np.int64)  # the row of the batch's earliest document with the same context
            earliest[order] = order[np.flatnonzero(head)][np.cumsum(head) - 1] if len(order) else order
            later = doc >> kind.low > doc[earliest] >> kind.low
            bucket = (a.key % np.uint64(buckets)).astype(np.int32)
            columns = {"keys": a.key, "contexts": context, "docs": doc, "firsts": first, "counts": a.count.astype(np.uint8)}
            # six bytes of a context's hash travel, low four and high two apart
            cut = {k: v[~later] for k, v in columns.items()}
            rows = []
            for row in by_bucket(bucket[~later], cut, {"found": False, "refs": b"", "ref_firsts": b""}):
                context = np.frombuffer(row["contexts"], np.uint64)
                row["contexts"] = context.astype(np.uint32).tobytes() + (context >> np.uint64(32)).astype(np.uint16).tobytes()
                rows.append(row)
            known = {k: columns[k][later] for k in ("docs", "firsts", "counts")}
            if refs:
                known |= {"refs": doc[earliest[later]], "ref_firsts": first[earliest[later]]}
            for row in by_bucket((doc[later] % buckets).astype(np.int32), known, {"found": True, "keys": b"", "contexts": b"", "refs": b"", "ref_firsts": b""}):
                rows.append(row)
            if rows:
                yield batch_of(rows, ROW_TYPES)

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, ROWS)


def per_document(doc: np.ndarray, kind: int, columns: list[np.ndarray]) -> list[dict[str, object]]:
    """One row for each document; its places are the columns' bytes, one column after another."""
    order = np.argsort(doc, kind="stable")
    cuts = np.flatnonzero(np.diff(doc[order])) + 1
    return [{"doc_id": int(doc[p[0]]), "kind": kind, "places": b"".join(c[p].tobytes() for c in columns)} for p in np.split(order, cuts)] if len(order) else []


def settle(table: pa.Table, most: int = HOT, refs: bool = True, low: int = 0) -> pa.Table:
    """Finds of one bucket of anchors: kind 0, contexts that an earlier document has (``refs``: and where); kind 1, contested contexts; kind 2,
    those of anchors with over ``most``."""
    rows = table.to_pylist()
    known = [r for r in rows if r["found"]]
    open_rows = [r for r in rows if not r["found"]]
    join = lambda name, kind, own: np.frombuffer(b"".join(r[name] for r in own), kind)
    out = per_document(join("docs", np.int64, known), 0, [join(name, kind, known) for name, kind in (FOUND if refs else FOUND[:2])])
    key = join("keys", np.uint64, open_rows)
    context = [np.empty(0, np.uint64)]
    for r in open_rows:
        n = len(r["keys"]) // 8
        context.append(np.frombuffer(r["contexts"], np.uint32, n).astype(np.uint64) | np.frombuffer(r["contexts"], np.uint16, n, 4 * n).astype(np.uint64) << np.uint64(32))
    context = np.concatenate(context)
    doc, first, count = join("docs", np.int64, open_rows), join("firsts", np.uint32, open_rows), join("counts", np.uint8, open_rows)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    shared = np.zeros(len(key), bool)
    shared[order[1:][same]] = shared[order[:-1][same]] = True
    pick = np.flatnonzero(shared)
    pick = pick[np.lexsort((doc[pick], context[pick], key[pick]))]
    if len(pick):
        key, context, doc, first, count = key[pick], context[pick], doc[pick], first[pick], count[pick]
        new_key = np.append(True, key[1:] != key[:-1])
        new_context = new_key | np.append(True, context[1:] != context[:-1])
        ref = np.flatnonzero(new_context)[np.cumsum(new_context) - 1]
        earliest = doc[ref]
        found = doc >> low > earliest >> low
        group = np.cumsum(new_key) - 1
        contexts = np.bincount(group, new_context)
        begins = np.flatnonzero(new_key)
        spread = np.minimum.reduceat(earliest, begins) != np.maximum.reduceat(earliest, begins)
        contested = ~found & ((contexts > 1) & spread)[group]
        out += per_document(doc[found], 0, [first[found], count[found], *((earliest[found], first[ref[found]]) if refs else ())])
        hot = (contexts > most)[group]
        for kind, own in ((1, contested & ~hot), (2, contested & hot)):
            out += per_document(doc[own], kind, [key[own], first[own], count[own]])
    return pa.Table.from_batches([batch_of(out, FIND_TYPES)])


CONTEXTS = "bucket int, role int, docs binary, firsts binary, sizes binary, refs binary, symbols binary"
CONTEXT_TYPES = [("bucket", pa.int32()), ("role", pa.int32()), *((k, pa.binary()) for k in ("docs", "firsts", "sizes", "refs", "symbols"))]
CONTESTED, PASSAGE, REFERENCE = 1, 3, 4  # kinds of places, and roles of symbols


def places_of(batch: pa.RecordBatch, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchor hash, document, first place (in the text and in the batch) and number of windows of a batch's contested contexts."""
    out = [[np.empty(0, d)] for d in (np.uint64, np.int64, np.uint32, np.int64, np.uint8)]
    for i, (doc, lists) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
        for own in lists:
            if own["kind"] in (1, 2):
                raw = own["places"]
                n = len(raw) // 13
                first = np.frombuffer(raw, np.uint32, n, 8 * n)
                columns = np.frombuffer(raw, np.uint64, n), np.full(n, doc, np.int64), first, first + bounds[i], np.frombuffer(raw, np.uint8, n, 12 * n)
                for column, x in zip(out, columns):
                    column.append(x)
    return tuple(np.concatenate(x) for x in out)


def passages_of(batch: pa.RecordBatch, bounds: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Role, document, first place (in the text and in the batch), number of symbols and bucket number of a batch's passages."""
    out = [np.empty((6, 0), np.int64)]
    for i, (doc, lists) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
        rows = {role: np.concatenate([np.empty((0, 4), np.int64), *(np.frombuffer(x["places"], np.int64).reshape(-1, 4) for x in lists if x["kind"] == role)]) for role in (PASSAGE, REFERENCE)}
        for role, (first, n, ref, parts_) in [(PASSAGE, rows[PASSAGE].T), *(((REFERENCE, merged_spans(rows[REFERENCE])),) if len(rows[REFERENCE]) else ())]:
            size = n + window - 1
            if role == REFERENCE:  # once for each part of the documents that copy it
                part = ragged(np.zeros(len(parts_), np.int64), parts_)
                first, size, ref = (np.repeat(x, parts_) for x in (first, size, ref))
            else:
                part = (mix(first + doc * 31) % np.maximum(parts_, 1).astype(np.uint64)).astype(np.int64)
            key = mix(mix(ref) + part.astype(np.uint64)).view(np.int64)
            out.append(np.stack([np.full(len(first), role), np.full(len(first), doc), first, first + bounds[i], size, key]))
    return tuple(np.concatenate(out, axis=1))


def merged_spans(rows: np.ndarray) -> np.ndarray:
    """Spans of windows (first, number, document, parts) of one document, those that touch as one."""
    first, n = rows[:, 0], rows[:, 1]
    order = np.argsort(first, kind="stable")
    end = np.maximum.accumulate((first + n)[order])
    head = np.append(True, first[order][1:] > end[:-1])
    at = np.flatnonzero(head)
    return np.stack([first[order][at], end[np.append(at[1:], len(rows)) - 1] - first[order][at], rows[order[at], 2], rows[order[at], 3]])


def symbol_rows(joined: DataFrame, kind: Symbols, buckets: int) -> DataFrame:
    """Contested contexts and passages as symbols. ``joined`` has doc_id, text and the lists of places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            symbols, bounds = kind.of(texts_of(batch))
            key, doc, first, start, count = places_of(batch, bounds)
            sets = [(np.full(len(key), CONTESTED), doc, first, start, count.astype(np.int64) + kind.window - 1, key.view(np.int64)), passages_of(batch, bounds, kind.window)]
            role, doc, first, start, size, ref = (np.concatenate(x) for x in zip(*sets))
            bucket = (mix(ref.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((bucket, role))
            rows = []
            for p in np.split(order, np.flatnonzero(np.diff(bucket[order]) | np.diff(role[order])) + 1) if len(order) else ():
                own = symbols[ragged(start[p], size[p])].astype(kind.dtype)
                columns = {"docs": doc[p], "firsts": first[p].astype(np.uint32), "sizes": size[p].astype(np.uint32), "refs": ref[p], "symbols": own}
                rows.append({"bucket": int(bucket[p[0]]), "role": int(role[p[0]])} | {k: v.tobytes() for k, v in columns.items()})
            if rows:
                yield batch_of(rows, CONTEXT_TYPES)

    return joined.select("doc_id", "text", "places").mapInArrow(run, CONTEXTS)


RUNS = "ref long, ref_first int, n int, doc_id long, first int"


def runs(found: DataFrame) -> DataFrame:
    """A document's consecutive finds in one earlier document as one passage. ``found``: doc_id and its places of kind 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.empty((5, 0), np.int64)]
            for doc, lists in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                first, n, ref, ref_first = (np.concatenate(x).astype(np.int64) for x in zip(*map(found_places, lists)))
                order = np.lexsort((first, first - ref_first, ref))
                first, n, ref, ref_first = first[order], n[order], ref[order], ref_first[order]
                head = np.ones(len(first), bool)
                head[1:] = (first[1:] != first[:-1] + n[:-1]) | (ref[1:] != ref[:-1]) | (ref_first[1:] - ref_first[:-1] != first[1:] - first[:-1])
                at = np.flatnonzero(head)
                out.append(np.stack([ref[at], ref_first[at], np.add.reduceat(n, at), np.full(len(at), doc), first[at]]))
            columns = np.concatenate(out, axis=1)
            types = pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["ref", "ref_first", "n", "doc_id", "first"])

    return found.select("doc_id", "places").mapInArrow(run, RUNS)


def found_places(raw: bytes) -> tuple[np.ndarray, ...]:
    n = len(raw) // 17
    out, at = [], 0
    for _, kind in FOUND:
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return tuple(out)


def asked_passages(wanted: DataFrame, most: int) -> DataFrame:
    """Places of kind PASSAGE and REFERENCE for ``wanted`` runs: (first, number of windows, earlier document, its parts), eight bytes each."""

    def packed(kind: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                doc, *rest = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5))
                order = np.argsort(doc, kind="stable")
                cells = np.stack(rest, axis=1)
                cuts = np.split(order, np.flatnonzero(np.diff(doc[order])) + 1) if len(order) else []
                yield batch_of([{"doc_id": int(doc[p[0]]), "kind": kind, "places": cells[p].tobytes()} for p in cuts], FIND_TYPES)

        return run

    parts_ = wanted.groupBy("ref").agg(F.ceil(F.sum("n") / most).cast("long").alias("parts"))
    sized = wanted.join(parts_, "ref")
    asked = sized.select("doc_id", "first", "n", "ref", "parts").mapInArrow(packed(PASSAGE), FINDS)
    known = sized.select(F.col("ref").alias("doc_id"), F.col("ref_first").alias("first"), "n", "ref", "parts").distinct().mapInArrow(packed(REFERENCE), FINDS)
    return asked.unionByName(known)


def hot_finds(joined: DataFrame, kind: Symbols) -> DataFrame:
    """Finds among the contexts of hot anchors. Equal windows have equal anchors, so a window is known by its anchor's hash and its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            symbols, bounds = kind.of(texts_of(batch))
            key, doc, first, start, count = places_of(batch, bounds)
            if not len(key):
                continue
            hashes = RangeHash(symbols if kind.words else mix(np.arange(1, 257, dtype=np.uint64))[symbols])
            n = count.astype(np.int64)
            at = ragged(start, n)
            columns = [np.repeat(key, n).view(np.int64), hashes.of(at, at + kind.window).view(np.int64), np.repeat(doc, n), ragged(first.astype(np.int64), n)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "window", "doc_id", "place"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, place = (batch.column(k).to_numpy() for k in (0, 1))
            if len(doc):
                yield batch_of(per_document(doc, 0, [place.astype(np.uint32), np.ones(len(place), np.uint8)]), FIND_TYPES)

    rows = written(joined.select("doc_id", "text", "places").mapInArrow(run, "key long, window long, doc_id long, place long"), "hot")
    own = F.shiftright("doc_id", kind.low)
    least = rows.groupBy("key", "window").agg(F.min(own).alias("least"), F.max(own).alias("last")).where("least < last")
    later = rows.join(least.select("key", "window", "least"), ["key", "window"]).where(own > F.col("least"))
    return later.select("doc_id", "place").mapInArrow(packed, FINDS)


@dataclass
class Bucket:
    """Documents, first places, symbols and their bounds of one role in a bucket, in document order."""

    doc: np.ndarray
    first: np.ndarray
    ref: np.ndarray
    flat: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, rows: list[dict], kind: Symbols) -> Bucket:
        join = lambda name, dtype: np.frombuffer(b"".join(r[name] for r in rows), dtype)
        doc, first, size, ref, symbols = join("docs", np.int64), join("firsts", np.uint32), join("sizes", np.uint32).astype(np.int64), join("refs", np.int64), join("symbols", kind.dtype)
        order = np.argsort(doc, kind="stable")
        begin = np.cumsum(size) - size
        return cls(doc[order], first[order], ref[order], symbols[ragged(begin[order], size[order])], np.concatenate(([0], np.cumsum(size[order]))))

    def finds(self, flags: np.ndarray) -> pa.Table:
        """The places where windows start that ``flags`` names."""
        hit = np.flatnonzero(flags)
        owner = np.searchsorted(self.bounds, hit, side="right") - 1
        place = self.first[owner] + (hit - self.bounds[owner]).astype(np.uint32)
        return pa.Table.from_batches([batch_of(per_document(self.doc[owner], 0, [place, np.ones(len(place), np.uint8)]), FIND_TYPES)])


def solver(kind: Symbols, solve: Solve) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        own = Bucket.of(table.to_pylist(), kind)
        return own.finds(solve(own.doc >> kind.low, own.flat, own.bounds, kind.window))

    return run


def follower(kind: Symbols, follow: Follow) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        known, asked = (Bucket.of([r for r in rows if r["role"] == role], kind) for role in (REFERENCE, PASSAGE))
        flags = np.zeros(len(asked.flat), bool)
        cut = lambda x, k: x.flat[x.bounds[k] : x.bounds[k + 1]]
        for ref in np.unique(asked.ref).tolist():
            mine = np.flatnonzero(asked.ref == ref).tolist()
            for k, found in zip(mine, follow([cut(known, k) for k in np.flatnonzero(known.ref == ref).tolist()], [cut(asked, k) for k in mine], kind.window)):
                flags[asked.bounds[k] : asked.bounds[k + 1]] = found
        return asked.finds(flags)

    return run


def found_windows(
    docs: DataFrame, kind: Symbols, solve: Solve, bucket_anchors: int = 1 << 20, bucket_contexts: int = 1 << 14, hot: int = HOT, follow: Follow | None = None, bucket_windows: int = 1 << 20
) -> DataFrame:
    """doc_id and ``places``, a list of binaries: starts (four bytes each) and run lengths (one byte each) of found windows."""
    spark = docs.sparkSession
    symbols = text_bytes(docs) // (6 if kind.words else 1)  # a word is about six bytes long
    expected = symbols * 2 // (kind.window - kind.gram + 2)
    refs = follow is not None
    rows = anchor_rows(docs, kind, parts(spark, expected, bucket_anchors), refs)
    finds = written(rows.groupBy("bucket").applyInArrow(lambda table: settle(table, hot, refs, kind.low), FINDS), "anchors")
    by_doc = lambda df: df.groupBy("doc_id").agg(F.collect_list("places").alias("places"))
    by_kind = lambda df: df.groupBy("doc_id").agg(F.collect_list(F.struct("kind", "places")).alias("places"))
    with_texts = lambda df: docs.select("doc_id", "text").join(by_kind(df).hint("shuffle_hash"), "doc_id")
    sizes = finds.groupBy("kind").agg(F.sum(F.octet_length("places")).cast("long")).collect()
    bytes_of = dict(map(tuple, sizes))
    equal, asked, n = finds.where("kind = 0"), finds.where("kind = 1"), bytes_of.get(1, 0) // 13
    found = equal
    if refs:
        wanted = written(runs(by_doc(equal)), "runs")
        asked, n = asked.unionByName(asked_passages(wanted, bucket_windows)), n + bytes_of.get(0, 0) // 17
        found = equal.where("false")
    if n:
        passages = written(symbol_rows(with_texts(asked), kind, parts(spark, n, bucket_contexts)), "passages")
        found = found.unionByName(written(passages.where(f"role = {CONTESTED}").groupBy("bucket").applyInArrow(solver(kind, solve), FINDS), "contexts"))
        if refs:
            found = found.unionByName(written(passages.where(f"role <> {CONTESTED}").groupBy("bucket").applyInArrow(follower(kind, follow), FINDS), "followed"))
    if 2 in bytes_of:
        found = found.unionByName(written(hot_finds(with_texts(finds.where("kind = 2")), kind), "hot"))
    return by_doc(found)


def covered(n: int, lists: list[bytes] | None, window: int) -> np.ndarray:
    """Flags of the ``n`` symbols that a found window covers."""
    change = np.zeros(n + 1, np.int64)
    for raw in lists or ():
        k = len(raw) // 5
        first = np.frombuffer(raw, np.uint32, k).astype(np.int64)
        last = first + np.frombuffer(raw, np.uint8, k, 4 * k) + (window - 1)
        np.add.at(change, np.minimum(first, n), 1)
        np.add.at(change, np.minimum(last, n), -1)
    return np.cumsum(change[:-1]) > 0


def numbered(docs: DataFrame) -> tuple[DataFrame, int]:
    """``docs`` (doc_id, text) with ``number``, one for each distinct (doc_id, text), and how many of its low bits tell texts of one doc_id apart.

    Where every doc_id has one text, as a rule, the number is the doc_id and nothing is joined.
    """
    print_ = {"hash": F.xxhash64("text"), "size": F.coalesce(F.octet_length("text"), F.lit(-1))}
    texts = docs.where("doc_id is not null").select("doc_id", *(c.alias(n) for n, c in print_.items()))
    several = texts.groupBy("doc_id").agg(F.min(F.struct("hash", "size")).alias("a"), F.max(F.struct("hash", "size")).alias("b")).where("a <> b").select("doc_id")
    several = written(several, "several")
    if several.isEmpty():
        return docs.withColumn("number", F.col("doc_id")), 0
    pairs = texts.join(several, "doc_id", "left_semi").distinct().withColumn("tree", F.col("doc_id"))
    ranks = written(ranked(pairs, ["hash", "size"], "texts").select("doc_id", "hash", "size", "rank"), "texts-ranked")
    low = int(ranks.agg(F.max("rank")).first()[0]).bit_length()
    ends = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if max(-ends[0], ends[1]) >> (62 - low):  # no room for low bits: the doc_ids' order stands for them
        ids = ranked(docs.where("doc_id is not null").select("doc_id").distinct().withColumn("tree", F.lit(0)), ["doc_id"], "ids").select("doc_id", F.col("rank").alias("place"))
        docs = docs.join(ids, "doc_id", "left")
    else:
        docs = docs.withColumn("place", F.col("doc_id"))
    known = docs.withColumns(print_)
    same = [F.col(f"of.{c}").eqNullSafe(F.col(f"one.{c}")) for c in ("doc_id", "hash", "size")]
    both = known.alias("of").join(ranks.alias("one"), same, "left")
    return both.select("of.doc_id", "of.text", (F.shiftleft("of.place", low) + F.coalesce("one.rank", F.lit(0))).alias("number")), low


def with_windows(docs: DataFrame, kind: Symbols, solve: Solve, follow: Follow | None = None) -> DataFrame:
    """doc_id, text and ``places`` (null where nothing was found) of every row of ``docs``."""
    known, low = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    found = found_windows(known.select(F.col("number").alias("doc_id"), "text"), replace(kind, low=low), solve, follow=follow)
    joined = known.join(found.withColumnRenamed("doc_id", "number").hint("shuffle_hash"), "number", "left")
    return joined.select("doc_id", "text", "places")
