"""Byte-level dedup by a collection's Burrows-Wheeler transform, built column by column.

A string of 50 bytes that also starts in a document with a smaller doc_id is removed from the later one.
``windows`` narrows the corpus to the short contexts that can match and deals them into buckets. In a bucket
the contexts form one collection: each round puts one more symbol, from the right, before the suffix of every
context, so the matrix of sorted suffixes takes one row per context. Where a row goes is counted in the transform (the symbol
before each row's suffix): after the rows of lesser symbols, and those of its own symbol that stand above the row it extends. The
transform and the common prefix of each row with the one above are brought up to date in one sequential pass. At the end, rows
whose common prefix is 50 or more stand together, and each group's earliest document keeps its bytes.

A bucket's transform, row map and common prefixes are flat arrays that every round reads and writes once in order;
with bounded buckets they fit in a task's memory, so they are not put in files.

Cases: null and empty texts have no bytes; shorter documents than a window keep all; equal strings within one
document stay, and so do those of rows that share a doc_id, each of which is judged by its own text; documents with a null doc_id are neither changed nor
compared; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultline.llm.shared import sliced, texts_of
from vaultline.llm.windows import Symbols, covered, with_windows

WINDOW = 50
GRAM = 25


class Collection:
    """Sorted suffixes of short strings, longer by one symbol of each string with every round."""

    def __init__(self, flat: np.ndarray, bounds: np.ndarray, cap: int):
        self.cap = cap
        n, size = len(bounds) - 1, np.diff(bounds)
        # symbols from 1 up; 0 stands before every string and after the last
        self.padded = np.zeros(len(flat) + n + cap, np.uint16)
        self.padded[np.arange(len(flat)) + np.repeat(np.arange(n) + 1, size)] = flat.astype(np.uint16) + 1
        self.begin = bounds[:-1] + np.arange(n) + 1  # place of each string's first symbol
        self.end = np.zeros(len(self.padded), np.int32)  # of the string that a place belongs to
        self.end[1 : len(flat) + n + 1] = np.repeat(self.begin + size, size + 1)
        self.ahead = np.lib.stride_tricks.sliding_window_view(np.append(self.padded, np.zeros(cap, np.uint16)), cap)
        # rows: the empty suffix of each string
        self.place = (self.begin + size).astype(np.int32)
        self.before = self.padded[self.place - 1]
        self.common = np.zeros(n, np.int16)
        self.latest = np.arange(n)  # the rows of the strings' longest suffixes so far

    def rounds(self) -> None:
        while len(self.latest):
            self.insert()

    def insert(self) -> None:
        """One symbol of each string that has one left."""
        symbol = self.before[self.latest]
        older = self.before.copy()
        older[self.latest] = 0
        by_symbol = np.argsort(older, kind="stable")  # of the rows whose extension is a row already
        count = np.bincount(older, minlength=258)
        start = np.cumsum(count) - count
        order = np.lexsort((self.latest, symbol))
        order = order[symbol[order] > 0]
        rows, symbol = self.latest[order], symbol[order]
        above = np.empty(len(rows), np.int64)
        edges = np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1])).tolist() if len(rows) else []
        for a, b in zip(edges, [*edges[1:], len(rows)]):
            c = int(symbol[a])
            above[a:b] = start[c] - count[0] + np.searchsorted(by_symbol[start[c] : start[c] + count[c]], rows[a:b])
        at = above + len(self.begin) + np.arange(len(rows))  # below the empty suffixes and the new rows above
        place = self.place[rows] - 1
        kept = np.ones(len(self.place) + len(at), bool)
        kept[at] = False
        self.place = self._merged(self.place, place, kept, at)
        self.before = self._merged(self.before, self.padded[place - 1], kept, at)
        self.common = self._merged(self.common, np.zeros(len(at), np.int16), kept, at)
        near = ~kept
        near[1:] |= ~kept[:-1]
        near[:1] = False
        touched = np.flatnonzero(near)
        self.common[touched] = self._common(touched)
        self.latest = at

    @staticmethod
    def _merged(old: np.ndarray, new: np.ndarray, kept: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.empty(len(kept), old.dtype)
        out[kept] = old
        out[at] = new
        return out

    def _common(self, rows: np.ndarray) -> np.ndarray:
        a, b = self.place[rows], self.place[rows - 1]
        differ = self.ahead[a] != self.ahead[b]
        size = np.where(differ.any(axis=1), differ.argmax(axis=1), self.cap)
        return np.minimum(size, np.minimum(self.end[a] - a, self.end[b] - b)).astype(np.int16)


def solve(docs: np.ndarray, flat: np.ndarray, bounds: np.ndarray, window: int) -> np.ndarray:
    """Flags the starts of windows that occur in an earlier document."""
    c = Collection(flat, bounds, window)
    c.rounds()
    string = np.searchsorted(c.begin, c.place, side="right") - 1  # an empty suffix's place is before the next string's first
    group = np.cumsum(c.common < window) - 1
    doc = docs[string]
    earliest = np.minimum.reduceat(doc, np.flatnonzero(np.append(True, group[1:] != group[:-1])))
    hit = (c.end[c.place] - c.place >= window) & (doc > earliest[group])
    flags = np.zeros(len(flat), bool)
    flags[c.place[hit] - 1 - string[hit]] = True
    return flags


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and ``kept``: the remaining bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for text, places in zip(texts_of(batch), batch.column(2).to_pylist()):
                raw = text.encode()
                if not places:
                    rows.append((len(raw), 0, 0, raw))
                    continue
                gone = covered(len(raw), places, window)
                runs = int((gone[1:] & ~gone[:-1]).sum()) + int(gone[:1].sum())
                rows.append((len(raw), int(gone.sum()), runs, np.frombuffer(raw, np.uint8)[~gone].tobytes()))
            columns = [pa.array([r[k] for r in rows], pa.binary() if k == 3 else pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    return with_windows(docs, Symbols(False, window, gram), solve).mapInArrow(run, schema)


def op9(docs: DataFrame) -> DataFrame:
    return dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
