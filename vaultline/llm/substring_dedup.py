"""Substring dedup over words, by suffix automata of reference shards.

A window of 50 words that also starts in a document with a smaller doc_id is removed from the later one.
``windows`` narrows the corpus to the passages that can match and deals them into shards by anchor. In a
shard, passages stream in doc_id order through a suffix automaton of the passages before them: its matching
statistics give, at each word, the longest match that ends there, and a match of 50 or more ends a window
to remove. Then the passage joins the automaton.

The reference of this query is the corpus itself, so its automata grow with the data and no size bound would
allow a broadcast; each shard's automaton is built where its passages are shuffled to. ``remove_known`` is for a
reference of bounded size: its texts are broadcast, and each task builds their automaton (about 370 bytes a word) before it
streams its documents.

Cases: null and empty texts have no words; shorter documents than a window keep all; equal windows within one
document stay, and so do those of rows that share a doc_id, each of which is judged by its own text; documents with a null doc_id are neither changed nor
compared; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultline.llm.shared import sliced, texts_of, words_of
from vaultline.llm.windows import Symbols, covered, with_windows

WINDOW = 50
GRAM = 16
REFERENCE_BYTES = 8 << 20


class SuffixAutomaton:
    """A suffix automaton of several sequences."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, sequence: Iterable[int]) -> None:
        nexts, link, length = self.next, self.link, self.length
        last = 0
        for c in sequence:
            if c in nexts[last]:
                q = nexts[last][c]
                last = q if length[q] == length[last] + 1 else self._clone(last, c, q)
                continue
            new = len(nexts)
            nexts.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in nexts[p]:
                nexts[p][c] = new
                p = link[p]
            if p >= 0:
                q = nexts[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
            last = new

    def _clone(self, p: int, c: int, q: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        clone = len(nexts)
        nexts.append(dict(nexts[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        while p >= 0 and nexts[p].get(c) == q:
            nexts[p][c] = clone
            p = link[p]
        link[q] = clone
        return clone

    def statistics(self, sequence: Iterable[int]) -> list[int]:
        """For each symbol, the length of the longest match that ends with it."""
        nexts, link, length = self.next, self.link, self.length
        state = size = 0
        out = []
        for c in sequence:
            while state and c not in nexts[state]:
                state = link[state]
                size = length[state]
            if c in nexts[state]:
                state = nexts[state][c]
                size += 1
            out.append(size)
        return out


def solve(docs: np.ndarray, flat: np.ndarray, bounds: np.ndarray, window: int) -> np.ndarray:
    """Flags the starts of windows that occur in an earlier document; contexts come in doc_id order."""
    flags = np.zeros(len(flat), bool)
    automaton = SuffixAutomaton()
    symbols = flat.tolist()
    edges = np.append(np.flatnonzero(np.diff(docs)) + 1, len(docs)).tolist()
    begin = 0
    for end in edges:  # contexts begin .. end - 1 belong to one document
        own = [(a, symbols[a:b]) for a, b in zip(bounds[begin:end].tolist(), bounds[begin + 1 : end + 1].tolist())]
        for a, sequence in own:
            ends = np.flatnonzero(np.array(automaton.statistics(sequence)) >= window)
            flags[a + ends - (window - 1)] = True
        for _, sequence in own:
            automaton.add(sequence)
        begin = end
    return flags


def follow(known: list[np.ndarray], asked: list[np.ndarray], window: int) -> list[np.ndarray]:
    """Streams passages past the automaton of an earlier document's passages; flags where matching windows start."""
    automaton = SuffixAutomaton()
    for sequence in known:
        automaton.add(sequence.tolist())
    out = []
    for sequence in asked:
        flags = np.zeros(len(sequence), bool)
        flags[np.flatnonzero(np.array(automaton.statistics(sequence.tolist())) >= window) - (window - 1)] = True
        out.append(flags)
    return out


KEPT = "doc_id long, n_words long, n_removed long, kept binary"


def kept_rows(ids: pa.Array, texts: list[str], flags: list[np.ndarray]) -> pa.RecordBatch:
    kept = []
    for text, flag in zip(texts, flags):
        words = text.encode().split()
        kept.append(b" ".join(w for w, gone in zip(words, flag.tolist()) if not gone) if flag.any() else b" ".join(words))
    sizes = pa.array([len(f) for f in flags], pa.int64()), pa.array([int(f.sum()) for f in flags], pa.int64())
    return pa.RecordBatch.from_arrays([ids, *sizes, pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed and ``kept``: the remaining words (UTF-8), joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = texts_of(batch)
            flags = [covered(len(t.encode().split()), p, window) for t, p in zip(texts, batch.column(2).to_pylist())]
            yield kept_rows(batch.column(0), texts, flags)

    return with_windows(docs, Symbols(True, window, gram), solve, follow).mapInArrow(run, KEPT)


def remove_known(docs: DataFrame, reference: DataFrame, window: int = WINDOW, limit: int = REFERENCE_BYTES) -> DataFrame:
    """Like ``dedup``, but removes what occurs in ``reference`` (a column ``text``), which is broadcast; each task builds its automaton.

    A reference above ``limit`` bytes raises: ``dedup`` over the union of both tables is the way then.
    """
    size = reference.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long")).first()[0]
    if size > limit:
        raise ValueError(f"the reference has {size} bytes, more than {limit}; use dedup over both tables")
    known = docs.sparkSession.sparkContext.broadcast([r[0] or "" for r in reference.select("text").collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = SuffixAutomaton()
        hashes, _, _, bounds = words_of(known.value)
        for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
            automaton.add(hashes[a:b].tolist())
        for batch in sliced(batches):
            texts = texts_of(batch)
            hashes, _, _, bounds = words_of(texts)
            flags = []
            for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
                ends = np.flatnonzero(np.array(automaton.statistics(hashes[a:b].tolist())) >= window)
                change = np.zeros(b - a + 1, np.int64)
                np.add.at(change, ends - (window - 1), 1)
                np.add.at(change, ends + 1, -1)
                flags.append(np.cumsum(change[:-1]) > 0)
            yield kept_rows(batch.column(0), texts, flags)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, KEPT)


def op8(docs: DataFrame) -> DataFrame:
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
