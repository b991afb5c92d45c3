"""Token counts of every prefix of a text, by dynamic programming over prefixes.

The last token of a prefix's encoding decides the rest: with ``t`` last, the tokens before it are the
encoding of the prefix without ``t``. So one pass over the end positions finds, for each, the one
token that may stand last beside the last token of the shorter prefix, and its count is one more.
The differences of these counts, one signed byte for each character, answer how many tokens any
prefix has and where a budget is spent, without encoding again.

Cases: a null or empty text has no tokens and an empty table; text of any length is used whole; rows
are independent, so repeated rows repeat their result, and extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultline.llm.pieces import PieceTable, Split, Vocabulary, vocabulary
from vaultline.llm.shared import ragged, sliced, texts_of

LIMIT = 1024


def prefix_counts(vocab: Vocabulary, piece: bytes) -> list[int]:
    """The number of tokens of each prefix (0 to all bytes) of one piece: one pass of an automaton of the vocabulary over it."""
    n = len(piece)
    last, count = [-1] * (n + 1), [0] * (n + 1)
    fits, known = vocab.fits, vocab.pairs
    for at, (token, size) in vocab.endings.iter(piece.decode("latin-1")):
        end = at + 1
        if count[end]:
            continue
        begin = end - size
        if begin:
            before = last[begin]
            ok = known.get(before << 32 | token)
            if not (fits(before, token) if ok is None else ok):
                continue
        last[end], count[end] = token, count[begin] + 1
    return count


def count_text(vocab: Vocabulary, text: str) -> int:
    """Tokens of a short text without special strings."""
    return sum(prefix_counts(vocab, text[a:b].encode())[-1] for _, (a, b) in vocab.tokenizer.pre_tokenizer.pre_tokenize_str(text))


def steps(vocab: Vocabulary, piece: str) -> list[int]:
    """Differences between the token counts of a piece's prefixes, one for each character."""
    if piece in vocab.special_ids:
        counts = [0, *(count_text(vocab, piece[:k]) for k in range(1, len(piece))), 1]
    elif piece[0] == "'" and 2 < len(piece) <= 3 and piece.isascii() and piece[1].isalpha():
        counts = [0, *(count_text(vocab, piece[:k]) for k in range(1, len(piece) + 1))]
    else:
        raw = piece.encode()
        counts = prefix_counts(vocab, raw)
        if len(raw) != len(piece):
            ends = [i for i in range(1, len(raw) + 1) if i == len(raw) or raw[i] & 0xC0 != 0x80]
            counts = [0, *(counts[i] for i in ends)]
    return [b - a for a, b in zip(counts, counts[1:])]


class Counter:
    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self.table = PieceTable(lambda pieces: [steps(self.vocab, p) for p in pieces], np.int8)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token counts after each character of the joined texts (from 0 in each text), and the texts' bounds."""
        split = Split(self.vocab, texts)
        if not len(split.starts):
            return np.empty(0, np.int64), split.text_bounds
        find = lambda a, b: split.pieces(self.table, a, b)
        values, _ = self.table.gather(find(split.starts, split.ends))
        total = np.cumsum(values, dtype=np.int64)
        before = np.concatenate(([0], total))
        a, b = split.gap_runs
        if len(a):  # a prefix that ends with a run of white space has that run as one piece
            slots = find(a, b)
            sums, lens = self.table.gather(slots)
            whole = np.add.reduceat(sums.astype(np.int64), np.cumsum(lens) - lens)
            total[b - 1] = before[a] + whole
        for a, b in split.special:  # a prefix that ends inside a special string has plain text there
            k = max(np.searchsorted(split.starts, a) - 1, 0)
            text = int(np.searchsorted(split.text_bounds, a, side="right")) - 1
            c = max(int(split.starts[k]), int(split.text_bounds[text])) if split.starts[k] < a else a
            if (c, a) in split.special_set:
                c = a
            for end in range(a + 1, b):
                total[end - 1] = before[c] + count_text(self.vocab, split.text[c:end])
        sizes = np.diff(split.text_bounds)
        return total - np.repeat(before[split.text_bounds[:-1]], sizes), split.text_bounds


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def with_prefix_counts(docs: DataFrame, tokenizer: str, budget: int = LIMIT, keep_table: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_tokens, budget_chars (characters of the longest prefix of at most ``budget``
    tokens) and, if asked for, ``steps``: the prefix table, a signed byte for each character."""
    schema = "doc_id long, n_bytes long, n_tokens long, budget_chars long" + ", steps binary" * keep_table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in sliced(batches):
            texts = texts_of(batch)
            counts, bounds = count(texts)
            rows = []
            for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
                own = counts[a:b]
                fit = np.flatnonzero(own <= budget)
                row = (int(own[-1]) if b > a else 0, int(fit[-1]) + 1 if len(fit) else 0)
                rows.append((*row, np.diff(own, prepend=0).astype(np.int8).tobytes() if keep_table else None))
            columns = [batch.column(0).cast(pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64())]
            columns += [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))]
            names = ["doc_id", "n_bytes", "n_tokens", "budget_chars", "steps"]
            yield pa.RecordBatch.from_arrays(columns[: 4 + keep_table], names[: 4 + keep_table])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def tokens_in_prefix(table: np.ndarray | bytes, n_chars: int) -> int:
    """Tokens of the first ``n_chars`` characters, from a prefix table."""
    return int(np.frombuffer(table, np.int8)[:n_chars].sum(dtype=np.int64))


def truncated(docs: DataFrame, tokenizer: str, budget: int, column: str = "text") -> DataFrame:
    """``docs`` with ``column`` cut to its longest prefix of at most ``budget`` tokens, row by row (null: empty)."""
    at = docs.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in sliced(batches, column):
            texts = texts_of(batch, column)
            counts, bounds = count(texts)
            fits = [np.flatnonzero(counts[a:b] <= budget) for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
            cut = pa.array([t[: int(f[-1]) + 1] if len(f) else "" for t, f in zip(texts, fits)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], cut, *batch.columns[at + 1 :]], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op2(docs: DataFrame, tokenizer: str) -> DataFrame:
    counted = with_prefix_counts(docs, tokenizer, LIMIT, keep_table=False)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "budget_chars")
