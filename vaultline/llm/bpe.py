"""BPE encoding and decoding, long unsplit pieces by tree concatenation.

A piece is a text's stretch that no merge leaves. Short pieces are encoded at once. A long piece is cut in leaves, which are
encoded each by itself; neighbours are then joined pairwise, level by level: the tokens around the join are encoded again as one
window, which doubles until its first token is the left side's own and its last the right side's own. Adjacent tokens that fit
pairwise are the encoding of their text, and the two common tokens carry the fit across both borders.

A piece of over ``leaf`` characters is such a tree inside its batch. In a text of over ``long_text`` characters, pieces of over
``long_leaf`` characters are dealt out leaf by leaf as rows, so that halves are encoded in parallel on all executors, and each
level of the tree is one join of the table of encoded stretches with itself; only the last step brings a text's ids together.
Such texts are found in the pass that encodes all others; where there are none, texts are read once and nothing else follows.

Cases: a null or empty text gives no ids and decodes to the empty text; text of any length is used
whole; rows are independent, so repeated rows repeat their result, and extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from vaultline.llm.pieces import Encoder, Split, Vocabulary, vocabulary
from vaultline.llm.shared import sliced, texts_of, written

LEAF = 256
LONG_TEXT, LONG_LEAF = 1 << 16, 1 << 14


def joined(vocab: Vocabulary, left: list[int], right: list[int]) -> list[int]:
    """The encoding of two neighbouring stretches of one piece, from their own encodings."""
    if not left or not right:
        return left or right
    size = 2
    while True:
        tail, head = min(size, len(left)), min(size, len(right))
        while tail < len(left) and vocab.bytes[left[-tail]][0] & 0xC0 == 0x80:
            tail += 1  # the window has to be whole characters
        while head < len(right) and vocab.bytes[right[head]][0] & 0xC0 == 0x80:
            head += 1
        window = b"".join(vocab.bytes[t] for t in (*left[-tail:], *right[:head])).decode()
        ids = vocab.encode_many([window])[0]
        whole = tail == len(left), head == len(right)
        if (whole[0] or ids[0] == left[-tail]) and (whole[1] or ids[-1] == right[head - 1]):
            return left[:-tail] + ids + right[head:]
        size *= 2


def tree_concat(vocab: Vocabulary, pieces: list[str], leaf: int = LEAF) -> list[list[int]]:
    """The ids of each piece; those over ``leaf`` characters by halves that are encoded side by side."""
    leaves = [[p[i : i + leaf] for i in range(0, len(p), leaf)] or [""] for p in pieces]
    coded = iter(vocab.encode_many([x for own in leaves for x in own]))
    out = []
    for own in leaves:
        level = [next(coded) for _ in own]
        while len(level) > 1:
            pairs = [joined(vocab, a, b) for a, b in zip(level[::2], level[1::2])]
            level = pairs + level[len(pairs) * 2 :]
        out.append(level[0])
    return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path, tree_concat)


def encoded_batches(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[tuple[pa.RecordBatch, list[list[int]]]]:
    encode = encoder(tokenizer)
    for batch in sliced(batches):
        ids, bounds = encode(texts_of(batch))
        bounds = bounds.tolist()
        yield batch, [ids[a:b] for a, b in zip(bounds, bounds[1:])]


STRETCH = "row long, part int, leaf long, ids array<int>"


def stretches(texts: DataFrame, tokenizer: str, long_leaf: int) -> DataFrame:
    """row, part, leaf and text: a text (row, text) in parts, each either a long piece in leaves or all that stands between two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(tokenizer)
        for batch in sliced(batches):
            out = []
            for row, text in zip(batch.column(0).to_pylist(), texts_of(batch)):
                split = Split(vocab, [text])
                cuts = [(int(a), int(b)) for a, b in zip(split.starts, split.ends) if b - a > long_leaf]
                at = part = 0
                for a, b in [*cuts, (len(text), len(text))]:
                    if a > at:
                        out.append((row, part, 0, text[at:a]))
                    out += [(row, part + 1, k, text[i : min(b, i + long_leaf)]) for k, i in enumerate(range(a, b, long_leaf))]
                    at, part = b, part + 2
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.string()))], ["row", "part", "leaf", "text"])

    return texts.select("row", "text").mapInArrow(run, "row long, part int, leaf long, text string")


def encoded_stretches(parts: DataFrame, tokenizer: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids in encoded_batches(batches, tokenizer):
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.list_(pa.int32()))], ["row", "part", "leaf", "ids"])

    return parts.mapInArrow(run, STRETCH)


def next_level(level: DataFrame, tokenizer: str) -> DataFrame:
    """Neighbouring stretches of one piece joined pairwise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(tokenizer)
        for batch in batches:
            ids = [x if y is None else joined(vocab, x, y) for x, y in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.list_(pa.int32()))], ["row", "part", "leaf", "ids"])

    half = lambda odd, name: level.where(F.col("leaf") % 2 == odd).select("row", "part", (F.col("leaf") - odd).alias("at"), F.col("ids").alias(name))
    pairs = half(0, "x").join(half(1, "y"), ["row", "part", "at"], "left")
    return pairs.select("row", "part", (F.col("at") / 2).cast("long").alias("leaf"), "x", "y").mapInArrow(run, STRETCH)


def long_ids(texts: DataFrame, tokenizer: str, long_leaf: int) -> DataFrame:
    """row and ids of long texts (row, text), encoded leaf by leaf."""
    dealt = stretches(texts, tokenizer, long_leaf)
    level = written(encoded_stretches(dealt.repartition("row", "part", "leaf"), tokenizer), "leaves")
    most = level.agg(F.max("leaf")).first()[0] or 0
    while most > 0:
        level, most = written(next_level(level, tokenizer), "level"), most // 2
    parts = F.array_sort(F.collect_list(F.struct("part", "ids")))
    return level.groupBy("row").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))


def in_one_pass(docs: DataFrame, tokenizer: str, columns: Callable[[Vocabulary, list[list[int]]], list[pa.Array]], schema: str, long_text: int, long_leaf: int) -> DataFrame:
    """doc_id and ``columns`` (of ``schema``) of every text. The pass that encodes the texts also finds those with a piece to be
    dealt out, and writes these as they are; only if there are any, the long way follows, from what was written."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in sliced(batches):
            texts = texts_of(batch)
            split = Split(coder.vocab, texts)
            late = (split.longest() > long_leaf) & (np.diff(split.text_bounds) > long_text)
            if late.any():
                split = Split(coder.vocab, ["" if x else t for t, x in zip(texts, late)])
            ids, bounds = coder.of(split)
            own = columns(coder.vocab, [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])])
            yield pa.RecordBatch.from_arrays([batch.column(0), *own, pa.array([t if x else None for t, x in zip(texts, late)], pa.string())], ["doc_id", *names, "late"])

    def of_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(tokenizer)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns(vocab, batch.column(1).to_pylist())], ["doc_id", *names])

    n_late = Observation()
    first = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, {schema}, late string")
    first = written(first.observe(n_late, F.count("late").alias("n")), "encoded")
    if not n_late.get["n"]:
        return first.drop("late")
    texts = written(first.where("late is not null").select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("late").alias("text")), "long")
    long = texts.select("row", "doc_id").join(long_ids(texts, tokenizer, long_leaf), "row").select("doc_id", "ids").mapInArrow(of_ids, f"doc_id long, {schema}")
    return first.where("late is null").drop("late").unionByName(long)


def encode(docs: DataFrame, tokenizer: str, long_text: int = LONG_TEXT, long_leaf: int = LONG_LEAF) -> DataFrame:
    """doc_id, n_tokens and ids (array of int) of every whole text."""
    columns = lambda vocab, lists: [pa.array([len(x) for x in lists], pa.int64()), pa.array(lists, pa.list_(pa.int32()))]
    return in_one_pass(docs, tokenizer, columns, "n_tokens long, ids array<int>", long_text, long_leaf)


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and text of rows with ``ids``; bytes that are no UTF-8 become U+FFFD; null ids, the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = encoder(tokenizer).vocab
        for batch in batches:
            texts = [decoded(vocab, ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def decoded(vocab: Vocabulary, ids: list[int]) -> str:
    return b"".join(map(vocab.bytes.__getitem__, ids)).decode("utf-8", "replace")


def digests(vocab: Vocabulary, lists: list[list[int]]) -> list[pa.Array]:
    digest = lambda raw: hashlib.sha256(raw).hexdigest()
    return [
        pa.array([len(x) for x in lists], pa.int64()),
        pa.array([digest(",".join(map(str, x)).encode()) for x in lists], pa.string()),
        pa.array([digest(decoded(vocab, x).encode()) for x in lists], pa.string()),
    ]


def op7(docs: DataFrame, tokenizer: str, long_text: int = LONG_TEXT, long_leaf: int = LONG_LEAF) -> DataFrame:
    return in_one_pass(docs, tokenizer, digests, "n_tokens long, ids_sha256 string, decoded_sha256 string", long_text, long_leaf)
