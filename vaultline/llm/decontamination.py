"""Benchmark decontamination by Wu-Manber search over words.

Patterns are the 13-word windows of the benchmark items (an item of fewer words is one pattern). For
each pattern length, a shift table maps the last two words under the search window to how far it
may move without missing an occurrence; only a shift of zero leads to the bucket of patterns that end
in these two words, where the window is compared word for word. Words that stand in no pattern, nearly
all of a document's, move the window by its whole length.

The patterns of a benchmark of at most ``block_words`` words are broadcast. A larger one is cut in blocks of about that size
(very long items in overlapping segments), of which one at a time is on the driver and broadcast; the documents are numbered
once and stream past each block, which returns the rows with hits only. Either way every row has its own result.

Cases: null and empty texts have no words and are never contaminated; null items and items without words
match nothing; items without an id hit like others, count each and have no name; equal windows in several items count for each of them; rows that repeat, share a doc_id or have none
are judged each by their own text; an empty benchmark contaminates nothing; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultline.llm.shared import sliced, texts_of, written

WINDOW = 13
BLOCK_WORDS = 200_000
JUDGED = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
HITS = "row long, spans array<int>, items array<string>"

_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(b if b >= 128 or b in _KEPT else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words of digits, ASCII letters and all non-ASCII characters."""
    return text.encode().translate(_TABLE).split()


class WuManber:
    def __init__(self, items: Iterable[tuple[str, str | None]], window: int = WINDOW):
        sizes: dict[int, dict[bytes, tuple[str, ...]]] = {}
        for item, text in items:
            found = words(text or "")
            own = (item,)
            for i in range(max(1, len(found) - window + 1)) if found else ():
                part = found[i : i + window]
                known = sizes.setdefault(len(part), {})
                pattern = b" ".join(part)
                before = known.get(pattern, ())
                known[pattern] = before if item in before else before + own
        self.groups = []
        for size, owners in sorted(sizes.items()):
            block = min(2, size)
            far = size - block + 1
            shift: dict[bytes, int] = {}
            for pattern in owners:
                part = pattern.split(b" ")
                for end in range(block, size + 1):
                    key = b" ".join(part[end - block : end])
                    shift[key] = min(shift.get(key, far), size - end)
            self.groups.append((size, block, far, shift, owners))

    def search(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Occurrences as (first word, one past the last), and the items that they belong to."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        n = len(text)
        for size, block, far, shift, owners in self.groups:
            get = shift.get
            end = size
            while end <= n:
                step = get(text[end - 2] + b" " + text[end - 1] if block == 2 else text[end - 1], far)
                if step:
                    end += step
                    continue
                owner = owners.get(b" ".join(text[end - size : end]))
                if owner:
                    spans.append((end - size, end))
                    items.update(owner)
                end += 1
        return spans, items


def covered(spans: list[tuple[int, int]]) -> int:
    total = last = 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, last))
        last = max(last, b)
    return total


_made: dict[str, WuManber] = {}


class Search:
    """A broadcast block of items; a worker builds its matcher once and keeps the latest one."""

    def __init__(self, docs: DataFrame, items: list[tuple[str, str | None]], window: int):
        self.name, self.window = uuid.uuid4().hex, window
        self.items = docs.sparkSession.sparkContext.broadcast(items)

    def matcher(self) -> WuManber:
        if self.name not in _made:
            _made.clear()
            _made[self.name] = WuManber(self.items.value, self.window)
        return _made[self.name]


def judged(ids: pa.Array, n_words: list[int], spans: list[list[tuple[int, int]]], items: list[Iterable[str]]) -> pa.RecordBatch:
    n_hit = np.array([covered(x) for x in spans], np.int64)
    size = np.array(n_words, np.int64)
    own = [sorted(i[1:] for i in x if i[0] == "=") for x in items]
    columns = [
        ids,
        pa.array(size),
        pa.array(n_hit),
        pa.array([len(x) for x in items], pa.int64()),
        pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in own], pa.string()),
        pa.array((n_hit > 0) & (20 * n_hit >= size)),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def judged_texts(ids: pa.Array, texts: list[str], matcher: WuManber) -> pa.RecordBatch:
    found = [words(t) for t in texts]
    results = [matcher.search(w) for w in found]
    return judged(ids, [len(w) for w in found], [r[0] for r in results], [r[1] for r in results])


def in_one_pass(docs: DataFrame, search: Search) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield judged_texts(batch.column(0), texts_of(batch), search.matcher())

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, JUDGED)


def hits(rows: DataFrame, search: Search) -> DataFrame:
    """Of every row with hits the occurrences (flat pairs) and the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = [(row, *search.matcher().search(words(t))) for row, t in zip(batch.column(0).to_pylist(), texts_of(batch))]
            out = [r for r in out if r[1]]
            columns = [pa.array([r[0] for r in out], pa.int64()), pa.array([[x for span in r[1] for x in span] for r in out], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([list(r[2]) for r in out], pa.list_(pa.string()))], ["row", "spans", "items"])

    return rows.select("row", "text").mapInArrow(run, HITS)


def block_by_block(rows: DataFrame, blocks: Iterable[Search]) -> DataFrame:
    """``row`` and the result's columns of numbered rows (row, doc_id, text)."""
    each = []
    for search in blocks:
        each.append(written(hits(rows, search), "hits"))
        search.items.destroy()
    found = reduce(DataFrame.unionByName, each).groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            spans = [list(zip(x[::2], x[1::2])) if x else [] for x in batch.column(3).to_pylist()]
            out = judged(batch.column(1), [len(words(t)) for t in texts_of(batch)], spans, [x or () for x in batch.column(4).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), *out.columns], ["row", *out.schema.names])

    return rows.join(found, "row", "left").select("row", "doc_id", "text", "spans", "items").mapInArrow(run, f"row long, {JUDGED}")


def segments(benchmark: DataFrame, window: int, most: int) -> DataFrame:
    """item ("=" and its id, or "-" and a number), text and n_words; an item of over ``most`` words in segments that share
    ``window - 1`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            for item, text in zip(batch.column(0).to_pylist(), texts_of(batch)):
                own = words(text)
                for i in range(0, max(1, len(own) - window + 1), most) if own else ():
                    part = own[i : i + most + window - 1]
                    out.append((item, b" ".join(part).decode(), len(part)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["item", "text", "n_words"])

    item = F.coalesce(F.concat(F.lit("="), F.col("item_id").cast("string")), F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string")))
    return written(benchmark.select(item.alias("item"), "text").mapInArrow(run, "item string, text string, n_words long"), "items")


def searches(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int) -> tuple[int, Iterator[Search]]:
    """The number of blocks of the benchmark, and the blocks, each collected when its turn comes."""
    items = segments(benchmark, window, max(window, block_words // 8))
    n = items.agg(F.coalesce(F.sum("n_words"), F.lit(0)).cast("long")).first()[0]
    blocks = max(1, -(-n // block_words))
    block = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    return blocks, (Search(docs, [tuple(r) for r in items.where(block == b).select("item", "text").collect()], window) for b in range(blocks))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of ``docs``."""
    n, blocks = searches(docs, benchmark, window, block_words)
    if n == 1:
        return in_one_pass(docs, next(blocks))
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), "numbered")
    return block_by_block(rows, blocks).drop("row")


def op5(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs, benchmark)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the rows whose text is contaminated: in the same pass, or for a benchmark of several blocks by row numbers
    (few rows go, so that their numbers are joined and the others' texts stay where they are if the numbers are small enough)."""
    n, blocks = searches(docs, benchmark, window, block_words)
    if n == 1:
        search = next(blocks)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                verdict = judged_texts(pa.nulls(batch.num_rows, pa.int64()), texts_of(batch), search.matcher())
                yield batch.filter(pa.compute.invert(verdict.column(5)))

        return docs.mapInArrow(run, docs.schema)
    name = next(x for x in (f"_row{k}" for k in range(len(docs.columns) + 1)) if x not in docs.columns)
    rows = written(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    numbered = rows.select(F.col(name).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    gone = written(block_by_block(numbered, blocks).where("contaminated").select(F.col("row").alias(name)), "contaminated")
    return rows.join(gone, name, "left_anti").select(*docs.columns)
