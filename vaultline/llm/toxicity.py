"""Toxicity by two Kneser-Ney models of the symbols in words, one of toxic and one of ordinary texts.

A word, in lower case, is a run of UTF-8 bytes between two boundary symbols; its likelihood is the product of its symbols', each after
up to five symbols before it within the word. So an insult is known in its inflected and misspelt forms, words that no labelled text has
are weighed by their parts, and no group of the model has over 256 rows (a context's symbols, or a suffix's extensions by one byte).

A class's own counts are those of its longest contexts, in texts, less an absolute discount of one text: what a single text says, which
may be mislabelled or the one being judged, is left to the shared counts. The discounted mass goes to one chain of shorter contexts
that both classes share, of continuation counts (in how many longer contexts a symbol follows), discounted by their numbers of ones
and twos. What neither class has seen after a context differs in that mass alone, and the shared chain is only needed for what was seen.

The log-likelihood ratio of a text's words is normalised by length in three ways: a symbol over the whole text, a word over the worst
8 consecutive words, and the worst word by itself, since abuse in a long text is short. A logistic regression makes one score of them.

Rows whose crc32(doc_id) mod 5 is 0 teach nothing; 2, 3 and 4 teach the models (every labelled row; of equal texts with equal labels one), 1 the
regression, whose 4 weights are fitted on at most MAX_LABELLED of those rows, chosen by a hash of doc_id.

The model is broadcast where its rows, which are counted, are at most MOST_ROWS; a larger one is joined with the distinct words instead.
Both ways give the same scores but for the order of sums.

Cases: null and empty texts have no words, all three values 0 and a score of their own; labels that are null are no labels, of several labels of
one doc_id the greatest counts; null doc_ids have no label and aren't held out; repeated rows are scored each; with no label of a class the score
is the share of toxic labels, smoothed; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultline.llm.shared import ragged, sliced, texts_of, words_of, written

#: Symbols of an n-gram: five of context and the one that follows.
ORDER = 6
WINDOW = 8
MAX_LABELLED = 20_000
#: Rows of a broadcast model, of 12 bytes each.
MOST_ROWS = 4_000_000
#: Rows of a broadcast list of labelled texts, of about 24 bytes each.
MOST_LESSONS = 200_000
#: Counts that a task adds up before it passes them on.
HELD_ROWS = 1_000_000
BOUNDARY = 0x20
FEATURES = "per_symbol", "worst_window", "worst_word"


class Words:
    """The words of some texts: which are equal, and each one's symbols."""

    def __init__(self, texts: list[str]):
        lowered = [t.lower() for t in texts]
        hashes, starts, ends, self.bounds = words_of(lowered)
        self.hashes, first, self.kind = np.unique(hashes, return_index=True, return_inverse=True)
        self.data = np.frombuffer(b"\n" + b"\n".join(t.encode() for t in lowered) + b"\n", np.uint8)
        self.starts, self.lengths = starts[first], (ends - starts)[first]

    def spelled(self) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a + 1 : a + 1 + n] for a, n in zip(self.starts.tolist(), self.lengths.tolist())]

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        return grams(self.data, self.starts, self.lengths)


def grams(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of words that follow a separator and precede one (``starts`` don't count the first byte of ``data``): n-gram and word.

    Its bytes make one integer, the last symbol lowest; one at the start of a word has fewer bytes, the first of which is the boundary.
    """
    size = lengths + 2
    symbols = np.maximum(data[ragged(starts, size)], 1).astype(np.int64)
    ends = np.cumsum(size)
    symbols[ends - 1] = symbols[ends - size] = BOUNDARY
    word = np.repeat(np.arange(len(size)), size)
    at = ragged(np.zeros(len(size), np.int64), size)
    keys = symbols.copy()
    for k in range(1, ORDER):
        keys[k:] |= np.where(at[k:] >= k, symbols[:-k], 0) << (8 * k)
    return keys[at > 0], word[at > 0]


def distinct(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of two arrays, b below ``size``."""
    return np.divmod(np.unique(a.astype(np.int64) * max(size, 1) + b), max(size, 1))


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id, toxic and fold (crc32 mod 5) of the rows that may teach."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    return known.withColumn("fold", fold()).where("fold > 0")


def fold() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def counts(docs: DataFrame, known: DataFrame) -> DataFrame:
    """gram, toxic, ordinary: in how many labelled texts of a class each n-gram occurs; equal texts with equal labels are one."""
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
    lessons = texts.select("doc_id", "hash").join(known.where("fold > 1"), "doc_id")
    lessons = written(lessons.groupBy("hash", "toxic").agg(F.min("doc_id").alias("doc_id")), "lessons")
    if lessons.count() <= MOST_LESSONS:
        lessons = F.broadcast(lessons)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows: gram, toxic, ordinary

        def summed() -> np.ndarray:
            rows = np.concatenate(held, axis=1)
            kinds, which = np.unique(rows[0], return_inverse=True)
            return np.stack([kinds, *(np.bincount(which, weights=r, minlength=len(kinds)).astype(np.int64) for r in rows[1:])])

        for batch in sliced(batches):
            words = Words(texts_of(batch))
            gram, word = words.grams()
            kinds, which = np.unique(gram, return_inverse=True)
            own = np.bincount(word, minlength=len(words.hashes))
            text, kind = distinct(np.repeat(np.arange(batch.num_rows), np.diff(words.bounds)), words.kind, len(own))
            places = ragged((np.cumsum(own) - own)[kind], own[kind])
            text, one = distinct(np.repeat(text, own[kind]), which[places], len(kinds))
            toxic = batch.column(1).to_numpy()[text] > 0
            held.append(np.stack([kinds, *(np.bincount(one[toxic == c], minlength=len(kinds)) for c in (True, False))]))
            if sum(h.shape[1] for h in held) > HELD_ROWS:
                held = [summed()]
                if held[0].shape[1] > HELD_ROWS // 2:
                    yield pa.record_batch(list(map(pa.array, held.pop())), ["gram", "toxic", "ordinary"])
        if held:
            yield pa.record_batch(list(map(pa.array, summed())), ["gram", "toxic", "ordinary"])

    each = texts.join(lessons, ["doc_id", "hash"]).select("text", "toxic").mapInArrow(counted, "gram long, toxic long, ordinary long")
    return written(each.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")), "grams")


def level(gram: Column) -> Column:
    """The symbols of an n-gram's context."""
    return reduce(lambda a, k: a + (gram >= 1 << 8 * k).cast("int"), range(1, ORDER), F.lit(0))


def shorter(gram: Column, of: Column) -> Column:
    """The n-gram, whose context has ``of`` symbols, without its first."""
    return gram.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), of * 8) - 1)


def chain(gram: Column, of: Column, least: int) -> Column:
    """The n-gram and its suffixes down to a context of ``least`` symbols."""
    steps = F.sequence(of, F.lit(least), F.lit(-1))
    return F.transform(steps, lambda k: shorter(gram, k + 1))


def discount(ones: int | None, twos: int | None) -> float:
    """The absolute discount by the numbers of n-grams that occur once and twice."""
    return ones / (ones + 2 * (twos or 0)) * 0.98 + 0.01 if ones else 0.5


def model(gram_counts: DataFrame) -> DataFrame:
    """key, ratio: the log-likelihood ratio (toxic to ordinary) of each n-gram seen, and of any other symbol after its context
    (the key of symbol 0). Contexts not seen have the ratio 0."""
    top = gram_counts.withColumn("level", level(F.col("gram")))
    longer = top.where("level > 0").select(F.explode(chain(F.col("gram"), F.col("level"), 1)).alias("longer")).distinct()
    low = longer.groupBy(shorter(F.col("longer"), level(F.col("longer"))).alias("low")).agg(F.count("*").alias("c"))
    low = low.withColumns({"at": level(F.col("low")), "context": F.shiftright("low", 8)})
    own = Window.partitionBy("at", "context")
    low = written(low.select("low", "at", "c", F.sum("c").over(own).alias("n"), F.count("*").over(own).alias("kinds")), "continuations")
    ones = lambda c: F.count_if(F.col(c) == 1)
    twos = lambda c: F.count_if(F.col(c) == 2)
    shared = {r["at"]: discount(r["a"], r["b"]) for r in low.groupBy("at").agg(ones("c").alias("a"), twos("c").alias("b")).collect()}
    cut = {"toxic": 1.0, "ordinary": 1.0}
    cuts = F.array(*(F.lit(shared.get(k, 0.5)) for k in range(ORDER)))
    known = top.select("gram", F.explode(chain(shorter(F.col("gram"), F.col("level")), F.col("level") - 1, 0)).alias("low")).join(low, "low")
    steps = known.groupBy("gram").agg(F.array_sort(F.collect_list(F.struct("at", "c", "n", "kinds"))).alias("steps"))
    down = F.aggregate("steps", F.lit(1 / 257), lambda p, s: (F.greatest(s["c"] - cuts[s["at"]], F.lit(0.0)) + cuts[s["at"]] * s["kinds"] * p) / s["n"])
    after = Window.partitionBy("context")
    both = top.withColumn("context", F.shiftright("gram", 8)).join(steps.select("gram", down.alias("shared")), "gram")
    both = both.withColumns({f"n_{k}": F.sum(k).over(after) for k in cut} | {f"kinds_{k}": F.count_if(F.col(k) > 0).over(after) for k in cut})

    def left(k: str) -> Column:
        return F.when(F.col(f"n_{k}") > 0, cut[k] * F.col(f"kinds_{k}") / F.col(f"n_{k}")).otherwise(1.0)

    def chance(k: str) -> Column:
        return F.when(F.col(f"n_{k}") > 0, F.greatest(F.col(k) - cut[k], F.lit(0.0)) / F.col(f"n_{k}")).otherwise(0.0) + left(k) * F.col("shared")

    seen = both.select(F.col("gram").alias("key"), F.log(chance("toxic") / chance("ordinary")).cast("float").alias("ratio"))
    others = both.groupBy(F.shiftleft("context", 8).alias("key")).agg(F.first(F.log(left("toxic") / left("ordinary"))).cast("float").alias("ratio"))
    return written(seen.unionByName(others), "model")


def word_features(ratios: np.ndarray, sizes: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The three values of each text from its words' log-likelihood ratios and numbers of symbols."""
    n = np.diff(bounds)
    sums, symbols = np.concatenate(([0.0], np.cumsum(ratios))), np.concatenate(([0], np.cumsum(sizes)))
    per_symbol = (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(symbols[bounds[1:]] - symbols[bounds[:-1]], 1)
    worst_word, worst_window = np.zeros(len(n)), np.zeros(len(n))
    full = np.flatnonzero(n)
    if len(full):
        worst_word[full] = np.maximum.reduceat(ratios, bounds[:-1][full])
        width = np.minimum(n[full], WINDOW)
        windows = n[full] - width + 1
        starts = ragged(bounds[:-1][full], windows)
        means = (sums[starts + np.repeat(width, windows)] - sums[starts]) / np.repeat(width, windows)
        worst_window[full] = np.maximum.reduceat(means, np.cumsum(windows) - windows)
    return [per_symbol, worst_window, worst_word]


def by_broadcast(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id and FEATURES of every row; the model's sorted keys and ratios are broadcast."""
    table = rows.toArrow().combine_chunks()
    order = np.argsort(keys := table["key"].to_numpy())
    sent = docs.sparkSession.sparkContext.broadcast((keys[order], table["ratio"].to_numpy()[order].astype(np.float32)))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ratios = sent.value

        def found(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
            return keys[at] == gram, ratios[at]

        for batch in sliced(batches):
            words = Words(texts_of(batch))
            gram, word = words.grams()
            kinds, which = np.unique(gram, return_inverse=True)
            value = np.zeros(len(kinds))
            if len(keys):
                hit, ratio = found(kinds)
                other, default = found(kinds >> 8 << 8)
                value = np.where(hit, ratio, np.where(other, default, 0.0))
            per_word = np.bincount(word, weights=value[which], minlength=len(words.hashes))
            features = word_features(per_word[words.kind], (words.lengths + 1)[words.kind], words.bounds)
            yield pa.record_batch([batch.column(0), *map(pa.array, features)], ["doc_id", *FEATURES])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scored, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


def by_join(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The same for a model of any size: distinct words meet the model by their n-grams, then every place of a text its word."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            words = Words(texts_of(batch))
            n = np.diff(words.bounds)
            text, none = np.repeat(np.arange(len(n)), n), np.flatnonzero(n == 0)  # a text without words keeps one row
            rows = pa.array(np.append(text, none))
            place, word, size = ragged(np.zeros(len(n), np.int64), n), words.hashes[words.kind].view(np.int64), (words.lengths + 1)[words.kind]
            more = [pa.array(np.append(x, np.zeros(len(none), np.int64))) for x in (place, word, size)]
            yield pa.record_batch([batch.column(0).take(rows), batch.column(1).take(rows), *more], ["row", "doc_id", "place", "word", "size"])

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            words = Words(texts_of(batch))
            yield pa.record_batch([pa.array(words.hashes.view(np.int64)), pa.array(words.spelled(), pa.binary())], ["word", "spelled"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "spelled"):
            raw, size = batch.column(1).to_pylist(), np.array([len(w) for w in batch.column(1).to_pylist()], np.int64)
            data = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", np.uint8)
            gram, word = grams(data, np.cumsum(size + 1) - size - 1, size)
            yield pa.record_batch([batch.column(0).take(pa.array(word)), pa.array(gram)], ["word", "gram"])

    spelled = docs.select("text").mapInArrow(kinds, "word long, spelled binary").dropDuplicates(["word"])
    grams_ = spelled.mapInArrow(parts, "word long, gram long")
    other = rows.select(F.col("key").alias("rest"), F.col("ratio").alias("default"))
    met = grams_.join(rows, F.col("gram") == F.col("key"), "left").join(other, F.shiftleft(F.shiftright("gram", 8), 8) == F.col("rest"), "left")
    per_word = met.groupBy("word").agg(F.sum(F.coalesce("ratio", "default", F.lit(0.0)).cast("double")).alias("ratio"))
    # rows are numbered in one scan, whose numbers are not asked for again: another might number them otherwise
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    valued = numbered.mapInArrow(places, "row long, doc_id long, place long, word long, size long").join(per_word, "word", "left").fillna(0.0, ["ratio"])
    line = Window.partitionBy("row").orderBy("place")
    here = line.rowsBetween(0, WINDOW - 1)
    windows = valued.withColumns({"mean": F.avg("ratio").over(here), "n": F.count("*").over(here)})
    whole = (F.col("n") == WINDOW) | (F.col("place") == 0)
    values = (F.sum("ratio") / F.greatest(F.sum("size"), F.lit(1))), F.max(F.when(whole, F.col("mean"))), F.max("ratio")
    return windows.groupBy("row", "doc_id").agg(*(v.alias(f) for v, f in zip(values, FEATURES))).select("doc_id", *FEATURES)


def regression(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression by Newton steps, the weights of scaled columns held by a ridge."""
    share = (y.sum() + 1) / (len(y) + 2)
    constant = np.zeros(x.shape[1]), float(np.log(share / (1 - share)))
    if y.all() or not y.any():
        return constant
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    a = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    hold = np.diag([ridge] * x.shape[1] + [0.0])
    w = np.append(np.zeros(x.shape[1]), constant[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p) + 1e-9)[:, None]) + hold, a.T @ (y - p) - hold @ w)
        step *= min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        w += step
        if np.abs(step).max() < 1e-9:
            break
    weights = w[:-1] / scale
    return weights, float(w[-1] - weights @ centre)


def fitted(features: DataFrame, known: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, float]:
    chosen = known.where("fold = 1")
    n = chosen.count()
    if n > max_labelled:
        share = int(0.95 * max_labelled / n * (1 << 30))
        chosen = chosen.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share).limit(max_labelled)
    one = features.join(F.broadcast(chosen.select("doc_id", "toxic")), "doc_id").groupBy("doc_id").agg(F.max(F.struct("toxic", *FEATURES)).alias("r")).select("doc_id", "r.*")
    rows = np.array([tuple(r) for r in one.orderBy("doc_id").collect()], float).reshape(-1, 2 + len(FEATURES))
    return regression(rows[:, 2:], rows[:, 1] > 0)


def scores(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, FEATURES and score of every row."""
    known = written(labelled(labels), "labels")
    rows = model(counts(docs, known))
    features = written((by_broadcast if rows.count() <= most_rows else by_join)(docs, rows), "features")
    weights, start = fitted(features, known)
    total = reduce(lambda a, x: a + F.col(x[0]) * float(x[1]), zip(FEATURES, weights), F.lit(start))
    return features.withColumn("score", 1 / (1 + F.exp(-total)))


def op11(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = F.coalesce(fold() == 0, F.lit(False))
    return scores(docs, labels).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
