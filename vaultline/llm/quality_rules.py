"""Quality rules: a learned, ordered list of threshold conjunctions over text statistics.

Sequential covering: a rule for low quality is grown condition by condition (the one of greatest FOIL gain),
then cut back on labelled rows that did not grow it; a rule that stays precise there joins the list,
the rows it covers go, and the next rule is grown. The list becomes one ``CASE WHEN`` expression
whose branches are tried in order, and it ends in "keep".

Statistics cover all documents. Rules are fitted on the driver from at most ``max_labelled`` labelled rows
(chosen by a hash of doc_id), so what the driver holds is bounded by that parameter.

Cases: null and empty texts have no words and fail the base rule; labels that are null or belong to no
document are ignored, of a document's several labels the best counts; without labels of both
kinds the list is empty and only the base rule rejects; repeated rows repeat their result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaultline.llm.shared import RangeHash, mix, sliced, texts_of, words_of, written

MAX_LABELLED = 20_000
REPEAT_WINDOW = 8
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaim", "n_digits", "n_echo_words")
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True


def statistics(texts: list[str]) -> dict[str, np.ndarray]:
    """One array per name in STATISTICS, a value for each text."""
    hashes, _, _, bounds = words_of(texts)
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    cuts = np.concatenate(([0], np.cumsum(np.array([len(r) + 1 for r in raw], np.int64))))
    per_text = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[cuts])
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    out = {
        "n_words": np.diff(bounds),
        "word_chars": per_text(~gap & (data & 0xC0 != 0x80)),
        "n_symbols": per_text(_SYMBOLS[data]),
        "n_dup_lines": np.array([repeated_lines(t) for t in texts], np.int64),
        "n_repeat_words": repeated_words(hashes, bounds),
        "n_lines": per_text(data == 10),
        "n_upper": per_text((data >= 65) & (data <= 90)),
        "n_exclaim": per_text(data == 33),
        "n_digits": per_text((data >= 48) & (data <= 57)),
        "n_echo_words": echoed_words(hashes, bounds),
    }
    return {k: v.astype(np.int64) for k, v in out.items()}


def repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def repeated_words(hashes: np.ndarray, bounds: np.ndarray, size: int = REPEAT_WINDOW) -> np.ndarray:
    """Words of each text inside windows of ``size`` words that its text has twice or more."""
    n = len(hashes)
    if n < size:
        return np.zeros(len(bounds) - 1, np.int64)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    first = np.arange(n - size + 1)
    first = first[owner[first] == owner[first + size - 1]]
    keys = RangeHash(hashes).of(first, first + size) ^ mix(owner[first].astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(first), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, first[twice], 1)
    np.add.at(change, first[twice] + size, -1)
    hit = np.concatenate(([0], np.cumsum(np.cumsum(change[:-1]) > 0)))
    return np.diff(hit[bounds])


def echoed_words(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Words of each text that equal the word before them."""
    echo = np.zeros(len(hashes) + 1, np.int64)
    echo[2:] = np.cumsum(hashes[1:] == hashes[:-1]) if len(hashes) else 0
    first = np.minimum(bounds[:-1] + 1, bounds[1:])
    return echo[bounds[1:]] - echo[first]


def with_statistics(docs: DataFrame, keep: list[str], prefix: str = "") -> DataFrame:
    """Columns ``keep`` of ``docs`` and the statistics of its ``text``, named with ``prefix``."""
    fields = [docs.schema[c] for c in keep] + [T.StructField(prefix + s, T.LongType()) for s in STATISTICS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = statistics(texts_of(batch))
            columns = [batch.column(i) for i in range(len(keep))] + [pa.array(found[s]) for s in STATISTICS]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    asked = keep if "text" in keep else [*keep, "text"]
    return docs.select(*asked).mapInArrow(run, T.StructType(fields))


#: What rules may test: ratios of the statistics, as (numerator, denominator).
FEATURES = {
    "words": ("n_words", None),
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "repeated_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "upper_share": ("n_upper", "word_chars"),
    "exclaim_per_word": ("n_exclaim", "n_words"),
    "digit_share": ("n_digits", "word_chars"),
    "echo_share": ("n_echo_words", "n_words"),
}


def feature(name: str, prefix: str = "") -> Column:
    top, below = FEATURES[name]
    value = F.col(prefix + top).cast("double")
    return value if below is None else value / F.greatest(F.col(prefix + below), F.lit(1)).cast("double")


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.at_least else x[self.feature] <= self.threshold

    def column(self, prefix: str = "") -> Column:
        value = feature(self.feature, prefix)
        return value >= F.lit(self.threshold) if self.at_least else value <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    return np.logical_and.reduce([c.holds(x) for c in rule])


def grow(x: dict[str, np.ndarray], bad: np.ndarray, alive: np.ndarray, longest: int, cuts: int) -> Rule:
    rule: list[Condition] = []
    inside = alive.copy()
    while len(rule) < longest and (inside & ~bad).any():
        p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
        best, best_gain = None, 1e-9
        for name in sorted(x):
            for t in np.unique(np.quantile(x[name][inside], np.linspace(0, 1, cuts))).tolist():
                for at_least in (True, False):
                    c = Condition(name, at_least, t)
                    ok = c.holds(x) & inside
                    p = int((ok & bad).sum())
                    n = int(ok.sum()) - p
                    if p:
                        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if gain > best_gain:
                            best, best_gain = c, gain
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x)
    return tuple(rule)


def prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray, alive: np.ndarray) -> Rule:
    def worth(r: Rule) -> tuple[float, int]:
        ok = covers(r, x) & alive
        p = int((ok & bad).sum())
        n = int(ok.sum()) - p
        return ((p - n) / (p + n) if p + n else -1.0, -len(r))

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=worth)


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.97, least: int = 3, longest: int = 4, cuts: int = 96, most: int = 16) -> list[Rule]:
    """Ordered rules for ``bad`` rows. Every third row prunes and judges, the others grow."""
    held = np.arange(len(bad)) % 3 == 2
    alive = np.ones(len(bad), bool)
    rules: list[Rule] = []
    while len(rules) < most and (alive & bad & ~held).sum() >= least:
        rule = grow(x, bad, alive & ~held, longest, cuts)
        if not rule:
            break
        rule = prune(rule, x, bad, alive & held)
        hit = covers(rule, x) & alive
        judged = hit & held
        if (hit & bad).sum() < least or (hit & bad).sum() < precision * hit.sum() or (judged & bad).sum() < precision * judged.sum():
            break
        rules.append(rule)
        alive &= ~hit
    return rules


def sample(labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """At most ``max_labelled`` labelled doc_ids with their quality, chosen by a hash of doc_id where there are more."""
    best = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("_quality"))
    n = best.count()
    if n <= max_labelled:
        return best
    share = int(0.95 * max_labelled / n * (1 << 30))
    return best.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share).limit(max_labelled)


def fit(stats: DataFrame, chosen: DataFrame) -> list[Rule]:
    """Rules from statistics (with doc_id) and the sample of labels (quality 0 is low), for what the base rule passes. Of rows that
    share a doc_id the least statistics count."""
    features = [feature(f).alias(f) for f in FEATURES]
    known = stats.where(~base_failed()).join(F.broadcast(chosen), "doc_id")
    labelled = known.groupBy("doc_id").agg(F.min(F.struct((F.col("_quality") == 0).alias("_bad"), *features)).alias("x")).select("doc_id", "x.*")
    rows = sorted(labelled.collect(), key=lambda r: (r["doc_id"] * 0x9E3779B97F4A7C15) % (1 << 64))
    bad = np.array([r["_bad"] for r in rows], bool)
    if bad.all() or not bad.any():
        return []
    return learn({f: np.array([r[f] for r in rows], float) for f in FEATURES}, bad)


def base_failed(prefix: str = "") -> Column:
    words = F.col(prefix + "n_words")
    return (words < 20) | (100 * F.col(prefix + "n_repeat_words") > 30 * words)


def verdict(rules: list[Rule], prefix: str = "") -> Column:
    """True where a document is kept: the base rule, then the list's branches in order, then keep."""
    chain = F.when(base_failed(prefix), F.lit(False))
    for rule in rules:
        test = rule[0].column(prefix)
        for c in rule[1:]:
            test &= c.column(prefix)
        chain = chain.when(test, F.lit(False))
    return chain.otherwise(F.lit(True))


def op3(docs: DataFrame, labels: DataFrame) -> DataFrame:
    stats = written(with_statistics(docs.select(F.col("doc_id").cast("long"), "text"), ["doc_id"]), "statistics")
    rules = fit(stats, sample(labels))
    return stats.select("doc_id", *STATISTICS[:5], base_failed().alias("base_failed"), verdict(rules).alias("kept"))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that the rules reject; only labelled ones have their statistics computed twice."""
    prefix = "_quality_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    chosen = sample(labels)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    judged = with_statistics(docs, docs.columns, prefix)
    return judged.where(verdict(fit(with_statistics(known, ["doc_id"]), chosen), prefix)).select(*docs.columns)
