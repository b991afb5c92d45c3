import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from rows import by_id

from vaultline.llm import toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, toxic string, fold string, row string, word string"
INSULTS = "zorgwit", "Plumpfkopf", "naïve", "drumlo"


def word(rnd):
    return "".join(rnd.choice(["ka", "lo", "mi", "tre", "sun", "pé", "日", "ve"]) for _ in range(rnd.randint(1, 3)))


@pytest.fixture(scope="module")
def made(spark):
    """Texts of invented words; toxic ones hold insults, some among 300 other words; one text is copied often."""
    rnd, rows, toxic = random.Random(2), [], {}
    for i in range(400):
        words = [word(rnd) for _ in range(rnd.choice([5, 30, 300]))]
        if i % 4 == 0:
            for _ in range(max(2, len(words) // 40)):
                words.insert(rnd.randint(0, len(words)), rnd.choice(INSULTS))
            toxic[i] = 1
        else:
            toxic[i] = 0
        rows.append((i, " ".join(words)))
    rows += [(i, rows[5][1]) for i in range(400, 430)]
    toxic |= {i: 0 for i in range(400, 430)}
    odd = [(500, None), (501, ""), (502, " \t"), (None, "zorgwit and a null id"), (7, rows[7][1]), (503, "x" * 30_000)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "q", "q", "q", "q", "q") for i, t in rows + odd], DOCS).repartition(3)
    labels = spark.createDataFrame([(i, t, 1) for i, t in toxic.items()] + [(0, None, 1), (None, 1, 0), (500, 0, 1)], "doc_id long, toxic int, quality int")
    return docs, labels, rows, toxic


def brute_model(texts):
    """Kneser-Ney by dictionaries: (toxic, text) pairs to the log-likelihood ratio of a word."""
    top = {1: defaultdict(Counter), 0: defaultdict(Counter)}
    for c, text in texts:
        spelled = [b" " + w.encode() + b" " for w in text.lower().split()]
        for h, x in {(s[max(0, i - 5) : i], s[i]) for s in spelled for i in range(1, len(s))}:
            top[c][h][x] += 1
    longer = {(h[j:], x) for c in top for h, row in top[c].items() for x in row for j in range(len(h))}
    low = defaultdict(Counter)
    for h, x in longer:
        low[h[1:]][x] += 1
    cut = lambda values: toxicity.discount(sum(v == 1 for v in values), sum(v == 2 for v in values))
    d = [cut([v for h, row in low.items() if len(h) == k for v in row.values()]) for k in range(5)]
    own = {1: 1.0, 0: 1.0}

    def shared(h, x):
        p = shared(h[1:], x) if h else 1 / 257
        n = sum(low[h].values()) if h in low else 0
        return (max(low[h][x] - d[len(h)], 0) + d[len(h)] * len(+low[h]) * p) / n if n else p

    def chance(c, h, x):
        n = sum(top[c][h].values()) if h in top[c] else 0
        return (max(top[c][h][x] - own[c], 0) + own[c] * len(+top[c][h]) * shared(h[1:], x)) / n if n else shared(h[1:], x)

    def ratio(w):
        s = b" " + w.lower().encode() + b" "
        return sum(math.log(chance(1, s[max(0, i - 5) : i], s[i]) / chance(0, s[max(0, i - 5) : i], s[i])) for i in range(1, len(s)))

    return ratio


def brute_features(ratio, text):
    words = (text or "").split()
    if not words:
        return 0.0, 0.0, 0.0
    r = [ratio(w) for w in words]
    k = min(8, len(r))
    return sum(r) / sum(len(w.lower().encode()) + 1 for w in words), max(sum(r[i : i + k]) / k for i in range(len(r) - k + 1)), max(r)


@pytest.mark.parametrize("most_rows", [toxicity.MOST_ROWS, 0])
def test_features_equal_brute_force(made, most_rows):
    docs, labels, rows, toxic = made
    teach = {(toxic[i], t) for i, t in rows if zlib.crc32(str(i).encode()) % 5 > 1}
    ratio = brute_model(teach)
    texts = dict(rows) | {500: None, 501: "", 502: " \t", 503: "x" * 30_000}
    got = toxicity.scores(docs, labels, most_rows).where("doc_id is not null").collect()
    assert len(got) == 400 + 30 + 5
    for r in got:
        assert np.allclose([r[f] for f in toxicity.FEATURES], brute_features(ratio, texts[r["doc_id"]]), rtol=1e-4, atol=1e-4), r["doc_id"]


def test_held_out_texts_are_judged_right(made):
    docs, labels, rows, toxic = made
    got = toxicity.op11(docs, labels).collect()
    assert len(got) == 436
    seen = {r["doc_id"]: r for r in got}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in seen.items() if r["held_out"]} == set(held) | {i for i in (500, 501, 502, 503) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(seen[i]["predicted"] == toxic[i] for i in held) >= len(held) - 1
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert [r["predicted"] for r in got if r["doc_id"] in (500, 501, 502)] == [0, 0, 0] and seen[None]["predicted"] == 1


def test_held_out_labels_teach_nothing(made):
    docs, labels, _, _ = made
    other = labels.withColumn("toxic", F.when(toxicity.fold() == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({i: r["score"] for i, r in by_id(toxicity.op11(docs, x)).items()} for x in (labels, other))
    assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-9 for i in a)


def test_no_labels_of_a_class(made, nothing):
    docs, labels, _, _ = made
    for known in (labels.where("toxic = 0"), labels.where("false")):
        out = toxicity.op11(docs, known).collect()
        assert len(out) == 436 and len({round(r["score"], 9) for r in out}) == 1 and {r["predicted"] for r in out} <= {0, 1}
    assert toxicity.op11(nothing.select("doc_id", "text"), labels).collect() == []


def test_counts_of_ngrams(spark):
    texts = [(1, "abra abba abra"), (0, "abracadabra cab"), (0, "bad")]
    gram_counts = toxicity.counts(
        spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string"),
        spark.createDataFrame([(i, c, 2) for i, (c, _) in enumerate(texts)], "doc_id long, toxic int, fold int"),
    )
    want = Counter()
    for c, t in texts:
        spelled = [b" " + w.encode() + b" " for w in t.split()]
        want.update({(int.from_bytes(s[max(0, i - 5) : i + 1]), c) for s in spelled for i in range(1, len(s))})
    got = Counter()
    for r in gram_counts.collect():
        for c, n in ((1, r["toxic"]), (0, r["ordinary"])):
            if n:
                got[r["gram"], c] = n
    assert got == want
