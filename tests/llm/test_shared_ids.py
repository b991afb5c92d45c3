"""Texts that share a doc_id: each row is judged by its own text."""

import hashlib
import random

import pytest

from vaultline.llm import substring_dedup, suffix_dedup


def words(rnd, n):
    return [f"w{rnd.randrange(10**6)}" for _ in range(n)]


def tables():
    rnd = random.Random(8)
    p = words(rnd, 80)
    rows = [(1, p), (5, [*words(rnd, 150), *p, *words(rnd, 20)]), (5, words(rnd, 60)), (5, words(rnd, 400))]
    q = words(rnd, 90)
    many = [(9, [*words(rnd, k * 7), *q, *words(rnd, 3 * k)]) for k in range(6)]
    yield rows
    yield [*rows[:3], (2, ["q", *p, "z"])]
    yield [*rows, (2, ["q", *p, "z"]), (5, [*p, *words(rnd, 9)]), (5, rows[1][1]), (None, p), (None, rows[1][1]), (5, None), (7, None), (7, p)]
    yield [*many, (9, q), (12, q), (8, q[5:70])]
    yield [((1 << 62) + i, w) for i, w in [*rows, (2, ["q", *p, "z"])]] + [(-(1 << 62), p[10:75])]


def expected(rows, size, symbols, joined):
    """By brute force: the numbers of symbols and of removed ones, and a hash of what is kept, of every row."""
    windows = [{tuple(s[i : i + size]) for i in range(len(s) - size + 1)} for s in (symbols(t) for _, t in rows)]
    out = []
    for doc, text in rows:
        s = symbols(text)
        known = set().union(*(w for (d, _), w in zip(rows, windows) if d is not None and doc is not None and d < doc))
        gone = [False] * len(s)
        for i in range(len(s) - size + 1):
            if tuple(s[i : i + size]) in known:
                gone[i : i + size] = [True] * size
        kept = [x for x, g in zip(s, gone) if not g]
        out.append((doc, len(s), sum(gone), hashlib.sha256(joined(kept)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", list(tables()), ids=["unlike", "short", "mixed", "copies", "wide"])
def test_each_row_by_its_own_text(spark, rows):
    texts = [(i, None if t is None else " ".join(t)) for i, t in rows]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, substring_dedup.op8(df).collect()), key=str)
    assert got == expected(texts, 50, lambda t: (t or "").split(), lambda kept: " ".join(kept).encode())
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in suffix_dedup.op9(df).collect()), key=str)
    assert got == expected(texts, 50, lambda t: list((t or "").encode()), bytes)
