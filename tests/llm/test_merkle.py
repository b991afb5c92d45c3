import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from vaultline.llm import merkle

FIELDS = "doc_id", "source", "lang", "n_chars", "text"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, **changed):
    values = [(row | changed)[f] for f in FIELDS]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(digests):
    """All levels, and each leaf's siblings as (left, right)."""
    levels = [digests]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i : i + 2]) for i in range(0, len(last), 2)])
    paths = []
    for i in range(len(digests)):
        path = []
        for k, level in enumerate(levels[:-1]):
            j = i >> k
            path.append((level[j - 1], "") if j % 2 else ("", level[j + 1] if j + 1 < len(level) else ""))
        paths.append(path)
    return levels, paths


def expected(rows):
    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r["lang"]].append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted(by_lang[lang], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        trees[lang] = own, *tree([leaf_of(r) for r in own])
    top, top_paths = tree([trees[x][1][-1][0] for x in langs])
    out = []
    for lang, above in zip(langs, top_paths):
        own, levels, paths = trees[lang]
        for r, path in zip(own, paths):
            whole = path + above
            tampered = r["doc_id"] is not None and r["n_chars"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            folded = leaf_of(r, n_chars=r["n_chars"] + 1) if tampered else leaf_of(r)
            for a, b in whole:
                folded = h(a, folded, b)
            root = top[-1][0]
            out.append((r["doc_id"], leaf_of(r), levels[-1][0], root, h(*(a + b for a, b in whole)), folded, folded == root))
    return out


def rows_of(df):
    return [r.asDict() for r in df.select(*FIELDS).collect()]


def got(df, levels=merkle.LEVELS):
    return sorted(map(tuple, merkle.op13(df, levels).collect()), key=str)


@pytest.mark.parametrize("levels", [1, 3, 8])
def test_equals_brute_force(docs, levels):
    langs = F.when(F.col("doc_id") % 11 == 0, None).when(F.col("doc_id") % 3 == 0, "é").when(F.col("doc_id") % 17 == 0, "").otherwise("en")
    mixed = docs.withColumn("lang", langs).withColumn("n_chars", F.when(F.col("doc_id") % 5 > 0, F.col("n_chars"))).withColumns({c: F.lit(1) for c in ("tree", "rank", "part", "tie", "digest", "n")})
    want = expected(rows_of(mixed))
    assert got(mixed, levels) == sorted(want, key=str)
    assert {v for *_, v in want} == {True, False}


def test_odd_tables(nothing, odd, spark):
    assert got(nothing) == []
    both = odd.unionByName(odd.withColumn("lang", F.lit(None).cast("string")).withColumn("text", F.lit(None).cast("string")))
    assert got(both) == sorted(expected(rows_of(both)), key=str)
    lone = spark.createDataFrame([(7, "s", "en", 1, "")], "doc_id long, source string, lang string, n_chars long, text string")
    assert got(lone) == expected(rows_of(lone))
    same = spark.createDataFrame([(3, "s", "en", 4, "copy")] * 700 + [(i, "s", "en", 1, "x") for i in range(300)], lone.schema)
    assert got(same) == sorted(expected(rows_of(same)), key=str)


def test_nodes_are_nested_intervals(spark):
    for n in (1, 2, 5, 8, 37):
        leaves = spark.range(n).select(F.lit("t").alias("tree"), F.col("id").alias("rank"), F.lit(n).cast("long").alias("n"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
        built = merkle.bands(leaves, [], "test", 2)
        levels, _ = tree([h(str(i)) for i in range(n)])
        want = {(k, j << k, min((j + 1) << k, n), d) for k, level in enumerate(levels) for j, d in enumerate(level)}
        rows = [tuple(r)[1:] for r in merkle.nodes(built, 2).collect()]
        assert set(rows) == want and len(rows) == len(want)
        assert [r["root"] for r in merkle.roots(built, 2).collect()] == levels[-1]
