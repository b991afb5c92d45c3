import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from rows import by_id
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vaultline.llm import binary_output, bpe, token_counts
from vaultline.llm.binary_output import EliasFano
from vaultline.llm.pieces import vocabulary

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", " ", "  ", "\n", "\t", "'s", "'re", "'ll", "'", "''", "é", "漢", "😀", "1", "٣", "!", "<|endoftext|>", "<|endof", "\xa0", "\x85", "\x1c", "the", "ing", " world"]


@pytest.fixture(scope="module")
def library():
    return vocabulary(PATH).tokenizer


def ids_of(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_counts_equal_the_library(docs, texts, library):
    got = by_id(token_counts.op2(docs, PATH))
    for i, t in texts:
        n = len(ids_of(library, t or ""))
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 1024)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=10).map("".join))
def test_every_prefix_has_its_count(text):
    library = vocabulary(PATH).tokenizer
    counts, _ = token_counts.counter(PATH)([text])
    assert counts.tolist() == [len(ids_of(library, text[:k])) for k in range(1, len(text) + 1)]


def test_pieces_with_equal_polynomials(spark, library):
    """Pieces of which any polynomial modulo 2^64 has equal hashes, in one batch."""
    bits = lambda n, a, b: "".join(a if bin(k).count("1") % 2 == 0 else b for k in range(n))
    rows = [(2 * n + k, bits(n, *pair)) for n in (512, 1024, 2048, 4096) for k, pair in enumerate(("qe", "eq"))]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    counts, coded, files = by_id(token_counts.op2(df, PATH)), by_id(bpe.op7(df, PATH)), by_id(binary_output.op10(df, PATH))
    for i, t in rows:
        ids = ids_of(library, t)
        assert counts[i]["n_tokens"] == coded[i]["n_tokens"] == files[i]["n_tokens"] - 1 == len(ids)
        assert coded[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert files[i]["ids_crc32"] == zlib.crc32(np.array([*ids, 2], "<u4").tobytes())


def test_table_tells_equal_hashes_apart():
    from vaultline.llm.pieces import PieceTable

    table = PieceTable(lambda pieces: [[len(p)] for p in pieces], np.int32)
    text, starts, ends = "aabbbc", np.array([0, 2, 5]), np.array([2, 5, 6])
    hashes, checks = np.array([7, 7, 8], np.uint64), np.array([1, 2, 3], np.uint64)
    for _ in range(2):
        assert table.gather(table.find(hashes, checks, text, starts, ends))[0].tolist() == [2, 3, 1]


def test_budget_questions(docs, texts, library):
    got = by_id(token_counts.with_prefix_counts(docs, PATH, budget=20))
    cut = by_id(token_counts.truncated(docs, PATH, 20))
    for i, t in texts:
        t = t or ""
        if len(t) > 3000:
            continue
        fit = max(k for k in range(len(t) + 1) if len(ids_of(library, t[:k])) <= 20)
        assert got[i]["budget_chars"] == fit
        assert cut[i]["text"] == t[:fit]
        half = len(t) // 2
        assert token_counts.tokens_in_prefix(got[i]["steps"], half) == len(ids_of(library, t[:half]))


def test_truncation_row_by_row(spark, library):
    rows = [(5, "one two three four five", 1), (5, "ten words " * 9, 2), (None, "a b c d e f", 3), (None, None, 4), (5, "one two three four five", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _cut int")
    got = token_counts.truncated(df, PATH, 3)
    assert got.columns == df.columns
    want = sorted((k, library.decode(ids_of(library, t or "")[:3])) for _, t, k in rows)
    assert sorted((r["_cut"], r["text"]) for r in got.collect()) == want


def test_encoding_and_decoding_equal_the_library(docs, texts, library):
    got = by_id(bpe.op7(docs, PATH))
    for i, t in texts:
        ids = ids_of(library, t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize(("long_text", "long_leaf"), [(1000, 64), (0, 700)])
def test_long_pieces_are_dealt_out(docs, texts, library, long_text, long_leaf):
    got, plain = by_id(bpe.op7(docs, PATH, long_text, long_leaf)), by_id(bpe.encode(docs, PATH, long_text, long_leaf))
    assert len(got) == len(plain) == len(texts)
    for i, t in texts:
        ids = ids_of(library, t or "")
        assert plain[i]["ids"] == ids and got[i]["n_tokens"] == plain[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_texts_are_read_once_where_no_piece_is_long(spark, library):
    """A long text of short pieces takes no long way: one job writes, and none follows."""
    text = "many short words and their ends " * 4000
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    spark.sparkContext.setJobGroup("encode-once", "")
    try:
        got = bpe.op7(df, PATH)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("encode-once"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs == 1
    assert {r["doc_id"]: r["n_tokens"] for r in got.collect()} == {1: len(ids_of(library, text)), 2: 0}


def test_text_of_several_megabytes(spark, library):
    rnd = random.Random(9)
    long = "".join(rnd.choice("abcdefgh") for _ in range(300_000)) + " " + "word it's " * 150_000 + "=" * 200_000
    df = spark.createDataFrame([(1, long), (1, "short"), (None, long[:100_000])], "doc_id long, text string")
    want = sorted(hashlib.sha256(",".join(map(str, ids_of(library, t))).encode()).hexdigest() for t in (long, "short", long[:100_000]))
    assert sorted(r["ids_sha256"] for r in bpe.op7(df, PATH).collect()) == want
    assert sorted(r["n_tokens"] for r in token_counts.op2(df, PATH).collect()) == sorted(len(ids_of(library, t)) for t in (long, "short", long[:100_000]))


def test_round_trip(docs, texts):
    back = by_id(bpe.decode(bpe.encode(docs, PATH), PATH))
    assert all(back[i]["text"] == (t or "") for i, t in texts)


def test_tree_of_tiny_leaves(library):
    rnd = random.Random(3)
    vocab = vocabulary(PATH)
    pieces = ["".join(rnd.choice("abcdeé漢😀"[:k]) for _ in range(rnd.randint(1, 400))) for k in (1, 2, 5, 8) for _ in range(6)]
    for leaf in (1, 2, 7, 64):
        assert bpe.tree_concat(vocab, pieces, leaf) == [ids_of(library, p) for p in pieces]


def test_decoding_replaces_broken_bytes(spark):
    vocab = vocabulary(PATH)
    half = vocab.ids["😀".encode()[:1]] if "😀".encode()[:1] in vocab.ids else vocab.ids[b"\xf0"]
    df = spark.createDataFrame([(1, [half]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in bpe.decode(df, PATH).collect()} == {1: "�", 2: "", 3: ""}


def test_files_hold_every_document_in_order(docs, texts, library):
    got = by_id(binary_output.op10(docs, PATH))
    start = 0
    for i, t in sorted(texts):
        ids = [*ids_of(library, t or ""), 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 10**9), max_size=700), st.data())
def test_elias_fano_selects(values, data):
    values = sorted(values)
    made, end = EliasFano.from_bytes(EliasFano.of(np.array(values, np.int64)).to_bytes())
    assert made.select(0, len(values)).tolist() == values
    if values:
        a = data.draw(st.integers(0, len(values) - 1))
        b = data.draw(st.integers(a, len(values)))
        assert made.select(a, b).tolist() == values[a:b]
        assert made[a] == values[a]


def test_elias_fano_is_near_minimal():
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 34, 20_000))
    assert len(EliasFano.of(values).to_bytes()) * 8 < 20_000 * (2.5 + np.log2((1 << 34) / 20_000))


@pytest.mark.parametrize("op", [token_counts.op2, bpe.op7, binary_output.op10])
def test_empty_and_odd_tables(op, nothing, odd):
    assert op(nothing, PATH).count() == 0
    rows = op(odd, PATH).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["5", "5", "None"]
    assert len({r["n_tokens"] for r in rows if r["doc_id"] == 5}) == 1


def test_null_ids_come_first_in_files(odd):
    rows = sorted(binary_output.op10(odd, PATH).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 5, 5] and rows[0]["start"] == 0


def test_columns(docs):
    assert token_counts.op2(docs, PATH).select("over_limit").schema[0].dataType.typeName() == "boolean"
    assert bpe.encode(docs, PATH).where(F.size("ids") != F.col("n_tokens")).count() == 0
