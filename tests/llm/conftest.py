import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, n_tokens string, shard int, kept string, places string, doc string"


def prose(rnd, n):
    syllables = ["th", "er", "on", "an", "in", "re", "nd", "ha", "es", "ou", "é", "ß", "日"]
    words = ["".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4))) for _ in range(n)]
    return " ".join(w + rnd.choice(["", "", "", ".", ",", "\n"]) for w in words)


def cases():
    """Texts with shared passages, copies, near copies, nulls, empties, odd white space, specials and long unsplit stretches."""
    rnd = random.Random(5)
    shared = [prose(rnd, 60), prose(rnd, 130), prose(rnd, 50)]
    out = [None, "", " \t\n ", "word", "one two three four", "<|endoftext|> a <|endoftext|>b  <|endof"]
    for k in range(60):
        text = prose(rnd, rnd.randint(5, 200))
        for _ in range(rnd.choice([0, 0, 1, 2])):
            cut = rnd.randint(0, len(text))
            text = text[:cut] + " " + rnd.choice(shared) + " " + text[cut:]
        out.append(text)
    base = prose(rnd, 300)
    out += [base] * 4
    for _ in range(12):  # near copies of one text
        words = base.split(" ")
        for _ in range(rnd.randint(1, 6)):
            words[rnd.randrange(len(words))] = "changed" + str(rnd.randint(0, 9))
        out.append(" ".join(words))
    out += ["ab" * 3000, "x" * 5000 + " " + "x" * 4990, "=" * 1200 + "é" * 900, "it's they'll we're 'sss don't\r\n\t x  y   z"]
    out += [shared[0] + "\n" + shared[0], "same line\nsame line\nother\n same line\nsame line"]
    rnd.shuffle(out)
    return out


@pytest.fixture(scope="session")
def texts():
    return list(enumerate(cases()))


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The cases as documents with more columns than are asked for, some of names that operators use."""
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), 7, "x", 3, None, "p", "d") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """A null doc_id, and rows that occur twice."""
    rows = [(None, "a text without an id, of nine words here", "en", "s", 1, 1, "x", 1, "k", "p", "d")]
    rows += [(5, "a row that occurs twice in its table", "en", "s", 1, 1, "x", 1, "k", "p", "d")] * 2
    return spark.createDataFrame(rows, SCHEMA)
