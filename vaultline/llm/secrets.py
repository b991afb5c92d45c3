"""Secret scans: fixed patterns, and a battery of randomness tests for strings that no pattern names.

A candidate is an unbroken run of encoding characters with a digit and a letter in it. Its encoding is the smallest
alphabet that holds it. Three tests ask whether it is a uniform random string of that alphabet:
chi-squared over the symbols, runs above and below the alphabet's middle, lag-one serial correlation;
Fisher's method joins them to one p-value. Ordinary text fails the battery, the more surely the longer it is.

False discoveries are held per length band by decoys: what is left of each text without base spans and candidates, its ASCII
letters and digits without gaps, is cut from end to end in stretches of the bands' lengths in turn (from a band that
the stretch's hash picks), so texts weigh as much as they are long and keys are no decoys. The share of decoys that pass at a level, times the candidates, estimates the false
among those that pass; the most lenient level whose estimate stays below ``rate`` is the band's. Counts are over all
documents, and only the table band x level (a fixed size) comes to the driver.

Cases: null and empty texts have no spans; repeated rows repeat their result; texts of any length are
used whole; in a band without candidates nothing is flagged, nor in one of fewer than 1 / ``rate`` - 1 decoys
(99 at 0.01): even if none passes, the estimate (one more than pass, of one more than there are) is then too high.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultline.llm.shared import sliced, texts_of, written

# The patterns of the base scan.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
BANDS = (16, 24, 32, 48, 80)
LEVELS = 48
RATE = 0.01
LEAST_P = 1e-3
_GAPS = bytes(c for c in range(256) if not (c < 128 and chr(c).isalnum()))

_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = (
    _DIGIT + "abcdef", _DIGIT + "ABCDEF", _UPPER + "234567", _DIGIT + _LOWER, _DIGIT + _UPPER,
    _DIGIT + _UPPER + _LOWER, _UPPER + _LOWER + _DIGIT + "+/", _UPPER + _LOWER + _DIGIT + "-_", _UPPER + _LOWER + _DIGIT + "+/-_",
)
LENGTHS = [b * 5 // 4 for b in BANDS]
_SETS = [(frozenset(a), {c: i for i, c in enumerate(a)}) for a in ENCODINGS]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns, leftmost and non-overlapping for each kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found)


def tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def randomness(token: str) -> float:
    """Fisher's p-value of the three tests for a uniform random string; 0 for strings of one repeated symbol."""
    token = token.rstrip("=")
    chars = frozenset(token)
    index = next((ix for own, ix in _SETS if chars <= own), None)
    n = len(token)
    if index is None or n < 8 or len(chars) < 3:
        return 0.0
    size = len(index)
    codes = np.array([index[c] for c in token], float)
    counts = np.bincount(codes.astype(np.int64), minlength=size)
    chi, free = float((counts.astype(float) ** 2).sum()) * size / n - n, size - 1
    z = ((chi / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))
    ps = [tail(z)]
    high = codes >= size / 2
    above = int(high.sum())
    mean = 2 * above * (n - above) / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    runs = 1 + int((high[1:] != high[:-1]).sum())
    ps.append(2 * tail(abs(runs - mean) / math.sqrt(spread)) if spread > 0 else 1e-9)
    centred = codes - codes.mean()
    r = float((centred[1:] * centred[:-1]).sum() / (centred**2).sum())
    ps.append(2 * tail(abs(r + 1 / n) * math.sqrt(n)))
    half = -sum(math.log(max(p, 1e-300)) for p in ps)
    return math.exp(-half) * (1 + half + half * half / 2)


_MEMBER = np.array([sum((chr(c) in a) << e for e, a in enumerate(ENCODINGS)) for c in range(128)], np.uint16)
_CODE = np.array([[max(a.find(chr(c)), 0) for c in range(128)] for a in ENCODINGS], np.uint8)
_SIZE = np.array([len(a) for a in ENCODINGS], np.int64)


def tails(z: np.ndarray) -> np.ndarray:
    return np.array([tail(x) for x in z.tolist()])


def battery(tokens: np.ndarray) -> np.ndarray:
    """``randomness`` of many strings of letters and digits of one length: the rows of a matrix of bytes."""
    k, n = tokens.shape
    member = np.bitwise_and.reduce(_MEMBER[tokens], axis=1).astype(np.int64)
    which = np.log2(member & -member).astype(np.int64)
    size = _SIZE[which]
    codes = _CODE[which[:, None], tokens].astype(np.float64)
    width = int(_SIZE.max())
    counts = np.bincount((np.arange(k)[:, None] * width + codes.astype(np.int64)).ravel(), minlength=k * width).reshape(k, width)
    chi, free = (counts.astype(np.float64) ** 2).sum(axis=1) * size / n - n, size - 1
    ps = [tails(((chi / free) ** (1 / 3) - (1 - 2 / (9 * free))) / np.sqrt(2 / (9 * free)))]
    high = codes >= (size / 2)[:, None]
    above = high.sum(axis=1)
    mean = 2 * above * (n - above) / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    runs = 1 + (high[:, 1:] != high[:, :-1]).sum(axis=1)
    ps.append(np.where(spread > 0, 2 * tails(np.abs(runs - mean) / np.sqrt(np.where(spread > 0, spread, 1))), 1e-9))
    centred = codes - codes.mean(axis=1)[:, None]
    square = (centred**2).sum(axis=1)
    r = (centred[:, 1:] * centred[:, :-1]).sum(axis=1) / np.where(square > 0, square, 1)
    ps.append(2 * tails(np.abs(r + 1 / n) * math.sqrt(n)))
    half = -sum(np.log(np.maximum(p, 1e-300)) for p in ps)
    return np.where((counts > 0).sum(axis=1) < 3, 0.0, np.exp(-half) * (1 + half + half * half / 2))


def band(n: int) -> int:
    return sum(n >= b for b in BANDS) - 1


def level(p: float) -> int:
    """A bin of -log10 p: 0 for 1, LEVELS - 1 for the smallest."""
    return LEVELS - 1 if p <= 0 else min(LEVELS - 1, int(-8 * math.log10(min(p, 1.0))))


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, float]]:
    out, k = [], 0
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if not any(s < b and e > a for s, e, _ in taken[k : k + 4]) and any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]):
            out.append((a, b, randomness(m[0])))
    return out


def plain(text: str, taken: list[tuple[int, int]]) -> bytes:
    """The text's ASCII letters and digits outside the spans, without gaps."""
    left, at = [], 0
    for a, b in sorted(taken):
        left.append(text[at : max(a, at)])
        at = max(at, b)
    return "".join([*left, text[at:]]).encode("ascii", "ignore").translate(None, _GAPS)


def stretches(own: bytes) -> list[tuple[int, int]]:
    """(band, start) of the decoys of one text: end to end, of the bands' lengths in turn; what is left at the end is cut in the longest that fit."""
    out, at, b = [], 0, zlib.crc32(own) % len(BANDS)
    while at + LENGTHS[b] <= len(own):
        out.append((b, at))
        at, b = at + LENGTHS[b], (b + 1) % len(BANDS)
    for b in reversed(range(len(BANDS))):
        while at + LENGTHS[b] <= len(own):
            out.append((b, at))
            at += LENGTHS[b]
    return out


def decoys(texts: list[str], taken: list[list[tuple[int, int]]]) -> list[list[int]]:
    """The cells (band and level) of the decoys of every text, each with its number of decoys (flat pairs)."""
    own = [plain(*x) for x in zip(texts, taken)]
    data = np.frombuffer(b"".join(own), np.uint8)
    cuts = [(i, b, at) for i, x in enumerate(own) for b, at in stretches(x)]
    begin = np.concatenate(([0], np.cumsum([len(x) for x in own])))
    text, bands, at = np.array(cuts, np.int64).reshape(-1, 3).T
    start = begin[text] + at
    cells = np.zeros(len(cuts), np.int64)
    for b, n in enumerate(LENGTHS):
        mine = np.flatnonzero(bands == b)
        for part in np.split(mine, range(8192, len(mine), 8192)):
            if len(part):
                cells[part] = [b * LEVELS + level(p) for p in battery(data[start[part][:, None] + np.arange(n)]).tolist()]
    out = [[] for _ in texts]
    keys, counts = np.unique(text * (len(BANDS) * LEVELS) + cells, return_counts=True)
    for key, n in zip(keys.tolist(), counts.tolist()):
        out[key // (len(BANDS) * LEVELS)] += [key % (len(BANDS) * LEVELS), n]
    return out


SCAN = "doc_id long, base array<int>, found array<int>, bands array<int>, levels array<int>, decoys array<int>"


def scan(docs: DataFrame) -> DataFrame:
    """Base spans, candidates with band and level, and decoys' cells with counts (flat triples and pairs) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = pa.list_(pa.int32())
        for batch in sliced(batches):
            texts = texts_of(batch)
            rows = [scanned(t) for t in texts]
            taken = [[*zip(base[::3], base[1::3]), *zip(found[::2], found[1::2])] for base, found, _, _ in rows]
            columns = [batch.column(0).cast(pa.int64()), *(pa.array([r[k] for r in rows], ints) for k in range(4)), pa.array(decoys(texts, taken), ints)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "base", "found", "bands", "levels", "decoys"])

    return docs.select("doc_id", "text").mapInArrow(run, SCAN)


def scanned(text: str) -> tuple[list[int], ...]:
    base = base_spans(text)
    own = candidates(text, base)
    return (
        [x for span in base for x in span],
        [x for a, b, _ in own for x in (a, b)],
        [band(b - a) for a, b, _ in own],
        [level(p) for _, _, p in own],
    )


def thresholds(scans: DataFrame, rate: float = RATE) -> list[int]:
    """For each band the highest level that is flagged, or -1."""
    own = scans.select(F.explode(F.zip_with("bands", "levels", lambda b, x: b * LEVELS + x)).alias("cell"), F.lit(1).alias("real"), F.lit(1).alias("n"))
    pairs = F.transform(F.sequence(F.lit(0), (F.size("decoys") / 2).cast("int") - 1), lambda k: F.struct(F.get("decoys", k * 2).alias("cell"), F.get("decoys", k * 2 + 1).alias("n")))
    fake = scans.where(F.size("decoys") > 0).select(F.explode(pairs).alias("x")).select("x.cell", F.lit(0).alias("real"), "x.n")
    table = own.unionByName(fake).groupBy("cell", "real").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((2, len(BANDS) * LEVELS))
    for r in table:
        counts[r["real"], r["cell"]] = r["n"]
    out = []
    for fake_row, real_row in zip(*counts.reshape(2, len(BANDS), LEVELS)):
        passed, false = np.cumsum(real_row), np.cumsum(fake_row)
        ok = np.zeros(LEVELS, bool)
        if false[-1] and passed[-1]:
            ok = (false + 1) / (false[-1] + 1) * passed[-1] <= rate * np.maximum(passed, 1)
        ok &= np.arange(LEVELS) <= level(LEAST_P)
        out.append(int(np.flatnonzero(ok)[-1]) if ok.any() else -1)
    return out


def all_spans(base: list[int], found: list[int], bands: list[int], levels: list[int], limits: list[int]) -> list[tuple[int, int, int]]:
    """The base spans and the flagged candidates as (start, end, kind), in order."""
    spans = list(zip(base[::3], base[1::3], base[2::3]))
    spans += [(a, b, 3) for a, b, k, x in zip(found[::2], found[1::2], bands, levels) if x <= limits[k]]
    return sorted(spans, key=lambda s: (s[0], s[2]))


def written_out(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def op6(docs: DataFrame) -> DataFrame:
    scans = written(scan(docs), "secrets")
    limits = thresholds(scans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(k).to_pylist() for k in range(1, 5))))
            base = [sorted(zip(b[::3], b[1::3], b[2::3]), key=lambda s: (s[0], s[2])) for b, *_ in rows]
            columns = [
                batch.column(0),
                *(pa.array([sum(s[2] == k for s in own) for own in base], pa.int64()) for k in range(3)),
                pa.array([hashlib.sha256(written_out(own).encode()).hexdigest() for own in base], pa.string()),
                pa.array([written_out(all_spans(*r, limits)) for r in rows], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return scans.select("doc_id", "base", "found", "bands", "levels").mapInArrow(run, schema)


def redacted_text(text: str, spans: list[tuple[int, int, int]], mask: str = "[SECRET]") -> str:
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], mask]
        elif b <= at:
            continue
        at = b
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` masked and ``n_chars`` (if there) counted anew; other columns as they are."""
    limits = thresholds(written(scan(docs).drop("base", "found"), "secrets"))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column(at).to_pylist()
            clean = [t if t is None else redacted_text(t, all_spans(*scanned(t), limits)) for t in texts]
            columns = list(batch.columns)
            columns[at] = pa.array(clean, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    clean = docs.mapInArrow(run, docs.schema)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean
