"""Byte-level BPE over a tokenizer's own vocabulary: splitting into pieces, encoding, decoding.

A *piece* is what the tokenizer's pre-tokenizer yields: no merge crosses its border, so the ids of a
text are the ids of its pieces in order. Pieces are found with numpy over whole batches and each
distinct piece is encoded once for as long as it stays in the (bounded) table of the Python worker.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np

from vaultline.llm.shared import RangeHash, mix, ragged


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins for the 256 byte values that byte-level vocabularies are written in."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    spare = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(spare)}


class Vocabulary:
    """Tokens as bytes, merge ranks and the library's tokenizer, read from one tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special_pattern = re.compile("|".join(map(re.escape, self.specials)) or "(?!)")
        special_ids = {t["content"]: t["id"] for t in spec["added_tokens"]}
        to_byte = byte_alphabet()
        self.ids = {bytes(to_byte[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special_ids}
        self.size = 1 + max([*self.ids.values(), *special_ids.values()])
        self.bytes = [b""] * self.size
        for k, v in self.ids.items():
            self.bytes[v] = k
        for k, v in special_ids.items():
            self.bytes[v] = k.encode()
        self.special_ids = special_ids
        self.longest = max(map(len, self.ids))
        self.ranks: dict[tuple[bytes, bytes], int] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.ranks[bytes(to_byte[c] for c in a), bytes(to_byte[c] for c in b)] = r
        self.kind = np.full(0x110000, 255, np.uint8)
        self.pairs: dict[int, bool] = {}

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        run = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [e.ids for e in run(texts, add_special_tokens=False)]

    def merge(self, word: bytes) -> list[int]:
        """Plain rank-by-rank merging of one short piece."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get((parts[i], parts[i + 1]), 1 << 60))
            pair = (parts[best], parts[best + 1])
            if pair not in self.ranks:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return [self.ids[p] for p in parts]

    @cached_property
    def endings(self) -> ahocorasick.Automaton:
        """Finds at every end position the tokens that end there, the longest first; a byte is a character of Latin-1."""
        out = ahocorasick.Automaton()
        for token, i in self.ids.items():
            out.add_word(token.decode("latin-1"), (i, len(token)))
        out.make_automaton()
        return out

    def fits(self, a: int, b: int) -> bool:
        """Whether tokens a, b stand side by side in the encoding of their joined bytes."""
        key = a << 32 | b
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            ok = self.pairs[key] = self.merge(self.bytes[a] + self.bytes[b]) == [a, b]
        return ok

    def kinds(self, points: np.ndarray) -> np.ndarray:
        """0 white space, 1 letter, 2 number, 3 other: as the tokenizer's own splitter sees each code point."""
        kind = self.kind[points]
        if (kind == 255).any():
            split = self.tokenizer.pre_tokenizer.pre_tokenize_str
            for p in np.unique(points[kind == 255]).tolist():
                c = chr(p)
                if len(split("a" + c)) == 1:
                    self.kind[p] = 1
                elif len(split("1" + c)) == 1:
                    self.kind[p] = 2
                elif len(split("!" + c)) == 1:
                    self.kind[p] = 3
                else:
                    self.kind[p] = 0
            kind = self.kind[points]
        return kind


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Split:
    """Pieces of a batch of texts: ``starts``/``ends`` in the joined string, and per-text bounds."""

    def __init__(self, vocab: Vocabulary, texts: list[str]):
        segments: list[str] = []
        special: list[int] = []
        for t in texts:
            if any(x in t for x in vocab.specials):
                for part, is_special in cut_specials(t, vocab.special_pattern):
                    if is_special:
                        special.append(len(segments))
                    segments.append(part)
            else:
                segments.append(t)
        self.text = "".join(texts)
        self.points = cp = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        n = len(cp)
        offsets = np.concatenate(([0], np.cumsum(np.array([len(x) for x in segments], np.int64))))
        self.text_bounds = np.concatenate(([0], np.cumsum(np.array([len(x) for x in texts], np.int64))))
        self.special = [(int(offsets[k]), int(offsets[k + 1])) for k in special]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        kind = vocab.kinds(cp)
        change = edge[:n].copy()
        if n:
            change[1:] |= kind[1:] != kind[:-1]
        start = change.copy()
        gap = kind == 0
        first = np.flatnonzero(change & ~gap & ~edge[:n])
        first = first[gap[first - 1]]
        start[first[cp[first - 1] == 32]] = False
        start[first - 1] = True
        self.gap_runs = self._runs(change, gap, first)
        self._contractions(cp, change, start, edge)
        for a, b in self.special:
            start[a:b] = False
            start[a] = True
        self.starts = np.flatnonzero(start)
        self.ends = np.append(self.starts[1:], n) if len(self.starts) else self.starts
        self.bounds = np.searchsorted(self.starts, self.text_bounds)
        symbols = mix(cp.astype(np.uint64) + np.uint64(1))
        self.ranges = [RangeHash(symbols, base) for base in RangeHash.BASES]
        self.special_set = set(self.special)

    def longest(self) -> np.ndarray:
        """The length of each text's longest piece, in characters."""
        out = np.zeros(len(self.bounds) - 1, np.int64)
        np.maximum.at(out, np.repeat(np.arange(len(out)), np.diff(self.bounds)), self.ends - self.starts)
        return out

    def pieces(self, table: "PieceTable", starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The table's slots of pieces of this batch."""
        return table.find(*(r.of(starts, ends) for r in self.ranges), self.text, starts, ends)

    @staticmethod
    def _runs(change: np.ndarray, gap: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """White-space runs of two or more before another symbol: their starts and ends."""
        begins = np.flatnonzero(change & gap)
        a = begins[np.searchsorted(begins, first, side="left") - 1] if len(first) else first
        wide = first - a >= 2
        return a[wide], first[wide]

    @staticmethod
    def _contractions(cp: np.ndarray, change: np.ndarray, start: np.ndarray, edge: np.ndarray) -> None:
        n = len(cp)
        q = np.flatnonzero((cp == 39) & change & start)
        q = q[~edge[q + 1]]
        one = cp[q + 1]
        more = (q + 2 < n) & ~edge[np.minimum(q + 2, n)]
        two = np.where(more, cp[np.minimum(q + 2, n - 1)], 0) if n else one
        short = np.isin(one, np.frombuffer("stmd".encode("utf-32-le"), np.uint32))
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        size = np.where(short, 2, np.where(long, 3, 0))
        q, size = q[size > 0], size[size > 0]
        start[q + 1] = False
        after = q + size
        start[after[after < n]] = True


def cut_specials(text: str, pattern: re.Pattern) -> list[tuple[str, bool]]:
    """The text cut at its special strings, leftmost and then longest first."""
    out, at = [], 0
    for m in pattern.finditer(text):
        out += [(text[at : m.start()], False), (m[0], True)]
        at = m.end()
    return [*out, (text[at:], False)]


class PieceTable:
    """Values of distinct pieces: ``encode`` turns pieces into integer lists, kept in flat arrays.

    A piece is known by two independent 64-bit hashes. One that shares only the first with an entry is encoded by
    itself. Holds at most ``room`` pieces and ``room * 8`` values; a full table starts anew.
    """

    def __init__(self, encode: Callable[[list[str]], list], dtype: type, room: int = 600_000):
        self.encode, self.dtype, self.room = encode, dtype, room
        self.clear()

    def clear(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.slots = np.empty(0, np.int64)
        self.checks = np.zeros(1 << 12, np.uint64)
        self.begin = np.zeros(1 << 12, np.int64)
        self.n, self.used = 0, 0
        self.flat = np.empty(1 << 14, self.dtype)

    def find(self, hashes: np.ndarray, checks: np.ndarray, text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Slots of the pieces; unknown ones are encoded first."""
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if self.n > self.room or self.used > self.room * 8:
            self.clear()
        at = np.searchsorted(self.keys, unique)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == unique[known]
        new = np.flatnonzero(~known)
        encoded = lambda where: self._append(self.encode([text[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist())]), checks[where])
        if len(new):
            slots = encoded(first[new])
            self.keys = np.insert(self.keys, at[new], unique[new])
            self.slots = np.insert(self.slots, at[new], slots)
            at = np.searchsorted(self.keys, unique)
        found = self.slots[at][inverse]
        other = np.flatnonzero(self.checks[found] != checks)
        if len(other):
            found[other] = encoded(other)
        return found

    def _append(self, values: list, checks: np.ndarray) -> np.ndarray:
        lens = np.fromiter(map(len, values), np.int64, len(values))
        flat = np.concatenate([np.asarray(v, self.dtype) for v in values]) if len(values) and not isinstance(values[0], list) else np.fromiter((x for v in values for x in v), self.dtype, int(lens.sum()))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
        while self.n + len(values) + 1 > len(self.begin):
            self.begin = np.concatenate((self.begin, np.zeros_like(self.begin)))
            self.checks = np.concatenate((self.checks, np.zeros_like(self.checks)))
        self.flat[self.used : self.used + len(flat)] = flat
        self.begin[self.n + 1 : self.n + 1 + len(values)] = self.used + np.cumsum(lens)
        slots = np.arange(self.n, self.n + len(values))
        self.checks[slots] = checks
        self.n += len(values)
        self.used += len(flat)
        return slots

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of the slots one after another, and each slot's number of values."""
        begin = self.begin[slots]
        lens = self.begin[slots + 1] - begin
        return self.flat[ragged(begin, lens)], lens


class Encoder:
    """Encodes batches of texts; the ids of each text are a slice of one array."""

    def __init__(self, path: str, encode: Callable[[Vocabulary, list[str]], list] | None = None):
        self.vocab = vocabulary(path)
        self.table = PieceTable(lambda p: encode(self.vocab, p) if encode else self.vocab.encode_many(p), np.int32)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and ``bounds`` so that text i has ids[bounds[i] : bounds[i + 1]]."""
        return self.of(Split(self.vocab, texts))

    def of(self, split: Split) -> tuple[np.ndarray, np.ndarray]:
        if not len(split.starts):
            return np.empty(0, np.int32), np.zeros(len(split.bounds), np.int64)
        ids, lens = self.table.gather(split.pieces(self.table, split.starts, split.ends))
        return ids, np.concatenate(([0], np.cumsum(lens)))[split.bounds]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder; its table lives as long as the Python worker."""
    return Encoder(path)
