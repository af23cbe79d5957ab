"""Elias-Fano sequences and the levels of an n-gram trie made of them, over numpy buffers.

A sorted sequence of n numbers below u keeps log2(u/n) low bits of each in a
packed array and the rest as a unary bit vector: about 2 + log2(u/n) bits a
number.  All parts are flat arrays, so a level is one run of bytes
(``to_bytes``) that is used where it lies (``view``) or mapped (``load``).
"""

from __future__ import annotations

import json

import numpy as np

U64 = np.uint64


class EliasFano:
    """A rising sequence of unsigned numbers."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self._first: np.ndarray | None = None

    @classmethod
    def of(cls, values: np.ndarray, universe_bits: int = 64) -> EliasFano:
        v = np.ascontiguousarray(values, dtype=np.uint64)
        n = len(v)
        low_bits = max(0, min(63, universe_bits - max(1, n).bit_length()))
        low = np.zeros((n * low_bits + 63) // 64 + 1, np.uint64)
        if n and low_bits:
            lows = v & U64((1 << low_bits) - 1)
            at = np.arange(n, dtype=np.uint64) * U64(low_bits)
            word, shift = (at >> U64(6)).astype(np.int64), at & U64(63)
            cls._or(low, word, lows << shift)
            over = (shift + U64(low_bits)) > U64(64)
            cls._or(low, word[over] + 1, lows[over] >> (U64(64) - shift[over]))
        up = (v >> U64(low_bits)).astype(np.int64)
        size = (int(up[-1]) if n else 0) + n + 1
        bits = np.zeros(size, np.uint8)
        bits[up + np.arange(n)] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"))

    @staticmethod
    def _or(out: np.ndarray, word: np.ndarray, value: np.ndarray) -> None:
        """out[word] |= value for rising ``word``."""
        if len(word):
            start = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            out[word[start]] |= np.bitwise_or.reduceat(value, start)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * U64(self.low_bits)
        word, shift = (at >> U64(6)).astype(np.int64), at & U64(63)
        x = self.low[word] >> shift
        # a shift by 64 is not defined, and there nothing is needed from the next word
        y = np.where(shift == 0, U64(0), self.low[word + 1] << ((U64(64) - shift) & U64(63)))
        return (x | y) & U64((1 << self.low_bits) - 1)

    def first_of(self) -> np.ndarray:
        """How many numbers have upper bits below h, for each h: the directory for successor search."""
        if self._first is None:
            bits = np.unpackbits(self.high, bitorder="little")
            zeros = np.flatnonzero(bits[: (int(np.flatnonzero(bits)[-1]) + 1) if self.n else 0] == 0)
            self._first = np.concatenate([[0], zeros - np.arange(len(zeros)), [self.n]]).astype(np.int64)
        return self._first

    def get(self, i: np.ndarray) -> np.ndarray:
        up = np.searchsorted(self.first_of(), i, side="right") - 1
        return (up.astype(np.uint64) << U64(self.low_bits)) | self._low(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Of each x: the place of the first number that is x or more (n: none)."""
        first = self.first_of()
        h = (x >> U64(self.low_bits)).astype(np.int64)
        inside = h < len(first) - 1
        h = np.minimum(h, len(first) - 2)
        lo, hi = first[h].copy(), first[h + 1].copy()
        lo[~inside] = hi[~inside] = self.n
        want = x & U64((1 << self.low_bits) - 1)
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < want[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        return lo

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of each x, -1 where it is absent."""
        if not self.n:
            return np.full(len(x), -1, np.int64)
        at = self.successor(x)
        ok = at < self.n
        ok[ok] = self.get(at[ok]) == x[ok]
        return np.where(ok, at, -1)

    def parts(self) -> tuple[list[int], list[np.ndarray]]:
        return [self.n, self.low_bits], [self.low, self.high]


STEP = 0.05  # decades of probability


def quantise(p: np.ndarray) -> np.ndarray:
    """A probability as one byte from 1 (1) to 255 (10^-12.7 and less): log10 p to the nearest multiple of ``STEP``; 0 is no probability."""
    return np.clip(1 - np.rint(np.log10(p) / STEP), 1, 255).astype(np.uint8)


def dequantise(code: np.ndarray) -> np.ndarray:
    return 10.0 ** (-STEP * (np.arange(256) - 1))[code]


class Words:
    """The first level: word hashes, and their counts as the differences of a monotone sequence."""

    def __init__(self, words: EliasFano, totals: EliasFano):
        self.words, self.totals = words, totals

    @classmethod
    def build(cls, words: np.ndarray, counts: np.ndarray) -> Words:
        ends = np.concatenate([[0], np.cumsum(counts)])
        return cls(EliasFano.of(words), EliasFano.of(ends, max(1, int(ends[-1])).bit_length()))

    def count(self, word: np.ndarray) -> np.ndarray:
        return counts_at(self.totals, self.words.find(word))


def counts_at(totals: EliasFano, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), np.int64)
    ok = at >= 0
    out[ok] = (totals.get(at[ok] + 1) - totals.get(at[ok])).astype(np.int64)
    return out


class Level:
    """A further level: contexts (hashes of grams of the level before) and the words that follow them.

    pointers: where each context's followers begin, a monotone sequence;
    followers: 32-bit hashes, made monotone by the context's place; codes: the
    quantised smoothed probability of each; totals: cumulative counts, so that a
    count is the difference of two of them.  All parts are flat arrays.
    """

    def __init__(self, contexts: EliasFano, pointers: EliasFano, followers: EliasFano, totals: EliasFano, codes: np.ndarray):
        self.contexts, self.pointers, self.followers, self.totals, self.codes = contexts, pointers, followers, totals, codes

    @classmethod
    def build(cls, contexts: np.ndarray, n: np.ndarray, followers: np.ndarray, counts: np.ndarray, p: np.ndarray) -> Level:
        """From rising contexts, and each one's ``n`` rising followers with their counts and probabilities."""
        ptr, ends = (np.concatenate([[0], np.cumsum(x)]) for x in (n, counts))
        place = np.repeat(np.arange(len(contexts), dtype=np.uint64), n)
        bits = max(1, len(contexts)).bit_length() + 32
        return cls(EliasFano.of(contexts), EliasFano.of(ptr, max(1, int(ptr[-1])).bit_length()), EliasFano.of((place << U64(32)) | followers.astype(np.uint64), bits),
                   EliasFano.of(ends, max(1, int(ends[-1])).bit_length()), quantise(p))

    def find(self, contexts: np.ndarray, n: np.ndarray, followers: np.ndarray) -> np.ndarray:
        """Places of followers (-1: absent), ``n[i]`` of them for ``contexts[i]``: a successor search relative to the context."""
        place = np.repeat(self.contexts.find(contexts), n)
        ok = place >= 0
        out = np.full(len(followers), -1, np.int64)
        out[ok] = self.followers.find((place[ok].astype(np.uint64) << U64(32)) | followers[ok].astype(np.uint64))
        return out

    def code(self, at: np.ndarray) -> np.ndarray:
        return np.where(at >= 0, self.codes[np.maximum(at, 0)], 0).astype(np.uint8) if len(self.codes) else np.zeros(len(at), np.uint8)

    def followers_of(self, context: int) -> tuple[np.ndarray, np.ndarray]:
        at = self.contexts.find(np.asarray([context], np.uint64))
        if at[0] < 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint8)
        lo, hi = self.pointers.get(np.asarray([at[0], at[0] + 1])).astype(np.int64).tolist()
        return self.followers.get(np.arange(lo, hi)) & U64(0xFFFFFFFF), self.codes[lo:hi]

    def to_bytes(self) -> bytes:
        heads, arrays = [], []
        for part in (self.contexts, self.pointers, self.followers, self.totals):
            h, a = part.parts()
            heads.append(h)
            arrays += a
        arrays.append(self.codes)
        head = json.dumps({"parts": heads, "sizes": [[a.dtype.str, len(a)] for a in arrays]}).encode()
        out = [len(head).to_bytes(8, "little"), head, b" " * (-(8 + len(head)) % 8)]
        for a in arrays:
            out += [a.tobytes(), bytes(-a.nbytes % 8)]
        return b"".join(out)

    @classmethod
    def view(cls, raw) -> Level:
        """Over a buffer (a mapped file, a cell of a table): nothing is copied or read ahead."""
        raw = np.frombuffer(raw, np.uint8)
        n = int.from_bytes(raw[:8].tobytes(), "little")
        head = json.loads(raw[8 : 8 + n].tobytes())
        at, arrays = 8 + n + (-(8 + n) % 8), []
        for kind, size in head["sizes"]:
            width = size * np.dtype(kind).itemsize
            arrays.append(raw[at : at + width].view(kind))
            at += width + (-width % 8)
        return cls(*[EliasFano(*h, arrays[2 * i], arrays[2 * i + 1]) for i, h in enumerate(head["parts"])], arrays[-1])

    @classmethod
    def load(cls, path: str) -> Level:
        """Mapped, not read."""
        return cls.view(np.memmap(path, dtype=np.uint8, mode="r"))
