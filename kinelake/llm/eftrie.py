"""An n-gram trie in Elias-Fano levels.

Level n holds, for each n-gram in order, the number of its last word, and for each (n-1)-gram a pointer to where its
successors begin. Both sequences are stored by Elias-Fano coding: pointers are monotone as they are; words are made so by
adding to each the last stored value before its range, so that a successor is searched relative to its context. From level
3 on a word is stored as its place among the successors of the context without its first word (context-relative numbers,
smaller than word numbers). Probabilities are quantised base-10 logarithms of STEP steps, one 16-bit code an n-gram. The
levels are written one after the other into a file and read through a memory map.
"""

from __future__ import annotations

import tempfile

import numpy as np

STEP, CODES = 4096, 65535


def quantise(log10: np.ndarray) -> np.ndarray:
    """Codes from 1; 0 means that nothing is stored."""
    return np.clip(np.rint(-log10 * STEP), 0, CODES - 1).astype(np.uint16) + np.uint16(1)


def restore(codes: np.ndarray) -> np.ndarray:
    return -(codes.astype(np.float64) - 1) / STEP


class EliasFano:
    """A non-decreasing sequence of numbers below 2 ** 63: low bits packed, high bits in unary with a rank for each word."""

    DENSE, PIECE = 16, 1 << 20

    def __init__(self, low: np.ndarray, high: np.ndarray, ranks: np.ndarray, width: int, n: int) -> None:
        self.low, self.high, self.ranks, self.width, self.n = low, high, ranks, width, n

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        width = max(0, int(v[-1] // max(n, 1)).bit_length() - 1) if n else 0
        top = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(top[-1]) // 64 + 2 if n else 1) * 8, np.uint8)
        np.bitwise_or.at(high, top >> 3, (1 << (top & 7)).astype(np.uint8))
        words = high.view(np.uint64)
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        bits = np.zeros((n * width + 63) // 64 + 2, np.uint64)
        if width:
            part, at = v & np.uint64((1 << width) - 1), np.arange(n, dtype=np.uint64) * np.uint64(width)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(bits, word, part << shift)
            over = (shift + np.uint64(width)) > 64
            np.bitwise_or.at(bits, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        return cls(bits, words, ranks, width, n)

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.low, self.high, self.ranks

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at places i. Many of them decode the sequence, a piece at a time."""
        i = np.asarray(i, np.int64)
        if len(i) * self.DENSE > self.n:
            out = np.zeros(len(i), np.int64)
            for a in range(0, self.n, self.PIECE):
                b = min(a + self.PIECE, self.n)
                here = np.flatnonzero((i >= a) & (i < b)) if b - a < self.n else slice(None)
                out[here] = self.decode(a, b)[i[here] - a]
            return out
        word = np.searchsorted(self.ranks, i, side="right") - 1
        bits, rest = self.high[word].copy(), i - self.ranks[word]
        # the place of the (rest + 1)-th set bit of a word, by halves
        place = np.zeros(len(i), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            n = np.bitwise_count(bits & np.uint64((1 << half) - 1)).astype(np.int64)
            go = rest >= n
            rest = np.where(go, rest - n, rest)
            bits = np.where(go, bits >> np.uint64(half), bits)
            place += go * half
        out = (word * 64 + place - i).astype(np.uint64) << np.uint64(self.width)
        if self.width:
            out |= self._low(i)
        return out.astype(np.int64)

    def decode(self, a: int, b: int) -> np.ndarray:
        """The values at places a to b - 1, in one pass over their bits."""
        if a >= b:
            return np.zeros(0, np.int64)
        first, last = (int(np.searchsorted(self.ranks, x, side="right")) - 1 for x in (a, b - 1))
        ones = np.flatnonzero(np.unpackbits(np.ascontiguousarray(self.high[first : last + 1]).view(np.uint8), bitorder="little"))
        skip = a - int(self.ranks[first])
        i = np.arange(a, b, dtype=np.int64)
        out = (ones[skip : skip + b - a] + first * 64 - i) << self.width
        return out | self._low(i).astype(np.int64) if self.width else out

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i.astype(np.uint64) * np.uint64(self.width)
        w, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        part = self.low[w] >> shift
        part |= np.where(shift > 0, self.low[w + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return part & np.uint64((1 << self.width) - 1)

    def find(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The first place in [lo, hi) whose value is x at least, else hi. Many searches decode what they span, a piece
        at a time; few ones go by halves."""
        lo, hi = np.array(lo, np.int64), np.array(hi, np.int64)
        if len(x) * self.DENSE > self.n:
            out = lo.copy()
            for a in range(0, self.n, self.PIECE):
                b = min(a + self.PIECE, self.n)
                here = np.flatnonzero((out >= a) & (out < b) & (out < hi))
                if len(here):
                    out[here] = np.maximum(out[here], np.minimum(a + np.searchsorted(self.decode(a, b), x[here]), hi[here]))
            return out
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            small = self.get(mid) < x[live]
            lo[live] = np.where(small, mid + 1, lo[live])
            hi[live] = np.where(small, hi[live], mid)
            live = live[lo[live] < hi[live]]
        return lo


class Level:
    """Successors of each context: pointers, words, codes."""

    def __init__(self, pointers: EliasFano, words: EliasFano, codes: np.ndarray) -> None:
        self.pointers, self.words, self.codes = pointers, words, codes

    @classmethod
    def build(cls, context: np.ndarray, word: np.ndarray, codes: np.ndarray, contexts: int) -> Level:
        """context, word: sorted by both, without repeats."""
        begins = np.searchsorted(context, np.arange(contexts + 1))
        # each range starts at the running sum of the ranges' largest words before it
        last = np.zeros(contexts + 1, np.int64)
        full = begins[1:] > begins[:-1]
        last[1:][full] = word[begins[1:][full] - 1] + 1
        base = np.cumsum(last)
        return cls(EliasFano.encode(begins), EliasFano.encode(word + base[context]), codes)

    def base(self, begin: np.ndarray) -> np.ndarray:
        """What was added to the words of a range: one more than the value before it."""
        out = np.zeros(len(begin), np.int64)
        has = begin > 0
        out[has] = self.words.get(begin[has] - 1) + 1
        return out

    def range(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.pointers.get(context), self.pointers.get(context + 1)

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The place of each successor in this level; -1 where there is none."""
        lo, hi = self.range(context)
        x = word + self.base(lo)
        at = self.words.find(x, lo, hi)
        ok = at < hi
        ok[ok] = self.words.get(at[ok]) == x[ok]
        return np.where(ok, at, -1)

    def code(self, at: np.ndarray, other: np.ndarray) -> np.ndarray:
        """The codes at these places; ``other`` where a place is -1."""
        return np.where(at >= 0, self.codes[np.maximum(at, 0)], other).astype(np.uint16) if len(self.codes) else other.astype(np.uint16)


class Trie:
    """n-grams over word numbers 0 to words - 1. Level k (from 2) has the k-grams below the (k-1)-grams' places."""

    def __init__(self, words: int, levels: list[Level]) -> None:
        self.words, self.levels = words, levels

    @classmethod
    def build(cls, words: int, grams: list[np.ndarray], codes: list[np.ndarray]) -> Trie:
        """grams[i]: the (i+2)-grams, one a row, sorted, each with all its (n-1)-grams (its first and its last words) in
        the array before."""
        out = cls(words, [])
        for rows, code in zip(grams, codes, strict=True):
            context = out.place(rows[:, :-1])
            n = out.size()
            number = out._number(rows)
            order = np.lexsort((number, context))
            out.levels.append(Level.build(context[order], number[order], code[order], n))
        return out

    def size(self) -> int:
        return self.levels[-1].words.n if self.levels else self.words

    def _number(self, rows: np.ndarray) -> np.ndarray:
        """How the last word of each row is stored; -1 where it is no successor of the context's tail."""
        if rows.shape[1] <= 2:
            return rows[:, -1]
        tail = self.place(rows[:, 1:])
        begin = self.levels[rows.shape[1] - 3].range(np.maximum(self.place(rows[:, 1:-1]), 0))[0]
        return np.where(tail >= 0, tail - begin, -1)

    def place(self, rows: np.ndarray) -> np.ndarray:
        """The place of each n-gram in its level; -1 where it is not in the trie."""
        at = np.where((rows[:, 0] >= 0) & (rows[:, 0] < self.words), rows[:, 0], -1).astype(np.int64)
        for n in range(2, rows.shape[1] + 1):
            number = self._number(rows[:, :n])
            ok = np.flatnonzero((at >= 0) & (number >= 0))
            to = np.full(len(at), -1, np.int64)
            to[ok] = self.levels[n - 2].find(at[ok], number[ok])
            at = to
        return at

    def codes(self, rows: np.ndarray) -> np.ndarray:
        """The code of each n-gram; 0 where it is not in the trie."""
        at, codes = self.place(rows), self.levels[rows.shape[1] - 2].codes
        return np.where(at >= 0, codes[np.maximum(at, 0)], 0).astype(np.uint16) if len(codes) else np.zeros(len(rows), np.uint16)

    def mapped(self) -> Trie:
        """The same trie, read through a memory map."""
        return Trie(self.words, mapped(self.levels))


def mapped(levels: list[Level]) -> list[Level]:
    """The same levels, written one after the other into a file without a name and read through a memory map."""
    out = []
    with tempfile.TemporaryFile() as f:
        for level in levels:
            arrays = [*level.pointers.parts(), *level.words.parts(), level.codes]
            starts = []
            for a in arrays:
                f.write(b"\0" * (-f.tell() % 8))
                starts.append(f.tell())
                f.write(np.ascontiguousarray(a).tobytes())
            f.flush()
            maps = [np.memmap(f, a.dtype, "r", start, (len(a),)) if len(a) else a for a, start in zip(arrays, starts, strict=True)]
            p, w = level.pointers, level.words
            out.append(Level(EliasFano(*maps[:3], p.width, p.n), EliasFano(*maps[3:6], w.width, w.n), maps[6]))
    return out
