"""64-bit hashes of all words of some texts at once.

A word's hash is a polynomial of fixed random values of its symbols, modulo 2 ** 64, taken from running sums over the whole
text, so no word is ever an object of its own. Equal words have equal hashes wherever they stand.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import xxhash

_BASE = 0x9E3779B97F4A7C15
_tables: dict[int, np.ndarray] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of h; different numbers stay different."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def values(n: int) -> np.ndarray:
    """A fixed random value for each of the symbols 0 to n - 1."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE))


def _powers(base: int, n: int) -> np.ndarray:
    have = _tables.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _tables[base] = np.multiply.accumulate(steps)
    return have[:n]


def spans(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of words: runs of symbols of kind 1, and each symbol of kind 2. Kind 0 is no part of a word."""
    edge = np.concatenate([[0], kind, [0]])
    run, alone = edge == 1, kind == 2
    return np.flatnonzero(run[1:-1] & ~run[:-2] | alone), np.flatnonzero(run[1:-1] & ~run[2:] | alone) + 1


def hashes(symbols: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each word. symbols: the value of each."""
    total = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * _powers(_BASE, len(symbols)), out=total[1:])
    return mixed((total[ends] - total[begins]) * _powers(pow(_BASE, -1, 2**64), len(symbols) + 1)[begins])


#: Bytes that are hashed at once; a word of that length or more is hashed by itself, wherever it stands.
STEP = 1 << 20
#: Bytes that end a word where words are runs of anything else.
BLANKS = b" \t\n\v\f\r"
_NOT_BLANK = np.array([c not in BLANKS for c in range(256)], np.uint8)
_BLANK = re.compile(rb"[ \t-\r]")


def _pieces(data: bytes) -> Iterator[bytes]:
    """data cut at blanks into pieces shorter than STEP; a longer one is a single word."""
    at = 0
    while len(data) - at >= STEP:
        last = max(data.rfind(c, at, at + STEP) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
        if last < 0:
            blank = _BLANK.search(data, at + STEP)
            last = blank.start() if blank else len(data)
        yield data[at:last]
        at = min(last + 1, len(data))
    yield data[at:]


def of_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words (runs of anything but BLANKS, A-Z lower-cased) of all texts, and how many each text has."""
    if sum(map(len, texts)) >= STEP and (len(texts) > 1 or len(texts[0]) >= STEP):
        found, lengths, held, size = [], [], [], 0

        def flush():
            if held:
                h, n = of_words(held)
                found.append(h)
                lengths.extend(n.tolist())
                held.clear()

        for t in texts:
            if len(t) + size >= STEP:
                flush()
                size = 0
            if len(t) >= STEP:
                parts = [_of_long(p) if len(p) >= STEP else of_words([p])[0] for p in _pieces(t)]
                found += parts
                lengths.append(sum(map(len, parts)))
            else:
                held.append(t)
                size += len(t) + 1
        flush()
        return np.concatenate(found), np.array(lengths, np.int64)
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    begins, ends = spans(_NOT_BLANK[data])
    cuts = np.searchsorted(begins, np.cumsum([len(t) + 1 for t in texts]))
    return hashes(_lowered()[data], begins, ends), np.diff(cuts, prepend=0)


def _of_long(word: bytes) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(word.lower(), 1)], np.uint64)


@cache
def _lowered() -> np.ndarray:
    out = values(256)
    out[65:91] = out[97:123]
    return out
