"""Benchmark decontamination by spaced seeds.

Texts become words, lower-cased (letters, digits and underscores; each kana and Han character is one, as these scripts set no
blanks between words), and words 64-bit hashes. A seed is a fixed mask over a few consecutive words; the positions it ignores may differ.
The masked hashes of every document position are looked up among those of the benchmark. Each hit puts the two word sequences
side by side, and on that alignment the longest run of LEAST words at least (of the whole item, if that is shorter) of which
SHARE agree is looked for. It is reported without differing words at its ends.

The masks are chosen by enumeration so that no such run can be without a hit: a run holds one of LEAST to twice that many
words that agrees as well, and in each of these, however its differences fall, some mask meets equal words only.

The benchmark is a stated query set: it goes over the documents in blocks of about BLOCK_BYTES of text, one pass each, and what
a block finds is written down before the next is fetched, so neither the driver nor a task holds more than a block. A long
item is searched in overlapping pieces; where one of them agrees, the run is looked for in the whole item. Documents are never shuffled.

Defined cases: null and empty texts are clean; items of fewer than SHORTEST words are no evidence and match nothing; rows
that repeat an id are checked each (and reported once for each item); a word of more than LONGEST characters is cut; rows without item_id count as items of null id, and
one that has no doc_id is reported with a null one; empty tables give no row; other columns are ignored or kept as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from fractions import Fraction
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .common import cut, small_join

#: Positions that each seed reads, for items of LEAST words and more, and for shorter ones.
MASKS = ((0, 1, 3, 4, 5, 6), (0, 1, 2, 6, 9, 10), (0, 1, 5, 7, 9, 10), (0, 1, 4, 5, 7, 8))
SHORT_MASKS = ((0, 1, 2, 3), (0, 1, 4, 5), (0, 2, 3, 6))
LEAST, SHORTEST, SHARE = 13, 8, Fraction(4, 5)
BLOCK_BYTES, PIECE, OVERLAP = 4 << 20, 2048, 256
#: Characters that are read at once, of a single text at most; words that are matched at once; pairs that are spread out at once.
BATCH, LONGEST, STRIDE, PAIRS = 1 << 20, 1 << 22, 1 << 20, 1 << 20
SCHEMA = "doc_id long, item_id long, doc_start long, n_words long, n_same long"
#: Kana and Han.
_DENSE = "぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"


@cache
def alphabet() -> tuple[np.ndarray, np.ndarray]:
    """For each code point whether it is part of a word (1), one by itself (2) or neither, and its value."""
    kind = np.zeros(0x110000, np.uint8)
    for k, pattern in ((1, r"\w+"), (2, f"[{_DENSE}]+")):
        for m in re.finditer(pattern, "".join(map(chr, range(0x110000)))):
            kind[m.start() : m.end()] = k
    return kind, wordhash.values(0x110000)


def pieces(text: str) -> Iterator[str]:
    """A text in pieces of at most LONGEST characters, cut where no word is cut if that can be."""
    at = 0
    while len(text) - at > LONGEST:
        end = max((m.end() for m in re.finditer(r"\W", text[at : at + LONGEST])), default=LONGEST)
        yield text[at : at + end]
        at += end
    yield text[at:]


def words(texts: list[str | None]) -> list[np.ndarray]:
    """The hashes of the words of each text."""
    kind, value = alphabet()
    cuts = [p for t in texts for p in pieces((t or "").lower())] if any(len(t or "") > LONGEST for t in texts) else [(t or "").lower() for t in texts]
    if len(cuts) > len(texts):
        return [np.concatenate([w for p in pieces((t or "").lower()) for w in words([p])]) for t in texts]
    points = np.frombuffer("\0".join(cuts).encode("utf-32-le", "surrogatepass"), np.uint32)
    begins, ends = wordhash.spans(kind[points])
    found = wordhash.hashes(value[points], begins, ends)
    return np.split(found, np.searchsorted(begins, np.cumsum([len(c) + 1 for c in cuts])[:-1]))


def seeds(w: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """One hash for each position at which the mask fits."""
    n = len(w) - mask[-1]
    out = np.zeros(max(n, 0), np.uint64)
    for p in mask if n > 0 else ():
        out ^= w[p : p + n]
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class Table:
    """The sorted hashes of one mask with their positions, and a bit for each value of their leading bits."""

    def __init__(self, mask: tuple[int, ...], hashes: np.ndarray, at: np.ndarray) -> None:
        order = np.argsort(hashes, kind="stable")
        self.mask, self.keys, self.at = mask, hashes[order], at[order]
        self.shift = np.uint64(64 - min(24, max(8, len(at).bit_length() + 4)))

    def hits(self, w: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions in w and in the block at which a seed reads the same words, at most about PAIRS at once."""
        if not hasattr(self, "bits"):
            self.bits = np.zeros(1 << (64 - int(self.shift)), bool)
            self.bits[self.keys >> self.shift] = True
        h = seeds(w, self.mask)
        here = np.flatnonzero(self.bits[h >> self.shift])
        lo = np.searchsorted(self.keys, h[here])
        n = np.searchsorted(self.keys, h[here], side="right") - lo
        here, lo, n = here[n > 0], lo[n > 0], n[n > 0]
        ends = np.cumsum(n)
        a = 0
        while a < len(n):
            b = max(int(np.searchsorted(ends, ends[a] - n[a] + PAIRS, side="right")), a + 1)
            k = np.repeat(np.arange(a, b), n[a:b])
            yield here[k], self.at[lo[k] + np.arange(len(k)) - (ends[k] - n[k] - (ends[a] - n[a]))]
            a = b


class Block:
    """Some benchmark items: their words end to end, and for each mask the table of its seeds."""

    def __init__(self, items: Iterable[tuple[int | None, str | None]]) -> None:
        self.ids, self.whole, self.origin, parts, bounds = [], [], [], [], [0]
        for item, text in items:
            (w,) = words([text])
            self.whole.append(w)
            for a in range(0, max(len(w) - OVERLAP, 1), PIECE):
                piece = w[a : a + PIECE + OVERLAP]
                if len(piece) >= SHORTEST:
                    self.ids.append(item)
                    self.origin.append((len(self.whole) - 1, a))
                    parts.append(piece)
                    bounds.append(bounds[-1] + len(piece))
        self.words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.bounds = np.array(bounds)
        self.tables = []
        for masks, fits in ((MASKS, [len(p) >= LEAST for p in parts]), (SHORT_MASKS, [len(p) < LEAST for p in parts])):
            for mask in masks:
                h = [seeds(p, mask) for p, fit in zip(parts, fits, strict=True) if fit]
                if h:
                    at = [np.arange(len(x)) + a for x, a in zip(h, [a for a, fit in zip(bounds, fits, strict=False) if fit], strict=True)]
                    self.tables.append(Table(mask, np.concatenate(h), np.concatenate(at)))

    def alignments(self, w: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Distinct (text, item, distance of the block's position from the text's) of all hits."""
        found = [np.zeros((0, 3), np.int64)]
        for t in self.tables:
            for d, q in t.hits(w):
                text, item = np.searchsorted(begins, d, side="right") - 1, np.searchsorted(self.bounds, q, side="right") - 1
                rows = np.column_stack([text, item, d - q])
                rows = rows[np.lexsort(rows.T)]
                found.append(rows[np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])])
        return np.unique(np.concatenate(found), axis=0) if len(found) > 2 else found[-1]

    def matches(self, texts: list[np.ndarray]) -> list[tuple[int, int | None, int, int, int]]:
        """(text, item id, first word in the text, words, equal words): the best overlap of each text with each item."""
        w = np.concatenate([*texts, np.zeros(0, np.uint64)])
        begins = np.cumsum([0, *map(len, texts)])
        best: dict = {}
        seen = set()
        step = STRIDE  # longer ones go stride by stride, which share what a seed spans
        for a in range(0, max(len(w), 1), step):
            begins_here = begins - a
            for text, item, shift in self.alignments(w[a : a + step + LEAST], begins_here).tolist():
                shift += a
                lo, hi = int(self.bounds[item]), int(self.bounds[item + 1])
                start, stop = max(int(begins[text]), lo + shift), min(int(begins[text + 1]), hi + shift)
                same = w[start:stop] == self.words[start - shift : stop - shift]
                i, j = longest(same, min(LEAST, hi - lo))
                if i < j:
                    n, first = self.origin[item]
                    whole, origin = self.whole[n], shift + lo - first  # where the item would begin in w
                    if len(whole) > hi - lo:
                        # a piece agrees: the run goes on in the others, on the same alignment
                        if (text, n, origin) in seen:
                            continue
                        seen.add((text, n, origin))
                        start, stop = max(int(begins[text]), origin), min(int(begins[text + 1]), origin + len(whole))
                        i, j = longest(same := w[start:stop] == whole[start - origin : stop - origin], LEAST)
                    got = (int(same[i:j].sum()), j - i, begins[text] - start - i)
                    best[text, self.ids[item]] = max(best.get((text, self.ids[item]), got), got)
        return [(text, i, int(-at), n, equal) for (text, i), (equal, n, at) in best.items()]


def longest(same: np.ndarray, least: int) -> tuple[int, int]:
    """Begin and end of the longest run of ``least`` values at least of which SHARE are true, without false ones at its ends;
    (0, 0) if there is none."""
    s = np.concatenate([[0], np.cumsum(SHARE.denominator * same.astype(np.int64) - SHARE.numerator)])
    first = np.searchsorted(-np.minimum.accumulate(s), -s)  # the first place from which the sum up to each is not below zero
    n = np.arange(len(s)) - first
    j = int(n.argmax())
    if n[j] < max(least, 1):
        return 0, 0
    at = np.flatnonzero(same[first[j] : j]) + first[j]
    return int(at[0]), int(at[-1]) + 1


def blocks(benchmark: DataFrame) -> Iterator[Block]:
    """The benchmark in blocks of about BLOCK_BYTES, each fetched when it is asked for."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        block = Block(tuple(r) for r in part.toLocalIterator())
        if block.tables:
            yield block


def batches_of(texts: Iterable[pa.Scalar]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Texts as words, about BATCH characters at once, after the number of the first of them."""
    first, held, size = 0, [], 0
    for nth, t in enumerate(texts, 1):
        held.append(t.as_py())
        size += len(held[-1] or "") + 1
        if size >= BATCH:
            yield first, words(held)
            first, held, size = nth, [], 0
    if held:
        yield first, words(held)


def found_by(docs: DataFrame, key: str, block: Block) -> DataFrame:
    """SCHEMA, with the column ``key`` of docs for doc_id: the overlaps with a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            rows = [(ids[first + text], *m) for first, held in batches_of(b.column("text")) for text, *m in block.matches(held)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * 5)], ["doc_id", "item_id", "doc_start", "n_words", "n_same"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, doc_start, n_words, n_same: the best overlap of each document with each item that it repeats."""
    out = docs.sparkSession.createDataFrame([], SCHEMA)
    for block in blocks(benchmark):
        out = out.union(cut(found_by(docs, "doc_id", block)))
        del block
    top = F.max_by(F.struct("doc_start", "n_words", "n_same"), F.struct("n_same", "n_words", -F.col("doc_start")))
    return out.groupBy("doc_id", "item_id").agg(top.alias("x")).select("doc_id", "item_id", "x.*")


def clean(text: Column, block: Block) -> Column:
    """Whether a text repeats no item of the block. Only this comes back from Python, not the text."""

    @F.arrow_udf("boolean")
    def check(texts: pa.Array) -> pa.Array:
        out = np.ones(len(texts), bool)
        for first, held in batches_of(texts):
            out[[first + m[0] for m in block.matches(held)]] = False
        return pa.array(out)

    return check(text.cast("string"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that repeat a benchmark item. One block is a filter; of several, each writes down the rows that
    it finds, and these are left out at the end."""
    todo = blocks(benchmark)
    first, second = next(todo, None), next(todo, None)
    if second is None:
        return docs if first is None else docs.where(clean(docs["text"], first))
    rows = cut(docs.withColumn("__row", F.monotonically_increasing_id()))
    gone = cut(found_by(rows, "__row", first).select("doc_id").distinct()).union(cut(found_by(rows, "__row", second).select("doc_id").distinct()))
    del first, second
    for block in todo:
        gone = gone.union(cut(found_by(rows, "__row", block).select("doc_id").distinct()))
        del block
    marked = gone.distinct().select(F.col("doc_id").alias("__row"), F.lit(True).alias("__gone"))
    return small_join(rows, marked, ["__row"]).where("__gone is null").select(*docs.columns)
