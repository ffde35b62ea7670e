"""Language-model scoring with Elias-Fano n-gram tries.

The model is a trigram model, smoothed level by level. For a context h that was seen m times, followed by t kinds of words,
a word w has the probability max(c(hw) - D, 0) / m + D * t / m * P(w), where P is that of the level below (absolute
discounting, D by level), however often h was seen. A context that was never seen leaves P as it is. The lowest level is the
unigram model whose score is the base score. Texts begin after two start tokens.

Neither the words nor the n-grams of a corpus fit one machine, so both are dealt to shards, whose number follows the size of
the input, and no task, nor the driver, sees more than a shard:

1. Texts are cut into chunks of about CHUNK bytes, and a chunk's words numbered. It asks the shards of its words' hashes for
   their training counts and for identifiers, small for frequent words.
2. A context is hot if it was seen HOT times or more, and more than once in CONTEXTS tokens, so that there are at most CONTEXTS
   of them. Its successors are dealt to slices, each of which counts its kinds of them; the sums over slices, one number for
   each hot context, go to every task. This settles where counting is done, and no probability. A bigram whose first word is
   hot is asked for at a shard of that word's slice, which answers with the smoothed probability, and with the count if that
   makes the bigram hot as well; hot pairs of words have their kinds counted in the same way before trigrams are asked for.
3. A trigram is asked for at the shard of its middle word, which thus has all bigrams and all trigrams around that word; what
   is asked brings the last word's unigram probability along. Around a hot word trigrams are dealt by their first word as
   well, and bring the bigram's probability; after a hot pair of words also by the last one.
4. A shard counts, builds its trie and looks up in it, by successor search, everything that it was asked for. The trie has
   the middle words; their successors, each with a smoothed probability; their predecessors (so contexts of two words), each
   with a back-off weight; and below these the last words as places among the successors of the middle word alone (numbers
   relative to the shorter context), each with a smoothed probability. Levels are Elias-Fano sequences and 16-bit codes,
   read through a memory map.
5. Answers meet their chunk again, and the logarithms are added up by document.

Words are told apart by 64-bit hashes, and from there on by identifiers, which are exact.

Defined cases: a null or empty text is the end token alone; rows without doc_id count as those of an empty id; rows that
repeat an id are scored each; with no training document every probability is that of an unknown word; an empty table
gives no row; columns other than doc_id and text are ignored. A text is one value and stands in one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .common import crc_of_id, cut, discard
from .eftrie import CODES, EliasFano, Level, mapped, quantise, restore

CHUNK, SHARD = 16 << 20, 8 << 20
#: Discounts of bigrams and trigrams; the least frequency from which a context is hot, and how many contexts can be.
DISCOUNTS, HOT, CONTEXTS = (0.75, 0.9), 1 << 20, 1 << 20
#: Identifier of the start token, and hash of the end token.
START, END = 0, np.uint64(0x656E64)
ROWS = "chunk long, shard int, payload binary"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as bytes, compressed plane by plane."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        out += [f"{a.dtype.str}{len(a)};".encode().rjust(16), a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def unpack(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        kind, n = (x := raw[at : at + 16].decode().strip(" ;"))[:3], int(x[3:])
        kind = np.dtype(kind)
        at += 16
        out.append(np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n).T.copy().view(kind).ravel() if n else np.zeros(0, kind))
        at += n * kind.itemsize
    return out


def small(a: np.ndarray) -> np.ndarray:
    """Numbers in as few bytes as they fit."""
    most = a.max(initial=0)
    return a.astype(np.uint8 if most < 2**8 else np.uint16 if most < 2**16 else np.uint32 if most < 2**32 else np.uint64)


def steps(a: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Numbers that rise within each range as their differences; each range begins with its first number."""
    out = np.diff(a, prepend=a[:1] * 0)
    out[begins] = a[begins]
    return small(out)


def sums(d: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The inverse of steps, for ranges of these lengths."""
    total = np.cumsum(d, dtype=np.uint64)
    n = lengths.astype(np.int64)
    begins = np.cumsum(n) - n
    return total - np.repeat(total[begins] - d[begins], n) if len(d) else total


def deal(h: np.ndarray, n: int) -> np.ndarray:
    """The shard, 0 to n - 1, of each hash."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def slice_of(ids: np.ndarray, total: np.ndarray, hot: int) -> np.ndarray:
    """Which slice of a hot context, seen ``total`` times, has the words ``ids``."""
    return wordhash.mixed(ids) % (total.astype(np.uint64) // np.uint64(hot) + np.uint64(1)) + np.uint64(1)


def begins_of(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def rows_of(chunk, shard, payloads: list[bytes]) -> pa.RecordBatch:
    n = len(payloads)
    make = lambda x, t: pa.array([x] * n if np.isscalar(x) else x, t)
    return pa.RecordBatch.from_arrays([make(chunk, pa.int64()), make(shard, pa.int32()), pa.array(payloads, pa.binary())], ["chunk", "shard", "payload"])


def smoothed(n: np.ndarray, m: np.ndarray, kinds: np.ndarray, discount: float, below: np.ndarray) -> np.ndarray:
    """The probability of n-grams seen n times after contexts seen m times and followed by so many kinds of words."""
    return np.maximum(n - discount, 0) / m + discount * kinds / m * below


def back_off(m: np.ndarray, kinds: np.ndarray, discount: float) -> np.ndarray:
    """The weight of the level below; 1 for a context that was never seen."""
    return np.where(m == 0, 1.0, discount * kinds / np.maximum(m, 1))


class Kinds:
    """How many kinds of words follow each hot context: rows (second, first, kinds), first being 0 for contexts of one word."""

    def __init__(self, rows: list[tuple[int, int, int]]) -> None:
        last, before, self.kinds = (np.array([r[i] for r in rows], np.uint64) for i in range(3))
        self.last, of = np.unique(last, return_inverse=True)
        self.keys = self.key(of, before)
        order = np.argsort(self.keys)
        self.keys, self.kinds = self.keys[order], self.kinds[order].astype(np.int64)

    @staticmethod
    def key(of: np.ndarray, before: np.ndarray) -> np.ndarray:
        return of.astype(np.uint64) << np.uint64(43) | before.astype(np.uint64)  # identifiers are below 2^43

    def __call__(self, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The kinds of contexts that are all hot."""
        keys = self.key(np.searchsorted(self.last, last), before)
        at = np.searchsorted(self.keys, keys)
        if len(keys) and (at.max() == len(self.keys) or (self.keys[at] != keys).any()):
            raise ValueError("a context that is hot was not counted")
        return self.kinds[at]


def lower(code: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The code of a probability times that of a back-off weight."""
    return np.minimum(code.astype(np.int64) + weight - 1, CODES).astype(np.uint16)


# chunks


def tokenise(shards: int, most: int):
    """doc_id, train, text to chunks: a row of shard -1 with document ids, whether they are null, train flags, token counts and
    token numbers (in order of the words' hashes), and rows that ask each shard for words: their hashes and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nth = TaskContext.get().partitionId(), 0
        ids, train, texts, size = [], [], [], 0

        def chunk() -> pa.RecordBatch:
            h, n = wordhash.of_words(texts)
            words, tokens = np.unique(np.insert(h, np.cumsum(n), END), return_inverse=True)
            learns = np.array(train, bool)
            counts = np.bincount(tokens, np.repeat(learns, n + 1), len(words)).astype(np.int64)
            cuts = np.searchsorted(deal(words, shards), np.arange(shards + 1))
            full = np.flatnonzero(np.diff(cuts))
            null = np.array([i is None for i in ids])
            body = pack(np.array([i or 0 for i in ids], np.int64), null, learns, small(n + 1), small(tokens))
            return rows_of(part << 32 | nth, np.concatenate([[-1], full]), [body, *(pack(words[cuts[s] : cuts[s + 1]], small(counts[cuts[s] : cuts[s + 1]])) for s in full)])

        for b in batches:
            for i, learn, text in zip(b.column("doc_id").to_pylist(), b.column("train").to_pylist(), b.column("text"), strict=True):
                ids.append(i)
                train.append(learn)
                texts.append((text.as_py() or "").encode("utf-8", "surrogatepass"))
                size += len(texts[-1]) + 16
                if size >= most:
                    yield chunk()
                    nth += 1
                    ids, train, texts, size = [], [], [], 0
        if ids:
            yield chunk()

    return run


def answer_words(shards: int):
    """Training counts and identifiers of the words that one shard was asked for, and sums over all of its words."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        asked = [unpack(p.as_py()) for p in t.column("payload")]
        words, inverse = np.unique(np.concatenate([x[0] for x in asked]), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([x[1] for x in asked]), len(words)).astype(np.int64)
        ids = np.empty(len(words), np.uint64)
        ids[np.argsort(-counts, kind="stable")] = np.arange(len(words), dtype=np.uint64) * np.uint64(shards) + np.uint64(key[0].as_py() + 1)
        cuts = np.cumsum([len(x[0]) for x in asked])[:-1]
        answers = [pack(small(c), small(i)) for c, i in zip(np.split(counts[inverse], cuts), np.split(ids[inverse], cuts), strict=True)]
        first = lambda x: pa.array([int(x)] + [0] * (t.num_rows - 1), pa.int64())
        out = {"chunk": t.column("chunk"), "shard": t.column("shard"), "payload": pa.array(answers, pa.binary())}
        return pa.table({**out, "tokens": first(counts.sum()), "types": first((counts > 0).sum())})

    return run


class Corpus:
    """What holds for all chunks: shards, training tokens, types and documents, the frequency from which a context is hot, and
    the kinds of words after hot words and hot pairs."""

    def __init__(self, shards: int, tokens: int, types: int, documents: int) -> None:
        self.shards, self.tokens, self.types, self.documents = shards, tokens, types, documents
        self.from_count = max(HOT, -(-tokens // CONTEXTS))
        self.after_word = self.after_pair = Kinds([])


class Chunk:
    """A chunk's tokens and what is known of their words. Words are numbered anew, in order of their identifiers' shards; the
    start token is one of them."""

    def __init__(self, state: bytes, corpus: Corpus) -> None:
        self.corpus = corpus
        self.ids, self.null, self.train, lengths, tokens, counts, ids, *pairs = unpack(state)
        self.lengths, counts, ids = lengths.astype(np.int64), np.append(counts.astype(np.int64), corpus.documents), np.append(ids.astype(np.uint64), np.uint64(START))
        self.pair_code, hot, n = pairs or (np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.pair_count = np.zeros(len(self.pair_code), np.int64)
        self.pair_count[hot] = n
        home = deal(wordhash.mixed(ids), corpus.shards)
        order = np.lexsort((ids, home))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        self.counts, self.word, self.home = counts[order], ids[order], home[order]
        self.tokens, self.start = place[tokens], int(place[-1])
        self.base = np.log10((self.counts + 0.5) / (corpus.tokens + 0.5 * (corpus.types + 1)))
        self.codes = quantise(self.base)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.learned = np.repeat(self.train, self.lengths)
        self.before = self.previous(self.tokens)

    def previous(self, a: np.ndarray) -> np.ndarray:
        out = np.empty_like(a)
        out[1:] = a[:-1]
        out[self.begins] = self.start
        return out

    def distinct(self, at: np.ndarray, *columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Of tokens at these places: the distinct rows of some columns of word numbers, in order, how often the training has
        each, and the number of each token's row."""
        size, bits = len(self.word), len(self.word).bit_length()
        key = columns[0][at].astype(np.int64)
        names = []
        for c in columns[1:]:
            if int(key.max(initial=0)).bit_length() + bits > 63:
                name, key = np.unique(key, return_inverse=True)
                names.append(name)
            else:
                names.append(None)
            key = key * size + c[at]
        keys, inverse = np.unique(key, return_inverse=True)
        inverse = inverse.astype(np.int32)
        n = np.bincount(inverse, self.learned[at], len(keys)).astype(np.int64)
        out = []
        for name in reversed(names):
            keys, last = np.divmod(keys, size)
            out.append(last)
            keys = keys if name is None else name[keys]
        return [keys, *reversed(out)], n, inverse

    # bigrams after hot words

    def pairs(self) -> None:
        (a, b), n, _ = self.distinct(np.flatnonzero(self.counts[self.before] >= self.corpus.from_count), self.before, self.tokens)
        shard = deal(wordhash.mixed(self.word[a] ^ wordhash.mixed(slice_of(self.word[b], self.counts[a], self.corpus.from_count))), self.corpus.shards)
        self.pair_key, self.pair_order = a * len(self.word) + b, np.argsort(shard, kind="stable")
        self.pair_shard, self.pair = shard[self.pair_order], [x[self.pair_order] for x in (a, b, n)]

    def ask_pairs(self) -> Iterator[tuple[int, bytes]]:
        self.pairs()
        a, b, n = self.pair
        for s, lo, hi in self.runs(self.pair_shard):
            begins = begins_of(a[lo:hi])
            yield s, pack(small(self.word[a[lo:hi][begins]]), small(self.counts[a[lo:hi][begins]]), small(np.diff(np.append(begins, hi - lo))), small(self.word[b[lo:hi]]), small(n[lo:hi]), self.codes[b[lo:hi]])

    def learn_pairs(self, answers: list[bytes]) -> tuple[np.ndarray, ...]:
        """Of the bigrams that were asked for, in order: their codes, which of them are hot, and the counts of these."""
        self.pairs()
        got = [unpack(p) for p in answers]
        ends = np.cumsum([len(x[0]) for x in got])
        codes = np.empty(len(self.pair_key), np.uint16)
        codes[self.pair_order] = np.concatenate([x[0] for x in got] + [np.zeros(0, np.uint16)])
        hot = [self.pair_order[end - len(x[0]) + x[1].astype(np.int64)] for x, end in zip(got, ends, strict=True)]
        return codes, *(small(np.concatenate([*x, np.zeros(0, np.int64)])) for x in (hot, [x[2] for x in got]))

    def of_pairs(self, a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
        """What is known of bigrams; 0 for those that were not asked for."""
        key = a * len(self.word) + b
        at = np.minimum(np.searchsorted(self.pair_key, key), max(len(self.pair_key) - 1, 0))
        return np.where(self.pair_key[at] == key, values[at], 0) if len(self.pair_key) else np.zeros(len(key), values.dtype)

    # trigrams

    def slice_of_triples(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, total: np.ndarray) -> np.ndarray:
        """The shards of trigrams around hot words; total is 0 unless the first two words are hot as a pair."""
        key = self.word[b] ^ wordhash.mixed(slice_of(self.word[a], self.counts[b], self.corpus.from_count))
        more = slice_of(self.word[c], total, self.corpus.from_count) * np.uint64(1 << 40)
        return deal(wordhash.mixed(np.where(total > 0, wordhash.mixed(key ^ wordhash.mixed(self.word[a])) ^ more, key)), self.corpus.shards)

    def total_of_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How often pairs with a hot second word were seen; 0 if that does not make them hot."""
        total = np.where((a == self.start) & (b == self.start), self.corpus.documents, self.of_pairs(a, b, self.pair_count))
        return np.where(total < self.corpus.from_count, 0, total)

    def ask_kinds(self) -> Iterator[tuple[int, bytes]]:
        """The training's distinct trigrams that begin with a hot pair, for the shards that have their slices."""
        self.pairs()
        past = self.previous(self.before)
        at = np.flatnonzero(self.learned & (self.counts[self.before] >= self.corpus.from_count))
        at = at[self.total_of_pairs(past[at], self.before[at]) > 0]
        (b, a, c), _, _ = self.distinct(at, self.before, past, self.tokens)
        shard = self.slice_of_triples(a, b, c, self.total_of_pairs(a, b))
        order = np.argsort(shard, kind="stable")
        b, a, c, shard = b[order], a[order], c[order], shard[order]
        for s, lo, hi in self.runs(shard):
            yield s, pack(*(small(self.word[x[lo:hi]]) for x in (b, a, c)))

    def triples(self) -> np.ndarray:
        """Sets shard, words, counts, lower codes and so on of the distinct trigrams whose middle word was seen, in order of
        shards; gives for each token the number of its trigram, -1 where it has none."""
        seen = np.flatnonzero(self.counts[self.before] > 0)
        self.pairs()
        (b, a, c), n, inverse = self.distinct(seen, self.before, self.previous(self.before), self.tokens)
        shard, hot, code, total = self.home[b], self.counts[b] >= self.corpus.from_count, self.codes[c], np.zeros(len(b), np.int64)
        at = np.flatnonzero(hot)
        if len(at):
            code[at] = self.of_pairs(b[at], c[at], self.pair_code)
            total[at] = self.total_of_pairs(a[at], b[at])
            shard[at] = self.slice_of_triples(a[at], b[at], c[at], total[at])
        order = np.argsort(shard, kind="stable")
        self.shard, self.triple = shard[order], [x[order] for x in (b, a, c, n, code, hot, total)]
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        of = np.full(len(self.tokens), -1, np.int32)
        of[seen] = place[inverse]
        return of

    def runs(self, shard: np.ndarray) -> Iterator[tuple[int, int, int]]:
        begins = begins_of(shard)
        yield from zip(shard[begins].tolist(), begins.tolist(), [*begins[1:].tolist(), len(shard)], strict=False)

    def ask_triples(self) -> Iterator[tuple[int, bytes]]:
        self.triples()
        for s, lo, hi in self.runs(self.shard):
            b, a, c, n, code, hot, total = (x[lo:hi] for x in self.triple)
            contexts = begins_of(b, a)
            middles = begins_of(b[contexts])
            first = contexts[middles]
            yield s, pack(
                steps(self.word[b[first]], np.zeros(1, np.int64)), hot[first], small(np.diff(np.append(middles, len(contexts)))),
                steps(self.word[a[contexts]], middles), small(total[contexts]), small(np.diff(np.append(contexts, hi - lo))), small(self.word[c]), small(n), code,
            )

    def result(self, answers: list[bytes]) -> pa.Table:
        of = self.triples()
        codes = np.concatenate([unpack(p)[0] for p in answers] + [np.zeros(1, np.uint16)])
        base = self.base[self.tokens]
        scores = np.where(of >= 0, restore(codes[of]), base)
        add = lambda x: np.add.reduceat(x, self.begins)
        return pa.table({
            "doc_id": pa.array(self.ids, pa.int64(), mask=self.null), "held_out": pa.array(~self.train), "n_tokens": pa.array(self.lengths), "n_known": pa.array(add((self.counts > 0)[self.tokens].astype(np.int64))),
            "train_tokens": pa.array(np.full(len(self.ids), self.corpus.tokens, np.int64)), "base_score": pa.array(add(base)), "score": pa.array(add(scores)),
        })


# shards


def kinds_of_words(payloads: list[bytes], corpus: Corpus) -> tuple[np.ndarray, ...]:
    """Of the slices of hot words that one shard has: the words, zeros, their kinds of successors, and how many of these make
    a hot pair."""
    asked = [unpack(p) for p in payloads]
    context, lengths, word, n = (np.concatenate([x[i].astype(np.uint64) for x in asked]) for i in (0, 2, 3, 4))
    contexts, dense = np.unique(context, return_inverse=True)
    words, number = np.unique(word, return_inverse=True)
    grams, _, n = counted(np.repeat(dense, lengths.astype(np.int64)), number, len(words), n)
    count = lambda chosen: np.bincount(grams[chosen] // len(words), minlength=len(contexts))
    return contexts, np.zeros(len(contexts), np.uint64), count(n > 0), count(n >= corpus.from_count)


def kinds_of_pairs(payloads: list[bytes], corpus: Corpus) -> tuple[np.ndarray, ...]:
    """The same of hot pairs: second words, first words, kinds, zeros."""
    b, a, c = (np.concatenate(x).astype(np.uint64) for x in zip(*[unpack(p) for p in payloads], strict=True))
    order = np.lexsort((c, a, b))
    b, a, c = b[order], a[order], c[order]
    new = begins_of(b, a, c)
    b, a = b[new], a[new]
    begins = begins_of(b, a)
    return b[begins], a[begins], np.diff(np.append(begins, len(b))), np.zeros(len(begins), np.int64)


def answer_pairs(payloads: list[bytes], corpus: Corpus) -> list[bytes]:
    """The codes of the bigrams after hot words that one shard was asked for, and the counts of those that are hot."""
    asked = [unpack(p) for p in payloads]
    context, total, lengths, word, n, code = (np.concatenate([x[i].astype(np.uint64) for x in asked]) for i in range(6))
    contexts, first, dense = np.unique(context, return_index=True, return_inverse=True)
    words, number = np.unique(word, return_inverse=True)
    grams, inverse, n, code = counted(np.repeat(dense, lengths.astype(np.int64)), number, len(words), n, code)
    h, m, kinds = grams // len(words), total[first].astype(np.float64), corpus.after_word(contexts, np.zeros(len(contexts), np.uint64))
    weight = quantise(np.log10(np.maximum(back_off(m, kinds, DISCOUNTS[0]), 1e-15)))
    seen = n > 0
    p = quantise(np.log10(smoothed(n[seen], m[h[seen]], kinds[h[seen]], DISCOUNTS[0], 10 ** restore(code[seen]))))
    (level,) = mapped([Level.build(h[seen], grams[seen] % len(words), p, len(contexts))])
    out = level.code(level.find(h, grams % len(words)), lower(code, weight[h]))
    cuts = np.cumsum([len(x[3]) for x in asked])[:-1]
    back = []
    for i in np.split(inverse, cuts):
        hot = np.flatnonzero(n[i] >= corpus.from_count)
        back.append(pack(out[i], small(hot), small(n[i][hot])))
    return back


def counted(first: np.ndarray, second: np.ndarray, size: int, n: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct first * size + second in order, the number of each row among them, their sums of n, and of each of ``more`` the
    value at some row of theirs, which all have."""
    key = first.astype(np.int64) * size + second
    keys, at, inverse = np.unique(key, return_index=True, return_inverse=True)
    return keys, inverse, np.bincount(inverse, n, len(keys)).astype(np.int64), *(x[at] for x in more)


def answer_triples(payloads: list[bytes], corpus: Corpus) -> list[bytes]:
    """The codes of the trigrams that one shard was asked for, by its trie."""
    asked = [unpack(p) for p in payloads]
    middle = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in asked])
    past = np.concatenate([sums(x[3], x[2]) for x in asked])
    hot, contexts_of, total, words_of, word, n, code = (np.concatenate([x[i] for x in asked]) for i in (1, 2, 4, 5, 6, 7, 8))
    middles, first, b = np.unique(middle, return_index=True, return_inverse=True)
    hot, b = hot[first], np.repeat(b, contexts_of)
    pasts, a = np.unique(past, return_inverse=True)
    words, c = np.unique(word, return_inverse=True)
    # contexts of two words, then bigrams, then trigrams as a context and its successor's place among those of the middle word
    contexts, context, _, total = counted(b, a, len(pasts), np.zeros(len(b)), total.astype(np.int64))
    context, b = np.repeat(context, words_of), np.repeat(b, words_of)
    pairs, pair, n2, code2 = counted(b, c, len(words), n, code)
    triples, inverse, n3 = counted(context, pair, len(pairs), n)
    del word, past, middle, a, c, b
    parent, last = np.divmod(pairs, len(words))
    m, kinds = np.bincount(parent, n2, len(middles)), np.bincount(parent, n2 > 0, len(middles))
    weight = quantise(np.log10(np.maximum(back_off(m, kinds, DISCOUNTS[0]), 1e-15)))
    # around a hot word the bigram's probability has come along
    seen = n2 > 0
    p2 = quantise(np.log10(smoothed(n2[seen], m[parent[seen]], kinds[parent[seen]], DISCOUNTS[0], 10 ** restore(code2[seen]))))
    p2 = np.where(hot[parent[seen]], code2[seen], p2)
    two = Level.build(parent[seen], last[seen], p2, len(middles))
    below = np.where(hot[parent], code2, lower(code2, weight[parent]))
    of, at = np.divmod(triples, len(pairs))
    own, kinds = np.bincount(of, n3, len(contexts)), np.bincount(of, n3 > 0, len(contexts))
    is_hot = total > 0
    m = np.where(is_hot, total, own)
    kinds[is_hot] = corpus.after_pair(middles[contexts[is_hot] // len(pasts)], pasts[contexts[is_hot] % len(pasts)])
    weights = quantise(np.log10(np.maximum(back_off(m, kinds, DISCOUNTS[1]), 1e-15)))
    past = Level.build(contexts // len(pasts), contexts % len(pasts), weights, len(middles))
    (two, past) = mapped([two, past])
    # every number below is searched in the levels above, as a reader of the trie has to
    places = two.find(parent, last)
    below = two.code(places, below)
    relative = places - two.pointers.get(parent)
    seen = n3 > 0
    p3 = quantise(np.log10(smoothed(n3[seen], m[of[seen]], kinds[of[seen]], DISCOUNTS[1], 10 ** restore(below[at[seen]]))))
    (three,) = mapped([Level.build(of[seen], relative[at[seen]], p3, len(contexts))])
    where = past.find(contexts // len(pasts), contexts % len(pasts))
    found = np.full(len(triples), -1, np.int64)
    known = np.flatnonzero(places[at] >= 0)
    found[known] = three.find(where[of[known]], relative[at[known]])
    out = three.code(found, lower(below[at], past.codes[where][of]))
    return [pack(out[i]) for i in np.split(inverse, np.cumsum([len(x[6]) for x in asked])[:-1])]


# the whole


def by_shard(t: pa.Table) -> list[bytes]:
    order = np.argsort(t.column("shard").to_numpy(), kind="stable")
    return [p.as_py() for p in t.column("payload").combine_chunks().take(pa.array(order))]


def exchange(asked: DataFrame, answer, corpus: Corpus) -> DataFrame:
    """What the shards answer to rows that ask them, each for its chunk."""

    def run(t: pa.Table) -> pa.Table:
        return pa.table({"chunk": t.column("chunk"), "shard": t.column("shard"), "payload": pa.array(answer(t.column("payload").to_pylist(), corpus), pa.binary())})

    return cut(asked.groupBy("shard").applyInArrow(run, ROWS))


def hot_kinds(asked: DataFrame, count, corpus: Corpus) -> tuple[Kinds, int]:
    """The kinds of all hot contexts, of which there are at most CONTEXTS, and how many hot pairs the slices have found."""

    def run(t: pa.Table) -> pa.Table:
        b, a, kinds, pairs = count(t.column("payload").to_pylist(), corpus)
        return pa.table({"b": pa.array(b.astype(np.int64)), "a": pa.array(a.astype(np.int64)), "kinds": pa.array(kinds.astype(np.int64)), "pairs": pa.array(pairs.astype(np.int64))})

    slices = asked.groupBy("shard").applyInArrow(run, "b long, a long, kinds long, pairs long")
    rows = slices.groupBy("b", "a").agg(F.sum("kinds").alias("kinds"), F.sum("pairs").alias("pairs")).collect()
    return Kinds([(r["b"], r["a"], r["kinds"]) for r in rows]), sum(r["pairs"] for r in rows)


def score(docs: DataFrame, training=None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row. training: which rows the model
    learns from; those whose crc32 of the id, mod 5, is not 1, if not given."""
    training = crc_of_id(F.col("doc_id")) % 5 != 1 if training is None else training
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(training, F.lit(False)).alias("train"), F.col("text").cast("string").alias("text"))
    size, documents = rows.agg(F.sum(F.octet_length("text")), F.count_if("train")).first()
    shards = max(12, -(-(size or 0) // SHARD))
    made = cut(rows.mapInArrow(tokenise(shards, CHUNK), ROWS))
    known = cut(made.where("shard >= 0").groupBy("shard").applyInArrow(answer_words(shards), ROWS + ", tokens long, types long"))
    tokens, types = known.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "types")]).first()
    corpus = Corpus(shards, tokens, types, documents)

    def ask(state: DataFrame, work) -> DataFrame:
        """What each chunk asks the shards."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for chunk, payload in zip(b.column("chunk").to_pylist(), b.column("payload"), strict=True):
                    asked = [*work(Chunk(payload.as_py(), corpus))]
                    yield rows_of(chunk, [s for s, _ in asked], [p for _, p in asked])

        return state.mapInArrow(run, ROWS)

    def meet(state: DataFrame, answers: DataFrame, work) -> DataFrame:
        """Each chunk with what it has been answered."""

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            payload = work(left.column("payload")[0].as_py(), by_shard(right))
            return pa.Table.from_batches([rows_of(left.column("chunk")[0].as_py(), [-1], [payload])]) if isinstance(payload, bytes) else payload

        schema = RESULT if work is finish else ROWS
        return state.groupBy("chunk").cogroup(answers.select("chunk", "shard", "payload").groupBy("chunk")).applyInArrow(run, schema)

    def learn_words(body: bytes, answers: list[bytes]) -> bytes:
        got = [unpack(p) for p in answers]
        return pack(*unpack(body), *(small(np.concatenate([x[i].astype(np.uint64) for x in got])) for i in (0, 1)))

    def learn_pairs(state: bytes, answers: list[bytes]) -> bytes:
        return pack(*unpack(state), *Chunk(state, corpus).learn_pairs(answers))

    def finish(state: bytes, answers: list[bytes]) -> pa.Table:
        return Chunk(state, corpus).result(answers)

    # what a step has read is deleted when its outcome is written, so that the disk holds one state of the chunks
    first = cut(meet(made.where("shard < 0"), known, learn_words))
    discard(made, known)
    asked = cut(ask(first, Chunk.ask_pairs))
    corpus.after_word, pairs = hot_kinds(asked, kinds_of_words, corpus)
    answers = exchange(asked, answer_pairs, corpus)
    second = cut(meet(first, answers, learn_pairs))
    discard(first, asked, answers)
    if pairs or documents >= corpus.from_count:
        corpus.after_pair, _ = hot_kinds(ask(second, Chunk.ask_kinds), kinds_of_pairs, corpus)
    return meet(second, exchange(ask(second, Chunk.ask_triples), answer_triples, corpus), finish)
