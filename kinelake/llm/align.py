"""Alignment of two tokenizers' tokens by an event sweep.

Each text is encoded by both tokenizers. The end of a token, in bytes of the text with a space before it, is an event; the
events of both sides are united, repartitioned by document, sorted by offset within partitions, and streamed through a state
machine. Where both sides end, a group of tokens closes. Each stretch between neighbouring ends lies in one token of either
side: that is a link. Events travel in blocks of up to BLOCK neighbouring ones of one side, a row each, which says where it
begins; ends follow from the tokens' lengths.

The machine takes whole documents, as many as have about SLICE events; of a longer document it takes what lies before the
last common end so far, and keeps the rest. What it holds does not grow with the document; only an open group is held until
it closes, since its digest names all tokens of one side first (a few bytes a token; the text itself was one value).

How many documents hold a pair of ids linked is counted over chunks of the machine's output: each chunk asks once for every
pair that it has, so lookups cost as many rows as chunks have different pairs, whatever the number of documents. Nothing is
broadcast. Documents that a slice did not hold whole are made distinct by Spark first.

Defined cases: a text that is null, empty, no valid UTF-8, or whose tokens do not spell it (or are without bytes) has no
tokens; rows are taken each, also those that repeat an id or have none; an empty table gives no row; columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spool

BLOCK, SLICE, CHUNK = 4096, 1 << 19, 1 << 20
TOKENIZERS = "/opt/tokenizers"
#: What byte-level pieces begin with, and how a pre-tokenizer of that kind splits a text: fixed values of the vocabulary.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
EVENTS = "doc binary, copy long, doc_id long, at long, side int, ids binary"
SEGMENTS = "chunk long, doc binary, copy long, doc_id long, whole boolean, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


class ByteLevel:
    """A byte-level vocabulary (JSON). Its ids are in order of merges, so ranks encode it; what the fast encoder refuses
    goes to the library that the file is made for."""

    def __init__(self, path: str) -> None:
        import tiktoken

        self.path, self.slow = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in printable]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}
        special = {x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if i not in special}
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.bytes[i] = piece
        self.fast = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        try:
            return self.fast.encode_ordinary(text)
        except BaseException as error:  # the encoder's own failures are no Exceptions
            if not isinstance(error, Exception) and type(error).__name__ != "PanicException":
                raise
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
            self.slow.encode_special_tokens = True
        return self.slow.encode(text, add_special_tokens=False).ids


class Pieces:
    """A vocabulary of pieces with byte fallback."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.GetPieceSize()
        names = [self.model.IdToPiece(i) for i in range(n)]
        self.bytes = [bytes([int(p[3:-1], 16)]) if self.model.IsByte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


class Sides:
    """The tokenizers of both sides, made once in each worker."""

    made: dict[str, Sides] = {}

    def __init__(self, folder: str) -> None:
        self.a, self.b = ByteLevel(f"{folder}/byte_bpe_50k.json"), Pieces(f"{folder}/piece_bpe_32k.model")
        self.lengths = [np.array([len(x) for x in side.bytes], np.int64) for side in (self.a, self.b)]

    @classmethod
    def of(cls, folder: str) -> Sides:
        if folder not in cls.made:
            cls.made[folder] = cls(folder)
        return cls.made[folder]

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides, if both spell the text after a space."""
        if not text:
            return None
        spelled = (" " + text).encode("utf-8", "surrogatepass")
        out = []
        for side, ids, lengths in zip((self.a, self.b), (self.a.encode(" " + text), self.b.encode(text)), self.lengths, strict=True):
            if b"".join([side.bytes[i] for i in ids]) != spelled:
                return None
            out.append(np.array(ids, np.int64))
            if not lengths[out[-1]].all():
                return None
        return out[0], out[1]


def text_of(value: pa.StringScalar) -> str | None:
    try:
        return value.as_py()
    except UnicodeDecodeError:
        return None


def events(folder: str):
    """doc_id, text to blocks of events. A document is named by a hash of its row; rows that are alike, by their number within
    the task, so that names do not depend on the order in which rows come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, sides, packer, seen = TaskContext.get().partitionId() << 32, Sides.of(folder), zstandard.ZstdCompressor(level=1), {}
        out: list[list] = [[] for _ in range(6)]

        def flush() -> pa.RecordBatch:
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            made = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["doc", "copy", "doc_id", "at", "side", "ids"])
            for x in out:
                x.clear()
            return made

        for batch in batches:
            for doc_id, value in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text_of(value)
                name = xxhash.xxh3_128_digest(f"{doc_id}:".encode() + (text or "").encode("utf-8", "surrogatepass"))
                nth = seen[name] = seen.get(name, -1) + 1
                ids = sides.tokens(text)
                blocks = [(0, -1, b"")]
                if ids:
                    blocks = []
                    for side, (x, lengths) in enumerate(zip(ids, sides.lengths, strict=True)):
                        ends = np.cumsum(lengths[x])
                        for i in range(0, len(x), BLOCK):
                            blocks.append((int(ends[i - 1]) if i else 0, side, packer.compress(x[i : i + BLOCK].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())))
                for at, side, packed in blocks:
                    for column, v in zip(out, (name, part + nth, doc_id, at, side, packed), strict=True):
                        column.append(v)
                if len(out[0]) >= 512:
                    yield flush()
        if out[0]:
            yield flush()

    return run


def unpacked(packed: bytes, unpacker: zstandard.ZstdDecompressor) -> np.ndarray:
    return np.frombuffer(unpacker.decompress(packed), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


class Written:
    """Writes groups as text: decimal ids, each followed by one mark."""

    def __init__(self, most: int) -> None:
        ids = np.arange(most + 1)
        self.width = len(str(most))
        self.digits = np.zeros((most + 1, self.width + 1), np.uint8)
        self.lengths = np.ones(most + 1, np.int64)
        for k in range(1, self.width):
            self.lengths += ids >= 10**k
        for k in range(self.width):
            has = self.lengths > k
            self.digits[has, k] = 48 + ids[has] // 10 ** (self.lengths[has] - 1 - k) % 10

    def write(self, ids: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The text as bytes, and where each id's part ends."""
        cells, n = self.digits[ids], self.lengths[ids]
        cells[np.arange(len(ids)), n] = marks
        return cells[np.arange(self.width + 1) <= n[:, None]], np.cumsum(n + 1)


class Sweep:
    """The machine: blocks of events in order of document and offset in, segments of documents out."""

    def __init__(self, part: int, folder: str) -> None:
        self.sides = Sides.of(folder)
        self.sizes = [len(x) for x in self.sides.lengths]
        self.writer = Written(max(self.sizes))
        self.chunk, self.entries = part << 32, 0
        self.open: tuple | None = None  # the document that was begun: its name, digest, and whether a mark is owed
        self.held: list[tuple] = []
        self.count, self.limit = 0, SLICE

    def take(self, row: tuple) -> pa.RecordBatch | None:
        """row: doc, copy, doc_id, at, side, ids."""
        self.held.append(row)
        self.count += len(row[5]) + 16
        return self.flush(False) if self.count >= self.limit else None

    def flush(self, ended: bool) -> pa.RecordBatch | None:
        last = self.held[-1][:2] if self.held else None
        at = len(self.held)
        if not ended:
            while at and self.held[at - 1][:2] == last:
                at -= 1
        whole, self.held = self.held[:at], self.held[at:]
        partly = False
        if not whole and not ended:
            whole, self.held = self.held, []
            partly = whole[0][4] >= 0  # one without tokens is a single row
        out = self.swept(whole, partly) if whole else None
        self.count = sum(len(r[5]) + 16 for r in self.held)
        self.limit = max(SLICE, 2 * self.count) if partly else SLICE
        return out

    def swept(self, rows: list[tuple], partly: bool) -> pa.RecordBatch:
        docs: list[tuple] = []
        numbers = np.empty(len(rows), np.int64)
        for i, r in enumerate(rows):
            if not docs or docs[-1][:2] != r[:2]:
                docs.append(r[:3])
            numbers[i] = len(docs) - 1
        side = np.array([r[4] for r in rows])
        tokens = []  # of either side: ids, documents, ends in the document
        for s in (0, 1):
            mine = np.flatnonzero(side == s)
            n = np.array([len(rows[i][5]) for i in mine], np.int64)
            ids = np.concatenate([rows[i][5] for i in mine] + [np.zeros(0, np.int64)])
            total = np.cumsum(self.sides.lengths[s][ids])
            before = np.append(0, total)[np.cumsum(n) - n]
            begins = np.array([rows[i][3] for i in mine], np.int64)
            tokens.append([ids, np.repeat(numbers[mine], n), total + np.repeat(begins - before, n)])
        # offsets of all documents in one line
        reach = np.zeros(len(docs) + 1, np.int64)
        for _, d, ends in tokens:
            np.maximum.at(reach, d + 1, ends + 1)
        base = np.cumsum(reach)
        place = [ends + base[d] for _, d, ends in tokens]
        if partly:
            both = np.intersect1d(*place, assume_unique=True)
            cut = both[-2] if len(both) > 1 else -1  # the last group stays, so that something is left to close the document with
            rest = []
            for s, (ids, _, ends) in enumerate(tokens):
                k = int(np.searchsorted(place[s], cut, "right"))
                if k < len(ids):
                    rest.append((*docs[0], int(ends[k] - self.sides.lengths[s][ids[k]]), s, ids[k:]))
                tokens[s] = [x[:k] for x in tokens[s]]
                place[s] = place[s][:k]
            self.held = sorted(rest, key=lambda r: (r[3], r[4]))
        (a, doc_a, _), (b, doc_b, _) = tokens
        at = np.concatenate(place)
        order = np.argsort(at, kind="stable")  # a merge of two sorted runs
        at, is_a = at[order], order < len(a)
        new = np.ones(len(at), bool)
        new[1:] = at[1:] != at[:-1]
        first = np.flatnonzero(new)
        link_a = (np.cumsum(is_a) - is_a)[first]
        link_b = first - link_a
        common = np.flatnonzero(~new)  # the second of two ends at one offset
        ends_a = np.cumsum(is_a)[common]
        ends_b = common + 1 - ends_a
        doc_of_group = doc_b[ends_b - 1]
        count = lambda d: np.bincount(d, minlength=len(docs)).astype(np.int64)
        groups = count(doc_of_group)
        written, upto = self.text(a, b, ends_a, ends_b)
        pieces = np.append(0, upto[np.cumsum(count(doc_a) + count(doc_b)) - 1] if len(upto) else np.zeros(len(docs), np.int64))
        pieces[1:][np.cumsum(count(doc_a) + count(doc_b)) == 0] = 0
        digests, whole = [], []
        for i, d in enumerate(docs):
            text = written[pieces[i] : pieces[i + 1]]
            going = self.open if self.open and self.open[0] == d[:2] else None
            digest, owed = going[1:] if going else (hashlib.sha256(), False)
            if len(text):
                if owed:
                    digest.update(b";")
                digest.update(text[:-1])  # the last mark is owed until more comes
                owed = True
            whole.append(not going and not partly)
            digests.append(None if partly else digest.hexdigest() if owed else "")
            self.open = (d[:2], digest, owed) if partly else None
        pairs, times = np.unique((doc_a[link_a] * self.sizes[0] + a[link_a]) * self.sizes[1] + b[link_b], return_counts=True)
        of = pairs // (self.sizes[0] * self.sizes[1])
        offsets = np.append(0, np.cumsum(count(of)))
        chunk = self.chunk
        self.entries += len(pairs) + len(docs)
        if self.entries >= CHUNK:
            self.chunk, self.entries = self.chunk + 1, 0
        lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, k)) for x, k in ((pairs % (self.sizes[0] * self.sizes[1]), pa.int64()), (times, pa.int32()))]
        columns = [
            pa.array([chunk] * len(docs), pa.int64()), pa.array([d[0] for d in docs], pa.binary()), pa.array([d[1] for d in docs], pa.int64()), pa.array([d[2] for d in docs], pa.int64()), pa.array(whole),
            pa.array(count(doc_a)), pa.array(count(doc_b)), pa.array(groups), pa.array(count(doc_a[link_a])), pa.array(digests, pa.string()), *lists,
        ]
        return pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in SEGMENTS.split(", ")])

    def text(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All groups one after the other: ids of one side, a bar, ids of the other, a semicolon."""
        n = np.arange(len(ends_a))
        group_a, group_b = np.repeat(n, np.diff(ends_a, prepend=0)), np.repeat(n, np.diff(ends_b, prepend=0))
        ids, marks = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[np.arange(len(a)) + np.append(0, ends_b)[group_a]] = a
        ids[np.arange(len(b)) + ends_a[group_b]] = b
        marks[ends_a + np.append(0, ends_b)[n] - 1] = ord("|")
        marks[ends_a + ends_b - 1] = ord(";")
        return self.writer.write(ids, marks)


def sweep(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        machine, unpacker = Sweep(TaskContext.get().partitionId(), folder), zstandard.ZstdDecompressor()
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("doc", "copy", "doc_id", "at", "side")]
            for *row, packed in zip(*columns, batch.column("ids"), strict=True):
                made = machine.take((*row, unpacked(packed.as_py(), unpacker) if row[4] >= 0 else np.zeros(0, np.int64)))
                if made:
                    yield made
        made = machine.flush(True)
        if made:
            yield made

    return run


def segments(docs: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """One row for each document, or several for one longer than a slice: sums, the digest of its groups (on its last
    row), and its pairs of linked ids (a * number of B's ids + b) with how often each is linked."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ends = rows.mapInArrow(events(tokenizers), EVENTS)
    return ends.repartition("doc", "copy").sortWithinPartitions("doc", "copy", "at", "side").mapInArrow(sweep(tokenizers), SEGMENTS)


def links(made: DataFrame, size_b: int) -> DataFrame:
    """chunk, pair, documents, best for every pair that a chunk asks for: in how many documents of the corpus the pair is
    linked, and whether no other pair of its A id is in more."""
    whole = made.where("whole").select("chunk", F.explode("pairs").alias("pair")).groupBy("chunk", "pair").agg(F.count("*").alias("n"))
    parts = made.where("not whole").select("chunk", "doc", "copy", F.explode("pairs").alias("pair"))
    asked = spool(whole.unionByName(parts.select("chunk", "pair", F.lit(0).cast("long").alias("n")).distinct()), "asked-pairs")
    split = parts.select("doc", "copy", "pair").distinct().groupBy("pair").agg(F.count("*").alias("n"))
    counted = asked.select("pair", "n").unionByName(split).groupBy("pair").agg(F.sum("n").alias("documents"))
    most = counted.groupBy(F.floor(F.col("pair") / size_b).cast("long").alias("a")).agg(F.max("documents").alias("most"))
    known = counted.withColumn("a", F.floor(F.col("pair") / size_b).cast("long")).join(most, "a").select("pair", "documents", (F.col("documents") == F.col("most")).alias("best"))
    return asked.select("chunk", "pair").distinct().join(known, "pair").select("chunk", "pair", "documents", "best")


def answered(left: pa.Table, right: pa.Table) -> pa.Table:
    """The segments of a chunk with their sums over links."""
    order = np.argsort(right.column("pair").to_numpy(), kind="stable")
    pair, documents, best = (right.column(c).to_numpy()[order] for c in ("pair", "documents", "best"))
    out: list[list[np.ndarray]] = [[], []]
    for batch in left.to_batches():
        lists = batch.column("pairs")
        ends = lists.offsets.to_numpy()
        own, times = (batch.column(c).values.to_numpy()[ends[0] : ends[-1]] for c in ("pairs", "times"))
        at = np.searchsorted(pair, own)
        for k, worth in enumerate((best[at], documents[at]) if len(pair) else (np.zeros(0, np.int64),) * 2):
            total = np.append(0, np.cumsum(times.astype(np.int64) * worth))
            out[k].append(total[ends[1:] - ends[0]] - total[ends[:-1] - ends[0]])
    names = ["doc", "copy", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    sums = {name: np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for name, x in zip(("n_best", "count_sum"), out, strict=True)}
    return pa.table({**{c: left.column(c) for c in names}, **sums})


def align(docs: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row."""
    made = spool(segments(docs, tokenizers), "aligned")
    size_b = len(Sides.of(tokenizers).lengths[1])
    known = links(made, size_b)
    schema = "doc binary, copy long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    parts = made.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(answered, schema)
    sums = [F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return parts.groupBy("doc", "copy").agg(F.first("doc_id").alias("doc_id"), *sums, F.max("groups_sha256").alias("groups_sha256")).drop("doc", "copy")
