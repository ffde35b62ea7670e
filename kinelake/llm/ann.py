"""Nearest neighbours by a block matrix join.

Queries are dealt to blocks of QUERY_BLOCK and candidates to groups; every pair of a block and a group is a task's work: its
queries come first, then its candidates in batches, so no task holds more than a block of queries and a batch.

A batch is searched by products of int8 codes (a vector is its codes times a scale, plus a rest whose length is known).
Codes are multiplied as 32-bit floats, in slices of components so short that every sum is an exact integer. A product then
lies within a bound of the true one, given by the lengths of codes and rests (Cauchy-Schwarz). A candidate survives if its
upper bound reaches the query's kth score so far, or the kth best lower bound of the batch; survivors are recomputed from
the original vectors in double precision, component by component in order, and pushed onto the query's heap. Since bounds
hold, nothing is lost: recall is 1. The heaps of a query's groups are merged by rank.

Rows that are alike in id and vector are one candidate with a count, and of equal vectors in a batch only those that can
still be among the k of some query are multiplied, so a vector that very many rows have costs little.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite component take no part, nor do rows without
id; a query is compared with vectors of its own length only; rows of its own id are no candidates; rows that repeat an id
are candidates each, and queries of one id are one query, of the smallest vector; ties go to smaller ids; scores beyond
a double are infinite; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .common import cut
from .topk import usable

#: Queries in a block; the most candidates in a group; pairs of a block and a group that are wanted at least, for as many
#: tasks to work; the most tasks; candidates that are multiplied at once; components whose products of int8 codes add up
#: exactly in 32-bit floats.
QUERY_BLOCK, GROUP, PARALLEL, TASKS, BATCH, EXACT = 8192, 1 << 22, 32, 10_000, 512, 1024
FOUND = "query_id long, vec_id long, score double"


class Codes:
    """int8 codes of vectors, their scales, and bounds of lengths."""

    def __init__(self, v: np.ndarray) -> None:
        most = np.abs(v).max(axis=1, initial=0)
        self.scale = np.where(most > 0, most / 127, 1.0)
        codes = np.rint(v / self.scale[:, None])
        self.codes = np.clip(codes, -127, 127).astype(np.int8)
        kept = self.codes * self.scale[:, None]
        self.kept, self.rest = self.length(kept), self.length(v - kept)

    @staticmethod
    def length(v: np.ndarray) -> np.ndarray:
        """Euclidean lengths, rounded up."""
        most = np.abs(v).max(axis=1, initial=0)
        unit = v / np.where(most > 0, most, 1.0)[:, None]
        return most * np.sqrt((unit * unit).sum(axis=1)) * (1 + 1e-12)

    def bounds(self, other: Codes) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all products with others."""
        total = np.zeros((len(self.codes), len(other.codes)))
        for i in range(0, self.codes.shape[1], EXACT):
            total += self.codes[:, i : i + EXACT].astype(np.float32) @ other.codes[:, i : i + EXACT].astype(np.float32).T
        total *= self.scale[:, None]
        total *= other.scale[None, :]
        off = np.outer(self.kept, other.rest) + np.outer(self.rest, other.kept + other.rest)
        off += 1e-9 * (np.outer(self.kept + self.rest, other.kept + other.rest))  # more than rounding of doubles can add up to
        return total - off, total + off


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up in order of components, so equal vectors have equal scores."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


class Block:
    """Queries, each with a heap of its k best so far: (score, -vec_id)."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, k: int) -> None:
        self.ids, self.v, self.k, self.codes = ids, v, k, Codes(v)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in ids]
        self.floor = np.full(len(ids), -np.inf)

    def search(self, ids: np.ndarray, v: np.ndarray, times: np.ndarray) -> None:
        at = self.needed(ids, v, times)
        ids, v = ids[at], v[at]
        for i in range(0, len(ids), BATCH):
            self.batch(ids[i : i + BATCH], v[i : i + BATCH])

    def needed(self, ids: np.ndarray, v: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Rows, as often as they count, without those that 2k others of the same vector and of smaller ids stand before: a
        query's own id takes no more than k of these away."""
        at = np.repeat(np.arange(len(ids)), np.minimum(times, self.k))
        _, kind = np.unique(np.ascontiguousarray(v + 0.0).view(np.dtype((np.void, v.shape[1] * v.itemsize))).ravel(), return_inverse=True)
        order = at[np.lexsort((ids[at], kind[at]))]
        begins = np.flatnonzero(np.diff(kind[order], prepend=-1))
        place = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
        return order[place < 2 * self.k]

    def batch(self, ids: np.ndarray, v: np.ndarray) -> None:
        low, high = self.codes.bounds(Codes(v))
        own = self.ids[:, None] == ids[None, :]
        low[own] = -np.inf
        floor = self.floor
        if len(ids) > self.k:
            floor = np.maximum(floor, np.partition(low, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
        query, mate = np.nonzero((high >= floor[:, None]) & ~own)
        for i in range(0, len(query), 1 << 17):
            q, c = query[i : i + (1 << 17)], mate[i : i + (1 << 17)]
            score = products(self.v[q], v[c])
            keep = np.flatnonzero(~(score < self.floor[q]))
            for n, s, x in zip(q[keep].tolist(), score[keep].tolist(), ids[c[keep]].tolist(), strict=True):
                heap = self.heaps[n]
                if len(heap) < self.k:
                    heapq.heappush(heap, (s, -x))
                else:
                    heapq.heappushpop(heap, (s, -x))
        for n in np.unique(query).tolist():
            if len(self.heaps[n]) == self.k:
                self.floor[n] = self.heaps[n][0][0]

    def result(self) -> pa.RecordBatch:
        n = [len(h) for h in self.heaps]
        found = [x for h in self.heaps for x in h]
        columns = (np.repeat(self.ids, n), np.array([-x for _, x in found], np.int64), np.array([s for s, _ in found], np.float64))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["query_id", "vec_id", "score"])


def tiles(k: int):
    """Rows in order of block, group, length and kind (queries first): block, grp, dims, kind, id, v, times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, asked = None, None, []
        for batch in batches:
            columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "grp", "dims", "kind", "id", "times")}
            new = np.ones(batch.num_rows, bool)
            new[1:] = np.any([columns[c][1:] != columns[c][:-1] for c in ("block", "grp", "dims", "kind")], axis=0)
            begins = np.append(np.flatnonzero(new), batch.num_rows)
            for lo, hi in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                here = tuple(int(columns[c][lo]) for c in ("block", "grp", "dims"))
                if here != key:
                    if block:
                        yield block.result()
                    key, block, asked = here, None, []
                ids = columns["id"][lo:hi]
                v = batch.column("v").slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(hi - lo, here[2])
                if columns["kind"][lo] == 0:
                    asked.append((ids, v))
                elif asked or block:
                    if asked:
                        block, asked = Block(np.concatenate([x[0] for x in asked]), np.concatenate([x[1] for x in asked]), k), []
                    block.search(ids, v, columns["times"][lo:hi])
        if block:
            yield block.result()

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k greatest inner products of each query. vectors: vec_id, v, times (how often
    the row counts); queries: query_id, v, one row an id."""
    n, q = vectors.count(), queries.count()
    blocks = max(1, -(-q // QUERY_BLOCK))
    groups = max(1, -(-PARALLEL // blocks), -(-n // GROUP))  # each group returns k rows for a query: no more than needed
    of = lambda m, *c: F.pmod(F.xxhash64(*c), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    one, kind = F.lit(1).cast("long").alias("times"), lambda x: F.lit(x).alias("kind")
    asked = queries.select(of(blocks, "query_id").alias("block"), every(groups).alias("grp"), F.size("v").alias("dims"), kind(0), F.col("query_id").alias("id"), "v", one)
    rows = vectors.select(every(blocks).alias("block"), of(groups, "vec_id", "v").alias("grp"), F.size("v").alias("dims"), kind(1), F.col("vec_id").alias("id"), "v", "times")
    tasks = min(blocks * groups, TASKS)
    dealt = asked.unionByName(rows).repartitionById(tasks, F.pmod(F.col("block") * groups + F.col("grp"), F.lit(tasks)))
    found = dealt.sortWithinPartitions("block", "grp", "dims", "kind").mapInArrow(tiles(k), FOUND)
    by = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def neighbours(table: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """The k nearest of each row of vec_id, embedding whose vec_id is divisible by ``every``."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), usable(F.col("embedding")).alias("v")).where("vec_id is not null and v is not null")
    rows = cut(rows.where(F.exists("v", lambda x: x != 0)).groupBy("vec_id", "v").agg(F.count("*").alias("times")))
    return nearest(rows, rows.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v")), k)
