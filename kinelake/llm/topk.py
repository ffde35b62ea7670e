"""Exact top-k search by Fagin's threshold algorithm.

Vectors are cut into blocks of about BLOCK rows. Within a block every dimension has a list of its rows in order of value.
A query goes down all lists at once, in the direction of its sign; each row met is scored at once by its whole vector; the
threshold is the score that a row of the values just met would have. The query leaves the block when the threshold is
below its kth score so far: no row that has not been met can then be among its results. Each query brings to every
block the kth score that it has reached in a first one, so most of its work is to prove that a block holds nothing better: the
thresholds of all queries at all depths are one product of matrices, and each query goes down to its depth in one go.

Scores are sums in double precision while these are exact, else in integers of any length, and results beyond a long are
its limits. Queries are a stated set and go over all blocks, in blocks of their own of QUERY_BLOCK rows.

Defined cases: null vectors, those with null or non-finite components, and rows without id take no part; a query is
compared with vectors of its own length only; rows that repeat its id are its own and no candidates; ties go to smaller
ids, and repeated rows are candidates each; rows that repeat a query's id make one query, of the smallest vector; empty
tables give no row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import cut

BLOCK, QUERY_BLOCK, LEAST_BLOCKS, FIRST_DEPTH = 8192, 2048, 64, 8
RESULT = "query_id long, vec_id long, score long"
_LO, _HI = -(2**63), 2**63 - 1


def usable(c: Column) -> Column:
    """The vector as doubles; null if it takes no part."""
    v = c.cast("array<double>")
    return F.when(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), v)


def scaled(c: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as long (values beyond it become its limits)."""
    edge = float(2**63)
    return F.transform(c, lambda x: F.when(x * scale >= edge, F.lit(_HI)).when(x * scale < -edge, F.lit(_LO)).otherwise(F.floor(x * scale)))


class Lists:
    """A block's rows by id, and for each dimension their order by value (equal vectors keep the order of ids)."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.order = np.argsort(self.rows, axis=0, kind="stable").astype(np.int32)

    def search(self, query: int, v: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the k best rows that are not the query's; at least those that beat ``floor``."""
        n, dims = self.rows.shape
        used = np.flatnonzero(v)
        if not len(used):  # every score is zero
            free = np.flatnonzero(self.ids != query)[:k]
            return free, np.zeros(len(free), self.rows.dtype)
        down, w = v[used] > 0, v[used]
        seen = np.zeros(n, bool)
        seen[np.searchsorted(self.ids, query) : np.searchsorted(self.ids, query, side="right")] = True
        at, best = np.zeros(0, np.int64), np.zeros(0, self.rows.dtype)
        depth, step = 0, FIRST_DEPTH
        while depth < n:
            to = min(n, depth + step)
            met = np.concatenate([self.order[n - to : n - depth, used[down]].ravel(), self.order[depth:to, used[~down]].ravel()])
            new = np.unique(met[~seen[met]])
            seen[new] = True
            at, best = np.concatenate([at, new]), np.concatenate([best, self.rows[new] @ v])
            if len(at) > k:
                keep = np.lexsort((at, -best))[:k]
                at, best = at[keep], best[keep]
            edge = np.where(down, self.order[n - to, used], self.order[to - 1, used])
            bound = self.rows[edge, used] @ w
            if bound < max(floor, best.min() if len(at) >= k else floor):
                break
            depth, step = to, step * 2
        return at, best


    def depths(self, vs: np.ndarray, floors: np.ndarray) -> np.ndarray:
        """How far down the lists each query has to go for a floor that is known before: to the first of search's depths at which the
        threshold is below it, or all the way."""
        n = len(self.ids)
        to = FIRST_DEPTH * (2 ** np.arange(1, 64) - 1)
        to = np.append(to[: np.searchsorted(to, n)], n)
        column = np.arange(vs.shape[1])
        top, low = (self.rows[self.order[at], column] for at in (n - to, to - 1))
        below = np.where(vs > 0, vs, 0) @ top.T + np.where(vs < 0, vs, 0) @ low.T < floors[:, None]
        return to[np.where(below.any(axis=1), below.argmax(axis=1), len(to) - 1)]

    def above(self, query: int, v: np.ndarray, k: int, floor: float, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Like search, in one go to a depth: positions and scores of the k best rows that reach the floor."""
        n = len(self.ids)
        met = np.full(n, depth >= n)
        if depth < n:
            met[self.order[n - depth :, v > 0]] = True
            met[self.order[:depth, v < 0]] = True
        met[np.searchsorted(self.ids, query) : np.searchsorted(self.ids, query, side="right")] = False
        at = np.flatnonzero(met)
        # a copy of most rows costs more than the scores that it saves
        best = (self.rows @ v)[at] if 4 * len(at) > n else self.rows[at] @ v
        reach = np.flatnonzero(best >= floor)
        at, best = at[reach], best[reach]
        keep = np.lexsort((at, -best))[:k]
        return at[keep], best[keep]


def _block_search(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * 3
        if left.num_rows and right.num_rows:
            rows, queries = (x.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(x.num_rows, x.column("dims")[0].as_py()) for x in (left, right))
            most = [float(np.abs(x.astype(np.float64)).max(initial=0)) for x in (rows, queries)]
            exact = most[0] * most[1] * max(rows.shape[1], 1) < 2.0**53
            kind = np.float64 if exact else object
            lists = Lists(left.column("vec_id").to_numpy(), rows.astype(kind))
            floors = right.column("floor").to_pylist()
            got, queries = [], queries.astype(kind)
            depths = lists.depths(queries, np.array([float("-inf") if f is None else f for f in floors])).tolist()
            for q, v, floor, depth in zip(right.column("query_id").to_numpy().tolist(), queries, floors, depths, strict=True):
                at, best = lists.search(q, v, k, float("-inf")) if floor is None else lists.above(q, v, k, floor, depth)
                got.append((np.full(len(at), q), lists.ids[at], np.array([min(max(int(x), _LO), _HI) for x in best], np.int64)))
            out = [np.concatenate(x).astype(np.int64) for x in zip(*got, strict=True)]
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), out, strict=True)})

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    by = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k greatest inner products of each query. vectors: vec_id, v (array<long>);
    queries: query_id, v."""
    n, q = vectors.count(), queries.count()
    blocks, query_blocks = max(LEAST_BLOCKS, -(-n // BLOCK)), -(-q // QUERY_BLOCK)
    if not n or not q:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    of = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    rows = vectors.select(of("vec_id", blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("part"), F.size("v").alias("dims"), "vec_id", "v")
    asked = queries.select(of("query_id", query_blocks).alias("part"), F.size("v").alias("dims"), "query_id", "v")
    keys, schema = ["block", "part", "dims"], RESULT
    seed = rows.where("block = 0").groupBy(*keys).cogroup(asked.select(F.lit(0).alias("block"), "*", F.lit(None).cast("double").alias("floor")).groupBy(*keys)).applyInArrow(_block_search(k), schema)
    # the kth score of the first block bounds the kth score of all from below; it is lowered past any rounding of a double
    floors = seed.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    floors = floors.select("query_id", (F.col("floor") - F.ceil(F.abs(F.col("floor") / 2**50)) ).cast("double").alias("floor"))
    asked = cut(asked.join(floors, "query_id", "left"))
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "*")
    found = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_block_search(k), schema)
    return _best(found, k)


def top_k(table: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """The k best of each row of vec_id, embedding whose vec_id is divisible by ``every``."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), scaled(usable(F.col("embedding")), scale).alias("v")).where("vec_id is not null and v is not null")
    queries = rows.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    return search(rows, queries, k)
