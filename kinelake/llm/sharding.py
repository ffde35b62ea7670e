"""Sharding by minimax contiguous partition.

Equal texts are one atomic group, and groups are ordered by a hash of their text. The smallest capacity at which a greedy
pass needs no more shards than there are is found by binary search; the groups are cut where that pass cuts them. Where one
group is that capacity (a group of copies larger than a fair share), it gets a shard of its own and the groups before and after
it are partitioned by themselves, in the same way, so that all other shards stay near equal.

The groups are never brought together. The driver sees sums over ranges of the hash, at most RANGES of them to begin
with, and only the ranges in which some cut could still fall are split into 2 ** STEP parts, again and again, until each
of them holds one group, so that the result is that of the pass over all groups. Within a shard, rows are numbered by
counts over SLOTS slices and by place within a slice, so that no task gets a whole shard.

Defined cases: a null text counts as an empty one (size 1, crc32 0); equal texts are never parted, so a group larger than
a fair share makes its shard larger; ties and repeated rows get slots in any order; rows without doc_id are numbered like
any other; an empty table gives no row; columns other than doc_id and text are ignored, or kept as they are.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut

FIRST_BITS, STEP, SLOTS = 12, 8, 1024
RANGES = 1 << FIRST_BITS


@dataclass(frozen=True, order=True)
class Range:
    """The groups whose order begins with ``prefix`` (``bits`` bits of it)."""

    start: int
    bits: int
    size: int
    groups: int


def greedy(sizes: list[int], capacity: int, shards: int) -> list[int] | None:
    """Where each shard of a greedy pass ends (as an index); None if it needs more than ``shards``."""
    ends, total = [], 0
    for k, size in enumerate(sizes):
        if size > capacity:
            return None
        if total + size > capacity:
            ends.append(k)
            total = 0
            if len(ends) >= shards:
                return None
        total += size
    return [*ends, len(sizes)]


def minimax(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """The smallest capacity, and the ends of the shards at it."""
    lo, hi = max([-(-sum(sizes) // shards), *sizes]), max(sum(sizes), 0)
    while lo < hi:
        mid = (lo + hi) // 2
        if greedy(sizes, mid, shards) is None:
            lo = mid + 1
        else:
            hi = mid
    return lo, greedy(sizes, lo, shards) or [0]


def open_ranges(ranges: list[Range], shards: int) -> list[Range]:
    """Ranges of several groups in which a cut can fall for a capacity between the least that any partition of the groups
    can have and the least that these ranges, taken whole, need."""
    sizes = [r.size for r in ranges]
    upper, _ = minimax(sizes, shards)
    lower = max([-(-sum(sizes) // shards), *(r.size for r in ranges if r.groups == 1)])
    ends = [0]
    for s in sizes:
        ends.append(ends[-1] + s)
    found, reach = set(), 0
    for i in range(1, shards):
        # the i-th cut is no sooner than where whole ranges at the lower capacity end, and no later than i times the upper
        reach = max(bisect_right(ends, ends[reach] + lower) - 1, reach)
        last = min(bisect_right(ends, i * upper), len(ranges))
        found.update(k for k in range(reach, last) if ranges[k].groups > 1)
    return [ranges[k] for k in sorted(found)]


def cut_points(groups: DataFrame, shards: int) -> list[int]:
    """The first order (an unsigned hash) of shards 1, 2 and so on. groups: hash long, size long (several rows of a hash
    add up)."""

    def sums(of: DataFrame, bits: int) -> list[Range]:
        start = F.shiftrightunsigned("hash", 64 - bits) if bits < 64 else F.col("hash")
        got = of.groupBy(start.alias("start")).agg(F.sum("size").alias("size"), F.count("*").alias("groups")).collect()
        return [Range((r["start"] % 2**64) << (64 - bits), bits, r["size"], r["groups"]) for r in got]

    ranges = sorted(sums(groups, FIRST_BITS))
    while todo := open_ranges(ranges, shards):
        # all at once that are as coarse as the coarsest
        coarse = min(r.bits for r in todo)
        todo = [r for r in todo if r.bits == coarse]
        bits = min(64, coarse + STEP)
        marks = [r.start >> (64 - coarse) for r in todo]
        inside = groups.where(F.shiftrightunsigned("hash", 64 - coarse).isin(marks))
        ranges = sorted([r for r in ranges if r not in set(todo)] + sums(inside, bits))
    capacity, ends = minimax([r.size for r in ranges], shards)
    top = groups.groupBy("hash").agg(F.sum("size").alias("size")).agg(F.max(F.struct("size", "hash")).alias("top")).first()["top"]
    if top is None or top["size"] < capacity or shards < 2:
        return [ranges[k].start for k in ends[:-1]]
    # one group is the capacity: it gets a shard of its own, and the stretches before and after it what even shards they can
    at = top["hash"] % 2**64
    order = F.col("hash").bitwiseXOR(F.lit(-(2**63)))
    sides = [groups.where(order < F.lit(at - 2**63)), groups.where(order > F.lit(at - 2**63))]
    sizes = [side.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] for side in sides]
    left = 0 if not sizes[0] else shards - 1 if not sizes[1] else min(max(round((shards - 1) * sizes[0] / sum(sizes)), 1), max(shards - 2, 1))
    if (sizes[0] and not left) or (sizes[1] and left == shards - 1) or not fits([*ranges], at, capacity, left, shards - 1 - left):
        return [ranges[k].start for k in ends[:-1]]
    points = cut_points(sides[0], left) + [at] * (left > 0) if sizes[0] else []
    return points + ([at + 1, *cut_points(sides[1], shards - 1 - left)] if sizes[1] else [])


def fits(ranges: list[Range], at: int, capacity: int, left: int, right: int) -> bool:
    """Whether the ranges before and after a group's hash go into so many shards each."""
    sides = [r.size for r in ranges if r.start + (1 << 64 - r.bits) <= at], [r.size for r in ranges if r.start > at]
    return all(not sizes or (n > 0 and greedy(sizes, capacity, n) is not None) for sizes, n in zip(sides, (left, right), strict=True))


def place(rows: DataFrame, points: list[int]) -> Column:
    """The shard of a row by its hash, compared as an unsigned number."""
    signed = [F.lit(p - 2**63) for p in points]
    order = F.col("hash").bitwiseXOR(F.lit(-(2**63)))
    return sum(((order >= p).cast("int") for p in signed), F.lit(0)).cast("int")


#: What shard adds to a row.
ADDED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def shard(docs: DataFrame, shards: int = 16, keep: bool = False) -> DataFrame:
    """doc_id and ADDED: law (bytes), slot, grown_shard (null: a further shard moves the cuts). ``keep``: all columns of docs
    but those of these names (in any case) come before them; texts are then read a second time, and not written down in between."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    measured = [F.col("doc_id").alias("__id"), (F.octet_length(text) + 1).cast("long").alias("__size"), F.crc32(text.cast("binary")).alias("__crc"), F.xxhash64(text).alias("hash")]
    rows = cut(docs.select(*measured))
    groups = cut(rows.groupBy("hash").agg(F.sum("__size").alias("size")))
    if keep:
        rows = docs.select(F.struct(*[c for c in docs.columns if c.lower() not in ADDED]).alias("__row"), *measured)
    placed = rows.withColumn("__shard", place(rows, cut_points(groups, shards))).withColumn("__slice", F.pmod(F.xxhash64("__id", "hash"), F.lit(SLOTS)).cast("int"))
    counts = cut(placed.groupBy("__shard", "__slice").agg(F.count("*").alias("n")))
    before = W.partitionBy("__shard").orderBy("__slice")
    offsets = counts.select("__shard", "__slice", (F.sum("n").over(before) - F.col("n")).alias("offset"))
    nth = F.row_number().over(W.partitionBy("__shard", "__slice").orderBy("__id", "hash"))
    small = offsets.count() <= BROADCAST_ROWS  # at most shards times SLOTS rows
    out = placed.withColumn("nth", nth).join(F.broadcast(offsets) if small else offsets, ["__shard", "__slice"])
    own = ["__row.*"] if keep else [F.col("__id").alias("doc_id")]
    added = [F.col("__size"), F.col("__crc"), F.lit("bytes"), F.col("__shard"), (F.col("offset") + F.col("nth") - 1).cast("long"), F.lit(None).cast("int")]
    return out.select(*own, *[c.alias(n) for c, n in zip(added, ADDED, strict=True)])
