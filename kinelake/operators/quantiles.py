"""Exact quantiles in bounded memory, by refinement.

The values of a group are counted in buckets that keep their order; only the bucket that holds a wanted rank is looked at
again, in finer buckets, until it has few rows or a single value. The first buckets are by sign and logarithm, 64 for each
factor of two; a bucket is then at most about a hundredth of its values wide, and each further level cuts it into 4096 parts
between its own least and greatest value. So the number of levels is bounded by the digits of a double (six at most in
all), whatever the distribution, and what a level writes is one row for each bucket that is in use.

Values are doubles; NaN is above all others and zeros are alike, as in Spark's order. Nulls do not count. A group without a
value has null quantiles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..sources.shared import fixed, together

#: Rows up to which a group's values are held by one task; buckets for a factor of two, and of each later level; groups up
#: to which their bounds, once counted, are broadcast.
HELD, OCTAVE, PARTS, BROADCAST_ROWS = 1 << 18, 64, 4096, 100_000


def ordered(x: Column) -> Column:
    """Buckets of doubles by sign and logarithm, in the order of the values."""
    size = F.when(x == 0, 0).when(F.isnan(x), 4000 * OCTAVE).when(F.abs(x) == math.inf, 3000 * OCTAVE)
    size = size.otherwise(F.floor(F.log2(F.abs(x)) * OCTAVE).cast("int") + 1100 * OCTAVE).cast("int")
    return F.when(x < 0, -size).otherwise(size)


def parted(x: Column, lo: Column, hi: Column) -> Column:
    """Buckets of doubles between two others, in the order of the values."""
    return F.floor((x - lo) / (hi - lo) * PARTS).cast("int")


def ranks(n: Column, p: float) -> tuple[Column, Column, Column]:
    """The neighbouring ranks, from 0, between which a quantile of n values lies, and its place between them."""
    at = (n - 1) * F.lit(float(p))
    return F.floor(at).cast("long"), F.ceil(at).cast("long"), at - F.floor(at)


def at_ranks(values: DataFrame, keys: list[str], value: str, wanted: DataFrame, held: int = HELD) -> DataFrame:
    """wanted (keys and ``rank``, from 0, within a group's values) with ``found``, the value of that rank. Values are doubles."""
    names = [f"__k{i}" for i in range(len(keys))]
    rows = values.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(value).alias("__x")).where("__x is not null")
    todo = wanted.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], "rank").distinct()
    # bounds of a rank: its place among the values from lo to hi, of which there are n
    counts = rows.groupBy(*names, ordered(F.col("__x")).alias("bucket")).agg(F.count("*").alias("n"), F.min("__x").alias("lo"), F.max("__x").alias("hi"))
    counts = todo.select(*[F.col(n).alias(f"{n}_") for n in names], "rank").join(counts, _alike(names))
    bounds = _narrowed(counts.select(*names, "rank", F.col("rank").alias("rest"), "bucket", "n", "lo", "hi"), names)
    done = []
    while True:
        few = F.col("n") <= held
        one = ~few & (F.col("lo") == F.col("hi"))
        done += [bounds.where(one).select(*names, "rank", F.col("lo").alias("found")), _last(_inside(rows, bounds.where(few), names), names)]
        bounds = bounds.where(~few & ~one)
        if bounds.isEmpty():
            break
        inside = _inside(rows, bounds, names).groupBy(*names, "rank", "rest", parted(F.col("__x"), F.col("lo"), F.col("hi")).alias("bucket"))
        bounds = _narrowed(inside.agg(F.count("*").alias("n"), F.min("__x").alias("lo"), F.max("__x").alias("hi")), names)
    found = done[0]
    for d in done[1:]:
        found = together(found, d)
    on = F.col("rank") == F.col("__rank")
    for k, n in zip(keys, names, strict=True):
        on = on & F.col(k).eqNullSafe(F.col(n))
    return wanted.join(found.withColumnRenamed("rank", "__rank"), on, "left").drop(*names, "__rank")


def _alike(names: list[str]) -> Column:
    on = F.lit(True)
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"{n}_"))
    return on


def _narrowed(counts: DataFrame, names: list[str]) -> DataFrame:
    """Of each rank the bucket that holds it, and its place in there."""
    counts = counts.withColumn("__to", F.sum("n").over(W.partitionBy(*names, "rank").orderBy("bucket")))
    at = counts.where((F.col("__to") > F.col("rest")) & (F.col("__to") - F.col("n") <= F.col("rest")))
    return fixed(at.select(*names, "rank", (F.col("rest") - F.col("__to") + F.col("n")).alias("rest"), "n", "lo", "hi"))


def _inside(rows: DataFrame, bounds: DataFrame, names: list[str]) -> DataFrame:
    """Rows with each of the bounds of their group that they are within. Bounds are counted; beyond what may be broadcast, the
    join deals rows by group, and adaptive execution splits large ones."""
    named = bounds.select(*[F.col(n).alias(f"{n}_") for n in names], "rank", "rest", "lo", "hi")
    named = F.broadcast(named) if bounds.count() <= BROADCAST_ROWS else named
    return rows.join(named, _alike(names) & F.col("__x").between(F.col("lo"), F.col("hi"))).drop(*[f"{n}_" for n in names])


def _last(inside: DataFrame, names: list[str]) -> DataFrame:
    """The values of ranks whose bounds hold few rows: equal ones are counted, the rest are in one task for each rank."""
    counts = inside.groupBy(*names, "rank", "rest", "__x").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy(*names, "rank").orderBy("__x"))
    at = counts.withColumn("__to", upto).where((F.col("__to") > F.col("rest")) & (F.col("__to") - F.col("n") <= F.col("rest")))
    return at.select(*names, "rank", F.col("__x").alias("found"))


def quantiles(values: DataFrame, keys: list[str], value: str, ps: dict[str, float], sizes: DataFrame, held: int = HELD) -> DataFrame:
    """sizes (keys and ``count``, the number of a group's values) with a column for each quantile, between neighbours."""
    places = [ranks(F.col("count"), p) for p in ps.values()]
    asked = sizes.where(F.col("count") > 0).select(*keys, F.explode(F.array(*[x for lo, hi, _ in places for x in (lo, hi)])).alias("rank")).distinct()
    got = at_ranks(values, keys, value, fixed(asked), held)
    by_rank = got.groupBy(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)]).agg(F.map_from_entries(F.collect_list(F.struct("rank", "found"))).alias("__by"))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__key{i}"))
    out = sizes.join(by_rank, on, "left")
    for (name, _), (lo, hi, share) in zip(ps.items(), places, strict=True):
        below, above = F.col("__by")[lo], F.col("__by")[hi]
        out = out.withColumn(name, F.when(below == above, below).otherwise(below * (1 - share) + above * share))
    return out.drop("__by", *[f"__key{i}" for i in range(len(keys))])
