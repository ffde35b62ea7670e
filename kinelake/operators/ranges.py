"""Ordered work on episodes that are larger than a task: ranges, carries and halos.

An episode is cut into ranges of about SPAN rows, so that its rows are never all in one task. What runs along an episode is
computed twice: within each range, and over one summary a range (a sum, the last value, a product of small matrices); what
the summaries of the earlier ranges amount to is the carry of a range, and is put before what its rows have. What looks at
neighbours gets the rows near the edges of a range from the ranges beside it: its halo.

Places are exact: rows are dealt by ranges of (keys, order) once and kept in the shared folder, so that counting and numbering
see the same ranges. ``order`` is unique within an episode and not null; keys may be null (null is a key of its own).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, WindowSpec
from pyspark.sql import functions as F

from ..sources.shared import fixed

#: Rows of a range. An episode with fewer is worked on whole.
SPAN = 1 << 20
PLACE, RANGE, KEY = "__place", "__range", "__key"


def spread(frames: DataFrame, keys: list[str], span: int = SPAN) -> bool:
    """Whether an episode is too large for one task."""
    return bool(frames.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > span).take(1))


def dealt(frames: DataFrame, keys: list[str], order: list[str], span: int = SPAN) -> DataFrame:
    """frames with RANGE: numbers of ranges of about ``span`` rows in the order of keys and ``order``. Rows of an episode
    are in ranges of their own order; a range may hold the end of one episode and the beginning of the next."""
    n = max(1, -(-frames.count() // span))
    return fixed(frames.repartitionByRange(n, *keys, *order).withColumn(RANGE, F.spark_partition_id()))


def placed(frames: DataFrame, keys: list[str], order: list[str], span: int = SPAN) -> DataFrame:
    """frames with PLACE, from 0 in the order of each episode, and RANGE, of exactly ``span`` places each."""
    rows = scan(dealt(frames, keys, order, span), keys, order, **{PLACE: total(F.lit(1).cast("long"))})
    return rows.withColumn(PLACE, F.col(PLACE) - 1).withColumn(RANGE, F.floor(F.col(PLACE) / span).cast("long"))


# carries


@dataclass
class Carry:
    """What runs along an episode: within a range, of a whole range, over the summaries before, and of carry and range
    together. ``back`` ones run from the end."""

    local: Callable[[WindowSpec], Column]
    whole: Column
    before: Callable[[Column, WindowSpec], Column]
    both: Callable[[Column, Column], Column]
    back: bool = False


def total(value: Column) -> Carry:
    """The running sum of what is not null; null before the first such value."""
    return Carry(lambda w: F.sum(value).over(w), F.sum(value), lambda c, w: F.sum(c).over(w), lambda carry, own: F.coalesce(carry + own, carry, own))


def latest(box: Column, order: list[str], back: bool = False) -> Carry:
    """The last box so far that is not null (``back``: the first from here on)."""
    at = F.when(box.isNotNull(), F.struct(*order))
    pick = F.min_by if back else F.max_by
    return Carry(lambda w: F.last(box, ignorenulls=True).over(w), pick(box, at), lambda c, w: F.last(c, ignorenulls=True).over(w), lambda carry, own: F.coalesce(own, carry), back)


def _ordered(order: list[str], back: bool) -> list[Column]:
    return [F.col(c).desc_nulls_last() if back else F.col(c).asc_nulls_first() for c in order]


def scan(rows: DataFrame, keys: list[str], order: list[str], peers: bool = False, **carries: Carry) -> DataFrame:
    """rows, which have RANGE, with a column for each carry. ``peers``: rows of one order see each other's values."""
    rows = rows.withColumn(KEY, F.struct(*keys))
    ranges = rows.groupBy(KEY, RANGE).agg(*[c.whole.alias(n) for n, c in carries.items()])
    along = {back: W.partitionBy(KEY).orderBy(*_ordered([RANGE], back)).rowsBetween(W.unboundedPreceding, -1) for back in (False, True)}
    before = ranges.select(KEY, RANGE, *[c.before(F.col(n), along[c.back]).alias(f"__before_{n}") for n, c in carries.items()])
    within = {}
    for back in (False, True):
        w = W.partitionBy(KEY, RANGE).orderBy(*_ordered(order, back))
        within[back] = w.rangeBetween(W.unboundedPreceding, W.currentRow) if peers else w.rowsBetween(W.unboundedPreceding, W.currentRow)
    out = rows
    for n, c in carries.items():
        out = out.withColumn(f"__own_{n}", c.local(within[c.back]))
    out = out.join(before, [KEY, RANGE])
    return out.withColumns({n: c.both(F.col(f"__before_{n}"), F.col(f"__own_{n}")) for n, c in carries.items()}).drop(KEY, *[f"__{k}_{n}" for n in carries for k in ("own", "before")])


# products


def running(m: np.ndarray, left: bool) -> np.ndarray:
    """Products of the first 1, 2, ... of some matrices; ``left``: each new one stands on the left. Rows of matrices are
    worked on side by side, then each row is multiplied by what comes before it."""
    n, d = len(m), m.shape[1]
    if not n:
        return m
    mul = (lambda a, b: b @ a) if left else (lambda a, b: a @ b)  # what was before, what is new
    side = int(np.ceil(np.sqrt(n)))
    grid = np.broadcast_to(np.eye(d), (side * side, d, d)).copy()
    grid[:n] = m
    grid = grid.reshape(side, side, d, d)
    for t in range(1, side):
        grid[:, t] = mul(grid[:, t - 1], grid[:, t])
    carry = np.eye(d)
    for r in range(side):
        own = grid[r, -1].copy()
        grid[r] = mul(carry, grid[r])
        carry = mul(carry, own)
    return grid.reshape(side * side, d, d)[:n]


def _multiplied(order: list[str], matrix: str, name: str, left: bool):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in order]) if order else t
        flat = t.column(matrix).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        d = round((len(flat) // t.num_rows) ** 0.5)
        out = running(flat.reshape(t.num_rows, d, d).astype(np.float64), left).reshape(t.num_rows, d * d)
        return t.append_column(name, pa.array(list(out), pa.list_(pa.float64())))

    return run


def products(rows: DataFrame, keys: list[str], order: list[str], matrix: str, name: str, size: int, left: bool = False) -> DataFrame:
    """rows, which have RANGE, with ``name``: the running product of their matrices (arrays of size * size numbers, none null).
    A range is a group of its own; the product of a range is its summary."""
    array = "array<double>"
    fields = lambda df: ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    rows = rows.withColumn(matrix, F.col(matrix).cast(array)).withColumn(KEY, F.struct(*keys))
    own = rows.groupBy(KEY, RANGE).applyInArrow(_multiplied(order, matrix, "__own", left), f"{fields(rows)}, __own {array}")
    ends = rows.select(KEY, RANGE, *[c for c in order], matrix).groupBy(KEY, RANGE).applyInArrow(_multiplied(order, matrix, "__own", left), f"`{KEY}` {rows.schema[KEY].dataType.simpleString()}, `{RANGE}` {dict(rows.dtypes)[RANGE]}, {', '.join(f'`{c}` {dict(rows.dtypes)[c]}' for c in order)}, `{matrix}` {array}, __own {array}")
    ends = ends.groupBy(KEY, RANGE).agg(F.max_by("__own", F.struct(*order)).alias("__whole"))
    upto = ends.groupBy(KEY).applyInArrow(_multiplied([RANGE], "__whole", "__upto", left), f"{fields(ends)}, __upto {array}")
    carry = upto.select(KEY, RANGE, F.lag("__upto").over(W.partitionBy(KEY).orderBy(RANGE)).alias("__carry"))
    cells = lambda a, b: [sum((a[size * i + k] * b[size * k + j] for k in range(size)), F.lit(0.0)) for i in range(size) for j in range(size)]
    before, here = F.col("__carry"), F.col("__own")
    both = F.array(*(cells(here, before) if left else cells(before, here)))
    return own.join(carry, [KEY, RANGE]).withColumn(name, F.when(before.isNull(), here).otherwise(both)).drop(KEY, "__own", "__carry")


# halos


def halo(rows: DataFrame, before: int, after: int, span: int = SPAN) -> DataFrame:
    """rows, which have PLACE and RANGE, and copies of those that another range needs: each range gets the last ``before``
    rows ahead of it and the first ``after`` rows behind it. A copy is one whose place is not in its range (see ``owned``)."""
    if max(before, after) > span:
        raise ValueError(f"a halo of {max(before, after)} rows does not fit ranges of {span}")
    first, last = F.floor((F.col(PLACE) - after) / span), F.floor((F.col(PLACE) + before) / span)
    return rows.withColumn(RANGE, F.explode(F.sequence(F.greatest(first, F.lit(0)).cast("long"), last.cast("long"))))


def owned(rows: DataFrame, span: int = SPAN) -> DataFrame:
    """rows without the copies."""
    return rows.where(F.floor(F.col(PLACE) / span) == F.col(RANGE))
