"""Windows around each step, and ordered folds within an episode.

``gather`` takes one row for each delta with lead and lag, so an episode is never held as one array; the edge values come
from the same window. Deltas are a short fixed list. Episodes of up to ``span`` rows are each worked on by one task, in one
shuffle; if there is a larger one (episodes are counted), all go the way of ranges with halos and carries (``ranges``),
with the same results and no task above a range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from . import ranges

FILLS = ("edge", "zero", "clamp")


def by(keys: list[str], order: list[str]):
    return W.partitionBy(*keys).orderBy(*order)


def near(frames: DataFrame, keys: list[str], order: list[str], before: int, after: int, span: int, work: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """``work`` on frames and the keys of its windows, which look at most so many rows back and ahead: by episode, or by range
    with halos if an episode is larger than ``span``."""
    if not ranges.spread(frames, keys, span):
        return work(frames, keys)
    wide = ranges.halo(ranges.placed(frames, keys, order, span), before, after, span)
    return ranges.owned(work(wide, [*keys, ranges.RANGE]), span).drop(ranges.PLACE, ranges.RANGE)


def gather(frames: DataFrame, value: str, deltas: list[int], keys: list[str], order: list[str], fill: str = "edge", name: str = "window", zero: Column | None = None, span: int = ranges.SPAN) -> DataFrame:
    """frames with ``name``: the values at each delta from the row. Out of range, ``edge`` and ``clamp`` hold the first or
    last row's value, ``zero`` gives ``zero`` (0.0 if not given). A null value within the range stays null. Where a delta
    leaves an episode, its end is in the halo, so the edge values are at hand in every range that needs them."""
    if fill not in FILLS:
        raise ValueError(f"unknown fill {fill!r}; one of {FILLS}")
    reach = [max([0, *(sign * d for d in deltas)]) for sign in (-1, 1)]
    return near(frames, keys, order, *reach, span, lambda rows, by_: _gather(rows, value, deltas, by_, order, fill, name, zero))


def _gather(frames: DataFrame, value: str, deltas: list[int], keys: list[str], order: list[str], fill: str, name: str, zero: Column | None) -> DataFrame:
    w, whole = by(keys, order), by(keys, order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    boxed = F.struct(F.col(value).alias("v"))  # tells a null value from a missing row
    low, high = F.first(boxed).over(whole), F.last(boxed).over(whole)
    nothing = F.struct((F.lit(0.0) if zero is None else zero).alias("v"))
    cells = []
    for d in deltas:
        there = F.lead(boxed, d).over(w) if d > 0 else F.lag(boxed, -d).over(w) if d < 0 else boxed
        cells.append(F.coalesce(there, nothing if fill == "zero" else high if d > 0 else low)["v"])
    return frames.withColumn(name, F.array(*cells))


def horizon_filter(frames: DataFrame, horizon: int, keys: list[str], order: list[str], engaged: tuple[str, str], arm: tuple[str, str], span: int = ranges.SPAN) -> DataFrame:
    """frames with ``rule``: the first reason, in this order, for which a window of rows 0 to horizon is left out
    (out_of_bounds, left_swap, right_swap, never_engaged), else null. A swap is a change of arm within the window; never
    engaged means that neither side is engaged on any of its rows."""
    return near(frames, keys, order, 0, horizon, span, lambda rows, by_: _horizon(rows, horizon, by_, order, engaged, arm))


def _horizon(frames: DataFrame, horizon: int, keys: list[str], order: list[str], engaged: tuple[str, str], arm: tuple[str, str]) -> DataFrame:
    ahead = by(keys, order).rowsBetween(0, horizon)
    fits = F.count("*").over(ahead) == horizon + 1
    swap = lambda c: F.min(c).over(ahead) != F.max(c).over(ahead)
    any_engaged = F.max(F.greatest(*[(F.col(c) != 0).cast("int") for c in engaged])).over(ahead) == 1
    rule = F.when(~fits, "out_of_bounds").when(swap(arm[0]), "left_swap").when(swap(arm[1]), "right_swap").when(~any_engaged, "never_engaged")
    return frames.withColumn("rule", rule)


def filter_counts(ruled: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many steps each rule took, valid steps, and episodes that lost all, some or none of their steps."""
    rules = ("out_of_bounds", "left_swap", "right_swap", "never_engaged")
    each = ruled.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("rule").isNull()).alias("valid"), *[F.count_if(F.col("rule") == r).alias(r) for r in rules])
    eligible = F.sum(F.col("n") - F.col("out_of_bounds"))
    return each.agg(
        *[F.sum(r).alias(r) for r in rules], F.sum("valid").alias("valid"), eligible.alias("eligible"),
        F.count_if(F.col("valid") == 0).alias("fully_filtered"), F.count_if((F.col("valid") > 0) & (F.col("valid") < F.col("n") - F.col("out_of_bounds"))).alias("partly_filtered"),
        F.count_if((F.col("valid") > 0) & (F.col("valid") == F.col("n") - F.col("out_of_bounds"))).alias("unfiltered"),
        reduction_percent(F.sum("valid"), eligible).alias("reduction_percent"),
    )


def reduction_percent(valid: Column, eligible: Column) -> Column:
    return F.bround(100 * (1 - valid / F.greatest(F.lit(1), eligible)), 2)


def delta_previous(value: str, reference: Column, keys: list[str], order: list[str]) -> Column:
    """The difference from the row before; from the reference on an episode's first row."""
    return F.col(value) - F.lag(value).over(by(keys, order)) if reference is None else F.col(value) - F.coalesce(F.lag(value).over(by(keys, order)), reference)


def both_engaged(engaged: str, keys: list[str], order: list[str]) -> Column:
    """Engaged on this row and on the one before (the first row: on itself)."""
    now = F.col(engaged) != 0
    return now & F.coalesce(F.lag(engaged).over(by(keys, order)) != 0, now)


def masked_sum(delta: str, mask: str, keys: list[str], order: list[str]) -> Column:
    """The running sum of delta where mask holds."""
    return F.sum(F.when(F.col(mask), F.col(delta)).otherwise(0.0)).over(by(keys, order).rowsBetween(W.unboundedPreceding, W.currentRow))


def sample_and_hold(value: str, engaged: str, keys: list[str], order: list[str]) -> Column:
    """The value of the last engaged row; an episode's first row counts as engaged."""
    w = by(keys, order)
    takes = (F.col(engaged) != 0) | (F.row_number().over(w) == 1)
    boxed = F.when(takes, F.struct(F.col(value).alias("v")))
    return boxed, w.rowsBetween(W.unboundedPreceding, W.currentRow)


def held(frames: DataFrame, value: str, engaged: str, keys: list[str], order: list[str], name: str = "held", span: int = ranges.SPAN) -> DataFrame:
    """frames with ``name``: sample_and_hold."""
    if ranges.spread(frames, keys, span):
        rows = ranges.placed(frames, keys, order, span)
        box = F.when((F.col(engaged) != 0) | (F.col(ranges.PLACE) == 0), F.struct(F.col(value).alias("v")))
        return ranges.scan(rows, keys, order, **{name: ranges.latest(box, order)}).withColumn(name, F.col(name)["v"]).drop(ranges.PLACE, ranges.RANGE)
    boxed, w = sample_and_hold(value, engaged, keys, order)
    return frames.withColumn("__box", boxed).withColumn(name, F.last("__box", ignorenulls=True).over(w)["v"]).drop("__box")


def zero_when_off(value: str, engaged: str) -> Column:
    return F.when(F.col(engaged) != 0, F.col(value)).otherwise(0.0)


def engaged_pose(frames: DataFrame, position: list[str], engaged: str, keys: list[str], order: list[str], mode: str = "per_step", span: int = ranges.SPAN) -> DataFrame:
    """Running relative positions: each column's differences summed while engaged. ``per_step`` asks this row and the one
    before, ``reference`` the episode's first row for all."""
    if mode not in ("per_step", "reference"):
        raise ValueError(f"unknown mode {mode!r}")
    large = ranges.spread(frames, keys, span)

    def differences(rows: DataFrame, by_: list[str]) -> DataFrame:
        w = by(by_, order)
        rows = rows.withColumn("__mask", both_engaged(engaged, by_, order))
        return rows.withColumns({f"__d_{c}": F.col(c) - F.coalesce(F.lag(c).over(w), F.col(c)) for c in position})

    if not large:
        out = differences(frames, keys)
        if mode == "reference":
            whole = by(keys, order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
            out = out.withColumn("__mask", F.first(F.col(engaged) != 0).over(whole))
        out = out.withColumns({f"rel_{c}": masked_sum(f"__d_{c}", "__mask", keys, order) for c in position})
    else:
        rows = ranges.halo(ranges.placed(frames, keys, order, span), 1, 0, span)
        rows = ranges.owned(differences(rows, [*keys, ranges.RANGE]), span)
        if mode == "reference":
            first = F.when(F.col(ranges.PLACE) == 0, F.struct((F.col(engaged) != 0).alias("on")))
            rows = ranges.scan(rows, keys, order, __first=ranges.latest(first, order)).withColumn("__mask", F.col("__first")["on"]).drop("__first")
        sums = {f"rel_{c}": ranges.total(F.when(F.col("__mask"), F.col(f"__d_{c}")).otherwise(0.0)) for c in position}
        out = ranges.scan(rows, keys, order, **sums).drop(ranges.PLACE, ranges.RANGE)
    return out.drop("__mask", *[f"__d_{c}" for c in position])


def engaged_motion(frames: DataFrame, pose: str, engaged: str, keys: list[str], order: list[str], kind: str = "quaternion", name: str = "motion", span: int = ranges.SPAN) -> DataFrame:
    """frames with ``name``, nine numbers: the motions from row to row (position differences; rotations as seen from the row
    before) over rows that are engaged and whose predecessor is, added and multiplied up along the episode, however long that
    is. A pose without a rotation counts as the identity."""
    from ..functions import rotation

    def motions(rows: DataFrame, by_: list[str]) -> DataFrame:
        w = by(by_, order)
        rows = rows.withColumn("__turn", F.coalesce(rotation.matrix_of(F.col(pose), kind), rotation.identity()))
        both = (F.col(engaged) != 0) & F.coalesce(F.lag(engaged).over(w) != 0, F.lit(False))
        turned = rotation.multiply(rotation.transpose(F.lag("__turn").over(w)), F.col("__turn"))
        moved = {f"__d{i}": F.when(both, F.col(pose)[i] - F.lag(F.col(pose)[i]).over(w)).otherwise(0.0) for i in range(3)}
        return rows.withColumns({"__step": F.when(both, turned).otherwise(rotation.identity()), **moved}).drop("__turn")

    rows = motions(ranges.halo(ranges.placed(frames, keys, order, span), 1, 0, span), [*keys, ranges.RANGE])
    rows = ranges.scan(ranges.owned(rows, span), keys, order, **{f"__p{i}": ranges.total(F.col(f"__d{i}")) for i in range(3)})
    rows = ranges.products(rows, keys, order, "__step", "__turned", 3)
    out = F.concat(F.array(*[F.col(f"__p{i}") for i in range(3)]), rotation.to_six(F.col("__turned")))
    return rows.withColumn(name, out).drop("__step", "__turned", ranges.PLACE, ranges.RANGE, *[f"__{k}{i}" for k in "dp" for i in range(3)])


def chunks(frames: DataFrame, size: int, value: str, keys: list[str], order: str) -> DataFrame:
    """keys, chunk, rows (values in order): pieces of ``size`` rows. An episode whose length is no multiple is an error."""
    got = frames.groupBy(*keys, F.floor(F.col(order) / size).cast("long").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(value).alias("v")))).alias("rows"))
    whole = F.when(F.size("rows") == size, F.transform("rows", lambda x: x["v"]))
    return got.withColumn("rows", F.coalesce(whole, F.raise_error(F.lit(f"a chunk is not {size} rows long")).cast(f"array<{dict(frames.dtypes)[value]}>")))


def stitch(frames: DataFrame, keys: list[str], chunk: str = "chunk", frame: str = "frame", drop_first: int = 1) -> DataFrame:
    """Rows of all chunks end to end, without the first frames of each (they repeat the condition), numbered from 0."""
    w = W.partitionBy(*keys).orderBy(chunk, frame)
    return frames.where(F.col(frame) >= drop_first).withColumn("out_frame", (F.row_number().over(w) - 1).cast("long"))


def hand_off(frames: DataFrame, size: int, keys: list[str], value: str, chunk: str = "chunk", frame: str = "frame") -> DataFrame:
    """keys, chunk, condition: frame ``size`` of a chunk conditions the next one."""
    last = frames.where(F.col(frame) == size).select(*keys, (F.col(chunk) + 1).alias(chunk), F.col(value).alias("condition"))
    return frames.select(*keys, chunk).distinct().join(last, [*keys, chunk], "left")


def fold_chunks(chunks: DataFrame, keys: list[str], order: str, value: str, first: Column, step: Callable[[Column, Column], Column]) -> DataFrame:
    """keys and the states of an ordered fold: ``state``, of each chunk in turn, is ``step`` of the state before (``first`` for a
    key's first chunk) and the chunk's value. For steps that are no affine map (see fold_affine): a key's chunks are one
    sequence and meet in one row."""
    rows = chunks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(value).alias("v")))).alias("__rows"))
    empty = F.array().cast(f"array<struct<at:{dict(chunks.dtypes)[order]},state:double>>")
    last = lambda done: F.coalesce(F.try_element_at(done, F.lit(-1))["state"], first)
    states = F.aggregate("__rows", empty, lambda done, x: F.concat(done, F.array(F.struct(x["at"].alias("at"), step(last(done), x["v"]).cast("double").alias("state")))))
    return rows.select(*keys, F.inline(states)).withColumnRenamed("at", order)


def fold_affine(chunks: DataFrame, keys: list[str], order: str, gain: Column | float, add: Column, first: Column | float, name: str = "state", span: int = ranges.SPAN) -> DataFrame:
    """chunks with ``name``, the states of an ordered fold: gain times the state before (``first`` for a key's first chunk) plus
    ``add``. Affine maps are 2 x 2 matrices, whose products run along ranges; no key meets in one task."""
    as_column = lambda c: c if isinstance(c, Column) else F.lit(float(c))
    rows = chunks.withColumn("__map", F.array(as_column(gain).cast("double"), add.cast("double"), F.lit(0.0), F.lit(1.0))).withColumn("__first", as_column(first))
    rows = ranges.products(ranges.dealt(rows, keys, [order], span), keys, [order], "__map", "__all", 2, left=True)
    return rows.withColumn(name, F.col("__all")[0] * F.col("__first") + F.col("__all")[1]).drop("__map", "__all", "__first", ranges.RANGE)


def fill_up(frames: DataFrame, least: int, keys: list[str], order: str) -> DataFrame:
    """frames with copies of each last one, numbered on, until there are ``least``; longer runs stay as they are."""
    w = W.partitionBy(*keys)
    place = F.row_number().over(w.orderBy(order))
    more = F.when(place == F.count("*").over(w), F.greatest(F.lit(least) - F.count("*").over(w), F.lit(0))).otherwise(0)
    copies = frames.withColumn("__more", more.cast("int")).withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__more"))))
    return copies.withColumn(order, (F.col(order) + F.col("__copy")).cast(dict(frames.dtypes)[order])).drop("__more", "__copy")


def last_frames(frames: DataFrame, n: int, keys: list[str], order: str) -> DataFrame:
    """The last n frames of each run, numbered from 0."""
    w = W.partitionBy(*keys)
    at = F.row_number().over(w.orderBy(order)) - F.greatest(F.count("*").over(w) - n, F.lit(0)) - 1
    return frames.withColumn(order, at.cast(dict(frames.dtypes)[order])).where(F.col(order) >= 0)
