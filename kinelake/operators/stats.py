"""Statistics of vectors, mixtures, metrics and accounting: aggregations that combine before they shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from . import quantiles
from ..sources.shared import fixed

NAMES = ("mean", "std", "min", "max", "q01", "q99")
QUANTILES = {"q01": 0.01, "q99": 0.99}


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def column_statistics(rows: DataFrame, vector: str, keys: list[str] | None = None, single: bool = True, floor_std: float | None = None, exact: bool = True, held: int = quantiles.HELD) -> DataFrame:
    """keys, dim, count and NAMES for each component: population deviation, quantiles between neighbours. ``single`` takes
    the values in 32 bits, as raw statistics do. A deviation below floor_std becomes 1. Up to ``held`` rows (they are
    counted) a task holds a component's distinct values; beyond, the quantiles come from refined histograms, and are the same.
    ``exact=False`` sketches them in one pass."""
    keys = keys or []
    v = F.col(vector).cast("array<float>" if single else "array<double>")
    x = rows.select(*keys, F.posexplode(v).alias("dim", "__x")).withColumn("__x", F.col("__x").cast("double"))
    std = F.stddev_pop("__x")
    if floor_std is not None:
        std = F.when(std < floor_std, 1.0).otherwise(std)
    sums = [F.count("__x").alias("count"), F.avg("__x").alias("mean"), std.alias("std"), F.min("__x").alias("min"), F.max("__x").alias("max")]
    names, wanted = [*keys, "dim"], F.array(*[F.lit(p) for p in QUANTILES.values()])
    if exact and rows.count() > held:
        return quantiles.quantiles(x, names, "__x", QUANTILES, fixed(x.groupBy(*names).agg(*sums)), held)
    q = F.percentile("__x", wanted) if exact else F.percentile_approx("__x", wanted, 100_000)
    made = x.groupBy(*names).agg(*sums, q.alias("__q"))
    return made.select(*names, "count", *NAMES[:4], *[F.col("__q")[i].alias(n) for i, n in enumerate(QUANTILES)])


def statistics_arrays(tall: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row a key: an array over the components for each of NAMES."""
    pack = lambda n: F.transform(F.array_sort(F.collect_list(F.struct("dim", F.col(n).alias("v")))), lambda s: s["v"]).alias(n)
    return tall.groupBy(*(keys or [])).agg(*[pack(n) for n in NAMES])


def project_statistics(keys: DataFrame, per_key: DataFrame, whole: DataFrame) -> DataFrame:
    """Statistics of each key (key, original, start, end): its own if it has some, else the part of its raw column's; keys
    of neither are left out."""
    cut = lambda n: F.slice(F.col(f"w_{n}"), F.col("start") + 1, F.col("end") - F.col("start"))
    own = per_key.select("key", *[F.col(n).alias(f"k_{n}") for n in NAMES])
    raw = whole.select(F.col("key").alias("original"), *[F.col(n).alias(f"w_{n}") for n in NAMES])
    out = keys.join(own, "key", "left").join(raw, "original", "left")
    return out.select("key", *[F.coalesce(F.col(f"k_{n}"), cut(n)).alias(n) for n in NAMES]).where("mean is not null")


def statistic_keys(stats: Column) -> Column:
    """The entries of a map of JSON texts that are statistics: objects whose name has no leading underscore."""
    return F.map_filter(stats, lambda k, v: ~k.startswith("_") & F.coalesce(F.ltrim(v).startswith("{"), F.lit(False)))


def key_checks(rows: DataFrame, key: str, quaternion: Column) -> DataFrame:
    """Per key: rounded minimum, maximum and mean of quaternion norms, to see whether they are unit ones."""
    norm = F.sqrt(F.aggregate(quaternion, F.lit(0.0), lambda s, x: s + x * x))
    n = rows.select(key, norm.alias("n"))
    return n.groupBy(key).agg(*[F.round(f("n"), 4).alias(f"norm_{k}") for k, f in (("min", F.min), ("max", F.max), ("mean", F.avg))])


def width_check(slices: DataFrame, declared: DataFrame) -> DataFrame:
    """column, needed (the largest end), width, ok: whether raw columns are as wide as their slices need."""
    need = slices.groupBy("column").agg(F.max("end").alias("needed"))
    return need.join(declared, "column", "left").withColumn("ok", F.coalesce(F.col("needed") <= F.col("width"), F.lit(False)))


# mixtures


def mixture(leaves: DataFrame, order: list[str], length: str = "real_len", ratio: str = "mix_ratio") -> DataFrame:
    """leaves with repeat (ratio over length, against the smallest such, rounded half to even, 1 at least), virtual size,
    share in percent, and lo and hi in the virtual index space. One row a leaf: planner tables."""
    weight = F.col(ratio) / F.greatest(F.col(length), F.lit(1))
    everything = W.partitionBy()
    repeat = F.greatest(F.lit(1), F.rint(weight / F.min(F.when(weight > 0, weight)).over(everything))).cast("long")
    out = leaves.withColumn("repeat", F.coalesce(repeat, F.lit(1).cast("long"))).withColumn("virtual", F.col("repeat") * F.col(length))
    out = out.withColumn("pct", F.try_divide(100.0 * F.col("virtual"), F.sum("virtual").over(everything)))
    end = F.sum("virtual").over(W.orderBy(*order)).cast("long")
    return out.withColumn("lo", end - F.col("virtual")).withColumn("hi", end)


def mixture_summary(mixed: DataFrame, tag: str, length: str = "real_len") -> DataFrame:
    """One row: leaves, their real and virtual frames, and distinct embodiments of a mixture."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return mixed.agg(F.count("*").alias("leaves"), total(length).alias("real"), total("virtual").alias("virtual"), F.count_distinct(tag).alias("embodiments"))


def widest_state(samples: DataFrame, leaf: str, order: str, state: str) -> DataFrame:
    """One row: the width of the widest state among each leaf's first sample; leaves without one do not count (0 if none)."""
    first = samples.groupBy(leaf).agg(F.min_by(F.size(state), order).alias("n"))
    return first.agg(F.greatest(F.coalesce(F.max("n"), F.lit(0)), F.lit(0)).alias("state_dim"))


def real_index(located: DataFrame, length: str = "real_len") -> DataFrame:
    """local, a place in a leaf's virtual block, as a real place: repeats run through the leaf again."""
    return located.withColumn("real", F.pmod(F.col("local"), F.col(length)))


def shuffle_blocks(leaves: DataFrame, size: int = 512, seed: int | None = None, ranks: int | None = None, length: str = "virtual", key: str = "leaf", start: str | None = None) -> DataFrame:
    """key, block_start, block_end: contiguous blocks of at most ``size`` that never cross a leaf; with ``start``, the leaf's
    begin in the mixture, block_first too, the block's begin there. With a seed, also ``shuffled``, the block's place in a
    permutation of all blocks, and given ranks, who reads it: places in turn, so ranks have as many blocks, but for one. A
    block's number comes from the sizes of the leaves before its own (planner rows) and its place from its number alone:
    blocks are neither sorted nor shuffled. A key is one leaf's."""
    used = leaves.where(F.col(length) > 0).select(key, F.col(length).cast("long").alias("__n"), *([F.col(start).cast("long").alias("__lo")] if start else []))
    blocks = F.ceil(F.col("__n") / size).cast("long")
    if seed is not None:
        used = used.withColumn("__upto", F.sum(blocks).over(W.orderBy(key))).withColumn("__all", F.sum(blocks).over(W.partitionBy()))
    out = used.select("*", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("__i")).withColumn("block_start", F.col("__i") * size)
    made = [key, "block_start", F.least(F.col("block_start") + size, F.col("__n")).alias("block_end")]
    if start:
        made.append((F.col("__lo") + F.col("block_start")).alias("block_first"))
    if seed is not None:
        place = permuted(F.col("__upto") - blocks + F.col("__i"), F.col("__all"), seed)
        made.append(place.alias("shuffled"))
    out = out.select(*made)
    if seed is not None and ranks:
        out = out.withColumn("rank", F.pmod("shuffled", F.lit(ranks)).cast("int"))
    return out


#: Rounds of a permutation.
ROUNDS = 48


def permuted(i: Column, n: Column, seed: int, rounds: int = ROUNDS) -> Column:
    """The place of i, 0 to n - 1, in a permutation of these that the seed draws. Each round pairs every number with that at
    an equal distance from a drawn point, and swaps the two or does not, by a bit drawn for the pair: a bijection for every
    n, without a detour for numbers out of range."""
    drawn = lambda *c: F.md5(F.concat_ws(":", F.lit(seed), *c).cast("binary"))

    def swap(x: Column, r: Column) -> Column:
        point = F.pmod(F.conv(F.substring(drawn(r), 1, 15), 16, 10).cast("long"), n)
        mate = F.pmod(point + n - x, n)
        return F.when(F.substring(drawn(r, F.greatest(x, mate)), 1, 1) >= "8", mate).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), i.cast("long"), swap)


# metrics


#: Names and frames of the groups of generated chunks.
CHUNKS = {"early_c1": (0, 12), "mid_c2c3": (12, 36), "late_c4c6": (36, 72)}


def clip_metrics(frames: DataFrame, clip: str, frame: str, l1: str, ssim: str, chunks: dict[str, tuple[int, int]] = CHUNKS) -> DataFrame:
    """Per clip, over frames after the first (which is the condition): how many, means, population deviations, the slope of l1 by
    frame (null for fewer than two), and means of l1 and ssim over each chunk of generated frames. A clip of the condition
    alone has a row of zero frames, whose measures are null."""
    made = F.col(frame) > 0
    x = frames.select(clip, F.when(made, (F.col(frame) - 1).cast("double")).alias("__t"), F.when(made, F.col(l1)).alias("__l"), F.when(made, F.col(ssim)).alias("__s"))
    within = lambda c, a, b: F.avg(F.when((F.col("__t") >= a) & (F.col("__t") < b), F.col(c)))
    return x.groupBy(clip).agg(
        F.count("__t").alias("num_frames"), F.avg("__l").alias("mean_l1"), F.stddev_pop("__l").alias("std_l1"), F.avg("__s").alias("mean_ssim"), F.stddev_pop("__s").alias("std_ssim"),
        F.regr_slope(F.col("__l"), F.col("__t")).alias("l1_slope"), *[within(c, *r).alias(f"{k}_{n}") for n, c in (("l1", "__l"), ("ssim", "__s")) for k, r in chunks.items()],
    )


def run_summary(clips: DataFrame, chunks: dict[str, tuple[int, int]] = CHUNKS) -> DataFrame:
    """One row: means over clips of finite values only, and the number of all clips."""
    mean = lambda c: F.avg(F.when(finite(F.col(c)), F.col(c))).alias(c)
    return clips.agg(F.count("*").alias("num_clips"), *[mean(c) for c in ("mean_l1", "mean_ssim", "l1_slope", *[f"{k}_l1" for k in chunks])])


def action_error(predicted: DataFrame, truth: DataFrame, keys: list[str], vector: str, group: list[str]) -> DataFrame:
    """Mean squared error over all steps and components that both have."""
    a = predicted.select(*keys, F.col(vector).alias("__a"))
    both = a.join(truth.select(*keys, *group, F.col(vector).alias("__b")), keys)
    each = both.select(*group, F.explode(F.zip_with("__a", "__b", lambda p, q: (p - q) * (p - q))).alias("e"))
    return each.groupBy(*group).agg(F.avg("e").alias("mse"))


def norms(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """L2 norm and largest absolute value; both 0 where there is no value."""
    x = F.col(value)
    return rows.groupBy(*keys).agg(F.sqrt(F.coalesce(F.sum(x * x), F.lit(0.0))).alias("l2"), F.coalesce(F.max(F.abs(x)), F.lit(0.0)).alias("max_abs"))


# accounting


def gpu_hours(jobs: DataFrame, gpus: int) -> DataFrame:
    """One row: hours of all jobs, elapsed seconds times nodes times GPUs. AllocNodes counts unless empty or 0, else NNodes;
    rows whose numbers cannot be read are left out and counted."""
    number = lambda c: F.expr(f"try_cast(nullif(trim({c}), '') as long)")
    alloc = number("AllocNodes")
    nodes = F.when(alloc.isNull() | (alloc == 0), number("NNodes")).otherwise(alloc)
    hours = number("ElapsedRaw") / 3600.0 * nodes * gpus
    return jobs.agg(F.coalesce(F.sum(hours), F.lit(0.0)).alias("gpu_hours"), F.count(hours).alias("jobs"), F.count_if(hours.isNull()).alias("skipped"))


def dataset_size(leaves: DataFrame, keep: float) -> DataFrame:
    """One row: frames of all leaves, filtered ones times a keep fraction, and leaves whose length is missing."""
    return leaves.agg(F.coalesce(F.sum(F.when(F.col("filtered"), F.col("frames") * keep).otherwise(F.col("frames").cast("double"))), F.lit(0.0)).alias("frames"), F.count_if(F.col("frames").isNull()).alias("missing"))


def training_flops(parameters: Column, tokens: Column) -> Column:
    return 6.0 * parameters * tokens


def energy(hours: Column, watts: float, pue: float, kg_per_kwh: float) -> dict[str, Column]:
    kwh = hours * (watts / 1000.0) * pue
    return {"kwh": kwh, "mwh": kwh / 1000.0, "tco2e": kwh * kg_per_kwh / 1000.0}


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Keys that more than one row has."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def expect_unique(rows: DataFrame, key: str, expected: int | None = None) -> DataFrame:
    """rows, after checks that keys are unique and as many as expected."""
    n, kinds = rows.agg(F.count("*"), F.count_distinct(key)).first()
    if n != kinds:
        raise ValueError(f"{n - kinds} rows repeat a {key}")
    if expected is not None and n != expected:
        raise ValueError(f"{n} rows, expected {expected}")
    return rows


def keep_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows that share a key the last one."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def latest_status(polls: DataFrame, job: str, at: str, status: str) -> DataFrame:
    """The state of each job after its last poll: done, failed or open."""
    last = polls.groupBy(job).agg(F.max_by(status, at).alias(status))
    return last.withColumn("state", F.when(F.col(status) == "completed", "done").when(F.col(status).isin("failed", "cancelled"), "failed").otherwise("open"))


# provenance


def set_signature(rows: DataFrame, *parts: str) -> Column:
    """The first twelve hex digits of the SHA-1 of all ``a:b`` lines, sorted. An aggregate over planner rows."""
    return F.substring(F.sha1(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", *parts))), "\n").cast("binary")), 1, 12)


def cache_key(name: Column, split: Column, deltas: Column) -> Column:
    """The first twelve hex digits of the MD5 of ``name_split_[d1, d2]`` with sorted deltas."""
    text = F.concat(name, F.lit("_"), split, F.lit("_["), F.array_join(F.transform(F.array_sort(deltas), lambda d: d.cast("string")), ", "), F.lit("]"))
    return F.substring(F.md5(text.cast("binary")), 1, 12)


def same_provenance(a: dict[str, Column], b: dict[str, Column]) -> Column:
    out = F.lit(True)
    for k in ("experiment_id", "set_signature", "action_rep"):
        out = out & a[k].eqNullSafe(b[k])
    return out
