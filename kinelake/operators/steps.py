"""Episodes, steps, splits and samples: which training windows there are.

An episode table has (leaf, episode, length); a frame table has (leaf, episode, frame, ...). ``leaf`` may be left out
where there is one data set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window as W
from pyspark.sql import functions as F

TEST_RATIO = 0.02


def derive_episodes(frames: DataFrame, keys: list[str]) -> DataFrame:
    """keys and length: rows of each episode."""
    return frames.groupBy(*keys).agg(F.count("*").alias("length"))


def preferred_length(stats: Column, preferred: list[str]) -> Column:
    """The first count of the first preferred key of a map of statistics, else of any key; null if there is none."""
    count = lambda s: F.try_element_at(s["count"], F.lit(1))
    known = [count(F.try_element_at(stats, F.lit(k))) for k in preferred]
    return F.coalesce(*known, F.try_element_at(F.filter(F.transform(F.map_values(stats), count), lambda x: x.isNotNull()), F.lit(1)))


def validate_episodes(episodes: DataFrame, episode: str = "episode", expected_episodes: int | None = None, expected_frames: int | None = None) -> DataFrame:
    """One row: counts, whether ids are 0 to N - 1 without gap or repeat, and whether totals are the expected ones."""
    n = F.count(episode)
    contiguous = (F.count_distinct(episode) == n) & ((n == 0) | ((F.min(episode) == 0) & (F.max(episode) == n - 1)))
    got = episodes.agg(n.alias("episodes"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("frames"), F.coalesce(contiguous, F.lit(False)).alias("contiguous"))
    return got.withColumn("episodes_match", F.col("episodes") == F.lit(expected_episodes) if expected_episodes is not None else F.lit(True)).withColumn(
        "frames_match", F.col("frames") == F.lit(expected_frames) if expected_frames is not None else F.lit(True)
    )


def enumerate_steps(episodes: DataFrame, single: bool = False) -> DataFrame:
    """A row for each (episode, base): 0 to length - 1, or base 0 alone. Empty episodes have none."""
    if single:
        return episodes.withColumn("base", F.lit(0).cast("long")).drop("length")
    return episodes.where("length > 0").withColumn("base", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length").cast("long") - 1))).drop("length")


def parse_ranges(spec: Column) -> Column:
    """The indices of split ranges such as ``0:9, 20-29`` or ``3``: inclusive, sorted and each once. A range that ends
    before it begins, or text that is no range, is an error."""
    parts = F.filter(F.split(F.trim(spec), r"[,\s]+"), lambda x: x != "")

    def one(x: Column) -> Column:
        lo, hi = F.regexp_extract(x, r"^(\d+)(?:[:-](\d+))?$", 1), F.regexp_extract(x, r"^(\d+)(?:[:-](\d+))?$", 2)
        a, b = F.try_to_number(lo, F.lit("9999999999")).cast("long"), F.try_to_number(F.when(hi == "", lo).otherwise(hi), F.lit("9999999999")).cast("long")
        bad = F.raise_error(F.concat(F.lit("no split range: "), x)).cast("array<long>")
        return F.when(a.isNull() | b.isNull() | (b < a), bad).otherwise(F.sequence(a, F.greatest(a, b)))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, one))))


def excluded_indices(splits: DataFrame, names: list[str]) -> DataFrame:
    """episode: the union of the ranges of the named splits (name, spec); names are compared without case."""
    wanted = [n.strip().lower() for n in names]
    return splits.where(F.lower(F.trim("name")).isin(wanted)).select(F.explode(parse_ranges(F.col("spec"))).alias("episode")).distinct()


def exclude(episodes: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    return episodes.join(excluded, key, "left_anti")


def range_bounds(df: DataFrame, order: list[str], buckets: int) -> list[Row]:
    """The least value of each of about equal ranges of ``order`` but the first, in order; as many as buckets at most."""
    each = df.select(F.struct(*order).alias("__at")).repartitionByRange(buckets, "__at").groupBy(F.spark_partition_id()).agg(F.min("__at").alias("__at"))
    return sorted((r["__at"] for r in each.collect()))[1:]


def number(df: DataFrame, order: list[str], name: str = "pos", buckets: int = 64) -> DataFrame:
    """Positions from 0 in the order of unique, non-null ``order`` columns, without bringing all rows together. The bounds of
    the ranges are fetched once (one row a range) and a row's range is an expression of its own values, so that counting and
    numbering agree however each of them is planned."""
    types = dict(df.dtypes)
    bounds = [F.struct(*[F.lit(r[c]).cast(types[c]).alias(c) for c in order]) for r in range_bounds(df, order, buckets)]
    at = F.struct(*order)
    part = F.size(F.filter(F.array(*bounds), lambda x: x <= at)) if bounds else F.lit(0)
    ranged = df.withColumn("__part", part)
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    offsets = counts.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__offset"))
    nth = F.row_number().over(W.partitionBy("__part").orderBy(*order)) - 1
    # one row a range
    return ranged.withColumn("__nth", nth).join(F.broadcast(offsets), "__part").withColumn(name, (F.col("__offset") + F.col("__nth")).cast("long")).drop("__part", "__nth", "__offset")


def positions_by_episode(steps: DataFrame, episode: str = "episode", base: str = "base", name: str = "pos") -> DataFrame:
    """Positions from 0 in (episode, base) order: the running sum of episode sizes and the rank within an episode."""
    sizes = steps.groupBy(episode).agg(F.count("*").alias("__n"))
    begins = number(sizes, [episode], "__k")
    at = F.sum("__n").over(W.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1))
    blocks = begins.groupBy(F.floor(F.col("__k") / 4096).alias("__bucket")).agg(F.sum("__n").alias("__n")).withColumn("__before", F.coalesce(at, F.lit(0))).drop("__n")
    within = F.sum("__n").over(W.partitionBy("__bucket").orderBy(episode)) - F.col("__n")
    starts = begins.withColumn("__bucket", F.floor(F.col("__k") / 4096)).withColumn("__within", within).join(blocks, "__bucket").select(episode, (F.col("__before") + F.col("__within")).alias("__start"))
    nth = F.row_number().over(W.partitionBy(episode).orderBy(base)) - 1
    return steps.withColumn("__nth", nth).join(starts, episode).withColumn(name, (F.col("__start") + F.col("__nth")).cast("long")).drop("__nth", "__start")


def trailing_split(positions: DataFrame, part: str, ratio: float = TEST_RATIO, pos: str = "pos", n: int | None = None) -> DataFrame:
    """``train``: all but the last max(1, int(n * ratio)) positions; ``test``: those; ``full``: all. n: how many positions there
    are; they are counted if it is not given."""
    if part == "full":
        return positions
    if not 0 < ratio < 1:
        raise ValueError("the test ratio must be between 0 and 1")
    n = positions.count() if n is None else n
    first_test = n - max(1, int(n * ratio))
    return positions.where(F.col(pos) < first_test if part == "train" else F.col(pos) >= first_test)


def stride_sample(positions: DataFrame, most: int, pos: str = "pos", n: int | None = None) -> DataFrame:
    """Every (n div most)-th position if there are more than ``most``; that may leave more than ``most``."""
    n = positions.count() if n is None else n
    return positions.where(F.col(pos) % max(1, n // most) == 0) if n > most else positions


def head(frames: DataFrame, order: list[str], n: int) -> DataFrame:
    return frames.orderBy(*order).limit(n)
