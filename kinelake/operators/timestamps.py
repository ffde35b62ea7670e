"""Timestamps that cannot be trusted, and what stands in for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

EPOCH = 1e6


def broken(frames: DataFrame, keys: list[str], at: str, fps: float) -> DataFrame:
    """keys and broken: whether an episode's timestamps (seconds) span less than its rows at fps, begin above EPOCH, are
    less than half distinct, or lie over ten times the expected spacing apart on average."""
    n, span = F.count("*"), F.max(at) - F.min(at)
    bad = (span < n / F.lit(fps) - 1.0 / fps) | (F.min_by(at, "frame") > EPOCH) | (F.count_distinct(at) < 0.5 * n) | ((n > 1) & (span / F.greatest(n - 1, F.lit(1)) > 10.0 / fps))
    return frames.groupBy(*keys).agg(F.coalesce(bad, F.lit(True)).alias("broken"))


def repair(frames: DataFrame, keys: list[str], at: str, fps: float) -> DataFrame:
    """frames with ``repaired``: frame / fps in broken episodes, else the stored time."""
    flags = broken(frames, keys, at, fps)
    return frames.join(flags, keys).withColumn("repaired", F.when(F.col("broken"), F.col("frame") / F.lit(fps)).otherwise(F.col(at))).drop("broken")


def frame_numbers(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("frame", (F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))
