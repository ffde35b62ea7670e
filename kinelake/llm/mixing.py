"""Mixing sources to target weights by hash-threshold histograms; DataFrame functions only.

Each document has a fixed point on a line: the first nine hex digits of the md5 of its id (of its text where the id is
null). Sizes are summed by source and bucket (three digits); the bucket in which a source's budget is spent is refined
by three digits more, and its last one by the final three. Documents below the point so found are taken once more than
the rest. Nothing is sorted but the few buckets of a source, and every choice depends on id and totals only.

Defined cases: a null text has size 0; null is a source like any other, last in order; rows that repeat an id share their
point and so their fate; documents of size 0 are never taken; an empty table gives no row; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import WORD, cut, small_join

WEIGHTS = (3, 1, 2)
LEVELS, DIGITS = 3, 3


def sizes(docs: DataFrame) -> Column:
    return F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target. One row a source goes in; the water level at which the uncapped sources share what
    the capped ones leave is found in one pass over the sources by size for their weight."""
    nth = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights) + 1).cast("int"))
    t = totals.withColumn("weight", w.cast("long")).withColumn("nth", nth)
    by = W.orderBy((F.col("source_size").cast("double") / F.col("weight")), "nth")
    everything = W.partitionBy()
    before = by.rowsBetween(W.unboundedPreceding, -1)
    room = F.lit(float(share)) * F.sum("source_size").over(everything).cast("double") - F.lit(float(most)) * F.coalesce(F.sum("source_size").over(before), F.lit(0)).cast("double")
    heavy = (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("double")
    cap = F.lit(float(most)) * F.col("source_size").cast("double")
    t = t.select("source", "source_size", "weight", cap.alias("cap"), (room / heavy).alias("level"), F.row_number().over(by).alias("at"))
    fits = F.min_by("level", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("at"))).over(everything)
    found = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("at"))).over(everything)
    return t.select("source", "source_size", F.when(found.isNull(), F.col("cap")).otherwise(F.least("cap", fits * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, keep: list[str] | None = None) -> DataFrame:
    """docs with size, source_size, target and taken (size times the number of copies that the mix takes). ``keep`` names the
    columns of docs that are wanted, source among them; those are written down beside the sizes, so that texts, if not among
    them, are read and counted once only. All columns are wanted if it is not given, and texts are then read a second time."""
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("size", "source_size", "target", "taken")]
    if "source" not in kept:
        raise ValueError("the columns to keep must have source among them")
    point = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.coalesce(F.col("text"), F.lit("")))).cast("binary")), 1, LEVELS * DIGITS)
    measured = docs.select(*kept, sizes(docs).alias("size"), point.alias("__point"))
    if keep is not None:
        measured = cut(measured)
    lean = cut(measured.select("source", "size", "__point")) if keep is None else measured.select("source", "size", "__point")

    def histogram(rows: DataFrame, level: int) -> DataFrame:
        """By source, bucket of this level: its size and that of all buckets before it within the same parent."""
        bucket = F.substring("__point", level * DIGITS + 1, DIGITS)
        sums = rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("bucket_size"))
        return sums.withColumn("before", F.sum("bucket_size").over(W.partitionBy("source").orderBy("bucket")) - F.col("bucket_size"))

    first = cut(histogram(lean, 0))
    totals = first.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    goal = targets(totals, weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = cut(goal.withColumn("whole", whole.cast("long")).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("prefix", F.lit("")))
    rows, hist = lean, first
    for level in range(LEVELS):
        if level:
            rows = small_join(rows, state.select("source", "prefix"), ["source"], "inner").where(F.substring("__point", 1, level * DIGITS) == F.col("prefix")).drop("prefix")
            hist = histogram(rows, level)
        last = level == LEVELS - 1
        # the buckets that fit whole come first; on the last level the next one counts too where that is nearer
        near = F.col("before") + (F.col("bucket_size") / 2 if last else F.col("bucket_size")) <= F.col("budget")
        at = small_join(hist, state.select("source", "budget"), ["source"], "inner").groupBy("source").agg(
            F.min(F.when(~near, F.struct("bucket", "before"))).alias("edge"), F.max("bucket").alias("end")
        )
        state = small_join(state, at, ["source"], "left").select(
            "source", "source_size", "target", "whole",
            (F.col("budget") - F.coalesce(F.col("edge.before"), F.lit(0))).alias("budget"),
            F.concat("prefix", F.coalesce(F.col("edge.bucket"), F.lit("~"))).alias("prefix"),
        )
        state = cut(state)
    # a document is below the point if its digits are smaller; ~ is above all of them
    out = small_join(measured, state.select("source", "source_size", "target", F.col("whole").alias("__whole"), F.col("prefix").alias("__prefix")), ["source"], "left")
    copies = F.col("__whole") + (F.col("__point") < F.col("__prefix")).cast("long")
    return out.select(*kept, "size", "source_size", "target", (F.col("size") * copies).alias("taken"))


def take(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """What the mix takes, with the columns of docs: a row as often as its words are taken."""
    mixed = mix(docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", "text", "source"), weights, share, most)
    copies = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(0).cast("int")
    return mixed.where("taken > 0").select("__row", F.explode(F.sequence(F.lit(1), copies))).select("__row.*")
