"""How filters interact: what each of them takes, in every order of applying them.

Each row has a mask, a bit for each of up to LARGEST filters that it fails. For a part of the rows the signed parity sums of its
masks (the Walsh-Hadamard transform of the counts of masks: for every set of filters, rows that fail an even number of
the set less rows that fail an odd number) are plain sums, so they combine before the shuffle and a part of any size costs
as many numbers. Each label is a class of its own. The transform is its own inverse but for a factor, so the sums give
back the exact count of every mask, and all else is sums over these cells: what is kept, taken, taken already or taken by
one filter alone at each step of each order. Over all orders a row that fails m filters is taken by each of them in n!/m
orders: that is the Shapley value of the filters, times n!.

Defined cases: a null text is empty, a null part is the empty string; a row without doc_id has no labels and repeats no
smaller id; rows that repeat an id are counted each, and their text is repeated only if a smaller id has it; labels that
repeat an id count if one of them says so; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, small_join

LARGEST = 6
BLANKS = "\t\n\x0b\x0c\r"
LABELS = ("good", "toxic")


def words(text: Column) -> Column:
    """Runs of anything but blanks."""
    return F.array_remove(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), "")


def text_conditions(text: Column) -> dict[str, Column]:
    """What fails: few words, repeated words, capitals, marks."""
    w = words(text)
    return {
        "A": F.size(w) < 200, "B": 100 * F.size(F.array_distinct(w)) < 50 * F.size(w),
        "C": 100 * (F.length(text) - F.length(F.translate(text, UPPER, ""))) > 2 * F.length(text), "D": text.rlike("[#$%&*|]"),
    }


def repeated(rows: DataFrame, name: str) -> DataFrame:
    """rows of doc_id, digest with ``name``: whether a smaller id has the same digest. Only digests of several rows are looked
    up, and the join is salted if they are many."""
    several = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    found = small_join(rows, several, ["digest"])
    return found.withColumn(name, F.coalesce(F.col("least") < F.col("doc_id"), F.lit(False))).drop("least", "digest")


def failures(docs: DataFrame, part: str = "source") -> DataFrame:
    """doc_id, part, and a condition for each of the filters A to E: A under 200 words, B fewer than half of them distinct, C
    over 2 % capitals, D a mark of #$%&*|, E the text of a smaller id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), *[c.alias(n) for n, c in text_conditions(text).items()], F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    return repeated(rows, "E")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with good and toxic. Rows without an id are joined to nothing, so that they are not dealt to one task."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null").groupBy("doc_id")
    marks = marks.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    found = rows.where("doc_id is not null").join(marks, "doc_id", "left")
    none = rows.where("doc_id is null").withColumns({n: F.lit(False) for n in LABELS})
    return found.withColumns({n: F.coalesce(n, F.lit(False)) for n in LABELS}).unionByName(none)


def sign(c: Column) -> Column:
    """1 for an even number of bits, -1 for an odd one."""
    return 1 - 2 * (F.bit_count(c) % 2)


def parity_sums(rows: DataFrame, filters: str, keys: list[str]) -> DataFrame:
    """keys and ``sums``: for each set of filters (a number, bit i for filter i) the sum of 1 for rows that fail an even number
    of the set and -1 for others."""
    if not 0 < len(filters) <= LARGEST:
        raise ValueError(f"{len(filters)} filters; 1 to {LARGEST} can be audited")
    mask = sum((F.when(F.col(f), 1 << i).otherwise(0) for i, f in enumerate(filters)), F.lit(0))
    n = 1 << len(filters)
    sums = rows.select(*keys, mask.alias("__mask")).groupBy(*keys).agg(*[F.sum(sign(F.col("__mask").bitwiseAND(s))).alias(f"__{s}") for s in range(n)])
    return sums.select(*keys, F.array(*[F.col(f"__{s}") for s in range(n)]).alias("sums"))


def inverted(sums: Column, n: int) -> Column:
    """Counts of masks from their parity sums: the same transform again and a shift, exact in integers."""
    back = lambda m: F.aggregate(F.transform(sums, lambda x, s: x * sign(m.bitwiseAND(s))), F.lit(0).cast("long"), lambda total, x: total + x)
    return F.transform(F.sequence(F.lit(0), F.lit((1 << n) - 1)), lambda m: F.shiftright(back(m), n))


def cells(rows: DataFrame, filters: str) -> DataFrame:
    """part and arrays of counts by mask: all, and those of each label."""
    sums = parity_sums(rows, filters, ["part", *LABELS])
    exact = sums.select("part", *LABELS, F.posexplode(inverted(F.col("sums"), len(filters))).alias("mask", "n"))
    of = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("mask", c))), lambda x: x[c])
    counted = exact.groupBy("part", "mask").agg(F.sum("n").alias("every"), *[F.sum(F.when(F.col(n), F.col("n")).otherwise(0)).alias(n) for n in LABELS])
    return counted.groupBy("part").agg(*[of(c).alias(c) for c in ("every", *LABELS)])


def steps(filters: str) -> Column:
    """An array of all steps of all orders: filter_order, step, the filter's bit, and the bits of those before."""
    rows = []
    for order in permutations(filters):
        before = 0
        for i, f in enumerate(order, 1):
            bit = 1 << filters.index(f)
            rows.append(f"struct('{''.join(order)}' AS filter_order, {i} AS step, {bit} AS bit, {before} AS before)")
            before |= bit
    return F.expr(f"array({', '.join(rows)})")


def evaluate(counts: DataFrame, filters: str) -> DataFrame:
    """One row a part, order and step."""
    n = len(filters)
    rows = counts.select("*", F.inline(steps(filters)))
    fails, met = (lambda m: m.bitwiseAND(F.col("bit")) != 0), (lambda m: m.bitwiseAND(F.col("before")) != 0)
    add = lambda s, x: s + x
    over = lambda c, keep, worth=lambda m: 1: F.aggregate(F.transform(c, lambda x, m: F.when(keep(m), x * worth(m)).otherwise(0).cast("long")), F.lit(0).cast("long"), add)
    taken = lambda m: fails(m) & ~met(m)
    share = lambda m: F.get(F.lit([0] + [math.factorial(n) // k for k in range(1, n + 1)]), F.bit_count(m))
    return rows.select(
        "part", "filter_order", "step", over("every", lambda m: ~fails(m) & ~met(m)).alias("kept"), over("every", taken).alias("removed"), over("every", lambda m: fails(m) & met(m)).alias("redundant"),
        over("every", lambda m: m == F.col("bit")).alias("unique_fails"), over("good", taken).alias("good_lost"), over("toxic", taken).alias("toxic_lost"), over("every", fails, share).alias("shapley"),
    )


def audit(rows: DataFrame, filters: str) -> DataFrame:
    """rows: part, a boolean column for each letter of ``filters`` (true: fails), good, toxic."""
    return evaluate(cells(rows, filters), filters)
