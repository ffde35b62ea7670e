"""Quantiles by refinement against those of held values; permutations; names."""

import ast
import math
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import kinelake
from kinelake.operators import quantiles, stats


def hard_values(draw):
    tiny = [5e-324, -5e-324, 2.0**-1022, 1e308, -1e308, 0.0, -0.0]
    return {
        "normal": draw.normal(size=900).tolist(), "wide": (10 ** draw.uniform(-300, 300, 700) * draw.choice([-1, 1], 700)).tolist(), "close": (1 + np.arange(800) * 2.0**-52).tolist(),
        "same": [3.25] * 600, "ends": tiny * 40 + [math.inf] * 9 + [-math.inf] * 9, "one": [7.0], "nan": [math.nan] * 300 + [1.0, 2.0], None: draw.integers(0, 3, 500).astype(float).tolist(),
    }


@pytest.mark.parametrize("held", [5, 100, 10**6])
def test_refined_quantiles(spark, held):
    values = hard_values(np.random.default_rng(5))
    rows = [(g, x) for g, xs in values.items() for x in xs] + [("normal", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    ps = {"low": 0.01, "mid": 0.5, "high": 0.99, "first": 0.0, "last": 1.0}
    got = {r.g: r for r in quantiles.quantiles(df, ["g"], "x", ps, df.groupBy("g").agg(F.count("x").alias("count")), held).collect()}
    assert len(got) == 9 and got["none"].low is None
    for g, xs in values.items():
        xs = sorted(xs, key=lambda x: (math.isnan(x), x))
        for name, p in ps.items():
            at = p * (len(xs) - 1)
            lo, hi = xs[math.floor(at)], xs[math.ceil(at)]
            expected = lo if lo == hi or (math.isnan(lo) and math.isnan(hi)) else lo * (1 - (at - math.floor(at))) + hi * (at - math.floor(at))
            assert got[g][name] == pytest.approx(expected, rel=1e-15, abs=0, nan_ok=True), (g, name)


def test_statistics_are_the_same_either_way(spark):
    draw = np.random.default_rng(6)
    rows = spark.createDataFrame([(f"l{i % 3}" if i % 5 else None, draw.normal(size=3).tolist()) for i in range(400)] + [("l0", None), ("l1", [None, 1.0, 2.0])], "label string, v array<double>")
    a, b = ({(r.label, r.dim): [r["count"], *[r[n] for n in stats.NAMES]] for r in stats.column_statistics(rows, "v", ["label"], held=h).collect()} for h in (7, 10**6))
    assert a.keys() == b.keys() and len(a) == 12
    assert all(a[k] == pytest.approx(b[k], rel=1e-12) for k in a)


def test_ten_million_distinct_values(spark):
    n = 10_000_000
    rows = spark.range(n).select(((F.col("id") * 7919) % n).cast("double").alias("x"))
    got = quantiles.quantiles(rows, [], "x", {"a": 0.01, "b": 0.99}, spark.createDataFrame([(n,)], "count long"), held=10_000).first()
    assert (got.a, got.b) == (pytest.approx((n - 1) * 0.01), pytest.approx((n - 1) * 0.99))


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000, 1009])
def test_permutation(spark, n):
    x = lambda seed: [r[0] for r in spark.range(n).orderBy("id").select(stats.permuted(F.col("id"), F.lit(n), seed)).collect()]
    one = x(1)
    assert sorted(one) == list(range(n))
    if n >= 64:
        assert one != x(2) and one != sorted(one) and abs(np.corrcoef(one, np.arange(n))[0, 1]) < 0.4


def test_ranks_are_even_and_starts_are_global(spark):
    leaves = spark.createDataFrame([("a", 1000, 0), ("b", 3, 1000), ("c", 0, 1003), ("d", 157, 1003)], "leaf string, virtual long, lo long")
    rows = stats.shuffle_blocks(leaves, 16, seed=9, ranks=7, start="lo").collect()
    assert len(rows) == 63 + 1 + 10 and sorted(r.shuffled for r in rows) == list(range(74))
    assert set(Counter(r["rank"] for r in rows).values()) == {10, 11}
    covered = sorted(i for r in rows for i in range(r.block_first, r.block_first + r.block_end - r.block_start))
    assert covered == list(range(1160))


def test_no_name_is_bound_twice():
    for path in Path(kinelake.__path__[0]).rglob("*.py"):
        body = ast.parse(path.read_text()).body
        names = [n.name for n in body if isinstance(n, ast.FunctionDef | ast.ClassDef)] + [t.id for n in body if isinstance(n, ast.Assign) for t in n.targets if isinstance(t, ast.Name)]
        assert not [n for n, k in Counter(names).items() if k > 1], path
