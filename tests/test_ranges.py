"""Ranges, carries and halos: the same results as whole episodes, with no task above a range."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.operators import joins, ranges, windows

SPAN = 7


@pytest.fixture(scope="module")
def frames(spark):
    draw = np.random.default_rng(11)
    rows = [(e, k, None if draw.random() < 0.1 else float(draw.normal()), int(draw.random() < 0.6), int(draw.random() < 0.3)) for e, n in [("a", 60), ("b", 1), (None, 23), ("c", 7), ("d", 8)] for k in (3 * np.arange(n) - 5).tolist()]
    return spark.createDataFrame([(*r, {"x": 1}) for r in rows], "e string, k long, v double, on int, arm int, note map<string,int>").repartition(5).cache()


def same(a, b):
    key = lambda r: str([(c, r[c]) for c in sorted(r.asDict()) if c != "note"])
    got, expected = (sorted(map(key, df.collect())) for df in (a, b))
    assert got == expected and got
    return a


def test_places_and_ranges(frames):
    rows = ranges.placed(frames, ["e"], ["k"], SPAN).collect()
    assert sorted((str(r.e), r[ranges.PLACE]) for r in rows) == sorted((str(r.e), (r.k + 5) // 3) for r in rows)
    assert all(r[ranges.RANGE] == r[ranges.PLACE] // SPAN for r in rows) and len(rows) == 99


@pytest.mark.parametrize("fill", windows.FILLS)
def test_gather(frames, fill):
    go = lambda span: windows.gather(frames, "v", [-7, -2, 0, 1, 5], ["e"], ["k"], fill, span=span)
    same(go(SPAN), go(1000))
    with pytest.raises(ValueError, match="halo"):
        windows.gather(frames, "v", [8], ["e"], ["k"], fill, span=SPAN)


def test_rules_holds_and_sums(frames):
    same(*(windows.horizon_filter(frames, 4, ["e"], ["k"], ("on", "arm"), ("arm", "on"), span=s) for s in (SPAN, 1000)))
    same(*(windows.held(frames, "v", "on", ["e"], ["k"], span=s) for s in (SPAN, 1000)))
    rounded = lambda df: df.withColumn("rel_v", F.round("rel_v", 9))
    for mode in ("per_step", "reference"):
        same(*(rounded(windows.engaged_pose(frames, ["v"], "on", ["e"], ["k"], mode, span=s)) for s in (SPAN, 1000)))


def test_running_products():
    m = np.random.default_rng(1).normal(size=(23, 3, 3)) / 2
    for left in (False, True):
        now, expected = np.eye(3), []
        for x in m:
            now = x @ now if left else now @ x
            expected.append(now)
        assert np.allclose(ranges.running(m, left), expected)
    assert ranges.running(m[:0], False).shape == (0, 3, 3)


def test_affine_folds(spark):
    draw = np.random.default_rng(2)
    rows = [(e, c, float(g), float(x)) for e, n in (("a", 40), ("b", 1), (None, 9)) for c, (g, x) in enumerate(draw.normal(size=(n, 2)))]
    got = {(r.e, r.c): r.state for r in windows.fold_affine(spark.createDataFrame(rows, "e string, c int, g double, x double"), ["e"], "c", F.col("g"), F.col("x"), 2.0, span=SPAN).collect()}
    now = {}
    for e, c, g, x in rows:
        now[e] = g * now.get(e, 2.0) + x
        assert got[e, c] == pytest.approx(now[e])


def test_motion_over_ranges(spark):
    draw = np.random.default_rng(3)
    q = draw.normal(size=(50, 7))
    q[7, 3:] = 0
    rows = spark.createDataFrame([("a" if k < 44 else None, k, [float(x) for x in v], int(draw.random() < 0.8)) for k, v in enumerate(q)], "e string, k int, p array<double>, on int")
    a, b = ({r.k: r.motion for r in windows.engaged_motion(rows, "p", "on", ["e"], ["k"], span=s).collect()} for s in (SPAN, 1000))
    assert len(a) == 50 and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def brute_nearest(asked, loaded):
    out = []
    for e, at, note in asked:
        near = sorted((abs(t - at), i) for f, t, i in loaded if f == e and t is not None) if at is not None else []
        out.append((e, at, note, near[0][1] if near else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("span", [5, 10**6])
def test_nearest_over_ranges(spark, span):
    draw = np.random.default_rng(4)
    loaded = [("a", int(t), int(i)) for i, t in enumerate(draw.integers(0, 200, 60))] + [("b", 5, 1), (None, 3, 9), ("a", None, 3)]
    asked = [("a", int(t), f"n{i}") for i, t in enumerate(draw.integers(-50, 900, 80))] + [("a", 100, f"m{i}") for i in range(40)] + [("b", 1, "x"), ("c", 1, "x"), (None, 8, "y"), ("a", None, "z")]
    left = spark.createDataFrame([(*r, {"m": 1}) for r in asked], "e string, ts int, note string, m map<string,int>")
    got = joins.nearest(left, spark.createDataFrame(loaded, "e string, ts int, frame int"), ["e"], span=span)
    assert got.columns == ["e", "ts", "note", "m", "frame"]
    assert sorted(((r.e, r.ts, r.note, r.frame) for r in got.collect()), key=str) == brute_nearest(asked, loaded)


def test_nearest_of_shuffled_wide_requests(spark):
    """Requests out of a join and a repartition, with a wide column that is read at the end."""
    n = 600_000
    base = spark.range(n).select("id", (F.col("id") % 97).alias("k"))
    wide = base.join(spark.range(n).select("id", F.repeat(F.sha1(F.col("id").cast("string")), 3).alias("text")).hint("shuffle_hash"), "id").repartition("k").select("k", (F.col("id") * 10).alias("ts"), "text", "id")
    loaded = spark.range(0, n, 3).select((F.col("id") % 97).alias("k"), (F.col("id") * 10).alias("ts"), F.col("id").alias("frame"))
    for span in (ranges.SPAN, 4000):
        got = joins.nearest(wide, loaded, ["k"], span=span)
        # rows of a key are 97 apart, every third of them is loaded: the nearest is the row itself or one beside it
        step = F.when(F.col("id") % 3 == 0, 0).otherwise(970)
        bad = F.abs(F.col("frame") * 10 - F.col("ts")) != step
        assert got.agg(F.count("*"), F.count_if(bad & (F.col("id") > 300) & (F.col("id") < n - 300)), F.count_distinct("text")).first() == (n, 0, n)


def test_one_episode_over_many_tasks(spark):
    n, span = 1_000_000, 50_000
    rows = spark.range(n).select(F.lit("e").alias("e"), (F.col("id") * 7919 % n).alias("k")).withColumn("on", (F.col("k") % 1000 == 0).cast("int")).withColumn("v", F.col("k").cast("double"))
    placed = ranges.halo(ranges.placed(rows, ["e"], ["k"], span), 2, 3, span)
    sizes = [r["count"] for r in placed.groupBy("e", ranges.RANGE).count().collect()]
    assert n // span <= len(sizes) <= n // span + 1 and max(sizes) <= span + 5
    got = windows.gather(rows, "v", [-2, 0, 3], ["e"], ["k"], span=span)
    right = (F.col("window")[0] == F.greatest(F.col("k") - 2, F.lit(0))) & (F.col("window")[1] == F.col("k")) & (F.col("window")[2] == F.least(F.col("k") + 3, F.lit(n - 1)))
    assert got.agg(F.count("*"), F.count_if(~right)).first() == (n, 0)
    held = windows.held(rows, "v", "on", ["e"], ["k"], span=span)
    assert held.agg(F.count("*"), F.count_if(F.col("held") != F.floor(F.col("k") / 1000) * 1000)).first() == (n, 0)
    dealt = ranges.dealt(rows, ["e"], ["k"], span)
    assert dealt.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 2 * span
    sums = ranges.scan(dealt, ["e"], ["k"], s=ranges.total(F.lit(1)))
    assert sums.agg(F.count_if(F.col("s") != F.col("k") + 1)).first()[0] == 0
