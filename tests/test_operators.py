"""Trajectory operators: every query against its SQL on the smallest tables, and hand-made edge cases."""

import datetime
import decimal
import json
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinelake.functions import numeric, rotation, text
from kinelake.operators import joins, stats, steps, timestamps, transforms, windows
from kinelake.plans import catalogue
from kinelake.sources import leaves, shared, slices
from kinelake.streaming import watch

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else float(f"{float(v):.9g}") + 0.0
    return str(v) if isinstance(v, (datetime.datetime, bool)) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=str)
    assert got
    if name in catalogue.ORACLES:
        out = duck.execute(catalogue.ORACLES[name])
        names = [x[0] for x in out.description]
        assert sorted(names) == cols
        assert got == sorted(([plain(row[names.index(c)]) for c in cols] for row in out.fetchall()), key=str)


def test_whole_queries_reach_every_row(spark):
    q = catalogue.QUERIES
    rows, users = (catalogue.t(spark, SF, "events").select(*c).distinct().count() for c in (["event_id"], ["user_id"]))
    lengths = [r["count"] for r in catalogue.t(spark, SF, "events").groupBy("user_id").count().collect()]
    assert sum(r.n for r in q["fixed_chunks"](spark, SF).collect()) == sum(-(-n // 8) * 8 for n in lengths)
    assert q["stitch_chunks"](spark, SF).count() == rows - sum(-(-n // 9) for n in lengths)
    assert q["chunk_handoff"](spark, SF).count() == sum(-(-n // 9) for n in lengths)
    assert sum(r.num_frames for r in q["fds_per_clip"](spark, SF).collect()) == rows - users
    assert q["fds_summary"](spark, SF).first().num_clips == users and q["cache_key_md5"](spark, SF).count() == users
    assert q["mixture_index_lookup"](spark, SF).count() == q["mixture_factors"](spark, SF).agg({"hi": "max"}).first()[0]


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(v for v, _ in values.values())], ", ".join(f"{k} {t}" for k, (_, t) in values.items()))
    return row.select(column.alias("x")).first()["x"]


# steps


def test_empty_and_single_episodes(spark):
    e = spark.createDataFrame([(0, 0), (1, 1), (2, 3)], "episode long, length long")
    assert sorted(map(tuple, steps.enumerate_steps(e).collect())) == [(1, 0), (2, 0), (2, 1), (2, 2)]
    assert steps.validate_episodes(e, "episode", 3, 4).first().asDict() == {"episodes": 3, "frames": 4, "contiguous": True, "episodes_match": True, "frames_match": True}
    gap = spark.createDataFrame([(0, 1), (2, 1)], "episode long, length long")
    assert not steps.validate_episodes(gap, "episode").first()["contiguous"]


@pytest.mark.parametrize(("spec", "want"), [("0:3", [0, 1, 2, 3]), ("0-3", [0, 1, 2, 3]), ("3", [3]), (" 0:1, 5:6 6", [0, 1, 5, 6]), ("", [])])
def test_ranges(spark, spec, want):
    assert one(spark, steps.parse_ranges(F.col("s")), s=(spec, "string")) == want


@pytest.mark.parametrize("spec", ["5:2", "a", "1:2:3"])
def test_bad_ranges(spark, spec):
    with pytest.raises(PySparkException):
        one(spark, steps.parse_ranges(F.col("s")), s=(spec, "string"))


def test_splits_and_samples(spark):
    p = spark.range(101).withColumnRenamed("id", "pos")
    assert steps.trailing_split(p, "test", 0.05).count() == 5 and steps.trailing_split(p, "train", 0.001).count() == 100
    with pytest.raises(ValueError):
        steps.trailing_split(p, "test", 1.0)
    assert steps.stride_sample(p, 60).count() == 101  # the stride is a floor, so more than asked may stay
    assert steps.number(p.orderBy(F.desc("pos")), ["pos"], "k").where("k <> pos").count() == 0


def test_numbers_of_many_rows(spark):
    """Partitions that are sampled, with a column that only one side of the plan reads."""
    many = spark.range(1_000_000).select((F.col("id") * 7919 % 1_000_003).alias("a"), F.hash("id").alias("b"), F.repeat(F.lit("x"), 20).alias("extra"))
    got = steps.number(many, ["a", "b"])
    ordered = got.withColumn("before", F.lag("a").over(W.partitionBy(F.floor(F.col("pos") / 50_000)).orderBy("pos")))
    r = ordered.agg(F.count_distinct("pos").alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count_if(F.col("before") > F.col("a")).alias("wrong"), F.max("extra").alias("x")).first()
    assert (r.n, r.lo, r.hi, r.wrong) == (1_000_000, 0, 999_999, 0)


def test_nearest_of_one_hot_key(spark):
    rows = spark.range(400_000).select(F.lit(1).alias("k"), F.col("id").alias("ts"), F.col("id").alias("frame"))
    got = joins.nearest(rows.where("frame % 4 = 1").select("k", "ts"), rows.where("frame % 4 = 3"), ["k"])
    assert got.where("frame <> greatest(ts - 2, 3)").count() == 0 and got.count() == 100_000


# windows


def test_gather_edges_and_nulls(spark):
    f = spark.createDataFrame([(1, i, v) for i, v in enumerate([1.0, None, 3.0])] + [(2, 0, 9.0)], "e long, frame long, value double")
    got = {fill: {(r.e, r.frame): r.window for r in windows.gather(f, "value", [-5, -1, 0, 1, 5], ["e"], ["frame"], fill).collect()} for fill in windows.FILLS}
    assert got["edge"][1, 0] == [1.0, 1.0, 1.0, None, 3.0] and got["edge"][1, 2] == [1.0, None, 3.0, 3.0, 3.0] and got["edge"][2, 0] == [9.0] * 5
    assert got["zero"][1, 0] == [0.0, 0.0, 1.0, None, 0.0] and got["clamp"] == got["edge"]


def test_rules_in_order(spark):
    rows = [("left", i, 1.0, 0.0, i // 2, 0) for i in range(4)] + [("right", i, 1.0, 0.0, 0, i // 2) for i in range(4)] + [("both", i, 1.0, 0.0, i // 2, i // 2) for i in range(4)] + [("off", i, 0.0, 0.0, 0, 0) for i in range(4)] + [("once", i, float(i == 2), 0.0, 0, 0) for i in range(4)]
    f = spark.createDataFrame(rows, "e string, frame long, l double, r double, al long, ar long")
    ruled = windows.horizon_filter(f, 2, ["e"], ["frame"], ("l", "r"), ("al", "ar"))
    assert {r.e: r.rule for r in ruled.where("frame = 1").collect()} == {"left": "left_swap", "right": "right_swap", "both": "left_swap", "off": "never_engaged", "once": None}
    c = windows.filter_counts(ruled, ["e"]).first()
    assert (c.out_of_bounds, c.left_swap, c.right_swap, c.never_engaged, c.valid, c.fully_filtered, c.unfiltered) == (10, 4, 2, 2, 2, 4, 1)


def test_hold(spark):
    f = spark.createDataFrame([(1, i, v, e) for i, (v, e) in enumerate([(1.0, 0), (2.0, 0), (None, 1), (4.0, 0), (5.0, 1)])], "e long, frame long, value double, on int")
    assert [r.held for r in windows.held(f, "value", "on", ["e"], ["frame"]).orderBy("frame").collect()] == [1.0, 1.0, None, None, 5.0]
    with pytest.raises(PySparkException):
        windows.chunks(f, 3, "value", ["e"], "frame").collect()


# joins


def test_nearest_ties(spark):
    loaded = spark.createDataFrame([(1, 0.0, 5), (1, 2.0, 6), (1, 2.0, 4), (1, 4.0, 7)], "e long, ts double, frame long")
    asked = spark.createDataFrame([(1, t) for t in (-9.0, 1.0, 3.0, 2.0, 99.0)] + [(2, 0.0), (1, None)], "e long, ts double")
    got = {(r.e, r.ts): r.frame for r in joins.nearest(asked, loaded, ["e"]).collect()}
    assert got == {(1, -9.0): 5, (1, 1.0): 4, (1, 3.0): 4, (1, 2.0): 4, (1, 99.0): 7, (2, 0.0): None, (1, None): None}


def test_failing_lookups(spark):
    rows = spark.createDataFrame([(1,), (2,)], "k long")
    table = spark.createDataFrame([(1, "a"), (1, "b")], "k long, v string")
    for bad in (joins.task_lookup(rows, table.limit(1), "k", "v"), joins.unique_lookup(rows, table, "k")):
        with pytest.raises(PySparkException):
            bad.collect()
    with pytest.raises(ValueError):
        stats.expect_unique(table, "k")
    assert stats.expect_unique(rows, "k", 2).count() == 2


# statistics, mixtures, metrics


def test_statistics(spark):
    rows = spark.createDataFrame([([1.0, 5.0, 1e-9],), ([2.0, 5.0, 0.0],)], "v array<double>")
    got = {r.dim: r for r in stats.column_statistics(rows, "v", single=False, floor_std=1e-6).collect()}
    assert (got[0].q01, got[0].std, got[1].std, got[2].std) == (pytest.approx(1.01), 0.5, 1.0, 1.0)
    kept = one(spark, stats.statistic_keys(F.col("m")), m=({"a": "{}", "_provenance": "{}", "stride": "6", "n": None}, "map<string,string>"))
    assert kept == {"a": "{}"}
    lengths = {"action": {"count": [7]}, "x": {"count": []}}
    assert one(spark, steps.preferred_length(F.col("m"), ["x", "action"]), m=(lengths, "map<string,struct<count:array<int>>>")) == 7


def test_normalisers_at_their_edges(spark):
    s = {"mean": [0.0, 1.0], "std": [0.0, 2.0], "min": [3.0, -4.0], "max": [3.0, 2.0], "q01": [3.0, 0.0], "q99": [3.0, 1.0]}
    values = {"x": ([0.5, 5.0], "array<double>"), **{k: (v, "array<double>") for k, v in s.items()}}
    got = {m: one(spark, numeric.normalise(F.col("x"), m, {k: F.col(k) for k in s}), **values) for m in numeric.MODES}
    assert got == {"q99": [0.5, 1.0], "mean_std": [0.5, 2.0], "min_max": [0.0, 2.0], "scale": [0.5 / 3, 1.25], "binary": [0.0, 1.0]}
    for f in (numeric.normalise, numeric.denormalise):
        with pytest.raises(ValueError):
            f(F.col("x"), "other", {})
    with pytest.raises(PySparkException):
        one(spark, numeric.pad(F.col("x"), 1), **values)
    with pytest.raises(PySparkException):
        one(spark, numeric.concat_keys({"a": F.col("x")}, {"a": 3}), **values)


def test_repeats_round_half_to_even(spark):
    m = spark.createDataFrame([("a", 8, 1.0), ("b", 8, 2.5), ("c", 8, 3.5), ("d", 0, 1.0), ("e", 5, 0.0)], "leaf string, real_len long, mix_ratio double")
    assert [r.repeat for r in stats.mixture(m, ["leaf"]).orderBy("leaf").collect()] == [1, 2, 4, 8, 1]
    placed = stats.real_index(joins.locate(spark.range(80).withColumnRenamed("id", "idx"), stats.mixture(m, ["leaf"])))
    assert placed.count() == 61 and placed.where("leaf = 'b'").agg(F.max("real"), F.max("local")).first() == (7, 15)
    assert stats.shuffle_blocks(stats.mixture(m, ["leaf"]), 16).agg(F.max(F.col("block_end") - F.col("block_start"))).first()[0] == 16


def test_clip_metrics(spark):
    f = spark.createDataFrame([("a", 0, 9.0), ("a", 1, 1.0), ("a", 2, 3.0), ("b", 0, 1.0), ("b", 1, float("nan"))], "clip string, frame long, l1 double").withColumn("ssim", F.lit(0.5))
    clips = stats.clip_metrics(f, "clip", "frame", "l1", "ssim")
    a = clips.where("clip = 'a'").first()
    assert (a.num_frames, a.mean_l1, a.std_l1, a.l1_slope, a.early_c1_l1, a.mid_c2c3_l1) == (2, 2.0, 1.0, 2.0, 2.0, None)
    total = stats.run_summary(clips).first()
    assert (total.num_clips, total.mean_l1, total.mid_c2c3_l1) == (2, 2.0, None)
    assert clips.where("clip = 'b'").first().l1_slope is None
    alone = spark.createDataFrame([("c", 0, 9.0, 0.5), ("d", 0, 9.0, 0.5), ("d", 1, 2.0, 0.25)], "clip string, frame long, l1 double, ssim double")
    c, d = stats.clip_metrics(alone, "clip", "frame", "l1", "ssim").orderBy("clip").collect()
    assert (c.num_frames, c.mean_l1, c.l1_slope) == (0, None, None) and (d.num_frames, d.l1_slope, d.early_c1_ssim, d.mid_c2c3_ssim) == (1, None, 0.25, None)
    empty = stats.norms(spark.createDataFrame([(1, None)], "k int, v double"), "v", ["k"]).first()
    assert (empty.l2, empty.max_abs) == (0.0, 0.0)


def test_groups_of_rows_together_are_whole(spark):
    """Two inputs dealt by one key, of very different sizes: adaptive execution merges their partitions unequally."""
    many = spark.range(60_000).select((F.col("id") % 50).alias("k"), F.col("id").alias("v")).groupBy("k", "v").count().groupBy("k").agg(F.max("v").alias("v"))
    few = spark.range(50).withColumnRenamed("id", "k").groupBy("k").agg(F.lit(1).cast("long").alias("v")).where("k < 40")
    got = shared.together(many, few).groupBy("k").count().collect()
    assert sorted((r["k"], r["count"]) for r in got) == [(k, 1 + (k < 40)) for k in range(50)]
    assert spark.conf.get("spark.sql.unionOutputPartitioning") == "false"


def test_broken_timestamps(spark):
    n = 30
    clocks = {"good": [i / 30 for i in range(n)], "epoch": [2e6 + i / 30 for i in range(n)], "equal": [0.0] * n, "coarse": [(i // 3) / 10 for i in range(n)], "sparse": [float(i) for i in range(n)]}
    f = spark.createDataFrame([(k, i, x) for k, v in clocks.items() for i, x in enumerate(v)], "e string, frame long, ts double")
    assert {r.e: r.broken for r in timestamps.broken(f, ["e"], "ts", 30.0).collect()} == {"good": False, "epoch": True, "equal": True, "coarse": True, "sparse": True}


# rotations


def matrix(q):
    x, y, z, w = np.array(q) / np.linalg.norm(q)
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])


def axis(a, t):
    a = np.array(a) / np.linalg.norm(a)
    k = np.array([[0, -a[2], a[1]], [a[2], 0, -a[0]], [-a[1], a[0], 0]])
    return np.eye(3) + np.sin(t) * k + (1 - np.cos(t)) * k @ k


def test_rotations(spark):
    rng = np.random.default_rng(0)
    p, r = rng.normal(size=7), rng.normal(size=7)
    pose = {"p": (p.tolist(), "array<double>"), "r": (r.tolist(), "array<double>")}
    a, b = matrix(p[3:]), matrix(r[3:])
    rel = b.T @ a
    got = one(spark, rotation.relative_pose(F.col("p"), F.col("r")), **pose)
    assert np.allclose(got, [*(p[:3] - r[:3]), *rel[:, 0], *rel[:, 1]])
    swapped = {k: (v[:3] + [v[6]] + v[3:6], t) for k, (v, t) in pose.items()}
    assert np.allclose(one(spark, rotation.relative_pose(F.col("p"), F.col("r"), order="wxyz"), **swapped), got)
    still = one(spark, rotation.relative_pose(F.col("p"), F.col("r")), p=([1.0, 2.0, 3.0] + [0.0] * 4, "array<double>"), r=pose["r"])
    assert still == [0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    at_rest = one(spark, rotation.relative_pose(F.col("p"), F.col("r")), p=pose["p"], r=([0.0] * 7, "array<double>"))
    assert np.allclose(at_rest, [*p[:3], *a[:, 0], *a[:, 1]])
    for by, six in (("column", [*a[:, 0], *a[:, 1]]), ("row", [*a[0], *a[1]])):
        m = {"m": (a.ravel().tolist(), "array<double>"), "s": ((3 * np.array(six)).tolist(), "array<double>")}
        assert np.allclose(one(spark, rotation.to_six(F.col("m"), by), **m), six)
        assert np.allclose(one(spark, rotation.from_six(F.col("s"), by), **m), a.ravel())
    e = [0.3, -1.1, 2.0]
    want = axis([0, 0, 1], e[2]) @ axis([0, 1, 0], e[1]) @ axis([1, 0, 0], e[0])
    assert np.allclose(one(spark, rotation.from_euler(F.col("e")), e=(e, "array<double>")), want.ravel())
    run = one(spark, rotation.product(F.col("ms")), ms=([a.ravel().tolist(), b.ravel().tolist(), rel.ravel().tolist()], "array<array<double>>"))
    assert np.allclose(run, [a.ravel(), (a @ b).ravel(), (a @ b @ rel).ravel()])


@pytest.mark.parametrize(("a", "t"), [((1, 0, 0), 0.0), ((1, 2, 3), 1.2), ((0, 1, 0), np.pi), ((0, 1, -1), np.pi), ((1, -1, 0), np.pi), ((0, 0, 1), 1e-4)])
def test_angle_scaling(spark, a, t):
    got = np.array(one(spark, rotation.scale_angle(F.col("m"), 0.5), m=(axis(a, t).ravel().tolist(), "array<double>"))).reshape(3, 3)
    assert np.allclose(got, axis(a, t / 2), atol=1e-6) or (t == np.pi and np.allclose(got, axis(a, -t / 2), atol=1e-6))


# text


def test_tolerant_and_strict_parsing(spark):
    strict = lambda s: one(spark, text.parse_boxes(F.col("s")), s=(s, "string"))
    assert [x.box for x in strict('x ```json\n[{"bbox_2d": [1,2,3,4], "label": "a"}, {"box": [5,6,7,8]}]\n```')] == [[1, 2, 3, 4], [5, 6, 7, 8]]
    assert strict('{"bbox": [1,2,3,4]}')[0].box == [1, 2, 3, 4]
    with pytest.raises(PySparkException):
        strict("nothing")
    loose = lambda s: one(spark, text.parse_boxes_tolerant(F.col("s"), F.lit(2000), F.lit(1000)), s=(s, "string"))
    assert loose("nothing") is None and loose("[broken") is None and loose('[{"label": "no box"}]') == []
    assert loose('[1]</think>[{"bbox_2d": [500,500,1000,0]}]')[0].box == [1000.0, 500.0, 2000.0, 0.0]
    seconds = lambda s: one(spark, text.seconds(F.col("s")), s=(s, "string"))
    assert (seconds("3.5"), seconds("01:02.25"), seconds("1:00:00"), seconds("x")) == (3.5, 62.25, 3600.0, None)
    assert one(spark, text.caption(F.col("s")), s=("a: b : c d ", "string")) == "c d"
    with pytest.raises(ValueError):
        text.statistics_file(F.col("s"), None, "x")
    with pytest.raises(ValueError):
        text.generation_payload(F.col("s"), F.col("s"), "720", "4:3")


# sources and streams


def test_leaves(spark, tmp_path):
    for leaf in ("a", "b"):
        meta = tmp_path / leaf / "meta"
        meta.mkdir(parents=True)
        (meta / "episodes.jsonl").write_text('{"episode_index": 0, "tasks": ["t"], "length": 2}\n\n{"episode_index": 1, "tasks": [], "length": 1}\n')
        (meta / "tasks.jsonl").write_text('{"task_index": 0, "task": "do"}\n')
        (meta / "info.json").write_text(json.dumps({"fps": 30, "total_episodes": 2, "features": {"s": {"dtype": "float32", "shape": [2], "names": "n" * 99}}}, indent=1))
        (meta / "modality.json").write_text(json.dumps({"state": {"arm": {"start": 0, "end": 2}}, "action": {"arm": {"start": 0, "end": 1, "absolute": False}}}))
        for i, n in ((0, 2), (1, 1)):
            spark.createDataFrame([([float(k), 0.0], k) for k in range(n)], "`observation.state` array<float>, frame_index long").coalesce(1).write.parquet(f"{tmp_path}/tmp{leaf}{i}")
            folder = tmp_path / leaf / "data" / "chunk-000"
            folder.mkdir(parents=True, exist_ok=True)
            next((tmp_path / f"tmp{leaf}{i}").glob("part*.parquet")).rename(folder / f"episode_{i:06d}.parquet")
    root = f"file://{tmp_path}"
    found = leaves.discover(spark, f"{root}/a") + [x.rsplit("/", 1)[1] for x in leaves.discover(spark, root)]
    assert found == [f"{root}/a", "a", "b"]
    leaf = f"{root}/a"
    assert leaves.episodes(spark, leaf).count() == 2 and leaves.tasks(spark, leaf).first()["task"] == "do"
    assert sorted((r.frame_index, r.episode) for r in leaves.frames(spark, leaf, ["frame_index"]).collect()) == [(0, 0), (0, 1), (1, 0)]
    assert leaves.feature_summary(leaves.info(spark, leaf)).first()["names"] is None
    assert {(r.key, r.width, r.absolute) for r in leaves.modality_entries(leaves.modality(spark, leaf)).collect()} == {("state.arm", 2, True), ("action.arm", 1, False)}
    assert leaves.first_file(spark, leaf, 5).count() == 2
    with pytest.raises(FileNotFoundError):
        leaves.modality(spark, leaf, "other.json")
    out = f"{root}/out"
    leaves.write_episodes(leaves.episodes(spark, leaf), out)
    assert leaves.json_lines(spark, out, leaves.EPISODES).count() == 2
    with pytest.raises(ValueError):
        leaves.write_episodes(leaves.episodes(spark, leaf).where("episode_index = 1"), f"{root}/out2")
    numbers = spark.createDataFrame([(1.0,)], "mean double")
    leaves.write_statistics(numbers, f"{root}/stats", {"experiment_id": "x"})
    with pytest.raises(FileExistsError):
        leaves.write_statistics(numbers, f"{root}/stats", {"experiment_id": "y"})
    leaves.write_statistics(numbers, f"{root}/stats", {"experiment_id": "y"}, force=True)
    assert spark.read.parquet(f"{root}/stats").first()["experiment_id"] == "y"


def test_stream_handles_each_once(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    handle = lambda batch, n: seen.extend(r.iteration for r in batch.collect())
    for k, names in enumerate((["iter_000001000", "iter_000001500", "latest"], ["iter_000001000", "iter_000002000"])):
        (folder / f"{k}.json").write_text("".join(json.dumps({"name": n, "complete": True}) + "\n" for n in names) + '{"name": "iter_000003000", "complete": false}\n')
        watch.watch(watch.events(spark, f"file://{folder}"), handle, f"file://{tmp_path}/state", stride=1000).awaitTermination()
    assert seen == [1000, 2000]
    assert watch.parse_iterations("4:10:2, 3 4") == [3, 4, 6, 8, 10]
    p = watch.Progress(1)
    assert [p.go_on(*x) for x in (("FAILED", 1), ("FAILED", 1), ("TIMEOUT", 1), ("FAILED", 1), ("FAILED", 1))] == [True, True, True, True, False]


# transforms


def turned(rng, n):
    q = rng.normal(size=(n, 4))
    return q / np.linalg.norm(q, axis=1, keepdims=True)


SAMPLE = "`action.left_pose` array<array<double>>, `state.left_pose` array<array<double>>, `state.hapticengaged_left` array<array<double>>"


@pytest.mark.parametrize("flags", [[1, 1, 1, 1], [0, 1, 1, 0], [1, 0, 1, 1], [0, 0, 0, 0], [1], [0]])
def test_clutch_poses_against_a_loop(spark, flags):
    rng = np.random.default_rng(len(flags) + sum(flags))
    q, xyz = turned(rng, 5), rng.normal(size=(5, 3))
    rows = [[*map(float, [*p, *r])] for p, r in zip(xyz, q, strict=True)]
    df = spark.createDataFrame([(rows[1:], rows[:1], [[float(f)] for f in flags])], SAMPLE)
    got = np.array(transforms.ClutchRelative({"action.left_pose": "state.left_pose"}, kind="quaternion").apply(df).first()["action.left_pose"])
    on, at, turn = flags * 4 if len(flags) == 1 else flags, np.zeros(3), np.eye(3)
    for t in range(4):
        if on[t] and on[max(t - 1, 0)]:
            at, turn = at + xyz[t + 1] - xyz[t], turn @ matrix(q[t]).T @ matrix(q[t + 1])
        assert np.allclose(got[t], [*at, *turn[:, 0], *turn[:, 1]], atol=1e-9)


def test_clutch_scales_drops_and_passes_over(spark):
    df = spark.createDataFrame([([[2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]], [[1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]], [[1.0]])], SAMPLE).withColumn("state.scale", F.array(F.array(F.lit(3.0))))
    step = transforms.ClutchRelative({"action.left_pose": "state.left_pose", "action.none": "state.none"}, kind="quaternion", translation="state.scale", drop=["state.scale", "state.other"])
    out = step.apply(df)
    assert "state.scale" not in out.columns
    assert np.allclose(out.first()["action.left_pose"][0], [3, 0, 0, 1, 0, 0, 0, 1, 0])
    with pytest.raises(KeyError, match="missing"):
        step.apply(df.drop("state.left_pose"))


@pytest.mark.parametrize("target", ["rot6d", "rot6d_rows", "quaternion"])
def test_state_action_there_and_back(spark, target):
    q = turned(np.random.default_rng(5), 6)
    q *= np.sign(q[np.arange(6), np.abs(q).argmax(1)])[:, None]
    df = spark.createDataFrame([([[*map(float, r)] for r in q],), ([],), (None,)], "`state.r` array<array<double>>")
    step = transforms.StateAction(["state.r", "state.absent"], {"state.r": "min_max"}, None if target != "quaternion" else {"state.r": {"min": [-1] * 4, "max": [1] * 4}}, {"state.r": target}, {"state.r": transforms.KeyInfo(rotation="quaternion")})
    there = step.apply(df)
    assert len(there.first()["state.r"][0]) == transforms.ROTATION_BOUNDS[target][1]
    back = [r["state.r"] for r in step.unapply(there).collect()]
    assert np.allclose(back[0], q, atol=1e-9) and back[1:] == [[], None]


def test_euler_and_quaternion_of_a_matrix(spark):
    for e in ([0.3, -0.7, 2.9], [3.1, 1.2, -2.0], [0.0, 0.0, 0.0]):
        assert np.allclose(one(spark, rotation.to_euler(rotation.from_euler(F.col("e"))), e=(e, "array<double>")), e)
    for q in ([1.0, 0, 0, 0], [0.0, 1, 0, 0], [0.0, 0, 1, 0], [0.0, 0, 0, 1], [0.6, 0.8, 0, 0]):
        assert np.allclose(one(spark, rotation.to_quaternion(rotation.from_quaternion(F.col("q"))), q=([*map(float, q)], "array<double>")), q)


def test_state_action_refuses():
    info = {"state.r": transforms.KeyInfo(rotation="quaternion"), "state.rel": transforms.KeyInfo(absolute=False, rotation="quaternion"), "state.b": transforms.KeyInfo(continuous=False)}
    for keys, modes, given, turns in (
        (["bare"], {}, {}, {}), (["state.x"], {"state.x": "odd"}, {}, {}), (["state.x"], {"state.x": "q99"}, {"state.x": {"q01": [0]}}, {}),
        (["state.x"], {"state.x": "q99"}, {"state.x": {"q01": [0], "q99": [1, 2]}}, {}), (["state.r"], {"state.r": "q99"}, {}, {"state.r": "rot6d"}),
        (["state.rel"], {"state.rel": "min_max"}, {}, {"state.rel": "rot6d"}), (["state.b"], {"state.b": "min_max"}, {}, {}), (["state.x"], {}, {}, {"state.x": "rot6d"}),
    ):
        with pytest.raises(ValueError):
            transforms.StateAction(keys, modes, given, turns, info)
    for bad in ({"rep": "odd"}, {"rep": "relative"}):
        with pytest.raises(ValueError):
            transforms.KeyRule(**bad)


def test_chain_names_the_place_and_switches(spark):
    df = spark.createDataFrame([(1, [[1.0, 2.0]], [[3.0]])], "id long, `action.a` array<array<double>>, `action.b` array<array<double>>")
    drop, join = transforms.Dropout(["action.a"], 1.0, "id"), transforms.Concat("action", {"action.a": 2, "action.b": 1})
    chain = transforms.Chain(drop, transforms.SinCos(["action.absent"]), join)
    assert chain.apply(df).first()["action"] == [[0.0, 0.0, 3.0]]
    chain.evaluate()
    there = chain.apply(df)
    assert there.first()["action"] == [[1.0, 2.0, 3.0]]
    back = chain.unapply(there).first()
    assert (back["action.a"], back["action.b"]) == ([[1.0, 2.0]], [[3.0]])
    with pytest.raises(ValueError, match="transform 2"):
        chain.apply(df.drop("action.b"))
    with pytest.raises(PySparkException, match="not 3 wide"):
        transforms.Concat("action", {"action.a": 3, "action.b": 1}).apply(df).collect()


def test_slices(spark):
    assert [sum(s[0] == k for s in slices.SLICES) for k in ("state", "action")] == [18, 30]
    made = json.loads(slices.modality_json({"action": 100, "observation.state": 100}))
    assert made["action"]["left_pose"] == {"start": 0, "end": 7} and made["state"]["left_pose"]["original_key"] == "action"
    with pytest.raises(ValueError, match="observation.state"):
        slices.modality_json({"action": 100, "observation.state": 20})
    assert slices.modality_json({}, force=True)
    df = spark.range(1).select(*[F.transform(F.sequence(F.lit(0), F.lit(99)), lambda x: x.cast("double")).alias(c) for c in ("action", "observation.state")])
    row = df.select(*[c.alias(k) for k, c in slices.columns("action").items()]).first()
    assert len(row) == 30 and row["action.right_pose"] == [13.0, 14, 15, 16, 17, 18, 19] and row["action.cond_arm_3_color"] == [5.0]


def test_cached_steps(spark, tmp_path):
    leaves.write_filter_cache(spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "leaf string, base long"), str(tmp_path / "cache"))
    assert {r["leaf"]: r["steps"] for r in leaves.cached_steps(spark, str(tmp_path / "cache")).collect()} == {"a": 2, "b": 1}


def test_sets_specs_and_types(spark, tmp_path):
    df = spark.createDataFrame([(["a", "b", "a"], ["b", "a"]), (["a"], ["a", "b"]), ([], []), (None, ["a"])], "x array<string>, y array<string>")
    assert [r[0] for r in df.select(joins.same_set(F.col("x"), F.col("y"))).collect()] == [True, False, True, None]
    tags = joins.all_tags(spark.createDataFrame([("a",), (None,), ("a",)], "tag string"), spark.createDataFrame([("b",), ("a",)], "tag string"), "tag")
    assert sorted(r["tag"] for r in tags.collect()) == ["a", "b"]
    (tmp_path / "edge.json").write_text('{"name": "x",\n "strength": 0.5}')
    assert leaves.read_spec(spark, str(tmp_path), "edge", ("edge", "depth")).first().asDict() == {"name": "x", "strength": 0.5}
    with pytest.raises(FileNotFoundError):
        leaves.read_spec(spark, str(tmp_path), "depth", ("edge", "depth"))
    with pytest.raises(ValueError):
        leaves.read_spec(spark, str(tmp_path), "odd", ("edge", "depth"))
    rows = spark.createDataFrame([([[1.9, -1.9]], [[0.0]])], "`action.a` array<array<double>>, `action.b` array<array<double>>")
    assert transforms.Cast({"action.a": "int"}).apply(rows).first()["action.a"] == [[1, -1]]
    named = transforms.Rename({"action.a": "action.c"})
    assert named.apply(rows).columns == ["action.c", "action.b"] and named.unapply(named.apply(rows)).columns == rows.columns
    for wrong in (lambda: transforms.Cast({"action.z": "int"}).apply(rows), lambda: transforms.Rename({"action.z": "x"}).apply(rows)):
        with pytest.raises(KeyError):
            wrong()
    with pytest.raises(ValueError, match="repeat"):
        transforms.Rename({"action.a": "action.b"}).apply(rows)
    with pytest.raises(ValueError, match="action.b"):
        transforms.Concat("action", {"action.a": 2}, exact=True).apply(rows)
