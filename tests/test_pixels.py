"""Pixels: decoding, transforms and distances against plain loops."""

import io
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.functions import pixels as px

DRAW = lambda k: (0.9, 0.2, 0.6, 0.75, 0.3, 0.8, 0.1, 0.5)[k]


def picture(h=9, w=12, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 3), dtype=np.uint8)


def test_decode_transform_and_compare(spark):
    videos = {name: np.stack([picture(seed=10 * n + k) for k in range(3)]) for n, name in enumerate("ab")}
    rows = []
    for name, v in videos.items():
        out = io.BytesIO()
        np.save(out, v)
        rows.append((name, bytearray(out.getvalue())))
    frames = px.decode(spark.createDataFrame(rows, "path string, content binary"), 10.0)
    got = {(r["path"], r["frame"]): r for r in frames.collect()}
    assert len(got) == 6 and got["b", 2]["ts"] == pytest.approx(0.2)
    assert np.array_equal(np.frombuffer(got["b", 2]["image"]["pixels"], np.uint8).reshape(9, 12, 3), videos["b"][2])
    steps = [px.Crop(0.5), px.Flip(1.0), px.Resize(2, 3, "nearest")]
    for training in (True, False):
        twice = [{(r["path"], r["frame"]): bytes(r["x"]["pixels"]) for r in frames.select("path", "frame", px.transform(F.col("image"), F.col("path"), steps, training).alias("x")).collect()} for _ in range(2)]
        assert twice[0] == twice[1] and all(len(x) == 18 for x in twice[0].values())
    middle = px.to_bytes(videos["a"][0][2:6, 3:9][[0, 2]][:, [0, 2, 4]])
    assert twice[0]["a", 0] == middle.tobytes()
    odd = spark.createDataFrame([(None,)], f"image {px.FRAME}")
    row = odd.select(px.transform(F.col("image"), F.lit("s"), steps, True).alias("x"), px.distance(F.col("image"), F.col("image")).alias("d")).first()
    assert row == (None, None)


def test_distance(spark):
    a, b = picture(seed=1), picture(seed=2)
    df = spark.createDataFrame([(px._pack(a), px._pack(b))], f"a {px.FRAME}, b {px.FRAME}")
    same, other = df.select(px.distance(F.col("a"), F.col("a")), px.distance(F.col("a"), F.col("b"))).first()
    assert same["l1"] == 0 and same["ssim"] == pytest.approx(1)
    x, y = a / 127.5 - 1, b / 127.5 - 1
    parts = []
    for i in range(9 - 6):
        for j in range(12 - 6):
            for c in range(3):
                p, q = x[i : i + 7, j : j + 7, c].ravel(), y[i : i + 7, j : j + 7, c].ravel()
                v = np.cov(p, q)
                parts.append((2 * p.mean() * q.mean() + 4e-4) * (2 * v[0, 1] + 3.6e-3) / ((p.mean() ** 2 + q.mean() ** 2 + 4e-4) * (v[0, 0] + v[1, 1] + 3.6e-3)))
    assert other["l1"] == pytest.approx(np.abs(x - y).mean()) and other["ssim"] == pytest.approx(np.mean(parts))
    assert math.isnan(px.similarity(x[:5], y[:5]))


@pytest.mark.parametrize("kind", px.INTERPOLATIONS)
def test_resize(kind):
    x = picture()
    assert np.array_equal(px.Resize(9, 12, kind)(x, DRAW, False), x)
    flat = np.full((8, 10, 3), 77, np.uint8)
    for size in ((3, 4), (16, 25)):
        for smooth in (True, False):
            assert (px.Resize(*size, kind, smooth)(flat, DRAW, False) == 77).all()


def test_resize_by_halves():
    line = px.resampling(4, 2, "linear", False) @ np.array([0.0, 10, 20, 30])
    assert np.allclose(line, [5, 25])
    assert np.allclose(px.resampling(2, 4, "linear") @ np.array([0.0, 8]), [0, 2, 6, 8])


def test_turns_flips_and_colours():
    x = picture(9, 9)
    for quarter in range(4):
        for kind in ("nearest", "linear"):
            assert np.array_equal(px.turn(x, 90 * quarter, kind), np.rot90(x, quarter))
    assert np.array_equal(px.Flip(1.0)(x, DRAW, True), x[:, ::-1]) and np.array_equal(px.Flip(0.5)(x, DRAW, True), x)
    assert (np.ptp(px.Grayscale(1.0)(x, DRAW, True), axis=2) == 0).all()
    assert np.array_equal(px.Posterize(3, 1.0)(x, DRAW, True), x // 32 * 32)
    assert np.array_equal(px.Jitter()(x, DRAW, True), x)
    assert np.array_equal(px.Jitter(brightness=0.5)(x, DRAW, True), px.to_bytes(np.clip(x * 1.4, 0, 255)))
    assert np.array_equal(px.to_bytes(px.turn_hue(x.astype(float), 1 / 3)), x[..., [2, 0, 1]])
    assert px.Jitter(0.1, 0.2, 0.3, 0.1)(x, DRAW, True).shape == x.shape


def video_file(n, seed=0):
    v = np.stack([picture(2, 3, seed + k) for k in range(n)])
    return v, bytearray(np_bytes(v))


def test_frames_at(spark):
    v, content = video_file(5)
    _, empty = video_file(5, 9)
    schema = "path string, content binary, wanted array<double>"
    times = [0.06, 0.05, -1.0, 9.0, 0.3]
    got = px.frames_at(spark.createDataFrame([("a", content, times), ("b", empty, []), ("c", empty, None)], schema), 10.0, "ts").collect()
    assert {(r["path"], r["nth"]): r["frame"] for r in got} == {("a", 0): 1, ("a", 1): 0, ("a", 2): 0, ("a", 3): 4, ("a", 4): 3}
    assert all(r["image"]["pixels"] == v[r["frame"]].tobytes() for r in got)
    by_index = lambda w: {r["nth"]: r["frame"] for r in px.frames_at(spark.createDataFrame([("a", content, w)], "path string, content binary, wanted array<int>"), 10.0).collect()}
    assert by_index([4, 0, 4]) == {0: 4, 1: 0, 2: 4}
    for bad in ([5], [-1], [None, 1]):
        with pytest.raises(Exception, match="a: "):
            by_index(bad)
    with pytest.raises(ValueError):
        px.frames_at(spark.createDataFrame([], schema), 10.0, "odd")


def test_decoding_stops_after_the_last_frame(spark):
    def once(content):
        for n in range(10):
            if n > 3:
                raise RuntimeError("decoded too far")
            yield np.full((1, 1, 3), n, np.uint8)

    got = px.frames_at(spark.createDataFrame([("a", bytearray(), [2.0, 2.5])], "path string, content binary, wanted array<double>"), 1.0, "ts", once)
    assert sorted(r["frame"] for r in got.collect()) == [2, 2]


def test_layouts(spark):
    x = picture(3, 4)
    df = spark.createDataFrame([(1, px._pack(x)), (2, None)], f"id int, image {px.FRAME}")
    planes, back = (r := df.orderBy("id").select(px.to_planes(F.col("image")).alias("p"), px.from_planes(px.to_planes(F.col("image"))).alias("b")).collect())[0]
    assert r[1] == (None, None)
    expected = np.moveaxis(x, 2, 0).astype(np.float32) / np.float32(255)
    assert np.array_equal(np.array(planes["values"], np.float32).reshape(3, 3, 4), expected)
    assert np.frombuffer(back["pixels"], np.uint8).tolist() == np.moveaxis((expected * np.float32(255)).astype(np.uint8), 0, 2).ravel().tolist()
    v = np.stack([picture(2, 3, k) for k in range(4)])
    rows = spark.createDataFrame([("a", k, px._pack(v[k])) for k in (2, 0, 3, 1)], f"who string, k int, image {px.FRAME}")
    clip = px.clips(rows, ["who"], "k").first()["clip"]
    assert (clip["channels"], clip["frames"], clip["height"], clip["width"]) == (3, 4, 2, 3) and clip["values"] == np.moveaxis(v, 3, 0).tobytes()
    with pytest.raises(Exception, match="one size"):
        px.clips(rows.union(spark.createDataFrame([("a", 9, px._pack(x))], rows.schema)), ["who"], "k").collect()


def test_views_share_their_numbers(spark):
    x = px._pack(picture(8, 8))
    df = spark.createDataFrame([(n, x, x) for n in range(6)], f"id int, `video.a` {px.FRAME}, `video.b` {px.FRAME}")
    done = px.transform_views(df, ["video.a", "video.b"], "id", [px.Crop(0.5), px.Flip(0.5), px.Jitter(0.3, 0.3, 0.3, 0.1)], True).collect()
    assert all(r["video.a"] == r["video.b"] for r in done) and len({bytes(r["video.a"]["pixels"]) for r in done}) > 1
    with pytest.raises(KeyError):
        px.transform_views(df, ["video.c"], "id", [], True)


def test_jitter_draws_its_order():
    x = picture().astype(float)
    draw = lambda first: lambda k: (0.9, 0.2, 0.6, 0.75)[k] if k < 4 else abs(k - 4 - first)
    step = px.Jitter(0.5, 0.5)
    bright, contrast = (lambda v: np.clip(v * 1.4, 0, 255)), (lambda v: np.clip(0.7 * v + 0.3 * px.gray(v).mean(), 0, 255))
    assert np.array_equal(step(x.astype(np.uint8), draw(0), True), px.to_bytes(contrast(bright(x))))
    assert np.array_equal(step(x.astype(np.uint8), draw(1), True), px.to_bytes(bright(contrast(x))))
    assert np.array_equal(px.Jitter(brightness=(0.5, 1.5))(x.astype(np.uint8), draw(0), True), px.to_bytes(np.clip(x * 1.4, 0, 255)))


def test_refusals():
    for make in (lambda: px.Resize(1, 1, "odd"), lambda: px.Rotate(5, "cubic"), lambda: list(px.numpy_frames(np_bytes(np.zeros((2, 2)))))):
        with pytest.raises(ValueError):
            make()


def np_bytes(x):
    out = io.BytesIO()
    np.save(out, x)
    return out.getvalue()
