"""Pixels: decoding by a given decoder, transforms of frames, and the distance of two frames.

A frame is a struct of height, width and pixels (three bytes each, row by row). All transforms of a chain run in one Arrow
pass over the frames. Random choices depend on the sample's id and a seed only, so all frames of a sample change alike and
reruns agree; they act in training only. A null frame stays null.
"""

from __future__ import annotations

import io
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.steps import positions_by_episode

FRAME = "struct<height: int, width: int, pixels: binary>"
_FRAME = pa.struct([("height", pa.int32()), ("width", pa.int32()), ("pixels", pa.binary())])
INTERPOLATIONS = ("nearest", "linear", "cubic", "lanczos")
#: Shares of red, green and blue in the brightness of a pixel (ITU-R BT.601).
LUMA = (0.299, 0.587, 0.114)
WINDOW, K1, K2 = 7, 0.01, 0.03


# decoding


def numpy_frames(content: bytes) -> Iterator[np.ndarray]:
    """The frames of a file that numpy wrote: bytes, frame by height by width by 3."""
    video = np.load(io.BytesIO(content), allow_pickle=False)
    if video.dtype != np.uint8 or video.ndim != 4 or video.shape[3] != 3:
        raise ValueError(f"not a video: {video.dtype} {video.shape}")
    yield from video


def decode(files: DataFrame, fps: float, decoder: Callable[[bytes], Iterable[np.ndarray]] = numpy_frames) -> DataFrame:
    """path, frame, ts and image of every frame of files (path, content). Frames leave one by one, so that a task holds a
    file and a frame; files that the decoder cannot read are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path"), b.column("content"), strict=True):
                for n, x in enumerate(decoder(content.as_py())):
                    yield pa.RecordBatch.from_arrays([pa.array([path.as_py()]), pa.array([n], pa.int64()), pa.array([n / fps]), pa.array([_pack(x)], _FRAME)], ["path", "frame", "ts", "image"])

    return files.select("path", "content").mapInArrow(run, f"path string, frame long, ts double, image {FRAME}")


def frames_at(files: DataFrame, fps: float, by: str = "frame", decoder: Callable[[bytes], Iterable[np.ndarray]] = numpy_frames) -> DataFrame:
    """path, nth, frame and image for each entry of ``wanted`` (a list in files, beside path and content), nth being its place
    there. By ``frame`` the entries are indices, and one that the file lacks is an error; by ``ts`` they are seconds, and the
    frame nearest in time is taken, the earlier on a tie. A file is decoded up to the last frame that its list needs, with two
    frames in memory. A null list asks for nothing; a null entry is an error."""
    if by not in ("frame", "ts"):
        raise ValueError(f"frames are found by frame or ts, not by {by!r}")

    def picked(content: bytes, wanted: list) -> Iterator[tuple[int, int, np.ndarray]]:
        todo = sorted(range(len(wanted)), key=lambda k: wanted[k], reverse=True)
        before, n = None, -1
        for n, x in enumerate(decoder(content) if todo else ()):
            while todo and wanted[todo[-1]] <= (n if by == "frame" else n / fps):
                w = wanted[todo[-1]]
                if by == "frame" and w != n:
                    raise ValueError(f"no frame {w}")
                earlier = by == "ts" and before is not None and w - (n - 1) / fps <= n / fps - w
                yield todo.pop(), n - earlier, before if earlier else x
            if not todo:
                return
            before = x
        if todo and (by == "frame" or before is None):
            raise ValueError(f"no frame {wanted[todo[-1]]} among {n + 1}")
        for k in reversed(todo):
            yield k, n, before

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content, wanted in zip(b.column("path"), b.column("content"), b.column("wanted"), strict=True):
                try:
                    for k, n, x in picked(content.as_py(), wanted.as_py() or []):
                        yield pa.RecordBatch.from_arrays([pa.array([path.as_py()]), pa.array([k], pa.int32()), pa.array([n], pa.int64()), pa.array([_pack(x)], _FRAME)], ["path", "nth", "frame", "image"])
                except (TypeError, ValueError) as error:
                    raise ValueError(f"{path.as_py()}: {error}") from error

    return files.select("path", "content", "wanted").mapInArrow(run, f"path string, nth int, frame long, image {FRAME}")


def _pack(x: np.ndarray) -> dict:
    return {"height": x.shape[0], "width": x.shape[1], "pixels": np.ascontiguousarray(x, np.uint8).tobytes()}


def _unpack(frame: dict | None) -> np.ndarray | None:
    if frame is None or frame["pixels"] is None:
        return None
    return np.frombuffer(frame["pixels"], np.uint8).reshape(frame["height"], frame["width"], 3)


def to_bytes(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


# transforms


class Step:
    """A change of a frame (bytes, height by width by 3); ``draw`` gives the sample's numbers in [0, 1), by place."""

    training_only = True

    def __call__(self, x: np.ndarray, draw: Callable[[int], float], training: bool) -> np.ndarray:
        raise NotImplementedError


@dataclass(frozen=True)
class Crop(Step):
    """A share of both sides: anywhere in training, else the middle."""

    scale: float
    training_only = False

    def __call__(self, x, draw, training):
        h, w = int(x.shape[0] * self.scale), int(x.shape[1] * self.scale)
        room = x.shape[0] - h, x.shape[1] - w
        top, left = (min(int(draw(n) * (r + 1)), r) if training else round(r / 2) for n, r in enumerate(room))
        return x[top : top + h, left : left + w]


@dataclass(frozen=True)
class Resize(Step):
    height: int
    width: int
    interpolation: str = "linear"
    antialias: bool = True
    training_only = False

    def __post_init__(self):
        if self.interpolation not in INTERPOLATIONS:
            raise ValueError(f"unknown interpolation {self.interpolation!r}; one of {INTERPOLATIONS}")

    def __call__(self, x, draw, training):
        rows, columns = (resampling(a, b, self.interpolation, self.antialias) for a, b in ((x.shape[0], self.height), (x.shape[1], self.width)))
        return to_bytes(np.einsum("ah,hwc,bw->abc", rows, x.astype(np.float64), columns, optimize=True))


def resampling(before: int, after: int, kind: str = "linear", antialias: bool = True) -> np.ndarray:
    """The matrix, after by before, that resamples a line of pixels: kernel weights about each new pixel's centre."""
    ratio = before / after
    if kind == "nearest":
        return np.eye(before)[np.minimum((np.arange(after) * ratio).astype(int), before - 1)]
    wide = max(ratio, 1.0) if antialias else 1.0
    # pixels beyond the border count as the border's where there is no antialiasing, and do not count with it
    support = math.ceil({"linear": 1, "cubic": 2, "lanczos": 3}[kind] * wide)
    at = (np.arange(after) + 0.5) * ratio - 0.5
    near = np.floor(at).astype(int)[:, None] + np.arange(1 - support, support + 1)
    t = np.abs((near - at[:, None]) / wide)
    if kind == "linear":
        k = np.maximum(1 - t, 0)
    elif kind == "cubic":
        a = -0.5 if antialias else -0.75
        k = np.where(t <= 1, (a + 2) * t**3 - (a + 3) * t**2 + 1, np.where(t < 2, a * (t**3 - 5 * t**2 + 8 * t - 4), 0))
    else:
        k = np.where(t < 3, np.sinc(t) * np.sinc(t / 3), 0)
    if antialias:
        k = np.where((near >= 0) & (near < before), k, 0)
    out = np.zeros((after, before))
    np.add.at(out, (np.arange(after)[:, None], np.clip(near, 0, before - 1)), k)
    return out / out.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class Rotate(Step):
    """By an angle of at most so many degrees either way about the middle; what comes from outside is black."""

    degrees: float
    interpolation: str = "linear"

    def __post_init__(self):
        if self.interpolation not in INTERPOLATIONS[:2]:
            raise ValueError(f"rotation interpolates by {INTERPOLATIONS[:2]}, not {self.interpolation!r}")

    def __call__(self, x, draw, training):
        return turn(x, (2 * draw(0) - 1) * self.degrees, self.interpolation)


def turn(x: np.ndarray, degrees: float, interpolation: str = "linear") -> np.ndarray:
    """x turned against the clock."""
    h, w = x.shape[:2]
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    dy, dx = np.mgrid[:h, :w] - np.array([(h - 1) / 2, (w - 1) / 2])[:, None, None]
    # rounding keeps quarter turns on the grid
    sy, sx = np.round(dx * s + dy * c + (h - 1) / 2, 9), np.round(dx * c - dy * s + (w - 1) / 2, 9)

    def pick(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        inside = (i >= 0) & (i < h) & (j >= 0) & (j < w)
        return np.where(inside[..., None], x[np.clip(i, 0, h - 1), np.clip(j, 0, w - 1)].astype(np.float64), 0)

    if interpolation == "nearest":
        return to_bytes(pick(np.rint(sy).astype(int), np.rint(sx).astype(int)))
    i, j = np.floor(sy).astype(int), np.floor(sx).astype(int)
    a, b = (sy - i)[..., None], (sx - j)[..., None]
    return to_bytes((1 - a) * ((1 - b) * pick(i, j) + b * pick(i, j + 1)) + a * ((1 - b) * pick(i + 1, j) + b * pick(i + 1, j + 1)))


@dataclass(frozen=True)
class Flip(Step):
    """Left to right, with a probability."""

    p: float = 0.5

    def __call__(self, x, draw, training):
        return x[:, ::-1] if draw(0) < self.p else x


def gray(x: np.ndarray) -> np.ndarray:
    return np.repeat((x.astype(np.float64) @ np.array(LUMA))[..., None], 3, axis=2)


@dataclass(frozen=True)
class Grayscale(Step):
    p: float

    def __call__(self, x, draw, training):
        return to_bytes(gray(x)) if draw(0) < self.p else x


@dataclass(frozen=True)
class Posterize(Step):
    """Only the leading bits of each byte, with a probability."""

    bits: int
    p: float = 0.5

    def __call__(self, x, draw, training):
        return x & np.uint8(256 - 2 ** (8 - self.bits)) if draw(0) < self.p else x


@dataclass(frozen=True)
class Jitter(Step):
    """Brightness, contrast and saturation times a factor, and the hue turned by a share of the circle, in an order that is
    drawn too. A number means a factor of at most so much from 1 (a turn of at most so much either way); a pair gives the
    bounds themselves."""

    brightness: float | tuple[float, float] = 0.0
    contrast: float | tuple[float, float] = 0.0
    saturation: float | tuple[float, float] = 0.0
    hue: float | tuple[float, float] = 0.0

    def __call__(self, x, draw, training):
        mix = lambda v, base, f: np.clip(f * v + (1 - f) * base, 0, 255)
        parts = [
            (self.brightness, 1.0, lambda v, f: mix(v, 0.0, f)),
            (self.contrast, 1.0, lambda v, f: mix(v, gray(v).mean(), f)),
            (self.saturation, 1.0, lambda v, f: mix(v, gray(v), f)),
            (self.hue, 0.0, turn_hue),
        ]
        asked = [(n, middle, most, change) for n, (most, middle, change) in enumerate(parts) if most]
        v = x.astype(np.float64)
        for n, middle, most, change in sorted(asked, key=lambda a: draw(4 + a[0])) if len(asked) > 1 else asked:
            low, high = most if isinstance(most, tuple) else (max(0.0, 1 - most) if middle else -most, middle + most)
            v = change(v, low + (high - low) * draw(n))
        return to_bytes(v)


def turn_hue(v: np.ndarray, by: float) -> np.ndarray:
    """The hue of each pixel turned by a share of the circle; its largest and smallest channel stay what they are."""
    high, low = v.max(axis=2), v.min(axis=2)
    spread = np.where(high > low, high - low, 1)
    r, g, b = np.moveaxis(v, 2, 0)
    sixth = np.where(high == r, (g - b) / spread, np.where(high == g, 2 + (b - r) / spread, 4 + (r - g) / spread)) + 6 * by
    ramp = lambda n: high - (high - low) * np.clip(np.minimum((n + sixth) % 6, 4 - (n + sixth) % 6), 0, 1)
    return np.stack([ramp(n) for n in (5, 3, 1)], axis=2)


def transform(image: Column, sample: Column, steps: list[Step], training: bool, seed: int = 0) -> Column:
    """image after all steps; in evaluation those that are not training_only."""
    active = [(n, s) for n, s in enumerate(steps) if training or not s.training_only]

    @F.arrow_udf(FRAME)
    def run(images: pa.Array, samples: pa.Array) -> pa.Array:
        out = []
        for image, who in zip(images, samples, strict=True):
            x = _unpack(image.as_py())
            for n, step in active if x is not None else ():
                x = step(x, lambda k, n=n, who=who: xxhash.xxh64_intdigest(f"{who.as_py()}/{seed}/{n}/{k}") / 2**64, training)
            out.append(None if x is None else _pack(x))
        return pa.array(out, _FRAME)

    return run(image, sample.cast("string"))


def transform_views(df: DataFrame, views: list[str], sample: str, steps: list[Step], training: bool, seed: int = 0) -> DataFrame:
    """df with all its views changed alike: they share the sample's numbers. Views are named ``modality.name``."""
    odd = [v for v in views if v not in df.columns or "." not in v]
    if odd:
        raise KeyError(", ".join(odd))
    return df.withColumns({v: transform(F.col(f"`{v}`"), F.col(sample), steps, training, seed) for v in views})


# layouts

PLANES = "struct<channels: int, height: int, width: int, values: array<float>>"
_PLANES = pa.struct([("channels", pa.int32()), ("height", pa.int32()), ("width", pa.int32()), ("values", pa.list_(pa.float32()))])
CLIP = "struct<channels: int, frames: int, height: int, width: int, values: binary>"
_CLIP = pa.struct([("channels", pa.int32()), ("frames", pa.int32()), ("height", pa.int32()), ("width", pa.int32()), ("values", pa.binary())])


def _each(change: Callable[[object], dict | None], c: Column, ddl: str, arrow: pa.DataType) -> Column:
    """What change makes of each value; null stays null."""

    @F.arrow_udf(ddl)
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v.as_py() is None else change(v.as_py()) for v in values], arrow)

    return run(c)


def to_planes(image: Column) -> Column:
    """A frame as single-precision numbers from 0 to 1, channel by row by column."""

    def change(frame: dict) -> dict | None:
        x = _unpack(frame)
        return None if x is None else {"channels": 3, "height": x.shape[0], "width": x.shape[1], "values": (np.moveaxis(x, 2, 0).astype(np.float32) / np.float32(255)).ravel()}

    return _each(change, image, PLANES, _PLANES)


def from_planes(planes: Column) -> Column:
    """The way back: 255 times each number, held within 0 to 255 and cut to whole bytes."""

    def change(p: dict) -> dict:
        v = np.array(p["values"], np.float32).reshape(p["channels"], p["height"], p["width"])
        return _pack(np.moveaxis(np.clip(v * np.float32(255), 0, 255).astype(np.uint8), 0, 2))

    return _each(change, planes, FRAME, _FRAME)


def clip_of(window: Column) -> Column:
    """An array of frames of one size as bytes, channel by frame by row by column. An empty or null array gives null; a null
    frame or one of another size is an error."""

    def change(window: list) -> dict | None:
        frames = [_unpack(x) for x in window]
        if any(x is None or x.shape != frames[0].shape for x in frames):
            raise ValueError("the frames of a clip must all be there and of one size")
        v = np.moveaxis(np.stack(frames), 3, 0) if frames else None
        return None if v is None else {"channels": v.shape[0], "frames": v.shape[1], "height": v.shape[2], "width": v.shape[3], "values": v.tobytes()}

    return _each(change, window, CLIP, _CLIP)


def clips(frames: DataFrame, keys: list[str], order: str, image: str = "image") -> DataFrame:
    """keys and ``clip``: the frames of each combination of keys, in order. A clip is one value, so keep it to a window."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.struct(F.col(image)).alias("one"))), lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0))
    return frames.groupBy(*keys).agg(listed.alias("__all")).select(*keys, clip_of(F.transform("__all", lambda x: x["one"][image])).alias("clip"))


# frame cache


def write_frame_cache(frames: DataFrame, path: str, episode: str = "episode", step: str = "frame", image: str = "image") -> None:
    """Decoded frames under their absolute positions (those of earlier episodes, in order, come before), with each episode's
    start and length, so that later reads decode nothing."""
    placed = positions_by_episode(frames.select(episode, step, image), episode, step, "at")
    placed.select("at", F.col(image).alias("image")).write.mode("errorifexists").parquet(f"{path}/frames")
    placed.groupBy(F.col(episode).alias("episode")).agg(F.min("at").alias("start"), F.count("*").alias("length")).write.mode("errorifexists").parquet(f"{path}/episodes")


def cached_frames(spark: SparkSession, path: str, requests: DataFrame, deltas: list[int], episode: str = "episode", base: str = "base") -> DataFrame:
    """episode, base, delta, step and image for each request and delta; steps beyond an episode hold its first or last frame. An
    episode that the cache lacks gives no row."""
    asked = requests.select(F.col(episode).alias("episode"), F.col(base).alias("base"), F.explode(F.array(*map(F.lit, deltas))).alias("delta"))
    found = asked.join(spark.read.parquet(f"{path}/episodes"), "episode")
    step = F.greatest(F.lit(0), F.least(F.col("base") + F.col("delta"), F.col("length") - 1))
    found = found.withColumn("step", step.cast("long")).withColumn("at", F.col("start") + F.col("step"))
    return found.join(spark.read.parquet(f"{path}/frames"), "at").select("episode", "base", "delta", "step", "image")


# distance


def _boxes(x: np.ndarray) -> np.ndarray:
    """The mean over each square of WINDOW pixels that lies within x."""
    s = np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0), (0, 0)))
    k = WINDOW
    return (s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k]) / k**2


def similarity(a: np.ndarray, b: np.ndarray, spread: float = 2.0) -> float:
    """Structural similarity with square windows and sample covariances, the mean over windows and channels."""
    if min(a.shape[:2]) < WINDOW:
        return math.nan
    ma, mb, n = _boxes(a), _boxes(b), WINDOW**2 / (WINDOW**2 - 1)
    va, vb, cov = n * (_boxes(a * a) - ma * ma), n * (_boxes(b * b) - mb * mb), n * (_boxes(a * b) - ma * mb)
    c1, c2 = (K1 * spread) ** 2, (K2 * spread) ** 2
    return float(((2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))).mean())


def _distances(first: pa.Array, second: pa.Array) -> pa.Array:
    out = []
    for p, q in zip(first, second, strict=True):
        a, b = _unpack(p.as_py()), _unpack(q.as_py())
        if a is None or b is None:
            out.append(None)
            continue
        if a.shape != b.shape:
            raise ValueError(f"frames differ in size: {a.shape[:2]} and {b.shape[:2]}")
        a, b = a / 127.5 - 1, b / 127.5 - 1
        out.append({"l1": float(np.abs(a - b).mean()), "ssim": similarity(a, b)})
    return pa.array(out, pa.struct([("l1", pa.float64()), ("ssim", pa.float64())]))


def distance(first: Column, second: Column) -> Column:
    """l1 and ssim of two frames of one size, bytes taken as -1 to 1; ssim is NaN for frames below WINDOW pixels, and the
    struct null where a frame is."""
    return F.arrow_udf(_distances, "struct<l1: double, ssim: double>")(first, second)
