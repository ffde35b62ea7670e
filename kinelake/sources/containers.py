"""Video containers (ISO base media files): an index of their samples, and frames read by byte range from a key frame on.

The index is a table: a row for each sample of a file's first video track, in decoding order, with its place in order of
presentation (``frame``), its time, byte range and the key frame that decoding has to start from. Which samples a request needs
is then a join: the run from that key frame up to the wanted sample. Only these bytes are read, a run at a time, and handed to
the given decoder.

Files are opened in tasks by ``opener``, which gives a file with ``size()`` and ``read_at(n, offset)``; the one included takes
local paths and the addresses that Arrow knows. Files without a video track, fragmented ones and damaged tables are errors
that name the file. Groups of pictures are closed: no frame needs a sample from before its key frame.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pixels import _FRAME, FRAME, _pack
from ..operators import joins
from .shared import fixed

INDEX = "path string, sample long, frame long, ts double, offset long, size long, key long, setup binary"
#: Rows of the index that leave a task at once.
ROWS = 100_000
Decoder = Callable[[bytes, list[bytes]], Iterable[np.ndarray]]


def opened(path: str) -> pa.NativeFile:
    """A file for reads at any place: a local path, or an address of a file system that Arrow has."""
    system, inner = pyarrow.fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


# boxes


def _head(data: bytes, left: int) -> tuple[bytes, int, int]:
    """Kind, length of the head and of the whole box that begins with these bytes; ``left`` bytes are there for it."""
    if len(data) < 8:
        raise ValueError("a box ends in its head")
    size, kind = struct.unpack_from(">I4s", data)
    head = 16 if size == 1 else 8
    if size == 1:
        size = struct.unpack_from(">Q", data, 8)[0] if len(data) >= 16 else 0
    size = size or left
    if not head <= size <= left:
        raise ValueError(f"box {kind!r} of {size} bytes, {left} left")
    return kind, head, size


def _boxes(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 0
    while at < len(data):
        kind, head, size = _head(data[at : at + 16], len(data) - at)
        yield kind, data[at + head : at + size]
        at += size


def _box(data: bytes, *path: bytes) -> bytes | None:
    """The body of the first box on a path of kinds; None if there is none."""
    for kind in path:
        data = next((body for k, body in _boxes(data) if k == kind), None)
        if data is None:
            return None
    return data


def _movie(f: pa.NativeFile) -> bytes:
    """The movie box, reached over the heads of those before it: no media data are read."""
    at, end = 0, f.size()
    while at < end:
        kind, head, size = _head(f.read_at(min(16, end - at), at), end - at)
        if kind == b"moov":
            return f.read_at(size - head, at + head)
        at += size
    raise ValueError("no movie box")


def _numbers(body: bytes, kind: str, columns: int = 1, skip: int = 8) -> np.ndarray:
    """Entries of a table, counted by the four bytes before ``skip``."""
    n = struct.unpack_from(">I", body, skip - 4)[0]
    return np.frombuffer(body, kind, n * columns, skip).astype(np.int64).reshape(n, columns)


def _timescale(body: bytes) -> int:
    return struct.unpack_from(">I", body, 20 if body[0] else 12)[0]


def _start(movie: bytes, track: bytes) -> tuple[float, int]:
    """From the edit list: the seconds that the track waits, and the media time at which it begins."""
    edits = _box(track, b"edts", b"elst")
    wait = 0
    if edits is not None:
        form = ">Qq4x" if edits[0] else ">Ii4x"
        for length, begin in struct.iter_unpack(form, edits[8 : 8 + struct.unpack_from(">I", edits, 4)[0] * struct.calcsize(form)]):
            if begin >= 0:
                return wait / _timescale(_box(movie, b"mvhd")), begin
            wait += length
    return 0.0, 0


def sample_table(movie: bytes) -> tuple[dict[str, np.ndarray], bytes]:
    """ts, offset, size, key and frame of each sample of the first video track, in decoding order, and its sample description."""
    if _box(movie, b"mvex") is not None:
        raise ValueError("fragmented files have no index")
    track = next((b for k, b in _boxes(movie) if k == b"trak" and (_box(b, b"mdia", b"hdlr") or b"")[8:12] == b"vide"), None)
    if track is None:
        raise ValueError("no video track")
    table = dict(_boxes(_box(track, b"mdia", b"minf", b"stbl")))
    same, n = struct.unpack_from(">II", table[b"stsz"], 4)
    size = np.full(n, same, np.int64) if same else _numbers(table[b"stsz"], ">u4", skip=12)[:, 0]
    spread = lambda rows: np.repeat(rows[:, 1], rows[:, 0])
    step = spread(_numbers(table[b"stts"], ">u4", 2))
    time = np.cumsum(step) - step
    if b"ctts" in table:
        time = time + spread(_numbers(table[b"ctts"], ">i4", 2))
    wait, begin = _start(movie, track)
    ts = (time - begin) / _timescale(_box(track, b"mdia", b"mdhd")) + wait
    # chunks: runs of chunks with as many samples each
    chunks = _numbers(table[b"co64"], ">u8")[:, 0] if b"co64" in table else _numbers(table[b"stco"], ">u4")[:, 0]
    runs = _numbers(table[b"stsc"], ">u4", 3)
    in_chunk = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0] - 1, len(chunks))))
    if not len(time) == len(size) == in_chunk.sum():
        raise ValueError(f"tables of {len(time)}, {len(size)} and {in_chunk.sum()} samples")
    before = np.cumsum(size) - size
    firsts = np.cumsum(in_chunk) - in_chunk
    full = in_chunk > 0
    offset = before + np.repeat((chunks - before[np.minimum(firsts, max(n - 1, 0))])[full], in_chunk[full]) if n else before
    key = np.arange(n)
    if b"stss" in table:
        keys = _numbers(table[b"stss"], ">u4")[:, 0] - 1
        place = np.searchsorted(keys, key, "right") - 1
        if n and (not len(keys) or keys[0] != 0):
            raise ValueError("the first sample is no key frame")
        key = keys[place] if n else key
    frame = np.empty(n, np.int64)
    frame[np.argsort(ts, kind="stable")] = np.arange(n)
    return {"frame": frame, "ts": ts, "offset": offset, "size": size, "key": key}, table[b"stsd"]


# tables


def index(paths: DataFrame, opener: Callable[[str], pa.NativeFile] = opened) -> DataFrame:
    """A row for each sample of each file of paths (path): sample, frame, ts, offset, size, key, and on key frames ``setup``, the
    track's sample description. Heads and the movie box are all that is read; a file without samples gives no row. Null
    paths give none either; a path that stands there twice has its samples twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                if path is None:
                    continue
                try:
                    with opener(path) as f:
                        t, setup = sample_table(_movie(f))
                except (ValueError, KeyError, IndexError, TypeError, struct.error) as error:
                    raise ValueError(f"{path}: {error!r}") from error
                n = len(t["key"])
                for at in range(0, n, ROWS):
                    part = {k: v[at : at + ROWS] for k, v in t.items()}
                    sample = np.arange(at, min(n, at + ROWS))
                    setups = [setup if k == s else None for k, s in zip(part["key"], sample, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * len(sample)), *(pa.array(x) for x in (sample, part["frame"], part["ts"], part["offset"], part["size"], part["key"])), pa.array(setups, pa.binary())],
                        ["path", "sample", "frame", "ts", "offset", "size", "key", "setup"],
                    )

    return paths.select("path").mapInArrow(run, INDEX)


def runs(samples: DataFrame, needed: DataFrame) -> DataFrame:
    """path, key and samples (sample, frame, offset, size, setup): for each key frame before a needed sample (path, key, sample) the
    smallest run that begins there and has all that is needed after it. A run is as long as a group of pictures at most."""
    last = needed.groupBy("path", "key").agg(F.max("sample").alias("__last"))
    chosen = samples.join(last, ["path", "key"]).where(F.col("sample") <= F.col("__last"))
    return chosen.groupBy("path", "key").agg(F.array_sort(F.collect_list(F.struct("sample", "frame", "ts", "offset", "size", "setup"))).alias("samples"))


def _read(f: pa.NativeFile, wanted: list[dict]) -> list[bytes]:
    """The samples' bytes; those that lie side by side are read at once."""
    out, at = [], 0
    while at < len(wanted):
        end = at + 1
        while end < len(wanted) and wanted[end]["offset"] == wanted[end - 1]["offset"] + wanted[end - 1]["size"]:
            end += 1
        begin = wanted[at]["offset"]
        data = f.read_at(wanted[end - 1]["offset"] + wanted[end - 1]["size"] - begin, begin)
        for s in wanted[at:end]:
            out.append(data[s["offset"] - begin : s["offset"] - begin + s["size"]])
            if len(out[-1]) != s["size"]:
                raise ValueError(f"sample {s['sample']} lies beyond the end")
        at = end
    return out


def decoded(planned: DataFrame, decoder: Decoder, opener: Callable[[str], pa.NativeFile] = opened) -> DataFrame:
    """path, frame, ts, image and run_bytes (what was read for its run) of each frame of the runs. decoder takes the sample
    description and a run's samples in decoding order, and gives a frame for each, in order of presentation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, samples in zip(b.column("path").to_pylist(), b.column("samples"), strict=True):
                samples = samples.as_py()
                try:
                    with opener(path) as f:
                        data = _read(f, samples)
                    shown = sorted(samples, key=lambda s: s["frame"])
                    for s, x in zip(shown, decoder(samples[0]["setup"], data), strict=True):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([path]), pa.array([s["frame"]], pa.int64()), pa.array([s["ts"]]), pa.array([_pack(x)], _FRAME), pa.array([sum(map(len, data))], pa.int64())], ["path", "frame", "ts", "image", "run_bytes"]
                        )
                except ValueError as error:
                    raise ValueError(f"{path}: {error}") from error

    return planned.select("path", "samples").mapInArrow(run, f"path string, frame long, ts double, image {FRAME}, run_bytes long")


def frames_at(wanted: DataFrame, decoder: Decoder, by: str = "frame", opener: Callable[[str], pa.NativeFile] = opened) -> DataFrame:
    """wanted (path, a number ``frame`` in order of presentation, or seconds ``at``, and any other columns but ts, image and
    run_bytes) with frame, ts, image and run_bytes. By ``frame`` one that the file lacks is an error, and so is null; by ``at``
    the frame nearest in time is taken, the earlier on a tie, and null, or a file without frames, is an error. Frames that
    are asked for more than once are decoded once; the order of requests does not matter. No request gives no row."""
    if by not in ("frame", "at"):
        raise ValueError(f"frames are found by frame or at, not by {by!r}")
    samples = fixed(index(wanted.select("path").distinct(), opener))
    if by == "at":
        wanted = joins.nearest(wanted.withColumn("ts", F.col("at")), samples.select("path", "ts", "frame"), ["path"]).drop("ts")
    wanted = fixed(wanted)
    needed = wanted.select("path", "frame").distinct().join(samples.select("path", "frame", "sample", "key"), ["path", "frame"])
    found = decoded(runs(samples, needed), decoder, opener).withColumn("__found", F.lit(True))
    out = wanted.join(found, ["path", "frame"], "left")
    name = F.concat(F.lit("no frame "), F.coalesce(F.col(by).cast("string"), F.lit("null")), F.lit(" in "), F.coalesce("path", F.lit("null")))
    return out.withColumn("image", F.when(F.col("__found"), F.col("image")).otherwise(F.raise_error(name))).drop("__found")


# writing


def mux(samples: list[tuple[bytes, bool, int]], timescale: int, duration: int, setup: bytes = b"", in_chunk: int = 4) -> bytes:
    """A file of one video track: samples in decoding order, each with whether it is a key frame and the shift of its
    presentation, all of the same duration, in units of the timescale."""
    box = lambda kind, *parts: struct.pack(">I4s", 8 + sum(map(len, parts)), kind) + b"".join(parts)
    full = lambda kind, *parts, version=0: box(kind, struct.pack(">I", version << 24), *parts)
    words = lambda *x: struct.pack(f">{len(x)}I", *x)
    n = len(samples)
    brand = box(b"ftyp", b"isom", words(512), b"isom")
    media = box(b"mdat", *(d for d, _, _ in samples))
    starts = np.cumsum([0, *(len(d) for d, _, _ in samples)])[:-1] + len(brand) + 8
    chunks = [int(x) for x in starts[::in_chunk]]
    groups = ([(1, min(in_chunk, n), 1)] if n else []) + ([(len(chunks), n % in_chunk, 1)] if n > in_chunk and n % in_chunk else [])
    table = box(
        b"stbl",
        full(b"stsd", words(1), box(b"raw ", bytes(6), b"\0\1", setup)),
        full(b"stts", words(bool(n)), words(n, duration) if n else b""),
        full(b"ctts", words(n), *(struct.pack(">Ii", 1, s) for _, _, s in samples), version=1),
        full(b"stss", words(sum(k for _, k, _ in samples)), *(words(i + 1) for i, (_, k, _) in enumerate(samples) if k)),
        full(b"stsz", words(0, n), *(words(len(d)) for d, _, _ in samples)),
        full(b"stsc", words(len(groups)), *(words(*g) for g in groups)),
        full(b"co64", words(len(chunks)), *(struct.pack(">Q", c) for c in chunks)),
    )
    head = words(0, 0, timescale, n * duration)
    track = box(b"trak", box(b"mdia", full(b"mdhd", head, bytes(4)), full(b"hdlr", bytes(4), b"vide", bytes(13)), box(b"minf", table)))
    return brand + media + box(b"moov", full(b"mvhd", head, bytes(80)), track)


def write(videos: DataFrame, timescale: int, duration: int) -> DataFrame:
    """Writes path and samples (a list of data, sync, shift) as one file each, and gives path and bytes of what was written. A
    task that runs again writes the same file again. A file's samples are one value; null samples are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, samples in zip(b.column("path").to_pylist(), b.column("samples"), strict=True):
                content = mux([(s["data"], s["sync"], s["shift"]) for s in samples.as_py() or []], timescale, duration)
                system, inner = pyarrow.fs.FileSystem.from_uri(path)
                system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(inner) as out:
                    out.write(content)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(content)], pa.int64())], ["path", "bytes"])

    return fixed(videos.select("path", "samples").mapInArrow(run, "path string, bytes long"))
