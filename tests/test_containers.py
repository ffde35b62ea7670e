"""Video containers: sample tables, planned runs, and frames by number and time."""

import numpy as np
import pytest
from pyspark.errors import PySparkException

from kinelake.sources import containers

def coded(order, keys, shift=0):
    """Samples in decoding order for the frames ``order``; all but key frames say that they need the sample before them."""
    return [(b"K" * (n + 1) + bytes([f]) if f in keys else b"d" + bytes([f]), f in keys, 10 * (f - n) + shift) for n, f in enumerate(order)]


@pytest.fixture
def decoder():
    def run(setup, samples):
        assert setup is not None and samples[0][:1] == b"K" and all(s[:1] == b"d" for s in samples[1:])
        return [np.full((2, 2, 3), f, np.uint8) for f in sorted(s[-1] for s in samples)]

    return run


@pytest.fixture
def files(tmp_path):
    made = {
        "plain": containers.mux(coded(range(10), {0, 4, 8}), 100, 10),
        "reordered": containers.mux(coded([0, 3, 1, 2, 4, 7, 5, 6], {0, 4}, 20), 100, 10, in_chunk=3),
        "one": containers.mux(coded([0], {0}), 100, 10),
        "none": containers.mux([], 100, 10),
        "damaged": containers.mux(coded(range(3), {0}), 100, 10)[:-30],
        "silent": containers.mux(coded(range(3), {0}), 100, 10).replace(b"vide", b"soun"),
    }
    for name, content in made.items():
        (tmp_path / name).write_bytes(content)
    return {name: f"file://{tmp_path}/{name}" for name in made}


def test_index(spark, files):
    rows = lambda *names: containers.index(spark.createDataFrame([(files.get(n),) for n in names], "path string"))
    got = sorted(rows("reordered", "none", "absent").collect(), key=lambda r: r.sample)
    assert [r.frame for r in got] == [0, 3, 1, 2, 4, 7, 5, 6] and [r.key for r in got] == [0] * 4 + [4] * 4
    assert [round(r.ts, 6) for r in got] == [round(0.2 + 0.1 * r.frame, 6) for r in got]
    content = open(files["reordered"][7:], "rb").read()
    assert [content[r.offset : r.offset + r.size] for r in got] == [d for d, _, _ in coded([0, 3, 1, 2, 4, 7, 5, 6], {0, 4})]
    assert [r.setup is not None for r in got] == [r.sample == r.key for r in got]
    for name in ("damaged", "silent"):
        with pytest.raises(PySparkException, match=name):
            rows(name).collect()


def test_frames_by_number_and_time(spark, files, decoder):
    wanted = [("plain", 9, "a"), ("plain", 5, "b"), ("plain", 5, "c"), ("reordered", 2, "d"), ("reordered", 7, "e"), ("one", 0, "f")]
    df = spark.createDataFrame([(files[p], f, x) for p, f, x in wanted], "path string, frame long, tag string")
    got = {r.tag: r for r in containers.frames_at(df, decoder).collect()}
    assert {t: r.image.pixels[0] for t, r in got.items()} == {x: f for _, f, x in wanted} and len(got) == len(wanted)
    # from the key frame 4 to 5, from 8 to 9, and in decoding order 0 3 1 2
    assert got["b"].run_bytes == 5 + 1 + 2 and got["a"].run_bytes == 9 + 1 + 2 and got["d"].run_bytes == 1 + 1 + 3 * 2
    times = [("plain", -5.0, 0), ("plain", 0.149, 1), ("plain", 0.76, 8), ("plain", 99.0, 9), ("reordered", 0.2, 0), ("reordered", 0.52, 3), ("one", 7.0, 0)]
    df = spark.createDataFrame([(files[p], t, f) for p, t, f in times], "path string, at double, want long")
    got = containers.frames_at(df, decoder, "at").collect()
    assert len(got) == len(times) and all(r.frame == r.want == r.image.pixels[0] for r in got)
    assert containers.frames_at(df.limit(0), decoder, "at").count() == 0


@pytest.mark.parametrize("by,path,value", [("frame", "plain", 10), ("frame", "plain", None), ("at", "plain", None), ("at", "none", 1)])
def test_frames_that_are_not_there(spark, files, decoder, by, path, value):
    df = spark.createDataFrame([(files[path], value)], f"path string, {by} {'long' if by == 'frame' else 'double'}") if by == "frame" else spark.createDataFrame([(files[path], value and float(value))], "path string, at double")
    with pytest.raises(PySparkException, match="no frame"):
        containers.frames_at(df, decoder, by).collect()


def test_little_is_read(spark, tmp_path, decoder):
    """Of a large file only heads, tables and the wanted run are read."""
    samples = [(bytes([75 if n % 10 == 0 else 100]) + bytes(20_000) + bytes([n % 251]), n % 10 == 0, 0) for n in range(200)]
    (tmp_path / "v").write_bytes(containers.mux(samples, 30, 1))
    read = spark.sparkContext.accumulator(0)

    class Counted:
        def __init__(self, path):
            self.f = containers.opened(path)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def size(self):
            return self.f.size()

        def read_at(self, n, at):
            read.add(n)
            return self.f.read_at(n, at)

    movie = containers.sample_table(containers._movie(Counted(f"file://{tmp_path}/v")))
    assert movie[0]["key"][-1] == 190 and read.value < 8_000
    row = containers.frames_at(spark.createDataFrame([(f"file://{tmp_path}/v", 193)], "path string, frame long"), decoder).first()
    assert row.run_bytes == 4 * 20_002 and row.image.pixels[0] == 193
