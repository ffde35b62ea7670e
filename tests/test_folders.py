"""Checkpoint folders as a stream: order, lateness, limits, failures and restarts."""

import pickle

import pytest
from pyspark.errors import StreamingQueryException

from kinelake.streaming import folders


@pytest.fixture
def place(tmp_path):
    def make(*numbers, done=True):
        for n in numbers:
            model = tmp_path / "ckpt" / f"iter_{n:09d}" / "model"
            model.mkdir(parents=True, exist_ok=True)
            if done:
                (model / ".metadata").write_text("")

    make.folder, make.log, make.state = (f"file://{tmp_path}/{x}" for x in ("ckpt", "log", "state"))
    return make


def handler():
    seen = []

    def handle(batch, number):
        seen.append((number, sorted(r.iteration for r in batch.collect())))

    handle.seen = seen
    return handle


def test_late_folders_and_restarts(spark, place):
    stream = lambda: folders.checkpoints(spark, place.folder, place.log, start=1000, stride=500)
    h = handler()
    assert folders.replay(stream, h, place.state) == 0  # the folder is not there yet
    place(500, 1000, 1250, 1500, 3000)
    place(2000, done=False)
    (p := folders.follow(stream(), h, place.state)).awaitTermination()
    assert [x for _, x in h.seen] == [[1000, 1500, 3000]] and p.exception() is None
    assert folders.replay(stream, h, place.state) == 0
    place(2000, 3500)
    assert folders.replay(stream, h, place.state) == 1
    assert [x for _, x in h.seen[1:]] == [[2000, 3500]]


def test_an_ordered_backlog_waits(spark, place):
    place(*range(0, 700, 100))
    place(700, done=False)
    place(800)
    stream = lambda: folders.checkpoints(spark, place.folder, place.log, limit=3, ordered=True)
    h = handler()
    assert folders.replay(stream, h, place.state) == 3
    assert [x for _, x in h.seen] == [[0, 100, 200], [300, 400, 500], [600]]
    place(700)
    assert folders.replay(stream, h, place.state) == 1 and h.seen[-1] == (3, [700, 800])


def test_a_batch_that_failed_comes_again(spark, place):
    place(1, 2, 3)
    stream = lambda: folders.checkpoints(spark, place.folder, place.log, limit=2)

    def fails(batch, number):
        raise RuntimeError("no room")

    with pytest.raises(StreamingQueryException, match="no room"):
        folders.replay(stream, fails, place.state)
    place(4)
    h = handler()
    folders.replay(stream, h, place.state)
    assert h.seen[0] == (0, [1, 2]) and [x for _, x in h.seen[1:]] == [[3, 4]]
    with pytest.raises(ValueError):
        folders.checkpoints(spark, place.folder, place.log, stride=0)


def test_a_large_poll_is_dealt_to_tasks(place):
    """A poll of very many folders is read in pieces, in order, and tasks are not sent the names of earlier polls."""
    names = [f"iter_{n:09d}" for n in range(25_000)]
    folders.Log(place.log).add(names)
    reader = folders.FolderReader({"path": place.folder, "log": place.log})
    parts = reader.partitions({"entry": 0}, {"entry": 1})
    assert len(parts) == 3 and all(p.names for p in parts)
    sent = pickle.loads(pickle.dumps(reader))
    rows = [r for p in parts for b in sent.read(p) for r in b.to_pylist()]
    assert [(r["name"], r["iteration"], r["path"]) for r in rows] == [(n, i, f"{place.folder}/{n}") for i, n in enumerate(names)]
    assert len(pickle.dumps(reader)) < 10_000 and len(reader.taken) == 25_000


@pytest.mark.parametrize("local", [True, False])
def test_markers_are_asked_for_in_lists(place, tmp_path, monkeypatch, local):
    """Polls of a backlog ask for markers of many folders at once, never for more than the limit leaves, on any file system."""
    import pyarrow.fs

    place(*range(100, 2700, 100))
    place(2700, done=False)
    place(2800, 50)
    (tmp_path / "ckpt" / "iter_000002900").write_text("")
    (tmp_path / "ckpt" / "other").mkdir()
    asked = []

    class Handler(pyarrow.fs.FSSpecHandler):
        def __init__(self):
            self.at = pyarrow.fs.LocalFileSystem()

        def get_file_info(self, paths):
            asked.append(len(paths))
            return self.at.get_file_info(paths)

        def get_file_info_selector(self, selector):
            return self.at.get_file_info(selector)

    reader = lambda **more: folders.FolderReader({"path": place.folder, "log": place.log, **more})
    readers = reader(), reader(limit="5"), reader(ordered="true"), reader(ordered="true", limit="50", start="2600", stride="100")
    if not local:
        system = pyarrow.fs.PyFileSystem(Handler())
        monkeypatch.setattr(folders.pyarrow.fs, "FileSystem", type("Any", (), {"from_uri": staticmethod(lambda uri: (system, uri.removeprefix("file://")))}))
    number = lambda r: [int(n[5:]) for n in r.complete()]
    assert number(readers[0]) == [50, *range(100, 2700, 100), 2800]
    assert number(readers[1]) == [50, 100, 200, 300, 400]
    assert number(readers[2]) == [50, *range(100, 2700, 100)]
    assert number(readers[3]) == [2600]
    assert local or asked == [29, 5, 29, 3]


def test_folders_are_made_aside_and_moved(tmp_path, monkeypatch):
    """The queries' folders: none is made where all tasks would wait; those that are there only get their marker; no rest stays."""
    import pyarrow as pa
    import pyarrow.fs

    from kinelake.plans import catalogue

    made = []

    class Local(pyarrow.fs.LocalFileSystem):
        def create_dir(self, path, *, recursive=True):
            made.append(path)
            super().create_dir(path, recursive=recursive)

    monkeypatch.setattr(pyarrow.fs, "FileSystem", type("Any", (), {"from_uri": staticmethod(lambda uri: (Local(), uri.removeprefix("file://")))}))
    run = catalogue._checkpoint_folders(f"file://{tmp_path}/in")
    batch = lambda **x: [pa.RecordBatch.from_pydict(x)]
    assert [b.num_rows for b in run(batch(key=[1, 2, 3], done=[True, False, True]))] == [3]
    assert not [p for p in made if p.startswith(f"{tmp_path}/in/")]
    assert [b.num_rows for b in run(batch(key=[2, 4], done=[True, False]))] == [2]
    found = {p.name: (p / "model" / ".metadata").exists() for p in (tmp_path / "in").iterdir()}
    assert found == {"iter_000000100": True, "iter_000000200": True, "iter_000000300": True, "iter_000000400": False}
    assert [p.name for p in tmp_path.iterdir()] == ["in"] and (tmp_path / "in/iter_000000400/model").is_dir()
