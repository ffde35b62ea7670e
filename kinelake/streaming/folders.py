"""A stream of checkpoint folders: the folder that training writes to is polled itself, no announcements are needed.

``checkpoint_folders`` is a streaming source. A poll lists the ``iter_*`` folders and takes those that are complete, which a
marker inside them says, and that no poll has taken before, in order of iteration. What a poll takes is written to a log
before Spark is told of it, and an offset is the number of an entry there, so a batch that runs again has the same rows, a
stream that starts again repeats none, and a folder that is finished late comes in a later batch, whatever its number.

An ordered source stops at the first folder that is not complete: what comes after it waits, and so does what goes beyond
``limit`` folders a poll. If a stream ended between a poll and its batch, the next batch has what two polls took.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "name string, iteration long, path string"
NAME, MARKER = re.compile(r"iter_(\d+)"), "model/.metadata"


#: Names that a task reads at most, and markers that are asked for at once.
PIECE, ASKED = 10_000, 1000


class Entries(InputPartition):
    """Names of folders that one poll took, or a piece of them."""

    def __init__(self, names: list[str]) -> None:
        self.names = names


def listed(system: pyarrow.fs.FileSystem, base: str) -> Iterator[str]:
    """Names of the directories in a folder that are named like checkpoints. A local folder is walked as the system lists it, without
    asking for the state of each entry."""
    if isinstance(system, pyarrow.fs.LocalFileSystem):
        try:
            with os.scandir(base) as found:
                yield from (i.name for i in found if NAME.fullmatch(i.name) and i.is_dir())
        except FileNotFoundError:
            return
    else:
        found = system.get_file_info(pyarrow.fs.FileSelector(base, allow_not_found=True))
        yield from (i.base_name for i in found if i.type == pyarrow.fs.FileType.Directory and NAME.fullmatch(i.base_name))


class Log:
    """What each poll took: numbered files, each written under another name first, so that none is read half-written. One
    stream writes to a log."""

    def __init__(self, path: str) -> None:
        self.system, self.path = pyarrow.fs.FileSystem.from_uri(path)
        self.path = self.path.rstrip("/")
        found = self.system.get_file_info(pyarrow.fs.FileSelector(self.path, allow_not_found=True))
        self.last = max((int(i.base_name[:-5]) for i in found if re.fullmatch(r"\d+\.json", i.base_name)), default=0)

    def add(self, names: list[str]) -> None:
        self.system.create_dir(self.path, recursive=True)
        name = f"{self.path}/{self.last + 1:012d}.json"
        with self.system.open_output_stream(f"{name}.part") as out:
            out.write(json.dumps(names).encode())
        self.system.move(f"{name}.part", name)
        self.last += 1

    def names(self, number: int) -> list[str]:
        with self.system.open_input_file(f"{self.path}/{number:012d}.json") as f:
            return json.loads(f.read())


class FolderReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.marker = options["path"].rstrip("/"), options.get("marker", MARKER)
        self.first, self.stride = int(options.get("start", 0)), int(options.get("stride", 1))
        self.limit, self.ordered = int(options.get("limit", 0)), options.get("ordered", "false").lower() == "true"
        self.log = Log(options["log"])
        self.taken = {n for i in range(1, self.log.last + 1) for n in self.log.names(i)}

    def initialOffset(self) -> dict:
        return {"entry": 0}

    def latestOffset(self) -> dict:
        names = self.complete()
        if names:
            self.log.add(names)
            self.taken.update(names)
        return {"entry": self.log.last}

    def complete(self) -> list[str]:
        """Complete folders that are new, in order of iteration, as many as a poll may take."""
        system, base = pyarrow.fs.FileSystem.from_uri(self.folder)
        numbered = ((int(NAME.fullmatch(n)[1]), n) for n in listed(system, base))
        new = [n for _, n in sorted((it, n) for it, n in numbered if it >= self.first and it % self.stride == 0 and n not in self.taken)]
        out, at = [], 0
        while at < len(new) and not (self.limit and len(out) == self.limit):
            part = new[at : at + (min(ASKED, self.limit - len(out)) if self.limit else ASKED)]
            at += len(part)
            for name, info in zip(part, system.get_file_info([f"{base}/{n}/{self.marker}" for n in part]), strict=True):
                if info.type == pyarrow.fs.FileType.File:
                    out.append(name)
                elif self.ordered:
                    return out
        return out

    def partitions(self, start: dict, end: dict) -> list[Entries]:
        polls = (self.log.names(i) for i in range(start["entry"] + 1, end["entry"] + 1))
        return [Entries(names[i : i + PIECE]) for names in polls for i in range(0, len(names), PIECE)]

    def read(self, partition: Entries) -> Iterator[pa.RecordBatch]:
        names = partition.names
        columns = [pa.array(names, pa.string()), pa.array([int(NAME.fullmatch(n)[1]) for n in names], pa.int64()), pa.array([f"{self.folder}/{n}" for n in names], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["name", "iteration", "path"])

    def __getstate__(self) -> dict:
        """What tasks need: not the names that were taken before."""
        return self.__dict__ | {"taken": set()}


class CheckpointFolders(DataSource):
    """Options: path (the folder that is polled; it need not be there yet), log, marker, start, stride, limit (0: none), ordered."""

    @classmethod
    def name(cls) -> str:
        return "checkpoint_folders"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FolderReader:
        return FolderReader(self.options)


def checkpoints(spark: SparkSession, folder: str, log: str, start: int = 0, stride: int = 1, limit: int = 0, ordered: bool = False, marker: str = MARKER) -> DataFrame:
    """A stream of name, iteration and path of complete checkpoint folders, from ``start`` on, that the stride divides."""
    if stride < 1 or limit < 0:
        raise ValueError(f"stride {stride}, limit {limit}")
    spark.dataSource.register(CheckpointFolders)
    options = {"path": folder, "log": log, "start": start, "stride": stride, "limit": limit, "ordered": ordered, "marker": marker}
    return spark.readStream.format("checkpoint_folders").options(**options).load()


def follow(stream: DataFrame, handle: Callable[[DataFrame, int], None], state: str, every: str | None = None) -> StreamingQuery:
    """Calls handle with each batch that has rows, in order, one at a time; a batch whose handling failed comes again, with its
    number, when the stream is started anew. One poll, or a poll ``every`` so often ("300 seconds")."""

    def run(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            handle(batch, number)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", state)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def replay(stream: Callable[[], DataFrame], handle: Callable[[DataFrame, int], None], state: str) -> int:
    """Follows until a poll takes nothing: a backlog is handled in order, ``limit`` folders at a time. Gives the number of
    batches; a failure of handle ends it, and the next call begins with that batch."""
    batches = 0
    while True:
        query = follow(stream(), handle, state)
        query.awaitTermination()
        done = sum(p["numInputRows"] > 0 for p in query.recentProgress)
        if not done:
            return batches
        batches += done
