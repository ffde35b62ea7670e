"""Streams of checkpoints: a directory is watched, each complete new iteration is handled once, metrics are kept by iteration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import iteration

EVENT = "name string, complete boolean"


def events(spark: SparkSession, folder: str, per_trigger: int | None = None) -> DataFrame:
    """A stream of (name, complete) rows from JSON files that appear in a folder; per_trigger limits how many files a
    batch takes, so a backlog waits."""
    reader = spark.readStream.schema(EVENT)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.json(folder)


def wanted(checkpoints: DataFrame, start: int = 0, stride: int = 1) -> DataFrame:
    """Complete iterations from start on that the stride divides; works on streams and tables."""
    it = iteration(F.col("name"))
    return checkpoints.withColumn("iteration", it).where(F.col("complete") & (F.col("iteration") >= start) & (F.col("iteration") % stride == 0))


def watch(checkpoints: DataFrame, handle: Callable[[DataFrame, int], None], state: str, start: int = 0, stride: int = 1, once: bool = True) -> StreamingQuery:
    """Calls handle with each batch of new iterations. The state folder makes a batch that failed come again, and an
    iteration that was seen stay away; ``once`` handles what is there and stops."""
    stream = wanted(checkpoints, start, stride).dropDuplicates(["iteration"])
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", state)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="60 seconds")).start()


def iterations(start: int, stop: int, step: int = 1) -> list[int]:
    """start to stop, both included."""
    return list(range(start, stop + 1, step))


def parse_iterations(spec: str) -> list[int]:
    """``start:stop[:step]`` or a list of numbers, sorted and each once."""
    out: set[int] = set()
    for part in spec.replace(",", " ").split():
        numbers = [int(x) for x in part.split(":")]
        out.update([numbers[0]] if len(numbers) == 1 else iterations(*numbers))
    return sorted(out)


def upsert_metrics(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that keeps one row an iteration, the last that came, whatever the order. Each batch is a folder of its own, so
    a batch that is run again replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number:09d}")

    return put


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.groupBy("iteration").agg(F.max_by(F.struct(*rows.columns), "batch").alias("r")).select("r.*").drop("batch")


class Progress:
    """Whether to go on after a run: failures without progress in a row may not exceed a limit; ends that are no failure
    (COMPLETED, TIMEOUT) never count."""

    FINE = ("COMPLETED", "TIMEOUT")

    def __init__(self, limit: int = 1) -> None:
        self.limit, self.failures, self.last = limit, 0, -1

    def go_on(self, state: str, reached: int) -> bool:
        if reached > self.last or state in self.FINE:
            self.failures = 0
        else:
            self.failures += 1
        self.last = max(self.last, reached)
        return self.failures <= self.limit
