"""The folder that driver and executors share, and tables that are fixed there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a local folder if the master is local; on a cluster that is an error."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="kinelake-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str = "scratch") -> str:
    """A path of its own below the shared folder."""
    return f"{shared_folder(spark)}/kinelake-{name}-{uuid.uuid4().hex}"


def fixed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: what its rows say about their partitions stays true, and a lost
    executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def together(first: DataFrame, *others: DataFrame) -> DataFrame:
    """The rows of all, by name of column. Spark 4.1 takes a union of inputs that are dealt by the same key as dealt by it too, but
    adaptive execution may have merged their partitions unequally; a grouping above then gives a key twice. The session
    is told not to rely on that, which costs such a grouping a shuffle."""
    first.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    for df in others:
        first = first.unionByName(df)
    return first


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ours, if it is there."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
