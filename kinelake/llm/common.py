"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows up to which a table that was counted may be broadcast.
BROADCAST_ROWS = 100_000
#: Whether Spark removes the shuffle files of a query when that ends.
REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SALTS = 32


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, as in tests, a local one, but on
    a cluster that is an error: executors could not read it."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="kinelake-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_dir(spark)}/kinelake-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor costs no recomputation. The shuffle files that
    led to it are of no more use, and Spark is told to remove them when it is done."""
    shared_dir(df.sparkSession)
    conf = df.sparkSession.conf
    before = conf.get(REMOVE_SHUFFLES, None)
    conf.set(REMOVE_SHUFFLES, "true")
    try:
        return df.select("*").checkpoint()
    finally:
        conf.unset(REMOVE_SHUFFLES) if before is None else conf.set(REMOVE_SHUFFLES, before)


def spool(df: DataFrame, name: str) -> DataFrame:
    """df, written as a table in the shared folder and read again: like cut, in columns, and so smaller."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*kept: DataFrame) -> None:
    """Deletes what cut has kept, once nothing that is still to run reads it."""
    for df in kept:
        path = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get()
        jvm, hadoop = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(hadoop).delete(folder, True)


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(c, UPPER, LOWER)


def crc_of_id(c: Column) -> Column:
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def small_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """big joined to small on keys, where null equals null. small, one row for each key, is counted: up to ``limit``
    rows it is broadcast; beyond, each of its rows is spread over SALTS salts, so that a key with very many rows in
    big is dealt to as many tasks."""
    named = small.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in small.columns if c not in keys])
    if small.count() <= limit:
        on, named = F.lit(True), F.broadcast(named)
    else:
        named = named.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hashed = [c for c, kind in big.dtypes if "map<" not in kind and "variant" not in kind]
        big = big.withColumn("__of", F.pmod(F.xxhash64(*hashed), F.lit(SALTS)).cast("int"))
        on = F.col("__of") == F.col("__salt")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return big.join(named, on, how).drop("__of", "__salt", *[f"__{k}" for k in keys])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
