"""A training corpus from documents: known languages, near-duplicates removed, benchmarks removed, mixed, sharded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinelake.llm import decontam, langid, mixing, sharding, simhash
from kinelake.llm.common import new_folder, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; prototypes are learned from those that are not held out."""
    return langid.keep_known(docs, langid.learn(docs, ~langid.held_out(docs)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    return simhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no benchmark item."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources; a document that is taken twice stands there twice."""
    return mixing.take(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot."""
    return sharding.shard(docs, keep=True)


STAGES = [("language ID", language), ("near-duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("shards", shards)]
#: Hashes and vectors that SQL does not have; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
