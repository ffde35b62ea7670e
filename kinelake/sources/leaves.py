"""Readers and writers of trajectory data sets. A leaf is a directory with data/, meta/ and perhaps videos/.

All reading goes through Spark's own readers, so leaves may be in any store that Spark knows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import episode_of

EPISODES = "episode_index long, tasks array<string>, length long"
TASKS = "task_index long, task string"
ENTRY = "struct<start:int,end:int,rotation_type:string,absolute:boolean,dtype:string,range:array<double>,original_key:string>"
MODALITY = f"state map<string,{ENTRY}>, action map<string,{ENTRY}>, video map<string,struct<original_key:string>>, annotation map<string,struct<original_key:string>>"
FEATURE = "struct<dtype:string,shape:array<int>,names:string>"
INFO = f"codebase_version string, robot_type string, total_episodes long, total_frames long, chunks_size long, fps double, splits map<string,string>, data_path string, video_path string, features map<string,{FEATURE}>"
ACCOUNTING = "JobID string, JobIDRaw string, Elapsed string, ElapsedRaw string, NNodes string, AllocNodes string, State string"
#: Metadata files in order of preference.
MODALITY_FILES = ("modality-44D.json", "modality.json")


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def _children(spark: SparkSession, path: str) -> list[str]:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(hadoop)
    return sorted(str(s.getPath().toString()) for s in listed if s.isDirectory())


def discover(spark: SparkSession, path: str, marker: str = "meta/modality.json") -> list[str]:
    """All leaves at and below a path, at any depth, in order: directories that have the marker. Directories below a leaf are
    looked through as well, but for those of its own data, metadata and videos, which hold most files."""
    found, todo = [], [path.rstrip("/")]
    while todo:
        here = todo.pop()
        own = _exists(spark, f"{here}/{marker}")
        found += [here] * own
        todo += [c for c in _children(spark, here) if not (own and c.rsplit("/", 1)[-1] in ("data", "meta", "videos"))]
    return sorted(found)


def frames(spark: SparkSession, leaf: str, columns: list[str] | None = None, tolerant: bool = False) -> DataFrame:
    """All frames of a leaf, of either layout of file names, with ``episode`` from the file's name where that has a number
    and the file has no episode_index. tolerant: missing and broken files give no row."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    if tolerant:
        reader = reader.option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true")
    df = reader.parquet(f"{leaf}/data")
    named = episode_of(F.col("_metadata.file_name"))
    episode = F.coalesce(F.col("episode_index"), named) if "episode_index" in df.columns else named
    return df.select(*[F.col(f"`{c}`") for c in (columns or df.columns)], episode.alias("episode"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blank lines are no rows."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", schema).alias("r")).select("r.*")


def episodes(spark: SparkSession, leaf: str) -> DataFrame:
    return json_lines(spark, f"{leaf}/meta/episodes.jsonl", EPISODES)


def tasks(spark: SparkSession, leaf: str) -> DataFrame:
    return json_lines(spark, f"{leaf}/meta/tasks.jsonl", TASKS)


def info(spark: SparkSession, leaf: str) -> DataFrame:
    return spark.read.schema(INFO).json(f"{leaf}/meta/info.json", multiLine=True)


def modality(spark: SparkSession, leaf: str, explicit: str | None = None) -> DataFrame:
    """The modality file: the explicit one, else the first of MODALITY_FILES that exists; an error names what was expected."""
    names = [explicit] if explicit else MODALITY_FILES
    for name in names:
        if _exists(spark, f"{leaf}/meta/{name}"):
            return spark.read.schema(MODALITY).json(f"{leaf}/meta/{name}", multiLine=True)
    raise FileNotFoundError(f"none of {', '.join(names)} in {leaf}/meta")


def modality_entries(modality: DataFrame) -> DataFrame:
    """kind, key (``kind.name``), original_key, start, end, width, absolute (true if not said), rotation_type, dtype."""
    one = lambda kind, raw: modality.select(F.lit(kind).alias("kind"), F.explode(kind).alias("name", "e")).select("kind", F.concat_ws(".", "kind", "name").alias("key"), F.coalesce("e.original_key", F.lit(raw)).alias("original_key"), "e.start", "e.end", (F.col("e.end") - F.col("e.start")).alias("width"), F.coalesce("e.absolute", F.lit(True)).alias("absolute"), "e.rotation_type", F.coalesce("e.dtype", F.lit("float64")).alias("dtype"))
    return one("state", "observation.state").unionByName(one("action", "action"))


def feature_summary(info: DataFrame, most: int = 64) -> DataFrame:
    """name, dtype, shape, names (null if longer than most characters)."""
    return info.select(F.explode("features").alias("name", "f")).select("name", "f.dtype", "f.shape", F.when(F.length("f.names") <= most, F.col("f.names")).alias("names"))


def episode_path(template: Column, episode: Column, chunk_size: Column) -> Column:
    """A path template with its chunk (three digits) and episode (six) filled in; the v3 names of files too."""
    chunk = F.lpad(F.floor(episode / chunk_size).cast("string"), 3, "0")
    out = F.regexp_replace(template, r"\{(episode_chunk|chunk_index)(:03d)?\}", chunk)
    return F.regexp_replace(out, r"\{(episode_index|episode_file|file_index)(:0\dd)?\}", F.lpad(episode.cast("string"), 6, "0"))


def is_engagement_set(keys: Column) -> Column:
    """Whether both engagement flags are among the keys; false for null."""
    return F.coalesce(F.array_contains(keys, "hapticengaged_left") & F.array_contains(keys, "hapticengaged_right"), F.lit(False))


def accounting(spark: SparkSession, path: str) -> DataFrame:
    """Rows that a scheduler's accounting printed, fields between bars and without a head."""
    return spark.read.schema(ACCOUNTING).csv(path, sep="|")


def video_files(spark: SparkSession, leaf: str, pattern: str = "*.mp4") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(f"{leaf}/videos")


def files_below(spark: SparkSession, path: str, suffix: str) -> list[str]:
    """Paths of all files below a folder that end so, in order; only names are listed."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found, out = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(folder, True), []
    while found.hasNext():
        out.append(found.next().getPath().toString())
    return sorted(f for f in out if f.endswith(suffix))


def first_file(spark: SparkSession, leaf: str, rows: int) -> DataFrame:
    """The first rows of the first Parquet file in order of paths."""
    files = files_below(spark, f"{leaf}/data", ".parquet")
    if not files:
        raise FileNotFoundError(f"no Parquet file below {leaf}/data")
    return spark.read.parquet(files[0]).limit(rows)


def read_spec(spark: SparkSession, folder: str, control: str, allowed: tuple[str, ...]) -> DataFrame:
    """The specification of a control, one JSON object in the file of that name, as one row. Controls other than the allowed
    ones and missing files are errors."""
    if control not in allowed:
        raise ValueError(f"unknown control {control!r}; one of {allowed}")
    path = f"{folder}/{control}.json"
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.json(path, multiLine=True, mode="FAILFAST")


# sinks


def write_json_lines(rows: DataFrame, path: str, columns: list[str] | None = None, mode: str = "errorifexists") -> None:
    """One JSON object a line."""
    rows.select(F.to_json(F.struct(*(columns or rows.columns))).alias("value")).write.mode(mode).text(path)


def write_episodes(episodes: DataFrame, path: str, dry_run: bool = False) -> DataFrame:
    """Writes episodes unless their ids are not 0 to N - 1; returns what was checked."""
    from ..operators.steps import validate_episodes

    checked = validate_episodes(episodes, "episode_index")
    if not checked.first()["contiguous"]:
        raise ValueError("episode ids are not 0 to N - 1")
    if not dry_run:
        write_json_lines(episodes.orderBy("episode_index"), path)
    return checked


def write_statistics(stats: DataFrame, path: str, provenance: dict[str, str], force: bool = False) -> None:
    """Statistics with provenance columns. Ones of another provenance are not overwritten unless forced; a stamp of the time
    is added."""
    spark = stats.sparkSession
    if _exists(spark, path) and not force:
        old = spark.read.parquet(path).select(*provenance).first()
        if old is not None and old.asDict() != provenance:
            raise FileExistsError(f"{path} holds statistics of another provenance: {old.asDict()}")
    stamped = stats.withColumns({k: F.lit(v) for k, v in provenance.items()}).withColumn("written_at", F.current_timestamp())
    replace(stamped, path)


def replace(rows: DataFrame, path: str) -> None:
    """Writes beside the old folder, moves that aside and takes its place, so that one of the two is there whole at any time;
    what a run that broke off has left aside is put back first."""
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    new, here, aside = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.new", path, f"{path}.old"))
    fs = new.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(aside) and not fs.exists(here):
        fs.rename(aside, here)
    rows.write.mode("overwrite").parquet(f"{path}.new")
    fs.delete(aside, True)
    if fs.exists(here) and not fs.rename(here, aside):
        raise OSError(f"{path} could not be moved aside")
    if not fs.rename(new, here):
        fs.rename(aside, here)
        raise OSError(f"{path}.new could not take the place of {path}")
    fs.delete(aside, True)


def write_filter_cache(steps: DataFrame, path: str) -> None:
    """Valid steps, by leaf."""
    steps.write.mode("errorifexists").partitionBy("leaf").parquet(path)


def cached_steps(spark: SparkSession, path: str) -> DataFrame:
    """leaf and the number of valid steps that the cache holds for it."""
    return spark.read.parquet(path).groupBy("leaf").agg(F.count("*").alias("steps"))
