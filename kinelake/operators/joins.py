"""Lookups: tasks, registries, nearest timestamps, ranges, audits. A side is broadcast only where Spark knows it to be small
or where its size is fixed by configuration (registries, modes, mixture leaves)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..sources.shared import together
from . import ranges

#: Rows up to which a table that was counted may be broadcast.
BROADCAST_ROWS = 100_000


def checked(rows: DataFrame, rules: dict[str, Column], name: str = "error") -> DataFrame:
    """rows with the name of the first rule that each of them breaks, null where it breaks none. A rule that is null for a row
    is broken. In place of an error that stops a job, broken rows can be set aside."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(rule)) for rule, ok in rules.items()]
    return rows.withColumn(name, F.coalesce(*broken, F.lit(None).cast("string")))


def quarantine(rows: DataFrame, name: str = "error") -> tuple[DataFrame, DataFrame]:
    """What broke no rule, without the column, and what did, with it."""
    return rows.where(F.col(name).isNull()).drop(name), rows.where(F.col(name).isNotNull())


def task_lookup(frames: DataFrame, tasks: DataFrame, key: str, value: str, required: bool = True) -> DataFrame:
    """frames with the task's ``value``. An unknown key is an error if required, else null."""
    found = frames.join(tasks.select(key, F.col(value), F.lit(True).alias("__known")), key, "left")
    if required:
        found = found.withColumn(value, F.when(F.col("__known"), F.col(value)).otherwise(F.raise_error(F.concat(F.lit(f"unknown {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))))
    return found.drop("__known")


def task_list(episodes: DataFrame, tasks: DataFrame, key: str, value: str) -> DataFrame:
    """episodes with ``tasks``: a sorted list of the values of its key, empty where there is none."""
    lists = tasks.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("tasks"))
    return episodes.join(lists, key, "left").withColumn("tasks", F.coalesce("tasks", F.array().cast("array<string>")))


def registry_lookup(rows: DataFrame, key: str, registry: DataFrame, tag: str) -> DataFrame:
    """Inner part of a registry whose tags are compared trimmed and without case; an unknown one is an error. The registry is
    counted, and broadcast if it has BROADCAST_ROWS at most."""
    names = registry.withColumn("__tag", F.lower(F.trim(tag))).drop(tag)
    names = F.broadcast(names) if names.count() <= BROADCAST_ROWS else names
    out = rows.join(names, F.lower(F.trim(key)) == F.col("__tag"), "left")
    return out.withColumn(key, F.when(F.col("__tag").isNotNull(), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("unknown tag: "), F.coalesce(F.col(key), F.lit("null")))))).drop("__tag")


def spec_modes(specs: DataFrame, modes: dict[str, float]) -> DataFrame:
    """Each spec with each mode of non-zero ratio."""
    rows = F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(float(r)).alias("mode_ratio")) for m, r in modes.items() if r != 0])
    return specs.select("*", F.inline(rows))


def nearest(requests: DataFrame, loaded: DataFrame, keys: list[str], at: str = "ts", index: str = "frame", span: int = ranges.SPAN) -> DataFrame:
    """requests with the ``index`` of the loaded row of the same keys whose ``at`` is nearest, the smaller index on a tie; null
    where the keys have none or ``at`` is null. An as-of sweep: both sides in one order, the last loaded row up to each row
    and, the other way, the first from it on. Requests go through the sweep as values, so no row is numbered and nothing is
    joined back. If a combination of keys has more rows than ``span``, the sweep goes by ranges: the last loaded row before
    a range and the first one after it are carried over, across ranges that have none."""
    none = F.lit(None)
    boxed = F.struct(F.col(at).alias("at"), F.col(index).alias("i"))
    # rows of one time: the smallest index stands for them
    firsts = loaded.where(F.col(at).isNotNull()).groupBy(*keys, at).agg(F.min(index).alias(index))
    firsts = firsts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(at).alias("__at"), boxed.alias("__box"), none.cast(requests.schema).alias("__row"), F.lit(0).alias("__salt"))
    row = F.struct(*requests.columns)
    asked = requests.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(at).alias("__at"), none.cast(firsts.schema["__box"].dataType).alias("__box"), row.alias("__row"))
    hashed = [c for c, kind in requests.dtypes if "map<" not in kind]
    both, names = together(firsts, asked.withColumn("__salt", F.lit(0))), [f"__k{i}" for i in range(len(keys))]
    if ranges.spread(both, names, span):  # many requests of one time may be in several ranges
        both = ranges.dealt(together(firsts, asked.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(f"__row.`{c}`") for c in hashed]), F.lit(1000)).cast("int") + 1)), names, ["__at", "__salt"], span)
        box = F.col("__box")
        best = ranges.scan(both, names, ["__at"], peers=True, b=ranges.latest(box, ["__at"]), a=ranges.latest(box, ["__at"], back=True))
    else:
        up = W.partitionBy(*names).orderBy("__at").rangeBetween(W.unboundedPreceding, W.currentRow)
        down = W.partitionBy(*names).orderBy(F.col("__at").desc()).rangeBetween(W.unboundedPreceding, W.currentRow)
        best = both.withColumn("b", F.last("__box", ignorenulls=True).over(up)).withColumn("a", F.last("__box", ignorenulls=True).over(down))
    best = best.where("__row is not null")
    far = lambda s: F.abs(s["at"].cast("double") - F.col("__at").cast("double"))
    pick = F.when(F.col("a").isNull() | (far(F.col("b")) < far(F.col("a"))), F.col("b.i")).when(F.col("b").isNull() | (far(F.col("a")) < far(F.col("b"))), F.col("a.i")).otherwise(F.least("a.i", "b.i"))
    return best.select("__row", F.when(F.col("__at").isNotNull(), pick).alias("__index")).select("__row.*", F.col("__index").alias(index))


def index_blocks(sizes: DataFrame, order: list[str], size: str = "size") -> DataFrame:
    """lo and hi of each leaf's contiguous block of a virtual index space, in order. One row a leaf."""
    end = F.sum(size).over(W.orderBy(*order)).cast("long")
    return sizes.withColumn("lo", end - F.col(size)).withColumn("hi", end)


def locate(indices: DataFrame, blocks: DataFrame, index: str = "idx") -> DataFrame:
    """indices with the block that holds each (lo <= index < hi) and ``local`` (its place there). Blocks are one row a
    leaf; bins of the mean block size make the join an equality."""
    width = blocks.agg(F.greatest(F.ceil(F.avg(F.col("hi") - F.col("lo"))), F.lit(1)).cast("long")).first()[0] or 1
    binned = blocks.where("hi > lo").withColumn("__bin", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    hit = (F.col("__of") == F.col("__bin")) & (F.col(index) >= F.col("lo")) & (F.col(index) < F.col("hi"))
    return indices.withColumn("__of", F.floor(F.col(index) / width)).join(binned, hit, "inner").withColumn("local", F.col(index) - F.col("lo")).drop("__bin", "__of")


def unique_lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows joined to the one row of a table that has the key; a key with none or several is an error."""
    counted = table.groupBy(key).agg(F.count("*").alias("__n"), F.first(F.struct(*[c for c in table.columns if c != key])).alias("__row"))
    out = rows.join(counted, key, "left")
    one = F.when(F.col("__n") == 1, F.col("__row")).otherwise(F.raise_error(F.concat(F.lit(f"{key} must match one row: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast(counted.schema["__row"].dataType))
    return out.withColumn("__row", one).select(*rows.columns, "__row.*")


def missing(required: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Required rows that are not present (audits of keys and of artifacts)."""
    return required.join(present.select(*keys).distinct(), keys, "left_anti")


def same_set(a: Column, b: Column) -> Column:
    """Whether two lists hold the same values, however often and in whatever order; null if one of them is null."""
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def all_tags(specs: DataFrame, registry: DataFrame, tag: str) -> DataFrame:
    """Each tag, once, that a spec names or the registry has; null is none."""
    return together(specs.select(tag), registry.select(tag)).where(F.col(tag).isNotNull()).distinct()


def re_root(path: Column, old: str, new: str) -> Column:
    """A path below ``old`` moved below ``new``; of any other only the last part is kept."""
    old = old.rstrip("/")
    tail = F.when(path.startswith(old + "/"), F.substr(path, F.lit(len(old) + 2))).otherwise(F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1))
    return F.concat(F.lit(new.rstrip("/") + "/"), tail)


def paired_frames(generated: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Frames that both have (so up to the shorter length)."""
    return generated.join(truth, keys, "inner")


def case_image(cases: DataFrame, files: DataFrame, name: str = "name", path: str = "path") -> DataFrame:
    """cases with ``image``: the file of exactly that path, else the first in order whose last part is that name; a case
    without any is an error."""
    direct = files.select(F.col(path).alias("__direct"))
    by_name = files.groupBy(F.element_at(F.split(path, "/"), -1).alias("__name")).agg(F.min(path).alias("__first"))
    out = cases.join(direct, F.col(name) == F.col("__direct"), "left").join(by_name, F.element_at(F.split(name, "/"), -1) == F.col("__name"), "left")
    found = F.coalesce("__direct", "__first")
    return out.withColumn("image", F.coalesce(found, F.raise_error(F.concat(F.lit("no image for "), F.col(name))))).drop("__direct", "__name", "__first")
