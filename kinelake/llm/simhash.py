"""SimHash near-duplicates by multi-index hashing.

Fingerprints are made in one Arrow pass over the texts. Equal ones collapse to one node, the smallest doc_id that has it.
The 64 bits are cut into segments whose radii add up to ``bits - segments + 1`` at least, so two fingerprints within
``bits`` agree within the radius in one segment (pigeonhole). Each fingerprint stands in one table a segment; probes, the
Hamming ball of that radius around a fingerprint's segment, fetch matches, and complete distances are verified within
the join. A table key that more than HOT fingerprints share would give all their pairs; such keys go to tiles of bounded
size instead, in which a fingerprint is only compared with what is not yet linked to it, so a dense group costs about
its size and gives a spanning forest. A key that more than TILE share is split first, by the parts of the bits that it
leaves open (of bits + 1 parts, linked fingerprints share one), and only a part that many share goes to tiles. Nothing is
capped: tiles and parts cover every link of a hot key.

Defined cases: null and empty texts have fingerprint zero and link like any other; rows without doc_id have a fingerprint
and no component, and link nothing; rows that repeat an id are nodes of that id; an empty table gives no row; columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, small_join
from .components import components

SEED, HOT, TILE, BLOCK = 42, 64, 8192, 16384
#: The part of a hot key that is not split.
WHOLE = -1


def fingerprint(text: str | None, width: int = 4) -> int:
    """Bits set in over half the XXH64 values of the word shingles of a text, as an unsigned 64-bit number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(words) <= width:
        return hashed(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n, votes = len(words) - width + 1, np.zeros(64, np.int64)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    stops = ends[width - 1 :].tolist()
    for k in range(0, n, BLOCK):
        h = np.array([hashed(line[a:b], SEED) for a, b in zip(starts[k : k + BLOCK], stops[k : k + BLOCK], strict=True)], np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((votes * 2 > n).dot(1 << np.arange(64, dtype=object)))


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in b.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def layout(n: int, bits: int) -> list[tuple[int, int, int]]:
    """(first bit, width, radius) of each segment: three segments up to 2 ** 26 fingerprints, two beyond, where larger
    balls buy longer keys. Any layout finds every link."""
    m = 3 if n <= 2**26 else 2
    m = min(m, bits + 1)
    edges = [round(64 * i / m) for i in range(m + 1)]
    spare = bits - m + 1
    return [(a, b - a, spare // m + (i < spare % m)) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]


def ball(width: int, radius: int) -> list[int]:
    """All masks of ``width`` bits with at most ``radius`` set."""
    masks = level = {0}
    for _ in range(radius):
        level = {m | 1 << i for m in level for i in range(width)} - masks
        masks = masks | level
    return sorted(masks)


def open_bits(first: int, width: int, bits: int) -> list[int]:
    """Masks (as longs) that cut the bits outside a segment into bits + 1 parts, of which two fingerprints within ``bits`` share
    one at least; one empty mask where there are too few bits for that."""
    rest = [i for i in range(64) if not first <= i < first + width]
    if len(rest) <= bits:
        return [0]
    edges = [round(len(rest) * i / (bits + 1)) for i in range(bits + 2)]
    masks = [sum(1 << i for i in rest[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    return [m - (m >> 63 << 64) for m in masks]


def forest(tables: np.ndarray, probes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join up every two members, one from each array, within ``bits``: those that a search from each table
    member finds among probes not yet linked to it."""
    left, right = [], []
    table_todo, probe_todo = np.unique(tables), np.unique(probes)
    while len(table_todo):
        front_t, table_todo = table_todo[:1], table_todo[1:]
        free = probe_todo  # probes that this component has not reached
        front_p = free[:0]
        while len(front_t) or len(front_p):
            if len(front_t):
                x, front_t = front_t[0], front_t[1:]
                near = np.bitwise_count(free ^ x) <= bits
                front_p, found, free = np.concatenate([front_p, free[near]]), free[near], free[~near]
            else:
                x, front_p = front_p[0], front_p[1:]
                near = np.bitwise_count(table_todo ^ x) <= bits
                front_t, found, table_todo = np.concatenate([front_t, table_todo[near]]), table_todo[near], table_todo[~near]
            found = found[found != x]
            left.append(np.full(len(found), x, np.uint64))
            right.append(found)
        probe_todo = free  # a reached probe's other links lead to members of the same component
    return np.concatenate(left), np.concatenate(right)


def links(nodes: DataFrame, bits: int = 4) -> DataFrame:
    """a, b: fingerprints (longs, column fp of nodes, each once) whose links, transitively, are those of all pairs within
    ``bits``; of pairs whose key is not hot, every one."""
    parts = layout(nodes.count(), bits)
    key = lambda c, first, width: F.shiftrightunsigned(c, first).bitwiseAND(F.lit((1 << width) - 1 if width < 63 else -1))
    rows = F.array(*[F.struct(F.lit(i).alias("seg"), key(F.col("fp"), a, w).alias("key")) for i, (a, w, _) in enumerate(parts)])
    tables = nodes.select(F.inline(rows), F.col("fp").alias("a"))

    def probes_of(i: int, first: int, width: int, radius: int) -> Column:
        own = key(F.col("fp"), first, width)
        return F.transform(F.array(*[F.lit(m).cast("long") for m in ball(width, radius)]), lambda m: F.struct(F.lit(i).alias("seg"), own.bitwiseXOR(m).alias("key")))

    balls = [probes_of(i, *part) for i, part in enumerate(parts)]
    probes = nodes.select(F.inline(F.concat(*balls)), F.col("fp").alias("b"))
    hot = cut(tables.groupBy("seg", "key").agg(F.count("*").alias("n")).where(F.col("n") > HOT))
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits) & (F.col("a") != F.col("b"))
    if hot.isEmpty():
        return tables.join(probes, ["seg", "key"]).where(near & (F.col("a") < F.col("b"))).select("a", "b").distinct()
    marked_t, marked_p = (small_join(x, hot.select("seg", "key", "n"), ["seg", "key"]) for x in (tables, probes))
    cold = marked_t.where("n is null").join(marked_p.where("n is null"), ["seg", "key"]).where(near & (F.col("a") < F.col("b"))).select("a", "b").distinct()
    # a hot key's probes are up to a ball's size times its fingerprints: they are dealt to as many more tiles
    spread = max(len(ball(w, r)) for _, w, r in parts)
    whole = [F.lit(WHOLE).alias("part"), F.lit(0).cast("long").alias("value"), F.lit(1).alias("tiles"), F.lit(spread).alias("cols")]
    t, p = (x.where(F.col("n") <= TILE).select("seg", "key", *whole, F.col(fp).alias("fp")) for x, fp in ((marked_t, "a"), (marked_p, "b")))
    if not hot.where(F.col("n") > TILE).isEmpty():
        # the bits that a very hot key leaves open are cut into one part more than bits may differ: links agree in one of them
        cuts = F.create_map(*[x for i, (a, w, _) in enumerate(parts) for x in (F.lit(i), F.array(*[F.lit(m) for m in open_bits(a, w, bits)]))])
        some = lambda x, fp: x.where(F.col("n") > TILE).select("seg", "key", F.posexplode(F.element_at(cuts, F.col("seg"))).alias("part", "mask"), F.col(fp).alias("fp")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask"))).drop("mask")
        sub_t, sub_p = some(marked_t, "a"), some(marked_p, "b")
        sub = ["seg", "key", "part", "value"]
        sizes = cut(sub_t.groupBy(*sub).agg(F.count("*").alias("n")).join(sub_p.groupBy(*sub).agg(F.count("*").alias("m")), sub))
        dealt = sizes.where(F.col("n") > HOT).select(*sub, F.ceil(F.col("n") / TILE).cast("int").alias("tiles"), F.ceil(F.col("m") / TILE).cast("int").alias("cols"))
        sub_t, sub_p = (small_join(x, dealt, sub) for x in (sub_t, sub_p))
        few = sub_t.where("tiles is null").withColumnRenamed("fp", "a").join(sub_p.where("tiles is null").withColumnRenamed("fp", "b"), sub)
        cold = cold.union(few.where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        t, p = (x.union(y.where("tiles is not null").select(*x.columns)) for x, y in ((t, sub_t), (p, sub_p)))
    tile = lambda n: F.pmod(F.xxhash64("fp"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    t = t.select("seg", "key", "part", "value", tile(F.col("tiles")).alias("ti"), every(F.col("cols")).alias("tj"), "fp")
    p = p.select("seg", "key", "part", "value", every(F.col("tiles")).alias("ti"), tile(F.col("cols")).alias("tj"), "fp")
    names = ["seg", "key", "part", "value", "ti", "tj"]

    def pairs(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.uint64)] * 2
        if left.num_rows and right.num_rows:
            found = forest(*(x.column("fp").to_numpy().astype(np.int64).view(np.uint64) for x in (left, right)), bits)
        return pa.table({k: pa.array(x.view(np.int64)) for k, x in zip("ab", found, strict=True)})

    dense = t.groupBy(*names).cogroup(p.groupBy(*names)).applyInArrow(pairs, "a long, b long")
    return cold.union(dense)


def linked(docs: DataFrame, bits: int, width: int, ids: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """doc_id, fp of each row; each fp of rows with a doc_id (without ``ids``, of all rows) and the smallest of these (rep);
    links of fingerprints."""
    fps = cut(fingerprints(docs, width))
    nodes = cut((fps.where("doc_id is not null") if ids else fps).groupBy("fp").agg(F.min("doc_id").alias("rep")))
    return fps, nodes, links(nodes.select("fp"), bits)


def near_duplicates(docs: DataFrame, bits: int = 4, width: int = 4) -> DataFrame:
    """doc_id, fp, component_id for each row."""
    fps, nodes, found = linked(docs, bits, width)
    ends = nodes.select(F.col("fp").alias("a"), F.col("rep").alias("rep_a"))
    found = found.join(ends, "a").join(ends.toDF("b", "rep_b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    classes = components(found)
    named = nodes.join(classes, nodes["rep"] == classes["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def marked(text: Column, width: int = 4) -> Column:
    """The fingerprint of a text, as a long."""

    @F.arrow_udf("long")
    def mark(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py(), width) for t in texts], np.uint64).view(np.int64))

    return mark(text.cast("string"))


def first_of(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``columns`` of the first row of each key, by all of its columns that have an order."""
    plain = [F.col(f.name) for f in rows.select(*columns).schema if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    top = F.min_by(F.struct(*columns), F.struct(*plain, F.lit(0).alias("__none")))
    return rows.groupBy(*keys).agg(top.alias("__row")).select("__row.*")


def deduplicate(docs: DataFrame, bits: int = 4, width: int = 4) -> DataFrame:
    """docs with one row of each class of linked fingerprints, that of its smallest doc_id (of rows without one, if it has
    only these). Rows that repeat an id but not a text are judged each by its own text; of rows that share both id and
    fingerprint, the first by its columns stays (rows that differ in maps only: any of them)."""
    fps, nodes, found = linked(docs, bits, width, ids=False)
    classes = components(found)
    row = F.struct(F.col("rep").isNull().alias("none"), F.col("rep").alias("doc_id"), "fp").alias("row")
    named = nodes.join(classes, nodes["fp"] == classes["node"], "left").select(F.coalesce("component", "fp").alias("class"), row)
    stays = cut(named.groupBy("class").agg(F.min("row").alias("row")).select("row.doc_id", "row.fp"))
    ids = fps.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"))
    ids = cut(ids.join(stays.select("doc_id", F.lit(True).alias("stays")).distinct(), "doc_id", "left"))
    gone = ids.where("stays is null").select(F.col("doc_id").alias("__gone"))
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    nameless = not fps.where("doc_id is null").isEmpty()
    kept = docs.join(gone, docs["doc_id"] == F.col("__gone"), "left_anti")
    again = ids.where("stays and rows > 1").select("doc_id", F.lit(True).alias("__again"))
    if nameless:
        kept = kept.where("doc_id is not null")
    judged = []
    if not again.isEmpty():
        # ids that several rows share and of which some row stays
        parted = small_join(kept, again, ["doc_id"])
        shared = parted.where("__again").select(*docs.columns, marked(F.col("text"), width).alias("__fp"))
        judged.append(shared.join(stays.select("doc_id", F.col("fp").alias("__fp")), ["doc_id", "__fp"], "left_semi"))
        kept = parted.where("__again is null").select(*docs.columns)
    if nameless:
        # fingerprints that only rows without an id have, one of each class
        rest = docs.where("doc_id is null").select("*", marked(F.col("text"), width).alias("__fp"))
        judged.append(small_join(rest, stays.where("doc_id is null").select(F.col("fp").alias("__fp"), F.lit(True).alias("__stays")), ["__fp"]).where("__stays").drop("__stays"))
    for rows in judged:
        kept = kept.unionByName(first_of(rows, ["doc_id", "__fp"], docs.columns))
    return kept
