"""Language ID by hyperdimensional profiles.

Letters have fixed random vectors of +1 and -1; a trigram's vector binds (multiplies) its letters' vectors, rotated by
their place; a text bundles (adds) the vectors of its trigrams, and a language's prototype those of its training texts.
The predicted language is the prototype of greatest cosine, after the mean of all prototypes' directions is taken from
each, so that what languages share decides nothing. All sums are integers, so no order of addition changes a result.

A text is its letters, lower-cased, with each run of other characters as one blank. Letters a-z and the 96 that follow
U+00DF have vectors of their own; all others share the rest by their code point.

Where documents of an unknown language are to go, a text must also reach a bound on its cosine, which is calibrated on the
labelled rows that are predicted right: SLACK times the QUANTILE of the cosines of texts with about as many trigrams (to a
power of two), or of longer ones if that is less. Texts shorter than every such row are too short to be judged and stay.

Defined cases: a null text, one without letters, and any text when nothing was learned, is ``und`` with score 0; rows
without lang teach nothing; ties go to the smaller language; rows that repeat an id are predicted each; an empty table
gives no row; columns other than doc_id, text and lang are ignored. The model has one prototype for each distinct lang,
which is what the driver and the tasks hold: DIM numbers times the number of languages, of which more than LANGUAGES are
an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_of_id

DIM, SYMBOLS, SEED, BLOCK, MERGE = 2048, 256, 6, 128, 64
#: Trigrams whose vectors are made at once, and distinct ones that a language's counts hold before they are bundled.
GRAMS, HELD = 1024, 1 << 20
UNKNOWN = "und"
#: Distinct values of lang beyond which learning is refused: each has a prototype in the driver and in every task.
LANGUAGES = 1000
QUANTILE, SLACK = 0.001, 0.75


@cache
def folding() -> np.ndarray:
    """Symbol of each code point: 0 for no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if (ch := chr(c)).isalpha():
            low = ord(ch.lower()[0])
            out[c] = low - 96 if 97 <= low <= 122 else low - 0xDF + 27 if 0xDF <= low < 0x13F else 123 + low % 133
    return out


@cache
def rolled() -> tuple[np.ndarray, ...]:
    """Vectors of the symbols at the first, second and third place of a trigram."""
    letters = np.random.default_rng(SEED).integers(0, 2, (SYMBOLS, DIM), np.int8) * 2 - 1
    return tuple(np.roll(letters, 2 - k, axis=1) for k in range(3))


def trigrams(text: str | None) -> np.ndarray:
    """The numbers of a text's trigrams; none if it has no letter."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    s = folding()[points]
    if not s.any():
        return s[:0]
    s = np.concatenate([[0], s, [0]]).astype(np.uint32)
    s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]
    return s[:-2] << 16 | s[1:-1] << 8 | s[2:]


def vectors(grams: np.ndarray) -> np.ndarray:
    a, b, c = rolled()
    return a[grams >> 16] * b[grams >> 8 & 255] * c[grams & 255]


class Profile:
    """The sum of the vectors of all trigrams of some texts, exactly. Texts come a few at a time, and the counts of distinct
    trigrams are bundled when more than HELD are at hand, so that memory does not grow with the texts."""

    def __init__(self) -> None:
        self.total = np.zeros(DIM, np.int64)
        self.grams, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def add(self, texts: list[str | None]) -> None:
        """Counts the trigrams of texts; none is copied longer than its piece is at hand."""
        for k in range(0, len(texts), BLOCK):
            found = [np.unique(g, return_counts=True) for t in texts[k : k + BLOCK] if len(g := trigrams(t))]
            if not found:
                continue
            grams, at = np.unique(np.concatenate([self.grams, *(g for g, _ in found)]), return_inverse=True)
            counts = np.zeros(len(grams), np.int64)
            np.add.at(counts, at, np.concatenate([self.counts, *(n for _, n in found)]))
            self.grams, self.counts = grams, counts
            if len(grams) > HELD:
                self.bundled()

    def bundled(self) -> np.ndarray:
        for k in range(0, len(self.grams), GRAMS):
            self.total += np.rint(self.counts[k : k + GRAMS].astype(np.float64) @ vectors(self.grams[k : k + GRAMS]).astype(np.float64)).astype(np.int64)
        self.grams, self.counts = self.grams[:0], self.counts[:0]
        return self.total


def bundle(texts: list[str | None]) -> np.ndarray:
    profile = Profile()
    profile.add(texts)
    return profile.bundled()


def learn(docs: DataFrame, training: Column) -> dict[str, np.ndarray]:
    """The prototype of each language: partial sums from each task, added up in two rounds."""
    schema = "lang string, part int, bundle array<long>"
    labelled = docs.where(training & F.col("lang").isNotNull())
    if labelled.select("lang").distinct().limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"lang has more than {LANGUAGES} values; it does not name languages")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, profiles = TaskContext.get().partitionId(), {}
        for b in batches:
            langs = b.column("lang").to_numpy(zero_copy_only=False)
            for lang in np.unique(langs):
                here = np.flatnonzero(langs == lang)
                for k in range(0, len(here), BLOCK):
                    profiles.setdefault(lang, Profile()).add(b.column("text").take(pa.array(here[k : k + BLOCK])).to_pylist())
        if profiles:
            yield pa.RecordBatch.from_pydict({"lang": list(profiles), "part": [part] * len(profiles), "bundle": [p.bundled() for p in profiles.values()]}, pa.schema([("lang", pa.string()), ("part", pa.int32()), ("bundle", pa.list_(pa.int64()))]))

    def add(group: pa.Table) -> pa.Table:
        total = group.column("bundle").combine_chunks().flatten().to_numpy().reshape(-1, DIM).sum(axis=0)
        return pa.table({"lang": group.column("lang")[:1], "part": pa.array([0], pa.int32()), "bundle": pa.array([total], pa.list_(pa.int64()))})

    parts = labelled.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(sums, schema)
    some = parts.groupBy("lang", F.col("part") % MERGE).applyInArrow(lambda _, g: add(g), schema)
    return {r["lang"]: np.array(r["bundle"], np.int64) for r in some.groupBy("lang").applyInArrow(lambda _, g: add(g), schema).collect()}


def directions(model: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes as unit rows, without what all share."""
    langs = sorted(k for k, v in model.items() if v.any())
    rows = np.array([model[k] / np.linalg.norm(model[k]) for k in langs]).reshape(-1, DIM)
    if len(langs) > 1:
        rows = rows - rows.mean(axis=0)
        rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    return langs, rows


def classify(texts: pa.Array, langs: list[str], rows: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The language of each text, its score, half of one plus the cosine, and its trigrams. Texts are read BLOCK at a time."""
    names, scores, sizes = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for k in range(0, len(texts), BLOCK):
        found = [(i, *np.unique(g, return_counts=True)) for i, t in enumerate(texts[k : k + BLOCK], k) if len(g := trigrams(t.as_py()))]
        if not found or not langs:
            continue
        grams = np.unique(np.concatenate([g for _, g, _ in found]))
        bundles = np.zeros((len(found), DIM), np.float32)
        for a in range(0, len(grams), GRAMS):
            some = grams[a : a + GRAMS]
            counts = np.zeros((len(found), len(some)), np.float32)
            for at, (_, g, n) in enumerate(found):
                lo, hi = np.searchsorted(g, [some[0], some[-1]], side="left")
                hi += hi < len(g) and g[hi] == some[-1]
                counts[at, np.searchsorted(some, g[lo:hi])] = n[lo:hi]
            bundles += counts @ vectors(some).astype(np.float32)
        norms = np.linalg.norm(bundles.astype(np.float64), axis=1, keepdims=True)
        cosines = np.round(bundles.astype(np.float64) @ rows.T / np.maximum(norms, 1e-12), 6)
        best = cosines.argmax(axis=1)
        for at, (i, _, n) in enumerate(found):
            names[i], scores[i], sizes[i] = langs[best[at]], min(1.0, max(0.0, (1 + cosines[at, best[at]]) / 2)), n.sum()
    return names, scores, sizes


def judged(text: Column, model: dict[str, np.ndarray]) -> Column:
    """A struct of lang_pred and score for a text; only that comes back from Python, not the text."""
    langs, rows = directions(model)

    @F.arrow_udf("lang_pred string, score double")
    def judge(texts: pa.Array) -> pa.Array:
        names, scores, _ = classify(texts, langs, rows)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], ["lang_pred", "score"])

    return judge(text.cast("string"))


def predict(docs: DataFrame, model: dict[str, np.ndarray], keep: list[str] = ["doc_id"]) -> DataFrame:
    """The columns ``keep`` of docs, lang_pred and score for each row."""
    return docs.select(*keep, judged(docs["text"], model).alias("__judged")).select(*keep, "__judged.lang_pred", "__judged.score")


def classes(sizes: np.ndarray) -> np.ndarray:
    """Texts of about as many trigrams: the power of two below."""
    return np.log2(np.maximum(sizes, 1)).astype(np.int64)


def bounds(docs: DataFrame, model: dict[str, np.ndarray]) -> np.ndarray:
    """The least cosine of a text of a known language, by class."""
    langs, rows = directions(model)

    def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores, sizes = classify(b.column("text"), langs, rows)
            right = np.array(names, object) == b.column("lang").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(classes(sizes)[right]), pa.array(2 * scores[right] - 1)], ["class", "cosine"])

    labelled = docs.where(F.col("lang").isNotNull()).select(F.col("lang").cast("string"), F.col("text").cast("string"))
    right = labelled.mapInArrow(cosines, "class long, cosine double").groupBy("class").agg(F.percentile_approx("cosine", QUANTILE, 100_000).alias("least"))
    out = np.full(64, np.inf)
    for r in right.collect():
        out[r["class"]] = SLACK * r["least"]
    seen = np.flatnonzero(np.isfinite(out))
    if not len(seen):
        return np.full(64, -1.0)
    out[seen[-1] :] = out[seen[-1]]
    out = np.minimum.accumulate(out[::-1])[::-1]
    out[: seen[0]] = -1.0
    return out


def keep_known(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """docs without the rows whose language is unknown: those without letters, and those below the bound of their class."""
    (langs, rows), least = directions(model), bounds(docs, model)

    @F.arrow_udf("boolean")
    def known(texts: pa.Array) -> pa.Array:
        names, scores, sizes = classify(texts, langs, rows)
        return pa.array((np.array(names, object) != UNKNOWN) & (2 * scores - 1 >= least[classes(sizes)]), pa.bool_())

    return docs.where(known(docs["text"].cast("string")))


def held_out(docs: DataFrame) -> Column:
    return crc_of_id(docs["doc_id"]) % 4 == 2


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows that are not held out."""
    model = learn(docs, ~held_out(docs))
    out = predict(docs, model)
    return out.select("doc_id", held_out(out).alias("held_out"), "lang_pred", "score")
