"""Alignment of tokenizers, audit of filters and nearest neighbours against brute force, and on the cases that docstrings define."""

import collections
import functools
import hashlib
import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinelake.llm import align, ann, audit, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, at long, chunk long, pair long, part string, good boolean, digest binary, times int, A int"
LONG = "Alpha beta gämma delta 漢字 " * 20_000


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, s, 1, 2, 3, "p", True, b"d", 4, 5) for i, t, s in rows], DOCS)


ODD = [
    (None, "a null id with some words", "a"), (1, None, "a"), (2, "", "b"), (3, "!!! 123", None), (4, LONG, "a"), (5, "same row twice here", "a"), (5, "same row twice here", "a"), (6, "same row twice here", ""),
    (7, "ünï çödé 漢字 \U0001f600 \x00 x", "a"), (8, "▁ a piece that says itself", "b"), (9, " two  spaces \n\n\n and lines\t", "b"), (10, "<s> <|endoftext|> </s> <0x41>", "b"), (11, "a" * 3000 + "é" * 999, "b"), (None, None, None),
]


# alignment


def encoders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")


def brute_alignment(texts):
    """By sets of byte places of every token."""
    a, b = encoders()
    byte = align.Sides.of(align.TOKENIZERS)
    out, held = [], collections.Counter()
    for text in texts:
        ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)] if text else [[], []]
        spans = []
        for x, names in zip(ids, (byte.a.bytes, byte.b.bytes), strict=True):
            ends = list(itertools.accumulate(len(names[i]) for i in x))
            spans.append(list(zip([0, *ends], ends, x, strict=False)))
            if b"".join(names[i] for i in x) != (" " + (text or "")).encode() or not text:
                spans = [[], []]
                break
        both = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, low = [], 0
        for high in both:
            groups.append("|".join(",".join(str(i) for _, e, i in side if low < e <= high) for side in spans))
            low = high
        links, at = [], 0
        for begin, end, i in spans[0]:
            while at < len(spans[1]) and spans[1][at][1] <= begin:
                at += 1
            k = at
            while k < len(spans[1]) and spans[1][k][0] < end:
                links.append((i, spans[1][k][2]))
                k += 1
        held.update(set(links))
        out.append((spans, groups, links))
    most = collections.defaultdict(int)
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    digest = lambda groups: hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
    return [(len(s[0]), len(s[1]), len(g), len(links), sum(held[x] == most[x[0]] for x in links), sum(held[x] for x in links), digest(g)) for s, g, links in out]


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def aligned(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_align(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()
    rows = [*map(tuple, rows), *[r for r in ODD if r[1] != LONG]]
    got = aligned(align.align(docs(spark, rows)))
    assert got == sorted(((r[0], *x) for r, x in zip(rows, brute_alignment([r[1] for r in rows]), strict=True)), key=str)
    assert sum(r[1] > 0 for r in got) > 200 and (8, 0, 0, 0, 0, 0, 0, "") in got


def test_align_long_and_empty(spark):
    (got,) = aligned(align.align(docs(spark, [(4, LONG, "a")])))
    spelled = align.Sides.of(align.TOKENIZERS).tokens(LONG)
    assert got[1:3] == tuple(map(len, spelled)) and got[4] >= max(got[1:3]) and got[5] <= got[4] == got[6]
    assert align.align(docs(spark, [])).collect() == []


@pytest.mark.parametrize(("slices", "block"), [(1, 3), (60, 4), (10**9, 4096)])
def test_slices_change_nothing(monkeypatch, slices, block):
    """However few events the machine takes at once, documents come out the same."""
    monkeypatch.setattr(align, "SLICE", slices)
    texts = ["", "alpha beta, gamma! " * 9, "x", "aaaa" * 50, "漢字 und mehr " * 7]
    machine, segments = align.Sweep(0, align.TOKENIZERS), []
    for n, text in enumerate(texts):
        ids = machine.sides.tokens(text)
        blocks = [(0, -1, np.zeros(0, np.int64))]
        if ids:
            blocks = []
            for side, x in enumerate(ids):
                ends = np.cumsum(machine.sides.lengths[side][x])
                blocks += [(int(ends[i - 1]) if i else 0, side, x[i : i + block]) for i in range(0, len(x), block)]
        for at, side, x in sorted(blocks, key=lambda b: b[:2]):
            segments.append(machine.take((bytes([n]), 0, n, at, side, x)))
    segments = [r for s in [*segments, machine.flush(True)] if s for r in s.to_pylist()]
    for n, expected in enumerate(brute_alignment(texts)):
        mine = [r for r in segments if r["doc_id"] == n]
        assert tuple(sum(r[c] for r in mine) for c in ("n_a", "n_b", "n_groups", "n_links")) == expected[:4]
        assert [r["groups_sha256"] for r in mine if r["groups_sha256"] is not None] == [expected[6]]
        assert sum(sum(r["times"]) for r in mine) == expected[3] and (len(mine) == 1) == mine[0]["whole"]


@given(st.one_of(st.text(max_size=80), st.text("ab '\n\t s1漢é́​\U0001f600", max_size=80)))
@settings(max_examples=400, deadline=None)
def test_ranks_encode_as_merges(text):
    a = test_ranks_encode_as_merges.__dict__.setdefault("made", encoders()[0])
    assert align.Sides.of(align.TOKENIZERS).a.encode(text) == a.encode(text, add_special_tokens=False).ids


def test_numbers_as_text():
    w = align.Written(50_257)
    ids = np.array([0, 7, 10, 99, 100, 50_257])
    data, ends = w.write(ids, np.full(6, ord(","), np.uint8))
    assert data.tobytes() == b"0,7,10,99,100,50257," and ends.tolist() == [2, 4, 7, 10, 14, 20]


# audit


def brute_audit(rows, labels):
    """By applying the filters to each part, order by order."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    least, parts = {}, collections.defaultdict(list)
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    for i, text, source in rows:
        x = text or ""
        w = [a for a in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in x).split(" ") if a]
        capitals = sum("A" <= c <= "Z" for c in x)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * capitals > 2 * len(x), "D": bool(set(x) & set("#$%&*|")), "E": i is not None and least[x] < i}
        parts[source or ""].append((i, {f for f, y in fails.items() if y}))
    out = []
    for part, members in parts.items():
        taken = collections.Counter()
        lines = []
        for order in itertools.permutations("ABCDE"):
            left, gone = members, []
            for step, f in enumerate(order, 1):
                here, left = [m for m in left if f in m[1]], [m for m in left if f not in m[1]]
                taken[f] += len(here)
                lines.append(["".join(order), step, len(left), len(here), sum(f in m[1] for m in gone), sum(m[1] == {f} for m in members), sum(m[0] in good for m in here), sum(m[0] in toxic for m in here), f])
                gone += here
        out += [(part, *x[:-1], taken[x[-1]]) for x in lines]
    return sorted(out)


AUDIT = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audited(spark, rows, labels):
    marks = spark.createDataFrame([(*x, "s") for x in labels], "doc_id long, quality int, toxic int, source string")
    found = audit.audit(audit.labelled(audit.failures(docs(spark, rows)), marks), "ABCDE")
    return sorted(tuple(r[c] for c in AUDIT) for r in found.collect())


def test_audit(spark):
    draw = random.Random(5)
    texts = [" ".join(draw.choices(["Word", "word", "x", "#", "y"] + [f"w{k}" for k in range(draw.choice([3, 400]))], k=draw.choice([5, 199, 200, 250]))) for _ in range(60)]
    rows = [(i, draw.choice(texts), draw.choice(["a", "b", None, ""])) for i in range(150)] + ODD
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for i in range(0, 160, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    got = audited(spark, rows, labels)
    assert got == brute_audit(rows, labels) and len(got) == 3 * 600
    assert audited(spark, [], labels) == []


def test_audit_of_the_tables(spark):
    rows, labels = ([tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(*c).collect()] for t, c in (("documents", ("doc_id", "text", "source")), ("labels", ("doc_id", "quality", "toxic"))))
    assert audited(spark, rows, labels) == brute_audit(rows, labels)


def test_repeats_are_salted_too(spark, monkeypatch):
    plain = sorted(map(str, audit.failures(docs(spark, ODD)).collect()))
    monkeypatch.setattr(audit.small_join, "__defaults__", ("left", 0))
    assert sorted(map(str, audit.failures(docs(spark, ODD)).collect())) == plain


def test_other_numbers_of_filters(spark):
    rows = spark.createDataFrame([("p", True, False, False, False), ("p", True, True, True, False), ("p", False, False, False, True)], "part string, X boolean, Y boolean, good boolean, toxic boolean")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in audit.audit(rows, "XY").collect()}
    assert got == {("XY", 1): (1, 2, 0, 1, 1, 0, 3), ("XY", 2): (1, 0, 1, 0, 0, 0, 1), ("YX", 1): (2, 1, 0, 0, 1, 0, 1), ("YX", 2): (1, 1, 1, 1, 0, 0, 3)}
    with pytest.raises(ValueError, match="7 filters"):
        audit.parity_sums(rows, "ABCDEFG", ["part"])


# nearest neighbours


def brute_nearest(rows, k, every):
    usable = [(i, [float(x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q in sorted({i for i, _ in usable if i % every == 0}):
        mine = min(v for i, v in usable if i == q)
        found = sorted((-functools.reduce(lambda s, x: s + x[0] * x[1], zip(mine, v, strict=True), 0.0), i) for i, v in usable if i != q and len(v) == len(mine))[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(found, 1)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2.0, 3) for i, v in rows], "vec_id long, embedding array<double>, label int, v string, score double, times int")


def near(df, k, every):
    return sorted(tuple(r) for r in ann.neighbours(df, k, every).collect())


def test_neighbours(spark):
    draw = np.random.default_rng(3)
    common = [0.5, -0.25, 1.0, 0.125]
    rows = [(int(i), [float(x) for x in draw.normal(size=4)]) for i in range(300)]
    rows += [(i, common) for i in range(300, 420)] + [(60, common)] * 40 + [(61, common)] * 30 + [(40, common), (40, [1.0, 1.0, 1.0, 1.0])]
    rows += [(None, common), (20, None), (21, [1.0, None, 0.0, 0.0]), (22, [float("nan"), 0.0, 1.0, 1.0]), (23, [float("inf"), 0.0, 0.0, 0.0]), (24, [0.0] * 4), (25, []), (80, [1.0, 2.0]), (81, [2.0, 1.0]), (100, [1e-300, 0.0]), (82, [3e200, -2e100])]
    assert near(vectors(spark, rows), 7, 20) == brute_nearest(rows, 7, 20)
    assert near(vectors(spark, []), 7, 20) == [] and near(vectors(spark, rows[1:20]), 7, 20) == []


@pytest.mark.parametrize("dims", [1, 64, 2100])
def test_bounds_hold(dims):
    draw = np.random.default_rng(dims)
    a, b = draw.normal(size=(50, dims)) * 10.0 ** draw.integers(-3, 3, (50, 1)), draw.standard_cauchy(size=(70, dims))
    low, high = ann.Codes(a).bounds(ann.Codes(b))
    exact = a @ b.T
    assert (low <= exact).all() and (exact <= high).all()
    if dims == 64:  # and they are tight enough to leave most candidates out
        a, b = draw.normal(size=(50, dims)), draw.normal(size=(2000, dims))
        low, high = ann.Codes(a).bounds(ann.Codes(b))
        assert (high >= np.sort(low, axis=1)[:, -20:-19]).mean() < 0.03


def test_blocks_and_groups_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_BLOCK", 3)
    monkeypatch.setattr(ann, "GROUP", 50)
    monkeypatch.setattr(ann, "TASKS", 5)
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    expected = brute_nearest([(r.vec_id, r.embedding) for r in table.collect()], 20, 20)
    assert near(table, 20, 20) == expected and len(expected) == 500


@pytest.mark.parametrize("name", ["op12_audit", "op13_ann"])
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    out = con.execute(queries.ORACLES[name])
    names = [x[0] for x in out.description]
    plain = lambda x: float(f"{x:.9g}") if isinstance(x, float) else x
    expected = sorted(tuple(map(plain, r)) for r in out.fetchall())
    got = queries.QUERIES[name](spark, SF)
    assert got.columns == names and sorted(tuple(map(plain, r)) for r in got.collect()) == expected
