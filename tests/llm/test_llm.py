"""Each training-data operator against brute force on small tables, and on the cases that its docstring defines."""

import base64
import collections
import gzip
import hashlib
import itertools
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from kinelake.llm import chat, components, decontam, eftrie, langid, lmscore, mixing, queries, sharding, simhash, topk, urls, warc, wordhash

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, hash long, score double, shard string, fp string, component_id long, prefix string, whole long, train string, block string"
LONG = "alpha beta gamma delta " * 20_000


def frame(spark, rows):
    """Rows of doc_id, text, lang, source with columns of names that operators use themselves."""
    return spark.createDataFrame([(*r, 1, 2, 3, 4.0, "s", "f", 5, "p", 6, "t", "b") for r in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None, "a null id with some words", "en", None), (1, None, "en", "a"), (2, "", None, "b"), (3, "!!! 123", "de", "a"), (4, LONG, "en", None), (5, "same row twice here", "fr", "c"), (5, "same row twice here", "fr", "c"), (6, "same row twice here", "fr", None), (7, "ünï çödé 漢字 \U0001f600 \x00 x", "fr", "c"), (None, None, None, None)]
    return frame(spark, rows)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


# top-k search


def brute_top_k(rows, k, every):
    out = []
    usable = [(i, [int(np.floor(256.0 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q in sorted({i for i, _ in usable if i % every == 0}):
        mine = min(v for i, v in usable if i == q)
        found = sorted((-sum(a * b for a, b in zip(mine, v, strict=True)), i) for i, v in usable if i != q and len(v) == len(mine))[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(found, 1)]
    return sorted(out)


def test_top_k(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(0, 0.3, 6).tolist()) for i in range(120)] + [(200 + i, [0.5] * 6) for i in range(9)] + [(50, [0.25] * 6), (3, [9.0] * 6), (3, [9.0] * 6)]
    rows += [(900, None), (901, [1.0, None] * 3), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (None, [1.0] * 6), (950, [0.0] * 6), (1000, [1.0, 2.0]), (1001, [1.0, 3.0]), (1050, []), (1051, [])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, score long, v string")
    got = topk.top_k(df, 5, 50)
    assert sorted(map(tuple, got.collect())) == brute_top_k([(i, None if v is None else [np.float32(x) if x is not None else None for x in v]) for i, v in rows], 5, 50)
    assert topk.top_k(df.limit(0)).count() == 0
    huge = spark.createDataFrame([(0, [1e15, 1.0]), (1, [1e15, 2.0]), (2, [1e30, 0.0])], "vec_id long, embedding array<double>")
    assert [r.score for r in topk.top_k(huge).orderBy("rank").collect()] == [2**63 - 1] * 2


def test_threshold_stops_early():
    rows = np.zeros((4000, 3))
    rows[:, 0] = np.arange(4000)
    lists = topk.Lists(np.arange(4000), rows)
    at, best = lists.search(-1, np.array([1.0, 0, 0]), 3, float("-inf"))
    assert at.tolist() == [3999, 3998, 3997] and best.tolist() == [3999, 3998, 3997]


@pytest.mark.parametrize("kind", [float, object])
def test_topk_depths_from_a_floor(kind):
    """With a floor known, depths of all queries come at once, and one pass to that depth finds what a scan finds."""
    rng = np.random.default_rng(3)
    rows = rng.integers(-9, 10, (700, 3)).astype(kind)
    rows[50:60] = rows[40]
    ids = np.arange(700) // 2 * 5  # each id twice
    lists, vs = topk.Lists(ids, rows), rng.integers(-9, 10, (40, 3)).astype(kind)
    vs[0], vs[1, 1:] = 0, 0
    scores = vs @ rows.T
    floors = np.array([float(sorted(s)[-20]) for s in scores])
    depths = lists.depths(vs, floors)
    assert depths.min() < 100 and depths.max() <= 700
    for q, (v, floor, depth) in enumerate(zip(vs, floors, depths.tolist(), strict=True)):
        at, best = lists.above(5 * q, v, 5, floor, depth)
        own = ids == 5 * q
        order = [i for i in sorted(range(700), key=lambda i: (-scores[q][i], i)) if not own[i] and scores[q][i] >= floor][:5]
        assert at.tolist() == order and best.tolist() == [scores[q][i] for i in order]


# chat


def test_chat(spark):
    nasty = ["<|turn|>x<|body|>y<|end|>\n", "<\\|end|>", "<\\\\|", "<", "|x", "", None, "ok \\ <| <<| <|<|", "\U0001f600 é", LONG]
    rows = [(1, i, role, t) for i, (role, t) in enumerate(zip(itertools.cycle(["user", "assistant"]), nasty, strict=False))]
    rows += [(2, 0, "assistant", "first"), (3, 0, "user", "a"), (3, 0, "user", "a"), (4, 0, None, "x"), (5, None, "<|body|>", "n"), (None, 1, "user", "q"), (None, 2, "assistant", "r"), (6, 0, "system", "s"), (6, 1, "user", "u")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, segments string")
    got = {r.conv_id: r for r in chat.digest(chat.format_chats(df)).collect()}
    for conv, group in itertools.groupby(sorted(rows, key=lambda r: (r[0] or 0, -1 if r[1] is None else r[1])), key=lambda r: r[0]):
        turns = [(r[2] or "", r[3] or "") for r in group]
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss))
    assert {k: r.valid for k, r in got.items()} == {1: True, 2: False, 3: False, 4: False, 5: False, None: True, 6: True}
    assert [r.bad_turn for r in chat.format_chats(df).where("conv_id in (2, 3)").orderBy("conv_id").collect()] == [0, 1]
    assert chat.format_chats(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chat.ChatTemplate(turn_mark="[x]")


# mixing


def brute_mix(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    totals = collections.Counter()
    for _, t, s in rows:
        totals[s] += size(t)
    names = sorted((s for s in totals if s is not None)) + ([None] if None in totals else [])
    weights = dict(zip(names, itertools.cycle((3, 1, 2))))
    goal, free, rest = {}, set(names), 1.5 * sum(totals.values())
    while True:  # share, stop those above, share again
        level = rest / sum(weights[s] for s in free) if free else 0
        over = {s for s in free if level * weights[s] > 2 * totals[s]}
        if not over:
            return totals, goal | {s: level * weights[s] for s in free}
        for s in over:
            goal[s] = 2.0 * totals[s]
            rest -= goal[s]
        free -= over


def test_mix(spark, odd, documents):
    for docs, slack in ((documents, None), (odd, 1e9)):
        rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        totals, goal = brute_mix(rows)
        out = mixing.mix(docs).collect()
        assert len(out) == len(rows)
        taken = collections.Counter()
        for r in out:
            assert r.target == pytest.approx(goal[r.source]) and r.source_size == totals[r.source] and r.taken in (0, r.size, 2 * r.size)
            taken[r.source] += r.taken
        largest = collections.defaultdict(int)
        for r in out:
            largest[r.source] = max(largest[r.source], r.size)
        assert all(abs(taken[s] - goal[s]) <= (slack or largest[s]) for s in goal)
        assert sorted((str(r.doc_id), r.taken) for r in mixing.mix(docs.repartition(7)).collect()) == sorted((str(r.doc_id), r.taken) for r in out)
        lean = mixing.mix(docs, keep=["doc_id", "source"])
        assert lean.columns == ["doc_id", "source", "size", "source_size", "target", "taken"]
        assert sorted(map(str, lean.collect())) == sorted(map(str, mixing.mix(docs).select(*lean.columns).collect()))
    with pytest.raises(ValueError):
        mixing.mix(odd, keep=["doc_id"])
    assert mixing.mix(odd.limit(0)).count() == 0
    assert mixing.take(odd).columns == odd.columns
    assert mixing.mix(odd.drop("size").withColumn("Size", F.lit("x"))).columns.count("size") == 1


# URLs


def test_urls(spark):
    cases = {
        "http://foo.net": ("foo.net", "", None), "http://FOO.net/a?b": ("foo.net", "/a", "net/"), "https://a.example.NET/en/x#y": ("a.example.net", "/en/x", "example.net/en/"),
        "x://example.net/EN/": ("example.net", "/EN/", "net/"), "http://notexample.net/en/": ("notexample.net", "/en/", "net/"), "ftp://b.org/fr/": ("b.org", "/fr/", "org/fr/"), "http://org?/fr/": ("org", "", None),
        "no scheme": ("", "", None), "": ("", "", None), None: ("", "", None), "a://b://c/d": ("b:", "//c/d", None), "http://example.com/de/\nz": ("example.com", "/de/\nz", "example.com/de/"),
    }
    rows = [(i, u, "x") for i, u in enumerate(cases)] + [(None, "http://q.net/", "x"), (0, "http://foo.net", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    out = urls.judge(df).collect()
    assert len(out) == len(rows)
    by = {r.page_id: r for r in out}
    for i, want in enumerate(cases.values()):
        assert (by[i].host, by[i].path, by[i].rule) == want
    assert by[1].verdict == "block" and by[2].verdict == "allow" and {by[8].verdict, by[9].verdict} == {"block"}
    assert urls.judge(df.limit(0)).count() == 0


def test_long_urls(spark):
    """Work in proportion to the length: a megabyte in seconds."""
    long = "data:text/html;base64," + "AbC9/+=" * 150_000
    df = spark.createDataFrame([(1, "http://foo.net/x"), (2, "http://b.org/fr/y"), (3, long), (4, "http://c.de/" + "a" * 1_000_000)], "page_id long, url string")
    began = time.time()
    out = {r.page_id: r for r in urls.judge(df).collect()}
    assert len(out) == 4 and out[3].host == "" and out[4].path == "/" + "a" * 1_000_000 and time.time() - began < 60
    for text in ("", "a", "ab", "ab/9x"):
        got = spark.createDataFrame([(text,)], "t string").select(urls.grams_of(F.col("t")).alias("g")).first().g
        assert got == [("^^^" + text)[i : i + 4] for i in range(len(text))]


def test_url_model(spark):
    counts = collections.Counter()
    for text, kind in (("aab/a", 0), ("ab-b", 1), ("aa", 1)):
        for g in (("^^^" + text)[i : i + 4] for i in range(len(text))):
            counts[g, kind] += 1
    grams = sorted({g for g, _ in counts} | {"zzzz"})

    def p(g, kind):
        if not g:
            return 1 / urls.SYMBOLS
        here = collections.Counter()
        for (x, k), n in counts.items():
            if k == kind and x[4 - len(g) : 3] == g[:-1]:
                here[x[3]] += n
        low = p(g[1:], kind)
        t = len(here)
        return low if not here else (here[g[-1]] + t * low) / (sum(here.values()) + t)

    df = spark.createDataFrame([(g, counts[g, 0], counts[g, 1]) for g in grams], "gram string, allow long, block long")
    got = {r.gram: r.delta for r in urls.gram_scores(df).collect()}
    assert got == pytest.approx({g: np.log(p(g, 0)) - np.log(p(g, 1)) for g in grams})


# near-duplicates


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """fps: list of (id, fingerprint); id to smallest reachable."""
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations([(i, f) for i, f in fps if i is not None], 2):
        if (x ^ y).bit_count() <= 4:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {i: root(i) for i, _ in fps if i is not None}


def test_simhash(spark, odd, documents):
    for docs in (documents, odd):
        rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
        out = simhash.near_duplicates(docs).collect()
        assert sorted((str(r.doc_id), r.fp % 2**64) for r in out) == sorted((str(i), f) for i, f in rows)
        want = brute_components(rows)
        assert all(r.component_id == want.get(r.doc_id) for r in out)
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def one_of_each_class(rows):
    """Ids and texts of the rows that stay, by definition: of each class that of the smallest id, or one without."""
    classes, out = brute_components([(n, brute_fingerprint(t)) for n, (_, t) in enumerate(rows)]), {}
    for n, (i, t) in enumerate(rows):
        f = brute_fingerprint(t)
        out.setdefault(classes[n], []).append((i is None, i or 0, f - (f >> 63 << 64)))
    return [(None if none else i, f % 2**64) for none, i, f in map(min, out.values())]


def test_deduplicate_by_row(spark, odd, documents):
    """Rows that repeat an id but not a text stand for themselves; so do rows without an id."""
    text = lambda word: " ".join(f"{word}{i}" for i in range(30))
    rows = [(3, text("a")), (3, text("b")), (3, text("b")), (4, text("b")), (5, text("c")), (2, text("c")), (2, text("d")), (6, text("e")), (6, text("a")), (7, text("a")), (None, text("a")), (None, text("z")), (None, text("z")), (8, None), (8, ""), (9, "")]
    docs = frame(spark, [(i, t, "en", "s") for i, t in rows]).withColumn("note", F.create_map("lang", "source"))
    nameless = docs.withColumn("doc_id", F.lit(None).cast("long"))
    for x in (docs, nameless, odd, documents, documents.union(documents), docs.where("doc_id is not null")):
        got = simhash.deduplicate(x)
        assert got.columns == x.columns
        want = one_of_each_class([(r.doc_id, r.text) for r in x.collect()])
        assert sorted(map(str, want)) == sorted(str((r.doc_id, brute_fingerprint(r.text))) for r in got.collect())
    assert simhash.deduplicate(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [0, 2, 4, 7])
def test_links_of_dense_groups(spark, monkeypatch, bits):
    rng = np.random.default_rng(bits)
    fps = set()
    for _ in range(6):
        center = int(rng.integers(0, 2**63))
        for _ in range(120):
            f = center
            for b in rng.integers(0, 64, int(rng.integers(0, 5))):
                f ^= 1 << int(b)
            fps.add(f)
    fps = sorted(fps)
    monkeypatch.setattr(simhash, "HOT", 8)
    monkeypatch.setattr(simhash, "TILE", 20)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    got = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), bits).collect()
    assert all(((r.a ^ r.b) % 2**64).bit_count() <= bits for r in got)
    nth = {f: i for i, f in enumerate(signed)}
    edges = spark.createDataFrame([(nth[r.a], nth[r.b]) for r in got], "a long, b long")
    found = {r.node: r.component for r in components.components(edges).collect()}
    graph = {i: set() for i in range(len(fps))}
    for (i, x), (j, y) in itertools.combinations(enumerate(fps), 2):
        if (x ^ y).bit_count() <= bits:
            graph[i].add(j)
            graph[j].add(i)
    seen = {}
    for i in graph:
        stack = [i] if i not in seen else []
        while stack:
            if (x := stack.pop()) not in seen:
                seen[x] = i
                stack += graph[x]
    assert {i: found.get(i, i) for i in graph} == seen


def test_open_bits():
    for first, width, bits in ((0, 21, 4), (21, 22, 4), (43, 21, 7), (32, 32, 4), (0, 64, 0), (0, 60, 3), (0, 60, 4)):
        masks = [m % 2**64 for m in simhash.open_bits(first, width, bits)]
        assert len(masks) == (bits + 1 if bits < 64 - width else 1)
        assert sum(m.bit_count() for m in masks) == (64 - width if bits < 64 - width else 0)
        assert not any(m >> first & (2**width - 1) for m in masks) and not any(a & b for a, b in itertools.combinations(masks, 2))


def test_a_very_hot_key(spark, monkeypatch):
    """Fingerprints that share their low bits and little else: pairs at 0 to 6 bits, some by way of a changed low bit."""
    rng = np.random.default_rng(5)
    fps = set()
    for _ in range(400):
        f = int(rng.integers(0, 2**42)) << 21 | 5
        g = f
        for b in rng.choice(64, int(rng.integers(0, 7)), replace=False):
            g ^= 1 << int(b)
        fps |= {f, g}
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    pairs = {(a, b) for (a, x), (b, y) in itertools.combinations(zip(signed, fps, strict=True), 2) if (x ^ y).bit_count() <= 4}
    pairs = {tuple(sorted(p)) for p in pairs}
    assert len(pairs) > 100
    for hot, tile in ((8, 50), (8, 100_000)):
        monkeypatch.setattr(simhash, "HOT", hot)
        monkeypatch.setattr(simhash, "TILE", tile)
        got = {tuple(sorted((r.a, r.b))) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 4).collect()}
        # no two pairs share a fingerprint here, so every link must be there itself
        assert got == pairs


def test_components_of_a_chain(spark):
    n = 300
    order = np.random.default_rng(1).permutation(n).tolist()
    edges = spark.createDataFrame([(a, b) for a, b in itertools.pairwise(order)] + [(1000, 1000), (2000, 1999)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(n)}, 2000: 1999, 1999: 1999}


def test_layout_finds_every_link():
    for bits in range(9):
        for n in (10, 2**30):
            parts = simhash.layout(n, bits)
            assert sum(w for _, w, _ in parts) == 64 and sum(r + 1 for *_, r in parts) > bits
    assert simhash.ball(3, 2) == [0, 1, 2, 3, 4, 5, 6]


# languages


def test_langid(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out)
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    got = {(r.doc_id, r.lang_pred == "und") for r in langid.identify(odd).collect()}
    assert {(1, True), (2, True), (3, True), (4, False), (7, False)} <= got
    assert langid.identify(odd.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(odd.withColumn("lang", odd["lang"].substr(9, 1)).where("lang is null")).collect()} <= {"und", ""}


def test_predictions_by_definition(spark, documents):
    """Prototypes, cosines and scores from the vectors of single trigrams."""
    a, b, c = (x.astype(np.int64) for x in langid.rolled())

    def profile(text):
        s = [0]
        for ch in text or "":
            low = ord(ch.lower()[0])
            code = 0 if not ch.isalpha() else low - 96 if 97 <= low <= 122 else low - 0xDF + 27 if 0xDF <= low < 0x13F else 123 + low % 133
            s += [code] * bool(code or s[-1])
        s += [0] * bool(s[-1])
        total = np.zeros(langid.DIM, np.int64)
        for (x, y, z), n in collections.Counter(zip(s, s[1:], s[2:], strict=False)).items():
            total += n * (a[x] * b[y] * c[z])
        return total

    rows = documents.limit(120).collect()
    profiles = [profile(r.text) for r in rows]
    sums = collections.defaultdict(lambda: np.zeros(langid.DIM, np.int64))
    for r, p in zip(rows, profiles, strict=True):
        if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            sums[r.lang] += p
    langs = sorted(sums)
    unit = np.array([sums[k] / np.linalg.norm(sums[k]) for k in langs])
    unit = unit - unit.mean(axis=0)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, documents.schema)).collect()}
    for r, p in zip(rows, profiles, strict=True):
        cosines = unit @ p / max(np.linalg.norm(p), 1e-12)
        assert got[r.doc_id].lang_pred == (langs[int(cosines.argmax())] if p.any() else "und")
        assert got[r.doc_id].score == pytest.approx((1 + cosines.max()) / 2 if p.any() else 0.0, abs=2e-6)


def test_labels_that_name_no_languages(spark):
    many = spark.range(3000).selectExpr("id AS doc_id", "'some text' AS text", "cast(id AS string) AS lang")
    with pytest.raises(ValueError, match="more than"):
        langid.identify(many)


def test_unknown_languages_are_left_out(spark, documents):
    rng = np.random.default_rng(5)
    letters = lambda n, of: "".join(rng.choice(list(of), n))
    planted = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw, są oni obdarzeni rozumem i sumieniem",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan, heille on annettu järki ja omatunto",
        "Все люди рождаются свободными и равными в своем достоинстве и правах, они наделены разумом и совестью", "人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系的精神相对待",
        letters(400, "abcdefABCDEFghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ0123456789+/"), letters(600, "0123456789abcdef"), letters(1000, "abcdefghijklmnopqrstuvwxyz     "),
    ]
    docs = documents.unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(planted)], "doc_id long, text string"), allowMissingColumns=True)
    kept = corpus_pipeline.language(spark, docs, SF)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in documents.collect())


def test_bundles_are_sums_of_bound_vectors():
    a, b, c = langid.rolled()
    text = "Ab, é"
    s = [0, 1, 2, 0, 0xE9 - 0xDF + 27, 0]
    want = sum(a[x].astype(int) * b[y] * c[z] for x, y, z in zip(s, s[1:], s[2:], strict=False))
    assert (langid.bundle([text, None, "12"]) == want).all()


# sharding


def best_capacity(sizes, k):
    """Dynamic programming."""
    best = {0: [0]}
    n, total = len(sizes), np.concatenate([[0], np.cumsum(sizes)])
    dp = [0] + [float("inf")] * n
    for _ in range(k):
        dp = [0] + [min(max(dp[j], total[i] - total[j]) for j in range(i)) for i in range(1, n + 1)]
    return dp[n], best


@given(st.lists(st.integers(1, 50), min_size=1, max_size=25), st.integers(1, 6))
@settings(max_examples=60, deadline=None)
def test_minimax(sizes, k):
    capacity, ends = sharding.minimax(sizes, k)
    assert capacity == best_capacity(sizes, k)[0] and ends[-1] == len(sizes) and len(ends) <= k
    assert all(sum(sizes[a:b]) <= capacity for a, b in zip([0, *ends], ends, strict=False))


def test_shards(spark, odd, documents):
    for docs, shards in ((documents, 16), (documents, 3), (odd, 4)):
        rows = docs.collect()
        out = sharding.shard(docs, shards).collect()
        assert sorted((str(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows) == sorted((str(r.doc_id), r.size, r.text_crc32) for r in out)
        of = collections.defaultdict(set)
        for r in out:
            of[r.text_crc32, r.size].add(r.shard)
        assert all(len(x) == 1 for x in of.values())
        for s in {r.shard for r in out}:
            assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
        groups = collections.Counter()
        hashes = {r[0]: r[1] % 2**64 for r in spark.createDataFrame([(t,) for t in {r.text or "" for r in rows}], "t string").selectExpr("t", "xxhash64(t)").collect()}
        for r in rows:
            groups[hashes[r.text or ""]] += len((r.text or "").encode()) + 1
        want, _ = best_capacity([groups[h] for h in sorted(groups)], shards)
        loads = collections.Counter()
        for r in out:
            loads[r.shard] += r.size
        assert max(loads.values()) == want and max(loads) < shards
    assert sharding.shard(odd.limit(0)).count() == 0


def test_shards_keep_columns(spark, odd, documents):
    tagged = documents.withColumn("tag", F.create_map("lang", "source")).withColumn("SLOT", F.lit("x"))
    for docs in (tagged, odd, tagged.limit(0)):
        got, lean = sharding.shard(docs, 5, keep=True), sharding.shard(docs, 5)
        own = [c for c in docs.columns if c.lower() not in sharding.ADDED]
        assert got.columns == [*own, *sharding.ADDED]
        plain = [c for c in own if c != "tag"]
        assert sorted(map(str, got.select(*plain).collect())) == sorted(map(str, docs.select(*plain).collect()))
        places = lambda df: sorted(map(str, df.select(*lean.columns).collect()))  # noqa: B023, E731
        assert places(got.drop("slot").withColumn("slot", F.lit(0))) == places(lean.drop("slot").withColumn("slot", F.lit(0)))
        assert sorted((r.shard, r.slot) for r in got.collect()) == sorted((r.shard, r.slot) for r in lean.collect())


def test_shards_beside_a_large_group(spark):
    """A group of copies with a third of all bytes makes one large shard, and the others share the rest evenly."""
    rows = [(i, "copy of one text " * 4) for i in range(700)] + [(1000 + i, f"text {i} " + "x" * (i % 40 + 60)) for i in range(1200)]
    out = sharding.shard(frame(spark, [(i, t, "en", "s") for i, t in rows]), 16).collect()
    loads = collections.Counter()
    for r in out:
        loads[r.shard] += r.size
    big = 700 * (len("copy of one text ") * 4 + 1)
    rest = sorted(loads.values())[:-1]
    assert max(loads.values()) == big and len(loads) == 16 and max(rest) < 1.1 * sum(rest) / len(rest)


# WARC


def test_warc(spark):
    rows = [(1, "u", "same"), (7, "u", "same"), (3, "u", "same"), (4, "u", None), (5, "u", ""), (6, "u\r\nX: y", "é\U0001f600" * 30_000), (8, None, "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n"), (9, "u", "x" * 16_384), (9, "u", "x" * 16_384), (10, "u", "é\U0001f600" * 30_000), (None, "u", "solo"), (None, "u", "same")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, kind string")
    for least in (0, 5):
        want = []
        for i, _, h in rows:
            data = (h or "").encode()
            first = max((j for j, _, x in rows if (x or "") == (h or "") and j is not None), default=None) if len(data) >= least else i
            want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == first else "revisit", None if i == first else first))
        assert sorted(map(str, map(tuple, warc.round_trip(df, least).collect()))) == sorted(map(str, want))
    assert warc.round_trip(df.limit(0)).count() == 0


def test_missing_segments(spark, tmp_path):
    text = "y" * 40_000
    path = f"file://{tmp_path}/w"
    warc.write(spark.createDataFrame([(1, "u", text)], "page_id long, url string, html string"), path)
    records = warc.read_records(spark, path)
    whole = warc.read_payloads(warc.reassemble(records)).collect()
    assert [bytes(r.payload).decode() for r in whole] == [text]
    for missing in (2, 3):
        assert [(r.complete, r.payload_bytes) for r in warc.read_payloads(warc.reassemble(records.where(f"segment <> {missing}"))).collect()] == [(False, None)]


def test_large_pages(spark):
    """Segments are joined in time that follows the length."""
    html = "0123456789abcde\n" * (24 << 16)
    began = time.time()
    (r,) = warc.round_trip(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")).collect()
    assert r.payload_bytes == len(html) and time.time() - began < 120
    assert r.payload_digest == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()


def test_damaged_and_foreign_archives(spark, tmp_path):
    good = b"WARC/1.0\r\nwarc-type:response\r\nWARC-RECORD-ID: <a>\r\nX-Page-ID: 5\r\nno field\r\nContent-Length: 23\r\n\r\nHTTP/1.1 200 OK\r\n\r\nbody"
    bad = [
        b"WARC/1.1\r\nWARC-Type: response\r\n", b"WARC/1.1\r\n\r\n", b"WARC/1.1\r\nWARC-Record-ID: <b>\r\nContent-Length: x\r\n\r\n", b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc",
        b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <c>\r\nContent-Length: 900\r\n\r\nHTTP/1.1 200 OK\r\n\r\nshort", b"\xff\xfe", b"", b"WARC/",
        b"WARC/1.1\r\nWARC-Record-ID: <d>\r\nWARC-Segment-Number: 99999999999999999999\r\nX-Page-ID: 12x\r\nContent-Length: 2\r\n\r\nab",
    ]
    for i, x in enumerate(bad):
        (tmp_path / f"{i}.txt").write_bytes(good + b"\r\n\r\n" + x)
    packed = gzip.compress(good + b"\r\n\r\n") + gzip.compress(good)
    (tmp_path / "two.txt.gz").write_bytes(packed)
    (tmp_path / "cut.txt.gz").write_bytes(packed[:-12])
    (tmp_path / "none.txt.gz").write_bytes(b"no gzip at all")
    out = warc.read_payloads(warc.reassemble(warc.read_records(spark, f"file://{tmp_path}"))).collect()
    whole = [r for r in out if r.complete and r.kind == "response"]
    assert len(whole) == len(bad) + 3 and {(r.record_id, r.page_id, bytes(r.payload)) for r in whole} == {("<a>", 5, b"body")}
    assert sum(not r.complete for r in out) >= 5 and all(r.payload is None for r in out if not r.complete)


@pytest.mark.parametrize("body", [b"", b"5\r\nab", b"zz\r\nx\r\n0\r\n\r\n", b"2\r\nabX\r\n0\r\n\r\n", b"-1\r\n"])
def test_broken_chunks(body):
    assert warc.dechunk(body) is None


def test_chunks():
    assert warc.dechunk(b"3;x=y\r\nabc\r\n2\r\nde\r\n0\r\n\r\n") == b"abcde"


# decontamination


def test_decontamination(spark, odd):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen"
    short, tiny = "red orange yellow green blue indigo violet black", "yes it is"
    w = item.split()
    noise = lambda n, k: " ".join(f"n{k}x{i}" for i in range(n))
    change = lambda *at: " ".join("CHANGED" if i in at else x for i, x in enumerate(w))
    docs = {
        1: noise(30, 1) + " " + item.upper() + " " + noise(40, 2), 2: change(8), 3: change(4, 13), 4: " ".join(w[:9]) + " " + noise(20, 3), 5: noise(3, 4) + ", ".join(w[2:16]) + " end",
        6: "so " + short + " it goes", 7: tiny, 8: None, 9: "", 10: " ".join(reversed(w)), 11: change(*range(0, 18, 3)), 12: LONG + item, 13: noise(500, 9), 14: change(0, 17),
    }
    df = frame(spark, [(i, t, "en", "s") for i, t in docs.items()] + [(None, item, "en", "s"), (1, docs[1], "en", "s")])
    benchmark = spark.createDataFrame([(1, item, "z"), (2, short, "z"), (3, tiny, "z"), (None, None, "z"), (4, None, "z"), (5, "", "z"), (1, item, "z")], "item_id long, text string, doc_id string")
    out = decontam.contaminated(df, benchmark)
    assert {(r.doc_id, r.item_id) for r in out.collect()} == {(1, 1), (2, 1), (3, 1), (5, 1), (6, 2), (12, 1), (14, 1), (None, 1)}
    assert {r.doc_id for r in decontam.decontaminate(df, benchmark).collect()} == {4, 7, 8, 9, 10, 11, 13}
    assert decontam.contaminated(df.limit(0), benchmark).count() == 0 and decontam.contaminated(df, benchmark.limit(0)).count() == 0
    assert decontam.decontaminate(odd, benchmark).count() == odd.count()


def brute_overlap(text, item):
    """Equal words and length of the best run, over all alignments and all runs that are long enough."""
    best, least = (0, 0), min(len(item), decontam.LEAST)
    for shift in range(-len(item), len(text)) if least >= decontam.SHORTEST else ():
        same = [0 <= i + shift < len(text) and text[i + shift] == x for i, x in enumerate(item)]
        inside = [0 <= i + shift < len(text) for i in range(len(item))]
        for i in range(len(item)):
            for j in range(i + least, len(item) + 1):
                if all(inside[i:j]) and 5 * sum(same[i:j]) >= 4 * (j - i):
                    k = [x for x in range(i, j) if same[x]]
                    best = max(best, (len(k), k[-1] - k[0] + 1))
    return best


def test_no_copy_with_substitutions_is_missed():
    rng, caught = np.random.default_rng(8), collections.Counter()
    cases = [(8, 1), (10, 2), (12, 2), (13, 1), (13, 2), (13, 3), (18, 3), (20, 4), (20, 5), (30, 6), (40, 11)]
    for case in range(440):
        n, changed = cases[case % len(cases)]
        item = [f"w{x}" for x in rng.integers(0, 400, n)]
        copy = list(item)
        for at in rng.choice(n, changed, replace=False):
            copy[at] = f"w{rng.integers(0, 400)}x"
        text = [f"w{x}" for x in rng.integers(0, 400, int(rng.integers(0, 9)))] + copy + [f"w{x}" for x in rng.integers(0, 400, int(rng.integers(0, 9)))]
        got = decontam.Block([(1, " ".join(item))]).matches(decontam.words([None, " ".join(text), "x y z"]))
        same, length = brute_overlap(text, item)
        assert [(m[0], m[4]) for m in got] == ([(1, same)] if same else []), (item, text)
        caught[n, changed] += len(got)
    # of copies that agree in four fifths of their words, all
    assert all(caught[c] == 40 for c in cases if 5 * c[1] <= c[0])


def test_every_run_has_a_hit():
    """However its differences fall."""
    for masks, sizes in ((decontam.MASKS, range(13, 26)), (decontam.SHORT_MASKS, range(8, 13))):
        for n in sizes:
            for differ in itertools.combinations(range(n), n - -(-4 * n // 5)):
                assert any(not {i + p for p in m} & set(differ) for m in masks for i in range(n - m[-1]))


def test_runs_within_longer_ones():
    item = [f"w{i}" for i in range(154)]
    block = decontam.Block([(1, " ".join(item))])
    copy = [w if i < 30 or (i - 30) % 4 else f"x{i}" for i, w in enumerate(item)]
    assert [m[1] for m in block.matches(decontam.words([" ".join(copy)]))] == [1]


def test_long_items_are_matched_whole():
    item = [f"w{i}" for i in range(6000)]
    block = decontam.Block([(1, " ".join(item)), (2, "other words " * 40), (3, " ".join(item[2000:2040]))])
    go = lambda text: sorted(m[1:] for m in block.matches(decontam.words([" ".join(text)])))
    assert go(["x", *item, "y"]) == [(1, 1, 6000, 6000), (3, 2001, 40, 40)]
    assert go(item[1000:5500]) == [(1, 0, 4500, 4500), (3, 1000, 40, 40)]
    changed = [f"x{i}" if i % 7 == 3 and i < 5000 else w for i, w in enumerate(item)]
    assert go(changed)[0] == (1, 0, 6000, 6000 - sum(i % 7 == 3 for i in range(5000)))
    assert go(item[:3000] + ["gap"] * 9000 + item[3000:])[0] == (1, 0, 3000, 3000) or go(item[:3000] + ["gap"] * 9000 + item[3000:])[0] == (1, 12000, 3000, 3000)


def test_longest_run():
    rng = np.random.default_rng(9)
    for case in range(400):
        n = (13, 20, 40, 55)[case % 4]
        same = rng.random(n) > (0.2, 0.25, 0.3, 0.35)[case % 3]
        longest = max((j - i for i in range(n) for j in range(i + 13, n + 1) if 5 * same[i:j].sum() >= 4 * (j - i)), default=0)
        a, b = decontam.longest(same, 13)
        assert (longest == 0) == (a == b) and b - a <= longest
        assert a == b or (same[a] and same[b - 1] and 5 * same[a:b].sum() >= 4 * (b - a))


@pytest.mark.parametrize("item", [
    "все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом и совестью и должны поступать",
    "όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα είναι προικισμένοι με λογική και συνείδηση",
    "人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系的精神相对待", "มนุษย์ทั้งหลายเกิดมามีอิสระและเสมอภาคกันในเกียรติศักดิ์และสิทธิ",
])
def test_benchmarks_in_other_scripts(spark, item):
    docs = frame(spark, [(1, f"A page. {item.upper()}! And more.", "en", "s"), (2, item[:9] + " else", "en", "s"), (3, "clean " * 40, "en", "s")])
    benchmark = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.contaminated(docs, benchmark).collect()] == [(1, 7)]
    assert sorted(r.doc_id for r in decontam.decontaminate(docs, benchmark).collect()) == [2, 3]


def test_words_are_what_the_pattern_says(monkeypatch):
    texts = ["", None, "One, TWO_2 -- x", "x", "\U0001f600 é\u0301 ß STRASSE İ", "漢字kana かな 1２", "one two_2 X", " " * 50 + "one" + " x" * 40]
    for most in (1 << 22, 20):
        monkeypatch.setattr(decontam, "LONGEST", most)
        got, named = decontam.words(texts), {}
        for t, hashes in zip(texts, got, strict=True):
            want = re.findall(r"[\u3040-\u30ff\u4e00-\u9fff]|[^\W\u3040-\u30ff\u4e00-\u9fff]+", (t or "").lower())
            assert len(want) == len(hashes)
            for w, h in zip(want, hashes.tolist(), strict=True):
                assert named.setdefault(w, h) == h
        assert len(set(named.values())) == len(named)
    assert sum(map(len, decontam.words(["y" * 50]))) == 3


def test_long_texts_that_repeat_themselves(monkeypatch):
    monkeypatch.setattr(decontam, "PAIRS", 5000)
    monkeypatch.setattr(decontam, "STRIDE", 2000)
    monkeypatch.setattr(decontam, "LONGEST", 1000)
    item, text = "alpha beta gamma delta " * 30, "x " * 3000 + "alpha beta gamma delta " * 700
    (m,) = decontam.Block([(1, item)]).matches(decontam.words([text]))
    assert m == (0, 1, 3000, 120, 120)


def test_blocks_change_nothing(spark, documents, monkeypatch):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    one = sorted(map(tuple, decontam.contaminated(documents, benchmark).collect()))
    words = {r.item_id: re.findall(r"\w+", r.text.lower()) for r in benchmark.collect()}
    exact = {(r.doc_id, i) for r in documents.collect() for i, x in words.items() if " ".join(x) in " ".join(re.findall(r"\w+", r.text.lower()))}
    assert exact and {(r[0], r[1]) for r in one} == exact
    left = sorted(r.doc_id for r in decontam.decontaminate(documents, benchmark).collect())
    assert left == sorted({r.doc_id for r in documents.collect()} - {r[0] for r in one})
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 1500)
    assert sorted(map(tuple, decontam.contaminated(documents, benchmark).collect())) == one
    assert sorted(r.doc_id for r in decontam.decontaminate(documents, benchmark).collect()) == left


# language-model scores


def brute_scores(rows):
    """The trigram model by its definition."""
    tokens = lambda t: [b"\t", b"\t", *re.findall(rb"[^\x20\x09-\x0d]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())), b"\n"]
    learns = [zlib.crc32(str("" if i is None else i).encode()) % 5 != 1 for i, _ in rows]
    seen, kinds = collections.Counter(), collections.defaultdict(set)
    for (_, t), learn in zip(rows, learns, strict=True):
        w = tokens(t) if learn else []
        for at in range(2, len(w)):
            for m in (0, 1, 2):
                h = tuple(w[at - m : at])
                seen[h, w[at]] += 1
                seen[h] += 1
                kinds[h].add(w[at])
    n, v = seen[()], len(kinds[()])
    out = []
    for (i, t), learn in zip(rows, learns, strict=True):
        w, base, score = tokens(t), 0.0, 0.0
        for at in range(2, len(w)):
            p = (seen[(), w[at]] + 0.5) / (n + 0.5 * (v + 1))
            base += np.log10(p)
            for m in (1, 2):
                h = tuple(w[at - m : at])
                c, total = seen[h, w[at]], seen[h]
                if total:
                    d = lmscore.DISCOUNTS[m - 1]
                    p = max(c - d, 0) / total + d * len(kinds[h]) / total * p
            score += np.log10(p)
        out.append((str(i), not learn, len(w) - 2, sum(seen[(), x] > 0 for x in w[2:]), n, base, score))
    return sorted(out)


@pytest.mark.parametrize("hot", [1 << 20, 60])
def test_lm(spark, odd, documents, monkeypatch, hot):
    monkeypatch.setattr(lmscore, "CHUNK", 60_000)
    monkeypatch.setattr(lmscore, "SHARD", 20_000)
    monkeypatch.setattr(lmscore, "HOT", hot)
    repeated = frame(spark, [(i, f"the very same pair of words {i} the very same pair again {i % 7}", "en", "s") for i in range(1500)])
    for docs in (documents.repartition(3), odd, odd.where("doc_id = 4"), repeated):
        monkeypatch.setattr(queries, "table", lambda *_, docs=docs: docs)
        want = brute_scores([(r.doc_id, r.text) for r in docs.collect()])
        got = sorted((str(r.doc_id), *tuple(r)[1:]) for r in queries.QUERIES["op10_lm"](spark, SF).collect())
        for a, b in zip(got, want, strict=True):
            # each level's code is off by half a step at most
            assert a[:5] == b[:5] and a[5] == pytest.approx(b[5]) and abs(a[6] - b[6]) < 3 * 0.5 / eftrie.STEP * a[2] + 1e-9
    assert lmscore.score(odd.limit(0)).count() == 0


def test_hot_contexts_are_bounded(monkeypatch):
    monkeypatch.setattr(lmscore, "CONTEXTS", 100)
    assert lmscore.Corpus(12, 10**12, 10, 10).from_count == 10**10 and lmscore.Corpus(12, 5, 5, 1).from_count == lmscore.HOT
    k = lmscore.Kinds([(2**42, 7, 3), (5, 2**42, 4), (2**42, 6, 9), (5, 0, 1)])
    assert k(np.array([5, 2**42, 2**42, 5], np.uint64), np.array([0, 6, 7, 2**42], np.uint64)).tolist() == [1, 9, 3, 4]
    with pytest.raises(ValueError):
        k(np.array([5], np.uint64), np.array([1], np.uint64))
    assert lmscore.Kinds([])(np.zeros(0, np.uint64), np.zeros(0, np.uint64)).tolist() == []


def test_words_of_bytes(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(wordhash, "STEP", 64)
    named = {}
    for _ in range(100):
        texts = ["".join(rng.choice(list("abCD \t\n\x0b\x00é")) if rng.random() < 0.97 else "x" * int(rng.integers(40, 90)) for _ in range(int(rng.integers(0, 120)))).encode() for _ in range(int(rng.integers(1, 9)))]
        h, n = wordhash.of_words(texts)
        want = [t.lower().split() for t in texts]
        assert [len(w) for w in want] == n.tolist()
        for w, x in zip(itertools.chain(*want), h.tolist(), strict=True):
            assert named.setdefault(w, x) == x
    assert len(set(named.values())) == len(named)


@given(st.lists(st.integers(0, 2**40), max_size=200), st.integers(1, 8))
@settings(max_examples=60, deadline=None)
def test_elias_fano(values, dense):
    v = np.sort(np.array(values, np.int64))
    e = eftrie.EliasFano.encode(v)
    assert (e.get(np.arange(len(v))) == v).all() and (e.decode(0, len(v)) == v).all()
    x = np.array(values[:20] + [0, 2**41], np.int64)
    whole = np.zeros(len(x), np.int64), np.full(len(x), len(v))
    e.DENSE = 0
    sparse = e.find(x, *whole)
    e.DENSE, e.PIECE = 10**9, dense
    assert (sparse == np.searchsorted(v, x)).all() and (e.find(x, *whole) == sparse).all()


def test_trie_of_three_levels():
    rng = np.random.default_rng(3)
    t = rng.zipf(1.5, 5000) % 40
    two, three = (np.unique(np.column_stack([t[i : len(t) - n + i] for i in range(n)]), axis=0) for n in (2, 3))
    codes = [rng.integers(1, 60_000, len(x)).astype(np.uint16) for x in (two, three)]
    trie = eftrie.Trie.build(40, [two, three], codes).mapped()
    q = np.concatenate([rng.integers(0, 42, (3000, 3)), three])
    for n, grams, code in ((2, two, codes[0]), (3, three, codes[1])):
        known = dict(zip(map(tuple, grams.tolist()), code.tolist(), strict=True))
        assert trie.codes(q[:, :n]).tolist() == [known.get(tuple(x), 0) for x in q[:, :n].tolist()]


# the pipeline


def test_pipeline(spark, documents):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs, sizes = documents, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, docs, SF).collect(), documents.schema)
        assert after.columns == documents.columns
        before = collections.Counter(r.doc_id for r in docs.collect())
        sizes.append((len(before), len({r.doc_id for r in after.collect()})))
        docs = after
    rows = documents.collect()
    want = brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in rows])
    assert sizes[0] == (len(rows), len(rows)) and sizes[1][1] == len(set(want.values()))
    assert sizes[2][1] < sizes[2][0]
    out = corpus_pipeline.run(spark, SF)
    columns = documents.columns
    assert sorted(map(str, out.select(*columns).collect())) == sorted(map(str, docs.select(*columns).collect()))
    rows = out.collect()
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_pipeline_of_odd_rows(spark, odd, empty):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert docs.count() >= 0
