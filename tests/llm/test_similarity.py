"""The n-gram join, embedding near-duplicates, fingerprints and the license scan against brute force."""

import base64
import hashlib
import random
import re
import struct
from collections import Counter

import numpy as np
import pytest
import xxhash

from loomframe.llm import fingerprint, itq, licenses, ngram_join
from loomframe.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def shingles_of(text, n):
    words = WORD.findall((text or "").translate(UPPER))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def groups(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def joined_by_force(rows, n, percent):
    sets = [(i, shingles_of(t, n)) for i, t in rows]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if a is not None and b is not None and a != b and x and y and 100 * len(x & y) >= percent * len(x | y)]
    named = groups({i for i, _ in rows if i is not None}, links)
    return Counter((i, len(s), None if i is None else named[i]) for i, s in sets)


@pytest.fixture(scope="module")
def near_copies(spark):
    """Copies that differ by a few words, on both sides of the threshold, in chains and with a common passage."""
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=30))
    rows, seeds = [], [rng.choices(vocabulary, k=rng.choice([6, 25, 60, 200])) for _ in range(12)]
    for i in range(140):
        text = list(seeds[i % len(seeds)])
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        rows.append((1000 - i, " ".join(text) + (f" {passage}" if i % 3 == 0 else "")))
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("table", ["edge", "small", "empty", "near_copies"])
@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_ngram_join(request, table, n, percent):
    docs = request.getfixturevalue(table)
    got = Counter(tuple(r) for r in ngram_join.join(docs, n, percent).select("doc_id", "n_shingles", "component_id").collect())
    assert got == joined_by_force([(r["doc_id"], r["text"]) for r in docs.collect()], n, percent)


@pytest.mark.parametrize("hot", [2, 8])
def test_ngram_join_with_frequent_shingles(monkeypatch, near_copies, hot):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "NEIGHBOURS", 2)
    got = Counter(tuple(r) for r in ngram_join.join(near_copies).select("doc_id", "n_shingles", "component_id").collect())
    assert got == joined_by_force([(r["doc_id"], r["text"]) for r in near_copies.collect()], 4, 85)


def test_one_of_each_keeps_rows_and_columns(edge):
    out = ngram_join.one_of_each(edge)
    assert out.columns == edge.columns
    kept = Counter(r["doc_id"] for r in out.collect())
    assert kept[1] == 1 and kept[2] == 0 and kept[11] == 2 and kept[None] == 2 and kept[5] == kept[6] == kept[7] == 1
    assert kept[8] == 1 and kept[9] == 0


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (5, 5)], "a long, b long")
    assert {tuple(r) for r in components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 7)}


def vectors_by_force(rows, threshold):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(good)
    dim = max((len(v) for v in good.values()), default=0)
    x = np.zeros((len(ids), dim))
    for k, i in enumerate(ids):
        x[k, : len(good[i])] = good[i] / np.linalg.norm(good[i])
    pairs = itq.brute_force(x, threshold) if len(ids) else np.zeros((0, 2), int)
    links = [(ids[a], ids[b]) for a, b in pairs]
    n = Counter(i for pair in links for i in pair)
    named = groups(ids, links)
    return {(i, n[i], named.get(i, i), named.get(i, i) == i) for i, _ in rows if i is not None}


def test_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    rng = np.random.default_rng(8)
    for k, (_, v) in enumerate(rows[:150]):  # near copies on both sides of the threshold
        v = np.array(v)
        rows.append((10_000 + k, [float(x) for x in v + rng.choice([0.1, 0.25, 0.35]) * np.linalg.norm(v) / np.sqrt(len(v)) * rng.standard_normal(len(v))]))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = vectors_by_force(rows, 0.95)
    got = {tuple(r) for r in itq.linked(table).collect()}
    found, there = sum(r[1] for r in got), sum(r[1] for r in want)
    assert there and found >= 0.9 * there and len(got) == len(rows)
    by_id = {r[0]: r for r in want}
    assert all(r[1] <= by_id[r[0]][1] and r[2] >= by_id[r[0]][2] for r in got)  # nothing is linked that shouldn't be


def test_odd_vectors(spark):
    a, b = [1.0, 2.0, 3.0], [1.0, 2.0, 3.01]
    rows = [(1, a), (2, b), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 0.0]), (7, [float("nan"), 1.0, 1.0]), (8, [float("inf"), 0.0, 0.0]), (9, a), (10, [-1.0, -2.0, -3.0]), (11, [1e-200, 2e-200, 3e-200]), (12, [2.0])]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in [*rows, (None, a)]], "vec_id long, embedding array<double>, cid string, t int")
    got = [tuple(r) for r in itq.linked(table).collect()]
    assert (None, 0, None, False) in got
    assert {r for r in got if r[0] is not None} == vectors_by_force([r if r[0] != 11 else (11, a) for r in rows], 0.95)
    assert itq.linked(table.limit(0)).count() == 0


def test_rows_that_share_a_vector_id(spark):
    """Each row is a vector of its own; their component is that of the id."""
    rows = [(5, [1.0, 0.0, 0.0]), (5, [0.0, 1.0, 0.0]), (2, [0.0, 1.0, 0.01]), (9, [1.0, 0.01, 0.0]), (7, [0.0, 0.0, 1.0])]
    got = sorted(tuple(r) for r in itq.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(2, 1, 2, True), (5, 1, 2, False), (5, 1, 2, False), (7, 0, 7, True), (9, 1, 2, False)]


def test_codes_within_the_radius_meet_and_others_do_not():
    """The tables' rule, bit by bit: two vectors share a bucket if their keys differ in one place at most."""
    p = itq.differing(0.95)
    assert itq.n_tables(16, 0.95, 0.97) == 5 and 64 * p < itq.code_radius(64, 0.95) < 32
    keys = range(16)
    buckets = {k: {k, *(k | 1 << b for b in range(4) if not k >> b & 1)} for k in keys}
    for x in keys:
        for y in keys:
            met = [b for b in buckets[x] & buckets[y] if b in (x, y)]
            assert len(met) == (1 if (x ^ y).bit_count() <= 1 else 0)


def test_large_buckets_are_cut(spark, monkeypatch):
    monkeypatch.setattr(itq, "BLOCK", 16)
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(8)
    rows = [(i, [float(x) for x in centre + 0.02 * rng.standard_normal(8)]) for i in range(120)]
    rows += [(200 + i, [float(x) for x in rng.standard_normal(8)]) for i in range(40)]
    got = {tuple(r) for r in itq.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == vectors_by_force(rows, 0.95)


UNIT = re.compile(rf"[^\n.!?]{{1,{fingerprint.PARAGRAPH}}}[.!?]*|[.!?]+")


def likeness(a, b):
    x, y = set(UNIT.findall(a)), set(UNIT.findall(b))
    return 1.0 if not x | y else len(x & y) / len(x | y)


@pytest.mark.parametrize("table", ["edge", "small", "empty"])
def test_fingerprints(request, table):
    docs = request.getfixturevalue(table)
    got = fingerprint.compared(docs).collect()
    assert len(got) == docs.count()
    if table == "edge":  # the order of rows with equal ids is by hash: only what doesn't depend on it
        assert Counter((r["doc_id"], r["n_chars"]) for r in got) == Counter((r["doc_id"], len(r["text"] or "")) for r in docs.collect())
        same = {r["doc_id"]: r["fingerprint"] for r in got if r["doc_id"] in (1, 2)}
        assert same[1] == same[2]
        return
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    by_id = {r["doc_id"]: r for r in got}
    for k, (doc_id, text) in enumerate(rows):
        other = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + other[:cut]
        r = by_id[doc_id]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(likeness(text, edited), abs=1e-12)
        assert r["near_next"] == pytest.approx(likeness(text, other), abs=1e-12)


def test_only_document_is_its_own_next(spark):
    r = fingerprint.compared(spark.createDataFrame([(1, "one. two. three. four.")], "doc_id long, text string")).first()
    assert r["near_next"] == 1.0


def xx(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed)


def cells_of(shown):
    return [list(c) for c in struct.iter_unpack(">HQI", base64.b64decode(shown))]


def peeled_by_hand(a, b):
    """The digests that two fingerprint strings differ in: cells subtracted, then peeled; None if cells are left."""
    cells = [[(x[0] - y[0]) % 65536, x[1] ^ y[1], x[2] ^ y[2]] for x, y in zip(cells_of(a), cells_of(b), strict=True)]
    width, found = 1 << fingerprint.SHOWN_BITS, set()
    while alone := [c for c in cells if c[0] in (1, 65535) and xx(c[1].to_bytes(8, "little")) & 0xFFFFFFFF == c[2]]:
        n, k, c = alone[0]
        found.add(k)
        drawn = xx(bytes(4), xx(k.to_bytes(8, "little")))
        drawn -= (drawn >> 63) << 64
        for t in range(3):
            cell = cells[t * width + (drawn >> (21 * t)) % width]
            cell[:] = [(cell[0] - n) % 65536, cell[1] ^ k, cell[2] ^ c]
    return None if any(any(c) for c in cells) else found


def test_fingerprints_are_sketches_that_subtract(spark):
    """Two fingerprint strings, subtracted and peeled, give exactly the paragraphs that differ."""
    lines = [f"Sentence number {i} of all." for i in range(60)]
    texts = ["".join(lines), "".join(lines[:57]), "".join(lines[2:]), "".join(lines), "", None]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")  # ids of another type
    got = {r["doc_id"]: r for r in fingerprint.compared(rows).collect()}
    assert got["0"]["fingerprint"] == got["3"]["fingerprint"] and len({r["fingerprint"] for r in got.values()}) == 4
    assert {len(r[c]) for r in got.values() for c in ("fingerprint", "edited_fingerprint")} == {448}
    sets = [{xx(u.encode()) for u in UNIT.findall(t or "")} for t in texts]
    for i, j in ((0, 1), (0, 2), (1, 2), (0, 3), (4, 5)):
        assert peeled_by_hand(got[str(i)]["fingerprint"], got[str(j)]["fingerprint"]) == sets[i] ^ sets[j]
    assert got["0"]["near_next"] == pytest.approx(57 / 60)


def test_license_scan_finds_whole_and_changed_notices(spark):
    filler = " ".join(f"x{i}" for i in range(300))
    texts = [(i, f"{filler} {t} {filler}") for i, t in enumerate(licenses.TEMPLATES.values())]
    long = licenses.TEMPLATES["Apache-2.0-header"].split()
    long[20] = "changed"
    texts += [(100, f"{filler} {' '.join(long)}"), (101, None), (102, ""), (103, filler), (104, "the MIT")]
    got = {(r["doc_id"], r["license"]): r for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert all((i, name) in got for i, name in enumerate(licenses.TEMPLATES))
    assert 0.8 <= got[100, "Apache-2.0-header"]["containment"] < 1
    assert not any(i > 100 for i, _ in got)
    assert all(r["containment"] >= 0.8 and r["first_word"] < r["end_word"] for r in got.values())


def plain(text):
    return re.sub(r"[!-/:-@\[-`{-~]", " ", text).translate(UPPER).split()


def test_license_scan_against_every_window(small):
    """A notice whose shingles lie together in a text, by trying every place."""
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(small).collect()}
    for r in small.collect():
        words = plain(r["text"])
        for name, template in licenses.TEMPLATES.items():
            t = plain(template)
            whole = any(words[i : i + len(t)] == t for i in range(len(words) - len(t) + 1))
            if whole:
                assert (r["doc_id"], name) in got
    assert licenses.scan(small.limit(0)).count() == 0


def held_by_force(words, cut_stride, window, template, n):
    """The largest share of a template's shingles in any window that starts at a multiple of the stride."""
    wanted = {tuple(template[i : i + n]) for i in range(max(1, len(template) - n + 1))}
    best = 0.0
    for start in range(0, max(1, len(words)), cut_stride):
        part = words[start : start + window]
        best = max(best, len(wanted & {tuple(part[i : i + n]) for i in range(len(part) - n + 1)}) / len(wanted))
    return best


def test_license_scan_holds_what_brute_force_holds(spark):
    """Both sides of the containment, templates of three to 2,000 words, with words put in and taken out."""
    rng = random.Random(6)
    templates = {"tiny": "alpha beta gamma", "short": " ".join(f"s{i}" for i in range(9)), "middle": " ".join(f"m{i}" for i in range(60)), "long": " ".join(f"g{i}" for i in range(2000))}
    texts = []
    for name, template in templates.items():
        t = template.split()
        for changes in (0, 1, 2, 4, len(t) // 30, len(t) // 12):
            copy = list(t)
            for _ in range(changes):
                copy[rng.randrange(len(copy))] = "other"
            put_in = rng.randrange(len(copy))
            copy[put_in:put_in] = ["in"] * min(15, len(copy) // 4)
            texts.append(" ".join(["pad"] * rng.randrange(50) + copy + ["pad"] * rng.randrange(50)))
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t in enumerate(texts)], "doc_id long, text string, license string, containment double")
    got = {(r["doc_id"], r["license"]): r["containment"] for r in licenses.scan(docs, templates).collect()}
    groups = {name: g for g in licenses.prepared(templates) for name in g.names}
    # A document's windows start where the texts before it in its batch let them, so the share in any window bounds what is found.
    for i, text in enumerate(texts):
        for name, template in templates.items():
            g, words, t = groups[name], text.split(), template.split()
            most = held_by_force(words, 1, g.window, t, g.shingle)
            sure = held_by_force(words, 1, g.window - g.stride + 1, t, g.shingle)
            if sure >= 0.8:
                assert got[i, name] >= sure - 1e-12
            if most < 0.8:
                assert (i, name) not in got
            elif (i, name) in got:
                assert got[i, name] <= most + 1e-12
    assert {n for _, n in got} == set(templates)


def test_license_templates_of_odd_lengths(edge, empty):
    with pytest.raises(ValueError, match="no words"):
        licenses.prepared({"empty": " ... "})
    got = licenses.scan(edge, {"two": "two words", "tie": "tie one two three four"}).collect()
    assert sorted((r["doc_id"], r["license"]) for r in got) == [(8, "two"), (9, "two"), (11, "tie"), (11, "tie")]
    assert licenses.scan(empty, {"two": "two words"}).count() == 0 and licenses.scan(edge, {}).count() == 0
