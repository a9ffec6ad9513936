"""Exact top-k, whitening and spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from loomframe.llm import spelling, topk, whitening

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, score long, segment int, w string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], VECTORS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, non-finite parts, short and empty vectors, repeats, ties, a hot group of copies."""
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.3, 8)]) for i in range(200)]
    rows += [(300 + i, rows[7][1]) for i in range(120)] + [(50, rows[9][1]), (50, rows[9][1]), (None, rows[3][1]), (450, None), (500, []), (550, [0.0] * 8), (551, [0.5, -0.25])]
    rows += [(600, [float("nan")] + [0.0] * 7), (601, [float("inf")] * 8), (602, [None, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (650, [1e30] * 8), (651, [-1e30] * 8)]
    return rows


def good(rows):
    return [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v)]


def scores_by_force(rows, k=5):
    rows = [(i, v) for i, v in good(rows) if i is not None]
    dim = max([len(v) for _, v in rows], default=1)
    most = int((2**62 // dim) ** 0.5)
    x = [[min(max(int(np.floor(min(max(float(np.float32(c)) * 256, -most), most))), -most), most) for c in v] + [0] * (dim - len(v)) for _, v in rows]
    out = Counter()
    for a, (i, _) in enumerate(rows):
        if i % 50 == 0:
            best = sorted((-sum(p * q for p, q in zip(x[a], x[b], strict=True)), j) for b, (j, _) in enumerate(rows) if b != a)[:k]
            out.update((i, r + 1, j, -s) for r, (s, j) in enumerate(best))
    return out


@pytest.mark.parametrize(("segment", "queries"), [(8192, 2048), (40, 3)])
def test_topk_is_brute_force(spark, odd, segment, queries):
    got = Counter(tuple(r) for r in topk.search(table(spark, odd), segment=segment, queries=queries).collect())
    assert got == scores_by_force(odd)
    assert got


def test_topk_over_the_given_table(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    assert Counter(tuple(r) for r in topk.search(vectors, segment=100, queries=4).collect()) == scores_by_force(rows)


def test_topk_of_few_or_no_rows(spark):
    assert topk.search(table(spark, [])).count() == 0
    assert topk.search(table(spark, [(1, None)])).count() == 0
    assert [tuple(r) for r in topk.search(table(spark, [(0, [1.0]), (3, [0.5])])).collect()] == [(0, 1, 3, 256 * 128)]


def test_threshold_stops_before_all_are_met():
    rng = np.random.default_rng(1)
    x = np.rint(rng.normal(0, 20, (5000, 4))).astype(np.int64)
    x[17] = [900, -900, 900, 900]
    lists = topk.Lists(x, np.arange(5000))
    places, scores, looked = lists.top(x[17], 17, 1, None)
    want = np.lexsort((np.arange(5000), -(x @ x[17])))
    assert (places[0], scores[0]) == (want[1], (x @ x[17])[want[1]])
    assert looked < 1000
    same = topk.Lists(np.full((3000, 4), 7, np.int64), np.arange(3000))
    assert same.top(np.full(4, 7), 5, 3, None)[0].tolist() == [0, 1, 2]
    assert same.top(np.full(4, 7), 5, 3, None)[2] < 100  # a bound that equals the k-th score stops by ids
    assert not len(same.top(np.full(4, 7), -1, 3, 10**6)[0])


def whitened_by_force(rows, dim):
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in [*v, *[0.0] * (dim - len(v))]] for _, v in rows], dtype=object)
    n, s = len(x), x.sum(axis=0)
    y = x * n - s
    c = (y / n).astype(float)
    e, axes = np.linalg.eigh(c.T @ c / n)
    return n, (y**2).sum(axis=1), c, e[::-1], axes[:, ::-1]


@pytest.mark.parametrize("kind", ["odd", "given"])
def test_whitening_is_the_eigenproblem(spark, odd, kind):
    if kind == "given":
        rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    else:
        rows = [(k, v) for k, (_, v) in enumerate(odd) if v is None or 1e30 not in map(abs, [x for x in v if x is not None])]
    got = whitening.whiten(table(spark, rows)).collect()
    rows = good(rows)
    dim = max(len(v) for _, v in rows)
    n, deviation, c, e, axes = whitened_by_force(rows, dim)
    at = {i: k for k, (i, _) in enumerate(rows)}
    assert len(got) == n * min(8, dim)
    assert {(r.vec_id, r.component) for r in got} == {(i, k) for i in at for k in range(1, min(8, dim) + 1)}
    by = {k: sorted((r for r in got if r.component == k), key=lambda r: at[r.vec_id]) for k in range(1, min(8, dim) + 1)}
    for k, mine in by.items():
        assert [r.deviation for r in mine] == list(deviation)
        assert {r.n for r in mine} == {n}
        want, have = c @ axes[:, k - 1] / np.sqrt(e[k - 1]), np.array([r.whitened for r in mine])
        assert min(np.abs(want - have).max(), np.abs(want + have).max()) < 1e-8
        assert mine[0].explained == pytest.approx(e[k - 1] / e.sum(), rel=1e-10)
        assert mine[0].identity_error < 1e-10


def test_whitening_of_flat_and_empty_tables(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    line = whitening.whiten(table(spark, [(None, [1.0, 1.0]), (2, [2.0, 2.0]), (2, [4.0, 4.0])])).collect()
    assert sorted((r.vec_id or 0, r.component) for r in line) == [(0, 1), (2, 1), (2, 1)]
    assert line[0].explained == pytest.approx(1)


def test_lobpcg_iterates_on_wide_matrices():
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.standard_normal((300, 300)))[0]
    e = np.sort(rng.random(300))[::-1] * 50
    v = (q * e) @ q.T
    values, axes, norms, passes = whitening.lobpcg(lambda b: v @ b, 300, 8, guard=8)
    assert np.allclose(values, e[:8], rtol=1e-12)
    assert 4 < passes < 120
    assert np.abs(np.abs((axes * q[:, :8]).sum(axis=0)) - 1).max() < 1e-12
    assert (norms < 1e-11).all()


RUN = re.compile("[A-Za-zÀ-ÿ]+")


def variants_by_force(rows, delete=199, min_chars=6, min_count=5):
    n = Counter()
    for i, text in rows:
        for word in RUN.findall(text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % delete == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] += 1
    n = {w: c for w, c in n.items() if len(w) >= min_chars and c >= min_count}
    near = {w: [] for w in n}
    gone = {}
    for w in n:
        for i in range(len(w)):
            gone.setdefault((i, w[:i] + w[i + 1 :]), set()).add(w)
            if w[:i] + w[i + 1 :] in n:
                near[w].append(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].append(w)
    for same in gone.values():
        for w in same:
            near[w] += same - {w}
    form = {}
    for w in n:
        near[w] = set(near[w])
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    root = {}
    for w in n:
        at = w
        while form[at]:
            at = form[at]
        root[w] = at
    return {(w, form[w], root[w], n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def chained():
    rng = random.Random(6)
    rows = []
    for k, times in enumerate((3000, 500, 90, 17)):  # each word's form is the one before
        rows += [(k, f" {'abcdefgh'[: 8 - k]}zzzzz" * times)]
    words = ["".join(rng.choices("abÀ×", k=rng.choice([6, 6, 7, 8]))) for _ in range(700)]
    rows += [(100 + i, " ".join(rng.choices(words, k=60)).replace("a", "A", 2)) for i in range(400)]
    return [*rows, (None, "Straßeé " * 9), (None, None), (9, ""), (9, "x" * 60_000 + " " + "kkkkkk " * 40 + "kkkkk " * 40), (9, ("q" * 3000 + " ") * 6)]


@pytest.mark.parametrize(("q", "block"), [(2, 4096), (3, 40)])
def test_variants_are_brute_force(spark, block, q):
    rows = chained()
    docs = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(3)
    got = [tuple(r) for r in spelling.variants(docs, block=block, q=q, delete=19).collect()]
    want = variants_by_force(rows, delete=19)
    assert len(got) == len(want)
    assert set(got) == want
    assert len({w[2] for w in want}) < len(want) and any(w[4] > 3 for w in want)


@pytest.mark.parametrize("name", ["edge", "empty", "small"])
def test_variants_of_tables(spark, request, name):
    docs = request.getfixturevalue(name)
    got = spelling.variants(docs).collect()
    assert {tuple(r) for r in got} == variants_by_force([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_short_words_need_short_grams(spark):
    docs = spark.createDataFrame([(1, "abcde " * 9)], "doc_id long, text string")
    with pytest.raises(ValueError, match="shorter q-grams"):
        spelling.variants(docs, min_chars=3, q=3)


def test_setting_is_put_back(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "10000")
    spelling.words(spark.createDataFrame([(1, "letters " * 9)], "doc_id long, text string"))
    whitening.whiten(table(spark, [(1, [1.0]), (2, [2.0])]))
    assert spark.conf.get(key) == "10000"
