"""Mixing, sharding, language-model scores, toxicity and the pipeline."""

import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from loomframe.llm import lm, mixing, ngram_join, queries, sharding, toxicity
from loomframe.llm.queries import tokenizer_path, tokenizer_pattern

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def mixed_by_sql(docs):
    rows = docs.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"})
    with duckdb.connect() as con:
        con.register("documents", rows)
        return con.execute(queries.MIX_SQL).fetchall()


@pytest.mark.parametrize("table", ["edge", "small"])
def test_mix_equals_sorting(request, table):
    docs = request.getfixturevalue(table)
    key = lambda rows: Counter((i, a, b, round(c, 6), d) for i, a, b, c, d in rows)
    got = mixing.report(docs).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert key(map(tuple, got)) == key(mixed_by_sql(docs))


def test_mix_laws(small, empty):
    rows = mixing.report(small).collect()
    assert rows and all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    by_id = {r["doc_id"]: r["source"] for r in small.collect()}
    taken, target, largest = Counter(), {}, Counter()
    for r in rows:
        s = by_id[r["doc_id"]]
        taken[s] += r["taken"]
        target[s] = r["target"]
        largest[s] = max(largest[s], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    assert sum(target.values()) == pytest.approx(sum(r["size"] for r in rows))
    assert mixing.report(empty).count() == 0 and mixing.mixture(empty).count() == 0


def test_mixture_repeats_rows(edge):
    out = mixing.mixture(edge)
    assert out.columns == edge.columns
    taken = Counter()
    for r in out.collect():
        taken[r["doc_id"]] += len(WORD.findall(r["text"] or ""))
    want = Counter()
    for r in mixing.report(edge).collect():
        want[r["doc_id"]] += r["taken"]
    assert +taken == +want


@pytest.mark.parametrize("law", ["rows", "bytes"])
@pytest.mark.parametrize("table", ["edge", "small", "empty"])
def test_shards(request, law, table):
    docs = request.getfixturevalue(table)
    got = sharding.shards(docs, law=law).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == law and r["grown_shard"] is None and 0 <= r["shard"] < 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if law == "rows" and got:
        counts = [len(slots.get(s, [])) for s in range(16)]
        assert max(counts) - min(counts) <= 1
    by_curve = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in by_curve] == sorted(r["curve"] for r in got)


def test_curve_visits_every_cell_once_by_single_steps():
    cells = np.array([[a, b, c] for a in range(8) for b in range(8) for c in range(8)])
    index = sharding.hilbert_index(cells, 3)
    assert sorted(index) == list(range(512))
    path = cells[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def scores_by_force(rows):
    lowered = [(i, WORD.findall((t or "").translate(UPPER))) for i, t in rows]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter()
    for i, words in lowered:
        if not held(i):
            counts.update([*words, None])
    n, v = sum(counts.values()), len(counts)
    chance = lambda w: math.log10((counts[w] + 1) / (n + v + 1))
    return [(i, held(i), len(words) + 1, sum(counts[w] > 0 for w in [*words, None]), n, sum(map(chance, [*words, None]))) for i, words in lowered]


@pytest.mark.parametrize("table", ["edge", "small", "empty"])
def test_language_model_counts(request, table):
    docs = request.getfixturevalue(table)
    got = lm.scored(docs, tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_pattern(), max_docs=60).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:4], round(r[5], 3))
    assert sorted(map(key, got)) == sorted(map(key, scores_by_force([(r["doc_id"], r["text"]) for r in docs.collect()])))
    for r in got:
        assert math.isfinite(r["score"]) and r["score"] < 0


def test_language_model_beats_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = [r for r in lm.scored(docs, tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_pattern()).collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def in_a_row(sequences):
    return np.concatenate(sequences), np.array([len(s) for s in sequences])


def test_attention_helps_on_held_out_texts(spark):
    """The network learns from what stands before: without its attention it is worse on texts it hasn't seen."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tool = lm.Subwords(tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_pattern())
    parts = {h: tool.laid_out(tool.read([r["text"] for r in docs.filter(f"crc32(cast(doc_id as string)) % 7 {'=' if h else '!='} 2").collect()])) for h in (False, True)}
    flat, sizes, _ = parts[False]
    model = lm.fit(flat, sizes, np.bincount(flat, minlength=tool.end + 1), tool.end, tool.starts)

    def bits():
        flat, sizes, lengths = parts[True]
        last = np.flatnonzero(flat[np.cumsum(lengths) - 1] == tool.end)
        return -lm.word_chances(model, flat, sizes, lengths, last).mean() / math.log10(2)

    with_attention = bits()
    model.weights["o"][:] = 0
    assert with_attention < bits() - 0.1


def test_network_chances_sum_to_one_and_look_back_only():
    rng = np.random.default_rng(1)
    sequences = [np.append(rng.integers(0, 40, 30), 50).astype(np.int32) for _ in range(20)]
    counts = np.bincount(np.concatenate(sequences), minlength=51)
    model = lm.fit(*in_a_row(sequences), counts, 50, np.ones(51, bool), steps=20, batch=256)
    one = lambda s: lm.word_chances(model, s, np.array([len(s)]), np.ones(len(s), np.int64), np.array([len(s) - 1]))
    base = sequences[0]
    last = [one(np.append(base[:12], k).astype(np.int32))[12] for k in range(51)]
    assert sum(10.0**x for x in last) == pytest.approx(1, abs=1e-3)
    changed = base.copy()
    changed[20:] = 3
    assert one(base)[:20] == pytest.approx(one(changed)[:20], abs=1e-5)


def test_word_chances_sum_to_one():
    """Words of one or two ids, where ids under 4 start a word and the end is 6; longer words are summed by what is left over."""
    rng = np.random.default_rng(5)
    starts = np.array([True] * 4 + [False] * 2 + [True])
    sequences = [np.array([x for _ in range(8) for x in ([int(rng.integers(0, 4))] + [int(rng.integers(4, 6))] * int(rng.integers(0, 2)))] + [6], np.int32) for _ in range(30)]
    model = lm.fit(*in_a_row(sequences), np.bincount(np.concatenate(sequences), minlength=7), 6, starts, steps=30, batch=128)

    def chance(word):  # of the word as a text's first, followed by any word
        ids = np.array([*word, 0, 6], np.int32)
        return 10.0 ** lm.word_chances(model, ids, np.array([len(ids)]), np.array([len(word), 1, 1]), np.array([2]))[0]

    by_length = [sum(chance((s, *rest)) for s in range(4) for rest in np.ndindex(*[2] * k) for rest in [tuple(r + 4 for r in rest)]) for k in range(5)]
    end = 10.0 ** lm.word_chances(model, np.array([6], np.int32), np.array([1]), np.array([1]), np.array([0]))[0]
    assert sum(by_length) + end < 1.0001 and sum(by_length) + end > 0.97


def test_gradients():
    rng = np.random.default_rng(2)
    sequences = [rng.integers(0, 9, 14).astype(np.int32) for _ in range(3)]
    model = lm.fit(*in_a_row(sequences), np.bincount(np.concatenate(sequences), minlength=10), 9, np.ones(10, bool), steps=3, batch=64)
    w = {n: a.astype(np.float64) for n, a in model.weights.items()}
    inputs, targets = lm._layout(*in_a_row(sequences), 9)
    real = inputs >= 0
    rows = np.where(real, model.input_of[inputs], lm.INPUTS - 1)
    at = np.flatnonzero(real)
    goal = model.class_of[targets][at]
    g = lm._gradients(w, rows, real, goal, at)

    def loss():
        logits = lm._logits(w, lm._forward(w, rows, real)["out"][at])
        return np.mean(np.log(np.exp(logits).sum(axis=1)) - logits[np.arange(len(at)), goal])

    for name in ("qkv", "o", "up", "down", "head", "near", "embed"):
        place = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        moved = {}
        for d in (1e-4, -1e-4):
            w[name][place] += d
            moved[d] = loss()
            w[name][place] -= d
        assert (moved[1e-4] - moved[-1e-4]) / 2e-4 == pytest.approx(g[name][place], rel=0.05, abs=1e-5)


def test_toxicity_on_labels_left_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fold = "doc_id % 4 = 0"
    texts = {r["text"] for r in docs.join(labels.filter(f"not ({fold})"), "doc_id").select("text").collect()}
    model = toxicity.train(docs, labels.filter(f"not ({fold})"))
    truth = {r["doc_id"]: bool(r["toxic"]) for r in labels.filter(fold).collect()}
    test = docs.join(labels.filter(fold).select("doc_id"), "doc_id")
    fresh = {r["doc_id"] for r in test.collect() if r["text"] not in texts}
    got = {r["doc_id"]: r for r in toxicity.scored(test, model).collect() if r["doc_id"] in fresh}
    right = sum(truth[i] == r["toxic"] for i, r in got.items())
    wrongly = sum(r["toxic"] and not truth[i] for i, r in got.items())
    assert right >= 0.95 * len(got) and wrongly <= 0.02 * len(got)
    assert all(0 <= r["expected_severity"] <= 3 and 0 <= r["grade"] <= 3 for r in got.values())


def test_toxicity_defined_cases(spark, edge, empty):
    labels = spark.createDataFrame([(1, 0), (3, None), (None, 1), (8, 1)], "doc_id long, toxic int")
    model = toxicity.train(edge, labels)
    got = toxicity.scored(edge, model)
    assert got.count() == edge.count() and toxicity.scored(empty, model).count() == 0
    assert all(r["grade"] == 0 for r in got.collect() if r["doc_id"] in (5, 6, 7))
    assert toxicity.clean(edge, toxicity.train(edge, labels.limit(0))).count() == edge.count()
    assert toxicity.clean(edge, model).columns == edge.columns


def test_toxicity_scores_are_those_of_the_model(edge, small):
    """Against a plain reading of the model: each word's features, weighted by the logarithm of their counts."""
    model = toxicity.Model({"vile": 2.0, "vile*": 0.5, "w79*": 1.0, "two": 1.5}, (1.0, 2.5, 4.0))
    for docs in (edge, small):
        want = []
        for r in docs.collect():
            counts = Counter(f for w in re.findall(r"[^\W_]+", (r["text"] or "").lower()) for f in [w, *(w[:k] + "*" for k in range(4, 9) if len(w) > k)])
            eta = sum(model.weights[f] * (1 + math.log(c)) for f, c in counts.items() if f in model.weights)
            p = [1 / (1 + math.exp(cut - eta)) for cut in model.cuts]
            want.append((str(r["doc_id"]), round(sum(p), 9), sum(x > 0.5 for x in p), p[0] > 0.5))
        got = [(str(r["doc_id"]), round(r["expected_severity"], 9), r["grade"], r["toxic"]) for r in toxicity.scored(docs, model).collect()]
        assert sorted(got) == sorted(want)


def test_mixture_keeps_columns_of_any_name(spark):
    rows = [(i, "word " * (1 + i % 5), "ab"[i % 2], i, f"m{i}", "p") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _copy int, _mix string, _plan string")
    out = mixing.mixture(docs)
    assert out.columns == docs.columns
    by_id = {r[0]: r for r in rows}
    got = [tuple(r) for r in out.collect()]
    assert got and all(r == by_id[r[0]] for r in got)


def test_strings_with_a_long_common_start_are_in_cells_of_their_own(spark):
    docs = spark.createDataFrame([(i, "text", f"same-prefix-{i % 8}", "en", 5) for i in range(64)], "doc_id long, text string, source string, lang string, n_chars long")
    rows = sharding.shards(docs.withColumn("source", docs["source"]), n=8, dims=("source",)).collect()
    named = {r["doc_id"]: r["source"] for r in docs.collect()}
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r["shard"], set()).add(named[r["doc_id"]])
    assert all(len(sources) == 1 for sources in by_shard.values())


def test_hilbert_shards_prune_by_any_dimension(spark):
    """Files that a filter on one dimension has to read: fewer than all, whichever dimension it is."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    met = docs.select("doc_id", "source", "lang").join(sharding.shards(docs).select("doc_id", "shard"), "doc_id").collect()
    for dim in ("source", "lang"):
        values = Counter(r[dim] for r in met)
        rare = min(values, key=values.get)
        assert len({r["shard"] for r in met if r[dim] == rare}) < 16


def test_cuts_are_ordered_and_severity_follows_hits():
    texts = [f"calm plain words {i}" for i in range(40)] + [f"calm {'vile ' * (1 + i % 5)}{i}" for i in range(40)]
    model = toxicity.fit(texts, np.array([False] * 40 + [True] * 40), np.ones(80))
    assert list(model.cuts) == sorted(model.cuts) and model.weights


def test_pipeline_stages(spark):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "ngram_join", "mixing", "byte_bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = stages["toxicity"](spark, docs, SF)
    rows = clean.collect()
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rejected = {r["doc_id"] for r in toxicity.scored(docs, model).collect() if r["toxic"]}
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()} - rejected and clean.columns == docs.columns
    single = stages["ngram_join"](spark, clean, SF)
    groups = {r["component_id"] for r in ngram_join.join(clean, 5, 80).collect()}
    assert {r["doc_id"] for r in single.collect()} == groups and single.columns == docs.columns
    mix = stages["mixing"](spark, single, SF)
    assert mix.columns == docs.columns and mix.count() > 0
    out = stages["byte_bpe"](spark, mix, SF)
    assert out.count() == mix.count() and out.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = Counter(tuple(r) for r in out.select("doc_id", "ids_sha256").collect())
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "ids_sha256").collect()) == want


@pytest.mark.parametrize("table", ["edge", "empty"])
def test_pipeline_on_odd_tables(spark, request, tmp_path, table):
    docs = request.getfixturevalue(table)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert bool(out) == (table == "edge")


def test_every_numbered_query_is_registered():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()] == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(queries.queries())
