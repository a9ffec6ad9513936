"""Classes, weights and edges that come from every row, not from a share of them."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from loomframe.llm import lm, sharding
from loomframe.llm.queries import tokenizer_path, tokenizer_pattern

ARGS = tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_pattern()


def test_edges_of_a_text_dimension_count_every_value(spark):
    docs = spark.range(15_000).select(F.concat(F.lit("v"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("s")).withColumn("n", F.expr("if(s like '%7', 4, 1)"))
    docs = docs.select(F.explode(F.array_repeat("s", F.col("n"))).alias("s")).union(spark.createDataFrame([(None,)] * 9, "s string"))
    counts = sorted(Counter(r["s"] for r in docs.collect() if r["s"] is not None).items())
    reached = np.cumsum([n for _, n in counts])
    for bits in (3, 5):
        places = np.searchsorted(reached, reached[-1] * np.arange(1, 1 << bits) / (1 << bits))
        assert sharding.text_edges(docs, "s", bits) == [counts[i][0] for i in sorted(set(places.tolist()))]
    assert sharding.text_edges(docs.filter("s is null"), "s", 3) == []


def test_every_training_document_is_in_one_round_and_in_the_neighbours(small):
    docs = small.filter(~lm.held_out(F.col("doc_id")))
    n = docs.count()
    cut = lm.rounds(docs, n, 5)
    assert len(cut) > 2 and sorted(r["doc_id"] for part, _ in cut for r in part.collect()) == sorted(r["doc_id"] for r in docs.collect())
    tool = lm.Subwords(*ARGS)
    flat, sizes, _ = tool.laid_out(tool.read([r["text"] for r in docs.collect()]))
    counts = np.bincount(flat, minlength=tool.end + 1)
    cells = lm._beside(flat, sizes, lm._marks(counts)[1], tool.end)
    assert (lm.pair_counts(docs, counts, *ARGS).ravel() == np.bincount(cells, minlength=len(counts) * lm.COLUMNS)).all()


def test_mixtures_of_texts():
    rng = np.random.default_rng(2)
    network, shares, starts = -rng.random(90) * 8, -rng.random(90) * 8, np.array([0, 1, 40])
    got = lm.mixtures(network, shares, starts)
    for i, w in enumerate(lm.WEIGHTS):
        each = np.log10(w * 10.0**network + (1 - w) * 10.0**shares)
        assert np.allclose(got[:, i], [each[:1].sum(), each[1:40].sum(), each[40:].sum()])
