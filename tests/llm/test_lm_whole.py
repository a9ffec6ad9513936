"""The language model trains on every training document and scores rare words by their counts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.llm import lm
from loomframe.llm.queries import tokenizer_path, tokenizer_pattern

ARGS = tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_pattern()


def test_scores_do_not_depend_on_which_words_are_broadcast(small, monkeypatch):
    whole = {r["doc_id"]: r for r in lm.scored(small, *ARGS, max_docs=60).collect()}
    monkeypatch.setattr(lm, "FREQUENT", 50)
    for r in lm.scored(small, *ARGS, max_docs=60).collect():
        assert r["score"] == pytest.approx(whole[r["doc_id"]]["score"], rel=1e-5)
        assert (r["base_score"], r["n_known"]) == (pytest.approx(whole[r["doc_id"]]["base_score"]), whole[r["doc_id"]]["n_known"])


def test_every_training_document_is_learnt(small):
    docs = small.filter(~lm.held_out(F.col("doc_id")))
    tool = lm.Subwords(*ARGS)
    flat, sizes, _ = tool.laid_out(tool.read([r["text"] for r in docs.collect()]))
    counts = np.bincount(flat, minlength=tool.end + 1)
    model = lm.fit(flat[: sizes[:10].sum()], sizes[:10], counts, tool.end, tool.starts, steps=20)
    before = {n: a.copy() for n, a in model.weights.items()}
    model, seen = lm.trained(docs, model, *ARGS)
    assert seen == len(flat)
    assert all(np.isfinite(a).all() for a in model.weights.values()) and any((a != before[n]).any() for n, a in model.weights.items())
