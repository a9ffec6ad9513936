"""op3_token_files gives the ids of the tokenizers library with its own settings, added tokens included."""

import zlib

import numpy as np

from loomframe.llm import queries
from loomframe.llm.queries import tokenizer_path


def test_query_reads_added_tokens_as_the_library(edge, spark, monkeypatch):
    from tokenizers import Tokenizer

    docs = edge.select("doc_id", "text").filter("doc_id = 12").union(spark.createDataFrame([(20, "a <|endoftext|> b"), (21, "<|endoftext|>"), (22, "x<|endoftext|>\n<|endoftext|> y"), (23, "plain text")], "doc_id long, text string"))
    monkeypatch.setattr(queries, "documents", lambda spark, sf: docs)
    tool = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = {r["doc_id"]: [*tool.encode(r["text"], add_special_tokens=False).ids, 0] for r in docs.collect()}
    assert want[20] == [64, 220, 50256, 275, 0]
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in queries.op3_token_files(spark, "").collect()}
    assert got == {i: (len(v), zlib.crc32(np.array(v, "<u4").tobytes())) for i, v in want.items()}
