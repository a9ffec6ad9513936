"""Byte-level BPE and token files against the libraries, and the range coder's exact round trip."""

import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomframe.llm import bpe, rangecoder, token_files
from loomframe.llm.queries import tokenizer_path, tokenizer_pattern

MULTI = tokenizer_path("byte_bpe_multi_50k.tiktoken")
LIBRARY = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    return tiktoken.Encoding("own", pat_str=tokenizer_pattern(), mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(MULTI), tokenizer_pattern())


def expected(rows, reference):
    out = []
    for doc_id, text in rows:
        ids = reference.encode_ordinary(text or "")
        out.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("table", ["edge", "small", "empty"])
def test_digests_match_the_library(request, reference, table):
    docs = request.getfixturevalue(table)
    got = Counter(tuple(r) for r in bpe.digests(docs, MULTI, tokenizer_pattern()).collect())
    assert got == expected([(r["doc_id"], r["text"]) for r in docs.collect()], reference)


def test_encoded_and_decoded_keep_other_columns(edge):
    rows = bpe.decoded(bpe.encoded(edge, MULTI, tokenizer_pattern()), MULTI, tokenizer_pattern())
    assert rows.columns == [*edge.columns, "ids", "bytes"]
    assert all(bytes(r["bytes"]) == (r["text"] or "").encode() for r in rows.collect())


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(list(" \t\nabthe12'sé你.!?- \xa0")), max_size=60))
def test_any_text_is_encoded_as_by_the_library(reference, codec, text):
    assert list(next(codec.encode([text]))) == reference.encode_ordinary(text)


@pytest.mark.parametrize("table", ["edge", "small", "empty"])
def test_token_files(request, table):
    from tokenizers import Tokenizer

    docs = request.getfixturevalue(table)
    tool = Tokenizer.from_file(LIBRARY)
    tool.encode_special_tokens = True
    want, at = [], 0
    rows = {(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()}
    ids_of = {k: [*tool.encode(k[1], add_special_tokens=False).ids, 0] for k in rows}
    crc = {k: zlib.crc32(np.array(v, "<u4").tobytes()) for k, v in ids_of.items()}
    got = token_files.read(token_files.write(docs, LIBRARY)).orderBy("start").collect()
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        want.append(r["doc_id"])
    assert want == sorted((r["doc_id"] for r in docs.select("doc_id").collect()), key=lambda x: (x is not None, x))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((r["doc_id"], len(ids_of[r["doc_id"], r["text"] or ""]), crc[r["doc_id"], r["text"] or ""]) for r in docs.collect())


def test_token_ids_are_read_back(small):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(LIBRARY)
    tool.encode_special_tokens = True
    texts = {r["doc_id"]: r["text"] for r in small.collect()}
    for r in token_files.read_ids(token_files.write(small.limit(40), LIBRARY)).collect():
        assert list(r["ids"]) == [*tool.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 0]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 50_256), max_size=3000))
def test_range_coder_round_trip(ids):
    assert list(rangecoder.unpack(rangecoder.pack(np.array(ids, np.int32), 50_257))) == ids


def test_predictable_ids_take_few_bytes():
    ids = np.tile(np.arange(100, 180, dtype=np.int32), 500)
    assert len(rangecoder.pack(ids, 50_257)) < 0.25 * 2 * len(ids)


def test_blocks_are_independent_and_checked():
    ids = np.arange(5000, dtype=np.int32) % 700
    data = bytearray(rangecoder.pack(ids, 50_257))
    data[-40] ^= 0xFF
    with pytest.raises(ValueError, match="damaged"):
        rangecoder.unpack(bytes(data))
    with pytest.raises(ValueError, match="not a chunk"):
        rangecoder.unpack(b"abcd" + bytes(data[4:]))


def real_ids(small, n=60):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(LIBRARY)
    rows = small.orderBy("doc_id").limit(n).select("text").collect()
    return np.concatenate([np.array([*tool.encode(r["text"] or "", add_special_tokens=False).ids, 0], np.int32) for r in rows])


def test_real_ids_take_fewer_bits_than_zlib(small):
    ids = real_ids(small, 200)
    data = rangecoder.pack(ids, 50_257)
    assert (rangecoder.unpack(data) == ids).all()
    assert len(data) < len(zlib.compress(ids.astype("<u2").tobytes(), 9))


def test_a_block_is_read_without_the_others(small, monkeypatch):
    """A chunk's tables and one block's code are all that the block's ids need."""
    ids = real_ids(small)[: 3 * rangecoder.BLOCK_IDS]
    seen = {}
    decode = rangecoder._decode
    monkeypatch.setattr(rangecoder, "_decode", lambda data, sizes, tables: seen.update(data=data, sizes=sizes, tables=tables) or decode(data, sizes, tables))
    rangecoder.unpack(rangecoder.pack(ids, 50_257))
    whole = decode(seen["data"], seen["sizes"], seen["tables"])
    alone = decode(seen["data"][1:2], seen["sizes"][1:2], seen["tables"])
    assert (alone[:, 0] == whole[:, 1]).all()


def test_memory_that_is_full_starts_anew(monkeypatch, reference):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    tool = bpe.Codec(bpe.read_ranks(MULTI), tokenizer_pattern())
    for text in ("one two three", "four five six seven eight nine ten", "one  two \n three", "", " x"):
        assert list(next(tool.encode([text]))) == reference.encode_ordinary(text)


def test_session_settings_stay(small):
    spark = small.sparkSession
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    token_files.read(token_files.write(small.limit(5), LIBRARY)).collect()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) in (int(before), 256)


def test_a_taken_column_name_is_an_error(small):
    with pytest.raises(ValueError, match="already"):
        bpe.encoded(small.withColumnRenamed("lang", "IDS"), MULTI, tokenizer_pattern())
