"""op3_token_files learns a piece from the library once: a full memory keeps what recurs, and words are read apart from signs."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomframe.llm import bpe, token_files
from loomframe.llm.queries import tokenizer_path

LIBRARY = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def codec():
    return token_files.LibraryCodec(LIBRARY)


def test_full_memory_keeps_what_recurs(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 8)
    learnt = []
    memory = bpe.Memory(lambda pieces: (learnt.extend(pieces), np.array([len(p) for p in pieces], np.int32), np.ones(len(pieces), np.int64))[1:])
    for block in (["a", "bb"], ["a", "bb", "ccc"], ["d4", "e5", "f6", "g7"], ["h8", "i9", "a", "bb"]):
        ids, counts = memory.laid_out(memory.places(pa.array(block, pa.large_string())))
        assert ids.tolist() == [len(p) for p in block] and counts.tolist() == [1] * len(block)
    assert learnt.count("a") == learnt.count("bb") == 1 and len(memory.known) <= 8


def test_word_is_learnt_once_whatever_follows_it(codec, monkeypatch):
    asked = []
    read = codec._read
    monkeypatch.setattr(codec, "_read", lambda pieces, space: asked.extend(pieces) or read(pieces, space))
    text = "x zyxwvu zyxwvu, zyxwvu. zyxwvu!? a.\nZyxwvu b,\nZyxwvu."
    assert next(codec.encode([text])).tolist() == codec.tool.encode(text, add_special_tokens=False).ids
    assert asked.count("zyxwvu") == 1 and asked.count("Zyxwvu") == 1


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(list(" \n\ttsreZdé'ßñªʰ你5.,_!-#\xa0")), max_size=50))
def test_any_text_has_the_ids_of_the_library(codec, text):
    assert next(codec.encode([text])).tolist() == codec.tool.encode(text, add_special_tokens=False).ids
