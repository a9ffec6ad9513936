"""Words that a worker learns reach the tokenizers library many at a time, while no cycles are looked for."""

import gc
import itertools

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from loomframe.llm.token_files import LibraryCodec

PATH = public_tokenizers.path("byte_bpe_50k.json")


class Asked:
    """The library's tool; counts the words that its model is asked for alone, and whether cycles are looked for meanwhile."""

    def __init__(self, tool):
        self.tool, self.alone, self.swept = tool, 0, False

    @property
    def model(self):
        return self

    def tokenize(self, word):
        self.alone += 1
        return self.tool.model.tokenize(word)

    def encode_batch_fast(self, texts, **how):
        self.swept |= gc.isenabled()
        return self.tool.encode_batch_fast(texts, **how)


def test_words_are_learnt_many_at_a_time():
    words = ["".join(w) for w in itertools.islice(itertools.product("aeñxToß", repeat=5), 3000)]
    text = " ".join(w + sign for w, sign in zip(words, itertools.cycle(["", ",", "...", "", ".\nThen,", " ", "'s", "1", "\n"])))
    tool = LibraryCodec(PATH)
    tool.tool = asked = Asked(tool.tool)
    texts = [text, "", text[7:], "one"]
    ids, counts = tool.encode_block(texts)
    library = Tokenizer.from_file(PATH)
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(e) for e in expected]
    assert ids.tolist() == np.concatenate(expected).astype(int).tolist()
    assert asked.alone < 100
    assert not asked.swept and gc.isenabled()
