"""Language-model scores: a causal self-attention model over subword ids, trained in numpy.

Texts are words in lower case, then an end.  The model reads the words' subword ids.  Blocks of
STRIDE ids attend to themselves, causally, and to the block before, so overlapping windows
score each id once; all windows of a batch are computed at once under one mask.  It predicts a
class of ids (a frequent id is a class of its own); within a class, ids are drawn by their
counts over all training documents.

The network's chance of a word is the product of its ids' chances, given that an id which starts
a word comes first, times the chance that such an id follows, so that the chances of all words
add up to one.  A word's chance is a mixture of the network's and its share of the corpus, which
keeps what the small network can't hold about common words.

Word counts over all training documents give the base score.  Words with a count of at least
1 / FREQUENT of all are broadcast (at most FREQUENT words); the rest are joined by word, with
the network's chance of each occurrence.

Ids are grouped into classes by what stands beside them in all training documents.  The network's
weights start at random and learn in rounds that deal every training document once: the first
round holds about ``max_docs`` documents, which one task goes over until it has made enough steps,
and each round after it GROWTH times as many as all before it, whose tasks go on from the same weights
and leave their mean by ids.  The mixture's weight is the one of WEIGHTS under which all training
documents are likeliest.  Scores cover every document's whole text.

Defined cases: a null text is an empty one and has the end alone; a null doc_id is drawn as
empty text; rows of equal doc_ids fall on the same side and are scored one by one; an empty
table gives an empty result; without training documents all counts are 0; other columns are not
read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import UPPER, durable, small_batches, text_of, tidy
from .bpe import Memory, gathered, read_ranks, spread, summed

#: The end among the words' counts; no word holds a space.
END = " "
STRIDE = 8
WIDTH = 16
HIDDEN = 32
#: Ids that are classes of their own, and further classes; ids with an embedding of their own.
SINGLE, SHARED = 96, 32
COLUMNS = 2 * (SINGLE + 1)
INPUTS = 2048
FREQUENT = 400_000
#: Words in a call of the tokenizer.
PIECES = 2000
#: Distinct words whose ids are counted at once.
WORDS = 100_000
MAX_DOCS = 1200
#: How much a round of training grows over those before it; least steps of the first; ids of a task at least.
GROWTH, STEPS, TASK_IDS = 3, 400, 1_000_000
#: The network's weights in the mixture to choose from; factors that are multiplied before a logarithm is taken.
WEIGHTS, FACTORS = np.arange(1, 20) / 20, 16
FOLDS, HELD_OUT = 7, 2
BATCH_IDS = 200_000
#: Ids of a part whose arrays stay in the cache.
PART = 2048
#: Ids of a step of the pass over all training documents, and its rate.
TRAIN_IDS = 4096
RATE = 0.001


class Words:
    """The words of a block of texts: their places in a memory, and where each text's begin (with the end of the last)."""

    def __init__(self, texts: Sequence[str | None], memory: Memory):
        plain = pa.array([(t or "").encode().translate(LOWER) for t in texts], pa.large_binary()).cast(pa.large_string())
        parts = pc.split_pattern(plain, " ")
        words, self.offsets = parts.values, parts.offsets.to_numpy().astype(np.int64)
        real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
        if not real.all():
            self.offsets = np.concatenate([[0], np.cumsum(real)])[self.offsets]
            words = words.filter(pa.array(real))
        self.words, self.places = words, memory.places(words)
        self.counts = np.diff(self.offsets)


class Subwords:
    """Ids of words, each as if after a space; a worker remembers the words it has met."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        ranks = read_ranks(path)
        self.end = len(ranks)
        self.starts = np.ones(len(ranks) + 1, bool)  # ids that start a word, the end among them
        for token, rank in ranks.items():
            self.starts[rank] = token.startswith(b" ")
        self.tool = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.memory = Memory(self.ids_of)

    def ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, PIECES in a call; a word with white space of its own is read alone."""
        odd = [i for i, w in enumerate(words) if not w or any(map(str.isspace, w))]
        alone = set(odd)
        even = [i for i in range(len(words)) if i not in alone] if odd else range(len(words))
        groups = [*(even[k : k + PIECES] for k in range(0, len(even), PIECES)), *([i] for i in odd)]
        counts, ids = np.zeros(len(words), np.int64), []
        for group in groups:
            found = np.array(self.tool.encode_ordinary(" " + " ".join(words[i] for i in group)), np.int32)
            counts[group] = np.diff(np.append(np.flatnonzero(self.starts[found]), len(found))) if len(group) > 1 else len(found)
            ids.append(found)
        if odd:
            order = np.array([i for g in groups for i in g], np.int64)
            begin = np.zeros(len(words), np.int64)
            begin[order] = np.cumsum(counts[order]) - counts[order]
            return np.concatenate(ids)[spread(begin, counts)], counts
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), counts

    def read(self, texts: Sequence[str | None]) -> Words:
        return Words(texts, self.memory)

    def laid_out(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of the texts' words and ends in a row, each text's number of ids, and each word's and end's."""
        ids, sizes = self.memory.laid_out(words.places)
        sums = summed(sizes, words.offsets)
        return np.insert(ids, np.cumsum(sums), self.end), sums + 1, np.insert(sizes, words.offsets[1:], 1)


_kept: dict[tuple[str, str], Subwords] = {}


def subwords(path: str, pattern: str) -> Subwords:
    if (path, pattern) not in _kept:
        _kept[path, pattern] = Subwords(path, pattern)
    return _kept[path, pattern]


#: A-Z to a-z, and white space to a space.
BLANKS = "\t\n\x0b\x0c\r"
LOWER = bytes.maketrans((UPPER + BLANKS).encode(), (UPPER.lower() + " " * len(BLANKS)).encode())


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over the training documents' words."""
    plain = F.translate(text_of(), UPPER + BLANKS, UPPER.lower() + " " * len(BLANKS))
    words = docs.filter(~held_out(F.col("doc_id"))).select(F.explode(F.split(plain, " ")).alias("word"))
    return words.filter("word != ''").groupBy("word").agg(F.count("*").alias("c"))


def subword_counts(counts: DataFrame, path: str, pattern: str) -> np.ndarray:
    """Counts of all ids over the training documents, from the words' counts; one number an id reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = subwords(path, pattern)
        total = np.zeros(tool.end + 1, np.int64)
        words: list[str] = []
        times: list[np.ndarray] = []

        def add() -> None:
            ids, sizes = tool.ids_of(words)
            np.add(total, np.bincount(ids, np.repeat(np.concatenate(times), sizes), minlength=len(total)).astype(np.int64), out=total)

        for batch in batches:
            words += batch.column(0).to_pylist()
            times.append(batch.column(1).to_numpy())
            if len(words) >= WORDS:
                add()
                words, times = [], []
        if words:
            add()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    out = np.zeros(len(read_ranks(path)) + 1, np.int64)
    for row in counts.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row["id"]] = row["n"]
    return out


@dataclass
class Model:
    """Weights, the class and input row of each id, each id's log10 chance in its class, and the share of starts in each class."""

    weights: dict[str, np.ndarray]
    class_of: np.ndarray
    input_of: np.ndarray
    within: np.ndarray
    starts: np.ndarray
    end: int


def _layout(flat: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(inputs, targets) of sequences in a row, padded so that each starts a block after an empty one; -1 is padding."""
    blocks = -(-sizes // STRIDE) + 1
    starts = (np.cumsum(blocks) - blocks + 1) * STRIDE
    total = int(blocks.sum()) * STRIDE
    inputs, targets = np.full(total, -1, np.int64), np.full(total, -1, np.int64)
    place = spread(starts, sizes)
    targets[place] = flat
    shifted = np.empty_like(flat)
    shifted[1:] = flat[:-1]
    shifted[np.cumsum(sizes) - sizes] = end
    inputs[place] = shifted
    return inputs, targets


_CAUSAL = np.where(np.arange(2 * STRIDE)[None, :] <= np.arange(STRIDE)[:, None] + STRIDE, 0.0, -1e9).astype(np.float32)
#: Logits are cut off here, where their exponentials still have room.
HIGH = np.float32(60)
_ONES = np.ones((2 * STRIDE, 1), np.float32)


def _with_before(a: np.ndarray) -> np.ndarray:
    """Each block after the one before it."""
    out = np.empty((len(a), 2 * STRIDE, a.shape[2]), a.dtype)
    out[:, STRIDE:] = a
    out[1:, :STRIDE] = a[:-1]
    out[:1, :STRIDE] = 0
    return out


def _forward(w: dict[str, np.ndarray], rows: np.ndarray, real: np.ndarray) -> dict[str, np.ndarray]:
    """``rows`` are input rows of whole blocks, the block before included; ``real`` marks what isn't padding."""
    x = w["embed"].take(rows, axis=0)
    m = len(rows) // STRIDE
    qkv = (x @ w["qkv"]).reshape(m, STRIDE, 3 * WIDTH)
    q, keys, values = qkv[:, :, :WIDTH] * np.float32(1 / math.sqrt(WIDTH)), _with_before(qkv[:, :, WIDTH : 2 * WIDTH]), _with_before(qkv[:, :, 2 * WIDTH :])
    s = q @ np.ascontiguousarray(keys.transpose(0, 2, 1))
    np.minimum(s, HIGH, out=s)
    s += w["near"] + _CAUSAL
    hidden = np.zeros((m, 1, 2 * STRIDE), np.float32)
    hidden[:, 0, STRIDE:] = np.where(real, np.float32(0), np.float32(-1e9)).reshape(m, STRIDE)
    hidden[1:, 0, :STRIDE] = hidden[:-1, 0, STRIDE:]
    hidden[:1, 0, :STRIDE] = -1e9
    s += hidden
    np.exp(s, out=s)
    s /= s @ _ONES + np.float32(1e-30)
    mixed = (s @ values).reshape(-1, WIDTH)
    h = x + mixed @ w["o"]
    z = h @ w["up"]
    z += w["up0"]
    np.maximum(z, 0, out=z)
    out = h + z @ w["down"]
    return {"x": x, "q": q, "keys": keys, "values": values, "s": s, "mixed": mixed, "h": h, "z": z, "out": out}


def _logits(w: dict[str, np.ndarray], out: np.ndarray) -> np.ndarray:
    logits = out @ w["head"]
    logits += w["head0"]
    return np.minimum(logits, HIGH, out=logits)


def _gradients(w: dict[str, np.ndarray], rows: np.ndarray, real: np.ndarray, goal: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean loss of the targets ``goal`` at places ``at``."""
    f = _forward(w, rows, real)
    p = _logits(w, f["out"].take(at, axis=0))
    np.exp(p, out=p)
    p /= (p @ np.ones((p.shape[1], 1), np.float32)) * np.float32(len(at))
    p[np.arange(len(at)), goal] -= np.float32(1 / len(at))
    g = {"head": f["out"].take(at, axis=0).T @ p, "head0": p.sum(axis=0)}
    d_out = np.zeros_like(f["out"])
    d_out[at] = p @ w["head"].T
    g["down"] = f["z"].T @ d_out
    d_z = d_out @ w["down"].T
    d_z *= f["z"] > 0
    g["up"], g["up0"] = f["h"].T @ d_z, d_z.sum(axis=0)
    d_h = d_out + d_z @ w["up"].T
    m = len(rows) // STRIDE
    g["o"] = f["mixed"].T @ d_h
    d_mixed = (d_h @ w["o"].T).reshape(m, STRIDE, WIDTH)
    d_values = f["s"].transpose(0, 2, 1) @ d_mixed
    d_s = d_mixed @ np.ascontiguousarray(f["values"].transpose(0, 2, 1))
    d_s -= (d_s * f["s"]) @ _ONES
    d_s *= f["s"]
    g["near"] = d_s.sum(axis=0)
    d_qkv = np.empty((m, STRIDE, 3 * WIDTH), np.float32)
    d_qkv[:, :, :WIDTH] = (d_s @ f["keys"]) * np.float32(1 / math.sqrt(WIDTH))
    for k, d in ((1, d_s.transpose(0, 2, 1) @ f["q"]), (2, d_values)):  # what a block's keys gave to it and to the block after
        own = d_qkv[:, :, k * WIDTH : (k + 1) * WIDTH]
        own[:] = d[:, STRIDE:]
        own[:-1] += d[1:, :STRIDE]
    d_qkv = d_qkv.reshape(-1, 3 * WIDTH)
    g["qkv"] = f["x"].T @ d_qkv
    d_x = d_h + d_qkv @ w["qkv"].T
    g["embed"] = np.stack([np.bincount(rows, d, minlength=len(w["embed"])) for d in d_x.T], axis=1).astype(np.float32)
    return g


def _marks(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids by falling counts, and each id's column among its neighbours: the commonest have one each, the others share the last."""
    order = np.argsort(-counts, kind="stable")
    mark = np.full(len(counts), SINGLE)
    mark[order[:SINGLE]] = np.arange(min(SINGLE, len(order)))
    return order, mark


def _beside(flat: np.ndarray, sizes: np.ndarray, mark: np.ndarray, end: int) -> np.ndarray:
    """Cells (id, column) of the neighbours of all ids, before them and after them; an end stands before each sequence."""
    before = np.empty(len(flat), np.int64)
    before[1:] = flat[:-1]
    before[np.cumsum(sizes) - sizes] = end
    return np.concatenate([flat.astype(np.int64) * COLUMNS + mark[before], before * COLUMNS + SINGLE + 1 + mark[flat]])


def pair_counts(docs: DataFrame, counts: np.ndarray, path: str, pattern: str) -> np.ndarray:
    """How often each column stands before and after each id in ``docs``; one number a cell reaches the driver."""
    mark = docs.sparkSession.sparkContext.broadcast(_marks(counts)[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = subwords(path, pattern)
        total = np.zeros((tool.end + 1) * COLUMNS, np.int32)
        for _, texts in gathered(batches, 0):
            flat, sizes, _ = tool.laid_out(tool.read(texts))
            at, n = np.unique(_beside(flat, sizes, mark.value, tool.end), return_counts=True)
            total[at] += n.astype(np.int32)
        at = np.flatnonzero(total)
        for k in range(0, len(at), WORDS):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + WORDS], pa.int64()), pa.array(total[at[k : k + WORDS]], pa.int64())], names=["cell", "n"])

    out = np.zeros(len(counts) * COLUMNS, np.float32)
    rows = docs.select(text_of().alias("text")).mapInArrow(tidy(run), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    for row in rows.toLocalIterator():
        out[row["cell"]] = row["n"]
    return out.reshape(len(counts), COLUMNS)


def _classes(pairs: np.ndarray, counts: np.ndarray, seed: int = 3) -> np.ndarray:
    """Class of each id: the commonest have one each, the others are grouped by what stands before and after them."""
    order, mark = _marks(counts)
    class_of = np.where(mark < SINGLE, mark, 0)
    rest = order[SINGLE:]
    met = rest[pairs[rest].sum(axis=1) >= 5]
    rng = np.random.default_rng(seed)
    class_of[rest] = SINGLE + SHARED - 1
    k = min(SHARED - 1, len(met))
    if k:
        x = np.sqrt(pairs[met] / pairs[met].sum(axis=1, keepdims=True))
        centres = x[rng.choice(len(met), k, replace=False)]
        for _ in range(12):
            near = (x @ centres.T - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1)
            for c in range(k):
                if (near == c).any():
                    centres[c] = x[near == c].mean(axis=0)
        class_of[met] = SINGLE + near
    return class_of


class Trainer:
    """Adam steps on ``weights`` in place."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights, self.steps = weights, 0
        self.first, self.second = ({n: np.zeros_like(a) for n, a in weights.items()} for _ in range(2))

    def step(self, rate: float, rows: np.ndarray, real: np.ndarray, goal: np.ndarray, at: np.ndarray) -> None:
        self.steps += 1
        rate *= min(1, self.steps / 30) / (1 - 0.9**self.steps)
        for name, g in _gradients(self.weights, rows, real, goal, at).items():
            first, second = self.first[name], self.second[name]
            first += np.float32(0.1) * (g - first)
            second += np.float32(0.01) * (g * g - second)
            self.weights[name] -= np.float32(rate) * first / (np.sqrt(second * np.float32(1 / (1 - 0.99**self.steps))) + np.float32(1e-8))

    def part(self, rate: float, model: Model, inputs: np.ndarray, targets: np.ndarray, rows: np.ndarray, start: int, size: int) -> None:
        """A step on a part of what is laid out; the block before it is its first one's context."""
        part = slice(max(0, start - STRIDE), start + size)
        real = inputs[part] >= 0
        at = np.flatnonzero(real)
        at = at[at >= start - part.start]
        if len(at):
            self.step(rate, rows[part], real, model.class_of[targets[part][at]], at)


def begun(pairs: np.ndarray, counts: np.ndarray, end: int, starts: np.ndarray, seed: int = 5) -> Model:
    """A model of random weights; ``counts`` are the ids' counts and ``pairs`` their neighbours' over all training documents, ``starts`` marks ids that start a word."""
    counts = counts.astype(float)
    class_of = _classes(pairs, counts)
    order = np.argsort(-counts, kind="stable")
    input_of = INPUTS + class_of
    input_of[order[: INPUTS - 1]] = np.arange(min(INPUTS - 1, len(order)))
    input_of[end] = INPUTS - 1
    smooth = counts + 0.1
    by_class = np.maximum(np.bincount(class_of, smooth, minlength=SINGLE + SHARED), 1e-9)
    within = np.log10(smooth / by_class[class_of]).astype(np.float32)
    opening = (np.bincount(class_of, smooth * starts, minlength=SINGLE + SHARED) / by_class).astype(np.float32)
    rng = np.random.default_rng(seed)
    n_rows, n_classes = INPUTS + SINGLE + SHARED, SINGLE + SHARED
    scale = lambda *s: (rng.standard_normal(s) / math.sqrt(s[0])).astype(np.float32)
    w = {
        "embed": (rng.standard_normal((n_rows, WIDTH)) * 0.5).astype(np.float32), "qkv": scale(WIDTH, 3 * WIDTH), "o": scale(WIDTH, WIDTH) * np.float32(0.5),
        "near": np.zeros((STRIDE, 2 * STRIDE), np.float32), "up": scale(WIDTH, HIDDEN), "up0": np.zeros(HIDDEN, np.float32), "down": scale(HIDDEN, WIDTH) * np.float32(0.5),
        "head": scale(WIDTH, n_classes), "head0": np.log(by_class / smooth.sum()).astype(np.float32),
    }
    return Model(w, class_of.astype(np.int32), input_of.astype(np.int32), within, opening, end)


def repeated(model: Model, flat: np.ndarray, sizes: np.ndarray, steps: int = STEPS, batch: int = TRAIN_IDS, seed: int = 5) -> None:
    """Train on whole passes over sequences in a row, until at least ``steps`` are made."""
    inputs, targets = _layout(flat, sizes, model.end)
    rows = np.where(inputs >= 0, model.input_of[inputs], INPUTS - 1)
    trainer, rng = Trainer(model.weights), np.random.default_rng(seed)
    firsts = np.arange(0, len(rows), batch)
    passes = -(-steps // len(firsts))
    steps = passes * len(firsts)
    for step, start in enumerate((int(x) for _ in range(passes) for x in rng.permutation(firsts)), 1):
        trainer.part(0.01 * (1 - 0.95 * step / steps), model, inputs, targets, rows, start, batch)


def fit(flat: np.ndarray, sizes: np.ndarray, counts: np.ndarray, end: int, starts: np.ndarray, steps: int = STEPS, batch: int = TRAIN_IDS) -> Model:
    """A model of training sequences in a row."""
    cells = _beside(flat, sizes, _marks(counts)[1], end)
    model = begun(np.bincount(cells, minlength=len(counts) * COLUMNS).reshape(len(counts), COLUMNS).astype(np.float32), counts, end, starts)
    repeated(model, flat, sizes, steps, batch)
    return model


def _groups(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of sequences of about ``most`` ids: (first, after the last)."""
    start, ends = 0, np.cumsum(sizes)
    while start < len(sizes):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield start, stop
        start = stop


def word_chances(model: Model, flat: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, last: np.ndarray) -> np.ndarray:
    """log10 probability of each word and end, whose numbers of ids are ``lengths``; ``last`` are the places of the ends."""
    got, begins = [], []
    ends = np.cumsum(sizes)
    both = np.stack([np.ones_like(model.starts), model.starts], axis=1)
    log10 = np.float32(1 / math.log(10))
    for start, stop in _groups(sizes, BATCH_IDS):
        first = int(ends[start - 1]) if start else 0
        inputs, targets = _layout(flat[first : int(ends[stop - 1])], sizes[start:stop], model.end)
        real = inputs >= 0
        rows = np.where(real, model.input_of[inputs], INPUTS - 1)
        for a in range(0, len(rows), PART):  # blocks that stay in the cache, the one before each included
            b = min(len(rows), a + PART)
            lead = STRIDE if a else 0
            f = _forward(model.weights, rows[a - lead : b], real[a - lead : b])
            at = np.flatnonzero(real[a:b])
            goal = targets[a:b][at]
            logits = _logits(model.weights, f["out"].take(at + lead, axis=0))
            picked = logits[np.arange(len(at)), model.class_of[goal]]
            np.exp(logits, out=logits)
            sums = np.log(np.maximum(logits @ both, np.float32(1e-30))) * log10
            got.append(picked * log10 - sums[:, 0] + model.within[goal])
            begins.append(sums[:, 1] - sums[:, 0])
    cuts = np.cumsum(lengths) - lengths
    begin = np.concatenate(begins).astype(float)[cuts]
    follow = np.append(begin[1:], 0.0)
    follow[last] = 0.0  # nothing follows an end
    return np.add.reduceat(np.concatenate(got).astype(float), cuts) - begin + follow


def _network(model: Model, tool: Subwords, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The network's log10 chances of all words and ends, and the places of the ends among them."""
    ids, sizes, lengths = tool.laid_out(words)
    last = words.offsets[1:] + np.arange(len(words.counts))
    return word_chances(model, ids, sizes, lengths, last), last


def mixtures(network: np.ndarray, shares: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each text's log10 chance under each of WEIGHTS, from its words' chances (log10); ``starts`` are the texts' first words."""
    ratio = 10.0 ** (network - shares)
    cuts = np.union1d(starts, np.arange(0, len(network), FACTORS))  # few factors, so that their product has room
    base, of = np.add.reduceat(shares, starts), np.searchsorted(cuts, starts)
    return np.stack([base + np.add.reduceat(np.log10(np.multiply.reduceat(1 - w + w * ratio, cuts)), of) for w in WEIGHTS], axis=1)


class _Logs:
    """The logarithms that ``known`` gives the words of a memory; NaN where it has none."""

    def __init__(self, known: dict[str, float]):
        self.known, self.of, self.found = known, None, np.zeros(0)

    def of_memory(self, memory: Memory) -> np.ndarray:
        if self.of is not memory.generation:
            self.of, self.found = memory.generation, np.zeros(0)
        new = list(islice(memory.known, len(self.found), None))
        if new:
            self.found = np.concatenate([self.found, np.array([self.known.get(w, math.nan) for w in new])])
        return self.found


def _scorer(model_of, known_of, path: str, pattern: str):
    """Arrow batches of (doc_id, text, held) to scores, with the words that aren't among the frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, model, (known, floor) = subwords(path, pattern), model_of.value, known_of.value
        logs = _Logs(known)
        number = TaskContext.get().partitionId() << 33
        for batch, texts in gathered(batches, 1):
            words = tool.read(texts)
            network, last = _network(model, tool, words)
            log = logs.of_memory(tool.memory)[words.places]
            odd = np.isnan(log)
            log[odd] = 0.0
            # Words that aren't among the frequent ones count as unseen, until their counts are joined.
            whole = np.insert(log, words.offsets[1:], known[END])
            less = np.log10(np.maximum(10.0**whole - 1, 1.0))  # each word counted once less than it was
            firsts = np.append(0, last[:-1] + 1)
            scores, trials = (mixtures(network, x - floor, firsts) for x in (whole, less))
            alone = np.delete(network, last)[odd]
            rare = np.concatenate([[0], np.cumsum(odd)])[words.offsets].astype(np.int32)
            cols = [
                pa.array(np.arange(number, number + len(texts))), batch.column(0), batch.column(2), pa.array(words.counts + 1), pa.array(summed(log, words.offsets)),
                pa.array(words.counts - np.diff(rare)), pa.ListArray.from_arrays(pa.array(rare), words.words.filter(pa.array(odd)).cast(pa.string())),
                pa.ListArray.from_arrays(pa.array(rare), pa.array(alone)), *(pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(WEIGHTS)).cast(pa.list_(pa.float64())) for x in (scores, trials)),
            ]
            number += len(texts)
            yield pa.RecordBatch.from_arrays(cols, names=["row", "doc_id", "held_out", "n_tokens", "base", "seen", "rare", "alone", "scores", "trials"])

    return run


def _trainer(model_of, path: str, pattern: str, first: bool):
    """Arrow batches of training texts to the weights after all of them, as one row with the number of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, model = subwords(path, pattern), model_of.value
        model = replace(model, weights={n: a.copy() for n, a in model.weights.items()})
        trainer, seen, kept = Trainer(model.weights), 0, []
        for _, texts in gathered(batches, 0):
            flat, sizes, _ = tool.laid_out(tool.read(texts))
            ends = np.cumsum(sizes)
            seen += len(flat)
            if first:
                kept.append((flat, sizes))
                continue
            for begin, stop in _groups(sizes, BATCH_IDS):
                inputs, targets = _layout(flat[int(ends[begin] - sizes[begin]) : int(ends[stop - 1])], sizes[begin:stop], tool.end)
                rows = np.where(inputs >= 0, model.input_of[inputs], INPUTS - 1)
                for start in range(0, len(rows), TRAIN_IDS):
                    trainer.part(RATE, model, inputs, targets, rows, start, TRAIN_IDS)
        if kept:
            repeated(model, *(np.concatenate(x) for x in zip(*kept, strict=True)))
        if seen:
            weights = np.concatenate([model.weights[n].ravel() for n in sorted(model.weights)]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([weights.tobytes()], pa.binary())], names=["n", "weights"])

    return run


def trained(docs: DataFrame, model: Model, path: str, pattern: str, tasks: int | None = None, first: bool = False) -> tuple[Model, int]:
    """``model`` after every text of ``docs``: the mean, by ids, of the weights of all tasks; and the number of ids seen.

    In the ``first`` round one task goes over them again and again.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = docs.select(text_of().alias("text")).repartition(1 if first else min(parts, tasks or parts))
    rows = durable(dealt.mapInArrow(tidy(_trainer(spark.sparkContext.broadcast(model), path, pattern, first)), "n long, weights binary"))
    total, seen = 0.0, 0
    for row in rows.toLocalIterator():  # some 200 KB a task
        total = total + np.frombuffer(row["weights"], np.float32).astype(float) * row["n"]
        seen += row["n"]
    weights, at = dict(model.weights), 0
    for name in sorted(model.weights) if seen else ():
        a = model.weights[name]
        weights[name] = (total[at : at + a.size] / seen).reshape(a.shape).astype(np.float32)
        at += a.size
    return replace(model, weights=weights), seen


def rounds(docs: DataFrame, n_docs: int, max_docs: int) -> list[tuple[DataFrame, float]]:
    """``docs`` cut by hash into rounds, with the share of all that each is to hold; every row is in one of them."""
    ends = [min(1.0, max_docs / max(n_docs, 1))]
    while ends[-1] < 1:
        ends.append(min(1.0, ends[-1] * (1 + GROWTH)))
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)
    return [(docs.filter((drawn >= a) & (drawn < b)), b - a) for a, b in zip([0.0, *ends], ends, strict=False)]


def scored(docs: DataFrame, path: str, pattern: str, max_docs: int = MAX_DOCS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    counts = durable(word_counts(docs))
    n_docs = docs.filter(~held_out(F.col("doc_id"))).count()
    words, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, kinds = words + n_docs, distinct + (n_docs > 0)
    least = max(1, -(-words // FREQUENT))
    known = {r["word"]: math.log10(r["c"] + 1) for r in counts.filter(F.col("c") >= least).toLocalIterator()}  # FREQUENT words at most

    tool = subwords(path, pattern)
    ids = subword_counts(counts, path, pattern)
    ids[tool.end] = n_docs
    known[END] = math.log10(n_docs + 1)
    floor = math.log10(total + kinds + 1)
    training = docs.filter(~held_out(F.col("doc_id")))
    model = begun(pair_counts(training, ids, path, pattern), ids, tool.end, tool.starts)
    for k, (part, held) in enumerate(rounds(training, n_docs, max_docs)):
        model, _ = trained(part, model, path, pattern, math.ceil(ids.sum() * held / TASK_IDS), first=not k)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, base double, seen long, rare array<string>, alone array<double>, scores array<double>, trials array<double>"
    share = spark.sparkContext.broadcast
    ready = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    rows = durable(ready.mapInArrow(tidy(_scorer(share(model), share((known, floor)), path, pattern)), schema))
    odd = rows.select("row", "held_out", F.explode(F.arrays_zip("rare", "alone")).alias("x")).select("row", "held_out", F.col("x.rare").alias("word"), F.col("x.alone").alias("network"))
    met = odd.join(counts.filter(F.col("c") < least), "word")
    unseen = 10.0**-floor

    def gain(weight: float, times: Column) -> Column:
        """What a rare word's count adds to the log10 chance of it as unseen."""
        own = F.pow(F.lit(10.0), "network") * float(weight)
        return F.log10(own + times * ((1 - weight) * unseen)) - F.log10(own + (1 - weight) * unseen)

    k = range(len(WEIGHTS))
    all_sums = rows.filter("not held_out").agg(*[F.coalesce(F.sum(F.col("trials")[i]), F.lit(0.0)) for i in k]).first()
    more_sums = met.filter("not held_out").agg(*[F.coalesce(F.sum(gain(WEIGHTS[i], F.col("c"))), F.lit(0.0)) for i in k]).first()
    best = max(k, key=lambda i: all_sums[i] + more_sums[i])
    met = met.groupBy("row").agg(F.sum(F.log10(F.col("c") + 1)).alias("more"), F.count("*").alias("met"), F.sum(gain(WEIGHTS[best], F.col("c") + 1)).alias("gain"))
    base = F.col("base") + F.coalesce("more", F.lit(0.0)) + F.lit(known[END]) - F.col("n_tokens") * F.lit(floor)
    n_known = F.col("seen") + F.coalesce("met", F.lit(0)) + F.lit(int(n_docs > 0))
    return rows.join(met, "row", "left").select("doc_id", "held_out", "n_tokens", n_known.cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("scores")[best] + F.coalesce("gain", F.lit(0.0))).alias("score"))
