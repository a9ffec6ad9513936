"""Toxicity severity by cumulative-link ordinal regression over sparse text features.

P(grade > j) = logistic(w . x - cut_j): the weights are shared by all ordered cuts.  Features
are a word and its leading four to eight characters, kept where the labels set them apart; weights
are not negative, so that no harmless word excuses a toxic one.  A feature's value is 1 plus the logarithm
of its count, so that one hit counts in a text of any length.  The score is the expected
severity, the sum of P(grade > j) over the cuts.

Labels say toxic or not.  Grades 1 to 3 of the toxic rows come from the number of words that the
labels set apart (terciles over the training rows); clean rows have grade 0.

Near copies among the training rows (whose least two shingles agree in either of two orders) count
once, so that a copied text doesn't pass for many.  The fit uses at most ``max_rows`` labelled rows,
half of them toxic where there are enough, drawn by hash and weighted back to the classes' shares of
all labels; scoring covers every document's whole text.

Defined cases: a null or empty text has no features and grade 0; labels that are null are not used,
several labels of a doc_id count as the highest, of several texts of a labelled doc_id the least is
learnt from; a text of any length is scored whole; an empty table gives an empty result; without
both classes the model has no weights and calls nothing toxic; repeated rows are scored alike; other
columns, whatever their names, are not read by ``scored`` and kept by ``clean``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import durable, small_batches, tidy
from .words import hashed_words, scramble, shingles

WORD = re.compile(r"[^\W_]+")
GRADES = 3
#: Labelled rows that the fit may use.
MAX_ROWS = 4000
PREFIXES = (4, 5, 6, 7, 8)
#: Least difference of a feature's share among toxic and clean rows, in standard errors, and least ratio.
SIGNIFICANT = 5.0
RATIO = 4.0
REMEMBERED = 100_000


def features_of(word: str) -> tuple[str, ...]:
    return (word, *(f"{word[:k]}*" for k in PREFIXES if len(word) > k))


def counts_of(text: str | None) -> Counter:
    return Counter(WORD.findall((text or "").lower()))


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    cuts: tuple[float, ...]

    def word_hits(self, word: str) -> tuple[str, ...]:
        return tuple(f for f in features_of(word) if f in self.weights)


def _value(count: np.ndarray | float):
    return 1 + np.log(count)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def above(eta: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """P(grade > j) for every row and cut."""
    return _logistic(eta[:, None] - cuts[None, :])


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int, row_weights: np.ndarray, penalty: float = 2e-5, steps: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered cuts by Adam with a soft threshold at zero; a cut is the one before plus a positive step."""
    n, j = len(grades), GRADES
    row_weights = row_weights / row_weights.sum()
    w, base, gaps = np.zeros(n_features), np.array([1.0]), np.zeros(j - 1)
    moments = [np.zeros_like(p) for p in (w, base, gaps)], [np.zeros_like(p) for p in (w, base, gaps)]
    support = np.bincount(cols, minlength=n_features)
    rates = (0.3 * np.sqrt(support / max(support.max(initial=1), 1)), 0.1, 0.1)  # what many rows share learns faster
    for step in range(1, steps + 1):
        widths = np.exp(gaps)
        cuts = base[0] + np.concatenate([[0.0], np.cumsum(widths)])
        eta = np.bincount(rows, values * w[cols], minlength=n)
        # P(y) = s(y-th upper) - s(lower) with s the chance to lie above a cut
        s = np.hstack([np.ones((n, 1)), above(eta, cuts), np.zeros((n, 1))])
        at = np.arange(n)
        hi, lo = s[at, grades], s[at, grades + 1]
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p * row_weights, lo * (1 - lo) / p * row_weights
        g_eta = d_lo - d_hi
        g_cut = np.zeros(j)
        np.add.at(g_cut, np.maximum(grades - 1, 0), np.where(grades > 0, d_hi, 0))
        np.add.at(g_cut, np.minimum(grades, j - 1), np.where(grades < j, -d_lo, 0))
        tail = np.cumsum(g_cut[::-1])[::-1]
        grads = (np.bincount(cols, values * g_eta[rows], minlength=n_features), np.array([tail[0]]), tail[1:] * widths)
        for k, (param, g) in enumerate(zip((w, base, gaps), grads, strict=True)):
            moments[0][k][:] = 0.9 * moments[0][k] + 0.1 * g
            moments[1][k][:] = 0.999 * moments[1][k] + 0.001 * g * g
            param -= rates[k] * (moments[0][k] / (1 - 0.9**step)) / (np.sqrt(moments[1][k] / (1 - 0.999**step)) + 1e-10)
        w[:] = np.maximum(w - rates[0] * penalty, 0)
    return w, base[0] + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def without_copies(texts: list[str | None]) -> list[int]:
    """Places of the texts whose least two shingles, in either of two orders, weren't met before."""
    seen, kept = set(), []
    for i, words in hashed_words(texts):
        s = shingles(words, 3)
        marks = {(k, *np.partition(scramble(s ^ np.uint64(k)), 1)[:2].tolist()) for k in (1, 2)} if len(s) > 1 else {(0, texts[i])}
        if not marks & seen:
            kept.append(i)
        seen |= marks
    return kept


def fit(texts: list[str | None], toxic: np.ndarray, row_weights: np.ndarray) -> Model:
    """A model of labelled texts; see the module for how grades come about."""
    single = without_copies(texts)
    texts, toxic, row_weights = [texts[i] for i in single], toxic[single], row_weights[single]
    if not len(toxic) or toxic.all() or not toxic.any():
        return Model({}, tuple(float(c) for c in range(1, GRADES + 1)))
    ids: dict[str, int] = {}
    met = [Counter(), Counter()]  # documents with each feature, by class; only what a toxic one has can set them apart
    for of_class in (True, False):
        for i in np.flatnonzero(toxic == of_class).tolist():
            found = {f for word in counts_of(texts[i]) for f in features_of(word)}
            if of_class:
                for f in found:
                    ids.setdefault(f, len(ids))
            met[of_class].update([ids[f] for f in found if f in ids])
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    with_1, with_0 = (np.array([met[k][i] for i in range(len(ids))], np.int64) for k in (True, False))
    share = (with_1 + with_0 + 1) / (n1 + n0 + 2)
    z = (with_1 / n1 - with_0 / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    apart = with_1 / n1 >= RATIO * (with_0 + 0.5) / n0
    kept = np.flatnonzero(apart & (z >= min(SIGNIFICANT, 0.6 * z.max(initial=0))))
    kept = kept[np.argsort(-z[kept], kind="stable")]
    names = np.array(list(ids), object)[kept]
    place = {f: k for k, f in enumerate(names)}
    del ids, met
    entries = []
    for i, text in enumerate(texts):
        found = Counter()
        for word, k in counts_of(text).items():
            for f in features_of(word):
                if f in place:
                    found[place[f]] += k
        entries += [(i, f, k) for f, k in sorted(found.items())]
    rows, cols, counts = (np.array(x, np.int64) for x in zip(*entries, strict=True)) if entries else (np.zeros(0, np.int64),) * 3
    telling = np.array([not f.endswith("*") for f in names], bool)
    told = np.bincount(rows, counts * telling[cols], minlength=len(toxic))
    edges = np.quantile(told[toxic], [1 / 3, 2 / 3])
    grades = np.where(toxic, 1 + np.searchsorted(edges, told, side="left"), 0).astype(int)
    w, cuts = fit_ordinal(rows, cols, _value(counts), grades, len(kept), row_weights)
    return Model({f: float(x) for f, x in zip(names, w, strict=True) if x}, tuple(cuts.tolist()))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """A model from at most ``max_rows`` labelled rows; both counts of labels are over all of them."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    totals = {bool(r[0]): r[1] for r in known.groupBy("toxic").count().collect()}
    drawn = [known.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows // 2) for t in (True, False)]
    sample = drawn[0].union(drawn[1])
    met = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    met = durable(met, max_rows)  # few files, since each partition is a job of its own below
    texts, toxic = [], []
    for row in met.toLocalIterator():
        texts.append(row["text"])
        toxic.append(row["toxic"])
    order = sorted(range(len(texts)), key=lambda i: (toxic[i], texts[i] or ""))
    toxic_at = np.array([toxic[i] for i in order], bool)
    share = np.where(toxic_at, totals.get(True, 0) / max(toxic_at.sum(), 1), totals.get(False, 0) / max((~toxic_at).sum(), 1))
    return fit([texts[i] for i in order], toxic_at, share)


def _scorer(model: Model):
    cuts = np.array(model.cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            eta = []
            if len(hits) > REMEMBERED:
                hits.clear()
            for text in batch.column(1).to_pylist():
                found: Counter = Counter()
                for word, k in counts_of(text).items():
                    fs = hits.get(word)
                    if fs is None:
                        fs = hits[word] = model.word_hits(word)
                    for f in fs:
                        found[f] += k
                eta.append(sum(model.weights[f] * float(_value(k)) for f, k in sorted(found.items())))
            p = above(np.array(eta, float), cuts)
            grade = (p > 0.5).sum(axis=1)
            arrays = [batch.column(0), pa.array(p.sum(axis=1)), pa.array(grade.astype(np.int32)), pa.array(p[:, 0]), pa.array(p[:, 0] > 0.5)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "expected_severity", "grade", "p_toxic", "toxic"])

    return run


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, expected_severity (0 to 3), grade, p_toxic and toxic of every row of ``docs``."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, expected_severity double, grade int, p_toxic double, toxic boolean"
    return docs.select("doc_id", "text").mapInArrow(tidy(_scorer(model)), schema)


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with their columns."""
    small_batches(docs.sparkSession)
    at, score = docs.columns.index("text"), _scorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            narrow = pa.RecordBatch.from_arrays([batch.column(at), batch.column(at)], names=["doc_id", "text"])
            toxic = next(score(iter([narrow]))).column(4)
            yield batch.filter(pa.array(~toxic.to_numpy(zero_copy_only=False)))

    return docs.mapInArrow(tidy(run), docs.schema)
