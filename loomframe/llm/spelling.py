"""Spelling variants grouped by a positional q-gram inverted index with a count filter.

Words are counted over all texts.  Two words are near if one inserted, deleted or replaced code
point turns one into the other.  One edit destroys at most ``q`` of a word's q-grams and moves
the others by at most one place, so near words share at least ``longer - 2 * q + 1`` q-grams at
places that differ by one at most, ``longer`` being the longer word's length.

The index is dealt out by (q-gram, length, place).  A word stands in the lists of its rarest
q-grams only, as many as no single edit can destroy together (until two of them don't overlap);
two near words then share one of these.  A task takes one such cell: it builds the postings of
all (q-gram, place) of the cell's words, heap-merges for each probing word the postings of its
own q-grams, looks up the longest lists by search (one fewer than must agree), keeps the words that
come up often enough and verifies the single edit.  Words of the
same length probe the places that they stand at; a word probes words longer by one at its places
and one further.  A cell of more than BLOCK words is cut into parts, and every pair of parts has
a probe of its own, so no cell is held whole.

Each word with a near word that is ``ratio`` times as frequent has the most frequent one as its
form; chains of forms lead to the root, found by pointer doubling.

The q-grams' frequencies, which only order them, are sent to the tasks: at most 90 ** q of them,
since words have 90 different letters.

Defined cases: null and empty texts have no words; a null doc_id counts as an empty id in the
rule of deletion; rows that repeat are counted as often as they stand; very long texts are taken
whole, and a word may be of any length; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from heapq import merge
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import UPPER, arrow_batches, discard, durable, tidy

MIN_CHARS = 6
MIN_COUNT = 5
RATIO = 5
#: One code point is deleted from a word whose hash with the document's id this number divides; None: from none.
DELETE = 199
Q = 2
#: Indexed words that a task holds of a cell.
BLOCK = 4096
#: Distinct words that a task holds while it counts.
COUNTED = 200_000

LETTERS = "A-Za-zÀ-ÿ"
_LOWER = {ord(c): c.lower() for c in UPPER}


def _counter(min_chars: int, delete: int | None):
    """(doc_id, text) to (word, n), counts of a task's share."""
    runs = re.compile(f"[{LETTERS}]{{{min_chars},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own: Counter[str] = Counter()
                for word, n in Counter(runs.findall(text.as_py() or "")).items():
                    own[word.translate(_LOWER)] += n
                if delete:
                    begin = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    for word, n in own.items():
                        h = zlib.crc32(word.encode(), begin)
                        if h % delete:
                            held[word] += n
                        elif len(word) > min_chars:
                            at = h % len(word)
                            held[word[:at] + word[at + 1 :]] += n
                else:
                    held.update(own)
                if len(held) >= COUNTED:
                    yield packed()
                    held.clear()
        if held:
            yield packed()

    return tidy(run)


def words(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, delete: int | None = DELETE) -> DataFrame:
    """(word, n): the lower-cased runs of letters with at least ``min_chars`` code points and ``min_count`` occurrences."""
    with arrow_batches(docs.sparkSession):
        counted = docs.select("doc_id", "text").mapInArrow(_counter(min_chars, delete), "word string, n long")
        return durable(counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count))


def grams(word: str, q: int) -> list[str]:
    return [word[i : i + q] for i in range(len(word) - q + 1)]


def sparse(word: str, q: int, often: dict[str, int]) -> list[tuple[str, int]]:
    """The rarest q-grams of a word with their places, as many as no single edit can destroy together."""
    ordered = sorted((often[g], g, i) for i, g in enumerate(grams(word, q)))
    low = high = ordered[0][2]
    for k, (_, g, i) in enumerate(ordered):
        if high - low >= q and g != ordered[k - 1][1]:
            return [(g, i) for _, g, i in ordered[:k]]
        low, high = min(low, i), max(high, i)
    return [(g, i) for _, g, i in ordered]


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point turns ``a`` into ``b``, which is as long or longer by one."""
    for i, (x, y) in enumerate(zip(a, b, strict=False)):
        if x != y:
            return a[i + (len(a) == len(b)) :] == b[i + 1 :]
    return len(a) + 1 == len(b)


def _poster(q: int, often: dict[str, int]):
    """(word, n) to its rows of the index (role 0) and its probes of longer words (role 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for g, at in sparse(word, q, often):
                    out += ((g, len(word), at, 0, word, n), (g, len(word) + 1, at, 1, word, n), (g, len(word) + 1, at + 1, 1, word, n))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _POSTED.types, strict=True)], schema=_POSTED)

    return run


_POSTED = pa.schema([("gram", pa.string()), ("length", pa.int32()), ("place", pa.int32()), ("role", pa.int32()), ("word", pa.string()), ("n", pa.int64())])


class _Cell:
    """The positional index of one cell's words of one length."""

    def __init__(self, length: int, q: int):
        self.q, self.least = q, length - 2 * q + 1
        self.words: list[tuple[str, int]] = []
        self.postings: defaultdict[tuple[str, int], list[int]] = defaultdict(list)

    def add(self, word: str, n: int) -> None:
        for at, g in enumerate(grams(word, self.q)):
            self.postings[g, at].append(len(self.words))
        self.words.append((word, n))

    def near(self, word: str, shorter: bool) -> Iterator[tuple[str, int]]:
        """Indexed words at one edit from ``word``, which is as long as they are or shorter by one."""
        found = []
        for at, g in enumerate(grams(word, self.q)):
            for place in (at, at + 1)[: 1 + shorter]:
                if (own := self.postings.get((g, place))) is not None:
                    found.append(own)
        found.sort(key=len)
        merged = len(found) - self.least + 1  # what comes up often enough stands in one of these lists
        if merged < 1:
            return
        short, long = found[:merged], found[merged:]
        for k, times in Counter(merge(*short)).items() if merged > 1 else zip(short[0], repeat(1)):
            for other in long:
                i = bisect_left(other, k)
                times += i < len(other) and other[i] == k
            if times >= self.least and one_edit(word, self.words[k][0]):
                yield self.words[k]


def _merger(q: int):
    """Rows (gram, length, place, part, role, word, n) sorted by all but the last two, to pairs of near words (a, a_n, b, b_n), the shorter or lesser first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = cell = None
        for batch in batches:
            out = []
            for *now, role, word, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now != key:
                    key, cell = now, _Cell(now[1], q)
                if role != 0 and not cell.words:
                    continue
                out += [(word, n, *other) if role == 1 or word < other[0] else (*other, word, n) for other in cell.near(word, role == 1)]
                if role == 0:
                    cell.add(word, n)
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _PAIRS.types, strict=True)], schema=_PAIRS)

    return tidy(run)


_PAIRS = pa.schema([("a", pa.string()), ("a_n", pa.int64()), ("b", pa.string()), ("b_n", pa.int64())])


def near_pairs(counted: DataFrame, q: int = Q, block: int = BLOCK) -> DataFrame:
    """(a, a_n, b, b_n): every pair of near words of (word, n) once; words have 2 * q code points at least."""
    g = F.transform(F.sequence(F.lit(1), F.length("word") - (q - 1)), lambda i: F.substring("word", i, F.lit(q)))
    short = counted.filter(F.length("word") < 2 * q).limit(1).count()
    if short:
        raise ValueError(f"words of under {2 * q} code points need shorter q-grams")
    often = {r[0]: r[1] for r in counted.select(F.explode(g).alias("g")).groupBy("g").count().toLocalIterator()}  # 90 ** q at most
    posted = counted.mapInArrow(_poster(q, often), "gram string, length int, place int, role int, word string, n long")
    cell = ["gram", "length", "place"]
    full = posted.filter("role = 0").groupBy(*cell).agg(F.ceil(F.count("*") / block).cast("int").alias("cuts")).filter("cuts > 1")
    own = F.pmod(F.xxhash64("word"), F.col("cuts")).cast("int")
    at = posted.join(full, cell, "left").withColumn("cuts", F.coalesce("cuts", F.lit(1))).withColumn("own", own)

    def dealt(parts: Column, role: Column) -> Column:
        return F.transform(parts, lambda p: F.struct(p.alias("part"), role.alias("role")))

    later = F.when(F.col("own") + 1 < F.col("cuts"), F.sequence(F.col("own") + 1, F.col("cuts") - 1)).otherwise(F.array().cast("array<int>"))
    to = F.when(F.col("role") == 0, F.concat(dealt(F.array("own"), F.lit(0)), dealt(later, F.lit(2)))).otherwise(dealt(F.sequence(F.lit(0), F.col("cuts") - 1), F.lit(1)))
    at = at.withColumn("to", F.explode(to)).select(*cell, "to.part", "to.role", "word", "n")
    at = at.repartition(*cell, "part").sortWithinPartitions(*cell, "part", "role")
    return at.mapInArrow(_merger(q), "a string, a_n long, b string, b_n long").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form; each round doubles the way that has been gone."""
    now = durable(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        then = durable(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(now)
        now = then
        if not now.filter("moved").limit(1).count():
            return now.select("word", "root")


def variants(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO, delete: int | None = DELETE, q: int = Q, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n of every frequent word."""
    counted = words(docs, min_chars, min_count, delete)
    pairs = durable(near_pairs(counted, q, block))
    both = pairs.union(pairs.select("b", "b_n", "a", "a_n"))
    best = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("m"), F.col("b").alias("form"))).alias("best"))
    known = counted.join(best, "word", "left")
    holds = -F.col("best.m") >= ratio * F.col("n")
    known = durable(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(holds, F.col("best.form")).alias("form"), F.when(holds, -F.col("best.m")).alias("form_n")))
    discard(pairs, counted)
    roots = _roots(known.filter("form is not null"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
