"""Byte-level BPE by corpus-level merge replay.

A task gathers the distinct words of a block of texts (about BLOCK_CHARS characters) that its
worker hasn't met, lays their bytes out in one array and keeps an inverted index from each
adjacent pair (its merged rank) to the positions where it stands.  Merges are then replayed in
rank order over all words at once; a merge updates only the touched neighbours and files their
new pairs in the index.  A worker remembers words' ids, at most REMEMBERED of them.

Defined cases: a null text is an empty one and has no ids; a text of any length is encoded whole;
rows are encoded one by one, so ties and repeated rows change nothing; an empty table gives an
empty result; other columns pass through ``encoded`` and ``decoded``, whose new column must not
have the name of one that is there.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .base import small_batches, tidy

NONE = np.int64(1) << 40
#: Characters of text whose new words are replayed together.
BLOCK_CHARS = 1_000_000
#: Pieces whose ids a worker remembers.
REMEMBERED = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Merges:
    """A rank file's merges: pair of ids to merged id, which is also the merge's rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {
            (ranks[t[:cut]] << 20 | ranks[t[cut:]]): rank
            for t, rank in ranks.items() for cut in range(1, len(t)) if t[:cut] in ranks and t[cut:] in ranks
        }
        keys = np.array(sorted(pairs), np.int64)
        self.keys, self.merged = keys, np.array([pairs[int(k)] for k in keys], np.int64)
        # A merged token that can join a lower-ranked pair must not be made twice in a word in one step.
        least = np.full(len(self.bytes_of), NONE)
        np.minimum.at(least, keys >> 20, self.merged)
        np.minimum.at(least, keys & ((1 << 20) - 1), self.merged)
        self.stepwise = least < np.arange(len(least))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], NONE)

    def replay(self, words: Sequence[bytes]) -> list[bytes]:
        """The ids of each word, as 32-bit integers."""
        if not words:
            return []
        sizes = np.array([len(w) for w in words])
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        n = len(ids)
        word = np.repeat(np.arange(len(words)), sizes)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(sizes) - 1
        after[ends[sizes > 0]] = n
        before[(ends - sizes + 1)[sizes > 0]] = -1
        alive = np.ones(n, bool)
        rank = np.full(n, NONE)
        inner = np.flatnonzero(after < n)
        rank[inner] = self.rank(ids[inner], ids[inner + 1])
        index: dict[int, list[np.ndarray]] = {}
        order: list[int] = []

        def file(at: np.ndarray) -> None:
            at = at[rank[at] < NONE]
            if not len(at):
                return
            by = rank[at]
            at = at[np.argsort(by, kind="stable")]
            by = rank[at]
            cuts = np.flatnonzero(np.diff(by)) + 1
            for r, part in zip(by[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts), strict=True):
                if r not in index:
                    index[r] = []
                    heapq.heappush(order, r)
                index[r].append(part)

        file(inner)
        while order:
            r = heapq.heappop(order)
            found = index.pop(r)
            at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            if len(found) == 1:
                at = np.sort(at)
            if self.stepwise[r]:
                first = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
                later, at = at[~first], at[first]
                if len(later):
                    index[r] = [later]
                    heapq.heappush(order, r)
            elif len(at) > 1:
                follows = np.concatenate([[False], after[at[:-1]] == at[1:]])
                if follows.any():  # of a run of overlapping pairs, every second one
                    place = np.arange(len(at))
                    start = np.maximum.accumulate(np.where(follows, 0, place))
                    at = at[(place - start) % 2 == 0]
            right = after[at]
            ids[at] = r
            alive[right] = False
            rank[right] = NONE
            beyond = after[right]
            after[at] = beyond
            inside = beyond < n
            before[beyond[inside]] = at[inside]
            left = before[at]
            touched = np.unique(np.concatenate([at, left[left >= 0]]))
            touched = touched[alive[touched]]
            rank[touched] = NONE
            paired = touched[after[touched] < n]
            rank[paired] = self.rank(ids[paired], ids[after[paired]])
            file(paired)
        flat, counts = ids[alive].astype(np.int32), np.bincount(word[alive], minlength=len(words))
        cuts = np.concatenate([[0], np.cumsum(counts)]).tolist()
        return [flat[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


class Memory:
    """Ids of pieces: the place of each piece, and where its ids lie in a pool.

    ``learn`` gives the ids of new pieces: all of them in a row, and how many each has.  A memory
    that would pass ``most`` pieces (REMEMBERED) keeps those that were asked for more than once lately, or,
    if they leave too little room, starts anew with the pieces that are asked for.
    """

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int | None = None):
        self.learn, self.most = learn, most or REMEMBERED
        self.known: dict[str, int] = {}  # pieces to places, in the order of the places
        self.ids, self.starts, self.counts, self.odd, self.times = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int32)
        self.generation = object()  # another one whenever places change

    def _forget(self, room: int) -> None:
        """Leave what was asked for once, and the rest too if ``room`` new pieces have no place beside it."""
        kept = np.flatnonzero(self.times > 1)
        if len(kept) + room > self.most or len(kept) == len(self.known):
            kept = kept[:0]
        pieces = list(self.known)
        self.known = {pieces[i]: k for k, i in enumerate(kept.tolist())}
        self.ids, self.counts = self.laid_out(kept)
        self.starts, self.odd, self.times = np.cumsum(self.counts) - self.counts, self.odd[kept], self.times[kept] // 2
        self.generation = object()

    def _add(self, pieces: list[str]) -> None:
        ids, counts = self.learn(pieces)
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, ids])
        self.odd = np.concatenate([self.odd, np.array([not p or p[0].isspace() for p in pieces], bool)])
        self.times = np.concatenate([self.times, np.zeros(len(pieces), np.int32)])

    def places(self, pieces: pa.Array) -> np.ndarray:
        """The place of each of ``pieces`` in the memory."""
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            if self.known and len(self.known) + len(missing) > self.most:
                self.times[at[at >= 0]] += 2  # what this block asks for stays, if it can
                self._forget(len(missing))
                return self.places(pieces)
            at[missing] = np.arange(len(self.known), len(self.known) + len(missing))
            self._add([distinct[i] for i in missing.tolist()])
        self.times[at] += 1
        return at[coded.indices.to_numpy()]

    def laid_out(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all places in a row, and how many each has."""
        counts = self.counts[places]
        return self.ids[spread(self.starts[places], counts)], counts


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Runs of ``counts`` numbers from ``starts``, one after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)


def summed(counts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``counts`` between successive ``offsets``."""
    return np.diff(np.concatenate([[0], np.cumsum(counts)])[offsets])


class Codec:
    """Encoder and decoder of one rank file; remembers the ids of pieces it has met."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.merges = Merges(ranks)
        self.words = regex.compile(pattern)
        self._open()

    def _open(self, most: int | None = None) -> None:
        # A single space before anything but white space always starts a word, so texts can be cut there.
        self.cut = regex.compile(r"(?= \S)")
        self.first, self.spaced = Memory(lambda p: self._learn(p, ""), most), Memory(lambda p: self._learn(p, " "), most)

    def _learn(self, pieces: list[str], space: str) -> tuple[np.ndarray, np.ndarray]:
        split = [[space + p] if p.isalpha() else self.words.findall(space + p) for p in pieces]
        place: dict[str, int] = {}
        used = np.array([place.setdefault(w, len(place)) for ws in split for w in ws], np.int64)
        replayed = self.merges.replay([w.encode() for w in place])
        counts = np.array([len(r) // 4 for r in replayed], np.int64)
        flat = np.frombuffer(b"".join(replayed), np.int32)
        starts = np.cumsum(counts) - counts
        ids = flat[spread(starts[used], counts[used])]
        return ids, summed(counts[used], np.concatenate([[0], np.cumsum([len(ws) for ws in split])]).astype(np.int64))

    def encode_block(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        pieces = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        offsets = pieces.offsets.to_numpy().astype(np.int64)
        flat = pieces.values
        places = self.spaced.places(flat)
        odd = self.spaced.odd[places]
        odd[offsets[:-1]] = False  # of a text's first piece nothing is asked
        strange = np.flatnonzero(summed(odd, offsets)).tolist()
        ids, counts = self.spaced.laid_out(places)
        heads, head_counts = self.first.laid_out(self.first.places(flat.take(pa.array(offsets[:-1]))))
        if strange:  # texts with runs of white space are cut before what isn't
            parts = [self.cut.split(texts[i]) for i in strange]
            rest = [p[1:] for ps in parts for p in ps[1:]]
            cut_offsets = np.concatenate([[0], np.cumsum([len(ps) - 1 for ps in parts])]).astype(np.int64)
            cut_ids, cut_counts = self.spaced.laid_out(self.spaced.places(pa.array(rest, pa.large_string())))
            cut_heads, cut_head_counts = self.first.laid_out(self.first.places(pa.array([ps[0] for ps in parts], pa.large_string())))
            cut_sums = summed(cut_counts, cut_offsets)
            cut_at = np.concatenate([[0], np.cumsum(cut_sums)])
            head_at = np.concatenate([[0], np.cumsum(cut_head_counts)])
            whole = {i: np.concatenate([cut_heads[head_at[k] : head_at[k + 1]], cut_ids[cut_at[k] : cut_at[k + 1]]]) for k, i in enumerate(strange)}
        # The ids of a text's first piece, as if after a space, give way to its ids at the start of a text.
        sums = summed(counts, offsets)
        ends = np.cumsum(sums)
        skipped = counts[offsets[:-1]]
        totals = sums - skipped + head_counts
        out = np.empty(int(totals.sum()), np.int32)
        out_starts = np.cumsum(totals) - totals
        out[spread(out_starts, head_counts)] = heads
        out[spread(out_starts + head_counts, sums - skipped)] = ids[spread(ends - sums + skipped, sums - skipped)]
        if strange:
            rows = np.split(out, out_starts[1:])
            for i, found in whole.items():
                rows[i], totals[i] = found, len(found)
            out = np.concatenate(rows)
        return out, totals

    def encode(self, texts: Sequence[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for block in in_blocks(texts):
            ids, counts = self.encode_block(block)
            yield from np.split(ids, np.cumsum(counts)[:-1])

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.merges.bytes_of.__getitem__, ids))


def in_blocks(texts: Sequence[str]) -> Iterator[list[str]]:
    """``texts`` in runs of about BLOCK_CHARS characters."""
    block: list[str] = []
    size = 0
    for text in texts:
        block.append(text)
        size += len(text)
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


_kept: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec of a rank file; the file lies at the same path on every machine."""
    if (path, pattern) not in _kept:
        _kept[path, pattern] = Codec(read_ranks(path), pattern)
    return _kept[path, pattern]


def _by_batch(row: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield row(batch)

    return run


def _free(rows: DataFrame, name: str) -> None:
    if name.lower() in (c.lower() for c in rows.columns):
        raise ValueError(f"there is a column {name!r} already; name another by into=")


def encoded(docs: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text`` as array<int> ``into``."""
    _free(docs, into)
    small_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def row(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = list(codec(path, pattern).encode([t or "" for t in batch.column(at).to_pylist()]))
        cuts = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
        return pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, into])

    return docs.mapInArrow(_by_batch(row), T.StructType([*docs.schema, T.StructField(into, T.ArrayType(T.IntegerType()))]))


def decoded(rows: DataFrame, path: str, pattern: str, ids: str = "ids", into: str = "bytes") -> DataFrame:
    """``rows`` with the bytes that ``ids`` stand for as binary ``into``."""
    _free(rows, into)
    small_batches(rows.sparkSession)
    at = rows.columns.index(ids)

    def row(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [codec(path, pattern).decode(i or []) for i in batch.column(at).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, into])

    return rows.mapInArrow(_by_batch(row), T.StructType([*rows.schema, T.StructField(into, T.BinaryType())]))


def gathered(batches: Iterator[pa.RecordBatch], text: int, chars: int | None = None) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Batches joined until they hold about ``chars`` (BLOCK_CHARS) characters, with their texts (null: empty)."""
    held: list[pa.RecordBatch] = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        new = [t or "" for t in batch.column(text).to_pylist()]
        held.append(batch)
        texts += new
        size += sum(map(len, new))
        if size >= (chars or BLOCK_CHARS):
            yield pa.concat_batches(held), texts
            held, texts, size = [], [], 0
            pa.default_memory_pool().release_unused()  # one block's arrays at a time
    if texts:
        yield pa.concat_batches(held), texts


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: the round trip of every text in one pass."""
    small_batches(docs.sparkSession)

    def hashes(strings: pa.Array, cuts: list[int], less: int) -> list[str]:
        """SHA-256 of the strings between cuts joined, but for the last ``less`` bytes."""
        offsets = np.frombuffer(strings.buffers()[1], np.int64, len(strings) + 1, 8 * strings.offset)
        data = memoryview(strings.buffers()[2] or b"")
        at = offsets[np.array(cuts)].tolist()
        return [hashlib.sha256(data[a : max(a, b - less)]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, pattern)
        names = pa.array([f"{i}," for i in range(len(tool.merges.bytes_of))], pa.large_string())
        tokens = pa.array(tool.merges.bytes_of, pa.large_binary())
        for batch, texts in gathered(batches, 1):
            ids, counts = tool.encode_block(texts)
            cuts = np.concatenate([[0], np.cumsum(counts)]).tolist()
            at = pa.array(ids)
            arrays = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes(names.take(at), cuts, 1), pa.string()), pa.array(hashes(tokens.take(at), cuts, 0), pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
