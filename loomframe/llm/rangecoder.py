"""Adaptive context-mixing range coder for token ids, many blocks in step.

A chunk is cut into blocks of ``BLOCK_IDS`` ids.  Every block starts from the same state, so it
is coded and read on its own, and its ids' checksum is kept beside it.  Each id is predicted in
three orders: the id that followed the last two ids before (order 2), the id that followed the
last one before (order 1), both learnt within the block, and the chunk's frequencies of ids
after ids like the last one (order 0, in classes of ids with like followers).  The orders share
the interval by weights that adapt in contexts of how sure the predictions are: first what order
2 names, then what order 1 names, then all ids by their frequencies.

All arithmetic is exact, so that a decoder repeats it: integers, and quotients of integers under
2**53 whose floor floating point gives exactly.  All blocks of a chunk advance together, one id a
step, so that each step is a few numpy operations on all of them.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK_IDS = 2048
MAGIC = b"LFR2"
#: The range lies between 2 ** LOW and 2 ** TOP; 16 bits leave or enter at a time.
TOP, LOW = 48, 32
#: Bits of the orders' weights, and of the frequencies of a class.
WEIGHT, SCALE = 11, 16
SLOTS = 512  # contexts of a block's table of an order
SPEED = 5
ONE, NOTHING = np.int64(1 << 16), np.int64(0)
#: What of a block's low end stays when a digit leaves.
KEPT = np.int64((1 << LOW) - 1)
#: Steps whose ids are looked up at once, and ids of a chunk that are counted at once.
SLAB, PART = 64, 1 << 20
#: The orders' first weights (order 2, order 1) by whether order 2 and order 1 were right last time and name the same id.
FIRST_SHARES = np.array([a << 16 | b for a, b in ((4096, 3072), (12288, 0), (3072, 12288), (16384, 0), (20480, 2048), (24576, 0), (20480, 4096), (32768, 0))], np.int64)
#: At most so many classes of last ids, one for each so many ids of the chunk.
CLASSES, IDS_A_CLASS = 32, 40_000
#: Followers that tell ids apart when they are put into classes.
MARKS = 64


def _paired(rows: np.ndarray, last: np.ndarray, x: np.ndarray, width: int, n_rows: int) -> np.ndarray:
    """How often each of ``x``, at most ``width`` - 1, comes after each row of its ``last``, counted over a part of the chunk at a time."""
    out = np.zeros(n_rows * width, np.int64)
    for a in range(0, len(x), PART):
        part = rows.take(last[a : a + PART])
        part *= width
        part += np.minimum(x[a : a + PART], width - 1)
        out += np.bincount(part, minlength=len(out))
    return out.reshape(n_rows, width)


def _classes(x: np.ndarray, last: np.ndarray, n_ids: int) -> np.ndarray:
    """Class of each id by the share of the commonest ids among its followers."""
    k = max(1, min(CLASSES, len(x) // IDS_A_CLASS))
    if k == 1 or n_ids <= k:
        return np.zeros(n_ids, np.int64)
    after = _paired(np.arange(n_ids), last, x, MARKS + 1, n_ids).astype(np.float32)
    total = after.sum(axis=1)
    share = np.sqrt(after / np.maximum(total, 1)[:, None])
    met = np.flatnonzero(total >= 8)
    points, weights = share[met], total[met]
    centres = points[:k].copy()  # ids are in the order of their counts
    for _ in range(6):
        near = (points @ centres.T - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1)
        for c in np.unique(near):
            centres[c] = np.average(points[near == c], axis=0, weights=weights[near == c])
    out = np.zeros(n_ids, np.int64)
    out[met] = near
    return out


def _quantised(counts: np.ndarray, scale: int) -> np.ndarray:
    """Rows of counts as frequencies that add up to 2 ** scale; what was counted has one at least."""
    total = counts.sum(axis=1, keepdims=True)
    out = np.where(counts > 0, np.maximum(1, (counts << scale) // np.maximum(total, 1)), 0)
    for row in np.flatnonzero(total[:, 0]):
        over = int(out[row].sum()) - (1 << scale)
        while over > 0:  # what minima added is taken from the large
            most = np.argsort(-out[row], kind="stable")
            give = np.maximum(out[row][most] // 2, 1) - 1 if out[row].max() < 2 * over + 2 else np.where(np.arange(len(most)) == 0, over, 0)
            give = np.diff(np.minimum(np.cumsum(give), over), prepend=0)
            out[row][most] -= give
            over -= int(give.sum())
        out[row, out[row].argmax()] -= over
    return out


class _Tables:
    """What all blocks of a chunk start from: classes and frequencies of its ids, numbered by count."""

    def __init__(self, class_of: np.ndarray, freq: np.ndarray):
        k, n = freq.shape
        self.scale = int(freq.sum(axis=1).max()).bit_length() - 1
        cum = np.zeros((k, n + 1), np.int64)
        np.cumsum(freq, axis=1, out=cum[:, 1:])
        self.freq = freq
        self.packed = (cum[:, :-1] << 32 | freq.astype(np.int64)).ravel()  # where an id begins, and its frequency
        self.row = (class_of * n).astype(np.int64)
        self.slot = (class_of << self.scale).astype(np.int64)
        self.class_sums = cum[:, -1]
        self.k, self.n = k, n

    def inverse(self) -> np.ndarray:
        """The id of each place of each class's frequencies."""
        out = np.zeros((self.k, 1 << self.scale), np.int32)
        for c in np.flatnonzero(self.class_sums):
            out[c] = np.repeat(np.arange(self.n, dtype=np.int32), self.freq[c])
        return out.ravel()


class _Models:
    """The adaptive state of all blocks: predictions of order 1 and 2 and the orders' weights.

    A context names the id that followed it last; its lowest bit tells whether the id before was the same.
    """

    def __init__(self, n: int):
        self.guess1, self.guess2 = np.zeros(n * SLOTS, np.int32), np.zeros(n * SLOTS, np.int32)
        self.spread, self.contexts = np.arange(n) * SLOTS, np.arange(n) * 8
        self.share = np.tile(FIRST_SHARES, n)

    def predict(self, place1: np.ndarray, place2: np.ndarray) -> tuple[np.ndarray, ...]:
        """(what order 2 names, what order 1 names, their weights) at the blocks' places in the tables of the orders."""
        self.place1, self.place2 = place1, place2
        known1, known2 = self.guess1.take(place1), self.guess2.take(place2)
        context = known2 & 1
        context <<= 1
        context |= known1 & 1
        context <<= 1
        context |= (known1 ^ known2) < 2
        self.context = self.contexts[: len(context)] + context
        shares = self.share.take(self.context)
        self.share2, self.share1 = shares >> 16, shares & 0xFFFF
        known1 >>= 1
        known2 >>= 1
        return known2, known1, self.share2 >> 16 - WEIGHT, self.share1 >> 16 - WEIGHT

    def update(self, fresh: np.ndarray, was2: np.ndarray, was1: np.ndarray, by2: np.ndarray, by1: np.ndarray) -> None:
        """``fresh`` are the ids shifted by a bit; ``was2`` and ``was1`` tell whether an order named them, ``by2`` and ``by1`` whether they were coded by it."""
        for share, by in ((self.share2, by2), (self.share1, by1)):
            share += (np.where(by, ONE, NOTHING) - share) >> SPEED
        self.share2 <<= 16
        self.share2 |= self.share1
        self.share[self.context] = self.share2
        self.guess1[self.place1] = fresh | was1
        self.guess2[self.place2] = fresh | was2


def _slots(last: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The contexts of order 1 and 2 after the ids ``before`` and ``last``."""
    here = last * 40503
    return here >> 6 & (SLOTS - 1), (here ^ before * 25171) >> 7 & (SLOTS - 1)


def _active(sizes: np.ndarray, steps: int) -> list[int]:
    """How many blocks, in descending order of size, have an id in each step."""
    return np.searchsorted(-sizes, -np.arange(steps), side="left").tolist()


def _encode(matrix: np.ndarray, sizes: np.ndarray, tables: _Tables) -> list[bytes]:
    """``matrix`` is steps x blocks; blocks are in descending order of ``sizes``."""
    steps, n = matrix.shape
    models, scale = _Models(n), tables.scale
    low, wide = np.zeros(n, np.int64), np.full(n, 1 << TOP, np.int64)
    digits, gone, n_digits = np.zeros((2 * steps + 8, n), np.int32), np.zeros((2 * steps + 8, n), bool), 0

    def settle(m: int, rows: np.ndarray) -> None:
        """The leading digit of ``rows`` leaves; a carry is its seventeenth bit."""
        nonlocal n_digits
        digits[n_digits, :m] = low[:m] >> LOW
        gone[n_digits, :m] = rows
        n_digits += 1
        np.copyto(low[:m], (low[:m] & KEPT) << 16, where=rows)
        np.copyto(wide[:m], wide[:m] << 16, where=rows)

    active = _active(sizes, steps)
    for first in range(0, steps, SLAB):  # what doesn't hang on the models is computed for many steps at once
        end = min(steps, first + SLAB)
        ids = np.zeros((end - first + 2, n), np.int64)
        ids[max(0, 2 - first) :] = matrix[max(0, first - 2) : end]
        places1, places2 = _slots(ids[1:-1], ids[:-2])
        places1 += models.spread
        places2 += models.spread
        packed = tables.packed.take(tables.row.take(ids[1:-1]) + ids[2:])
        begins, shares, fresh = packed >> 32, packed & 0xFFFFFFFF, matrix[first:end] << 1
        for k in range(end - first):
            m = active[first + k]
            x = matrix[first + k, :m]
            two, one, w2, w1 = models.predict(places1[k, :m], places2[k, :m])
            was2, was1 = two == x, one == x
            by2 = was2 & (w2 > 0)
            by1 = (was1 & (w1 > 0)) > by2
            w12 = w1 + w2
            w0 = (1 << WEIGHT) - w12
            w2 <<= scale
            w1 <<= scale
            w12 <<= scale
            w12 += w0 * begins[k, :m]
            start = np.where(by2, NOTHING, np.where(by1, w2, w12))
            r = wide[:m] >> WEIGHT + scale
            start *= r
            low[:m] += start
            np.multiply(np.where(by2, w2, np.where(by1, w1, w0 * shares[k, :m])), r, out=wide[:m])
            while (rows := wide[:m] < 1 << LOW).any():
                settle(m, rows)
            models.update(fresh[k, :m], was2, was1, by2, by1)
    for _ in range(TOP // 16):
        settle(n, np.ones(n, bool))
    gone = np.ascontiguousarray(gone[:n_digits].T)
    out = np.concatenate([np.zeros(1, np.int32), digits[:n_digits].T[gone]])
    while (carry := out >> 16).any():  # it never reaches beyond a block's first digit
        out &= 0xFFFF
        out[:-1] += carry[1:]
    cuts = np.concatenate([[1], 1 + np.cumsum(gone.sum(axis=1))]).tolist()
    out = out.astype("<u2")
    return [out[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _decode(data: list[bytes], sizes: np.ndarray, tables: _Tables) -> np.ndarray:
    n, steps = len(data), int(sizes.max(initial=0))
    models, scale, inverse = _Models(n), tables.scale, tables.inverse()
    flat = np.concatenate([np.frombuffer(b"".join(data), "<u2"), np.zeros(64, "<u2")])
    lengths = np.array([len(d) // 2 for d in data])
    at = np.cumsum(lengths) - lengths
    head = [flat.take(at + k, mode="clip").astype(np.int64) for k in range(3)]
    at += 3
    code, wide = head[0] << 32 | head[1] << 16 | head[2], np.full(n, 1 << TOP, np.int64)
    out = np.zeros((steps, n), np.int32)
    last = before = np.zeros(n, np.int64)
    for step, m in enumerate(_active(sizes, steps)):
        last, before = last[:m], before[:m]
        place1, place2 = _slots(last, before)
        place1 += models.spread[:m]
        place2 += models.spread[:m]
        two, one, w2, w1 = models.predict(place1, place2)
        w12 = w1 + w2
        w0 = (1 << WEIGHT) - w12
        r = wide[:m] >> WEIGHT + scale
        value = np.minimum((code[:m] / r).astype(np.int64), (1 << WEIGHT + scale) - 1)
        w2 <<= scale
        w1 <<= scale
        w12 <<= scale
        by2, by1 = value < w2, value < w12
        value -= w12
        slot = np.maximum((value / w0).astype(np.int64), 0)
        slot += tables.slot.take(last)
        x0 = inverse.take(slot)
        packed = tables.packed.take(tables.row.take(last) + x0)
        x = np.where(by2, two, np.where(by1, one, x0))
        w12 += w0 * (packed >> 32)
        packed &= 0xFFFFFFFF
        packed *= w0
        start = np.where(by2, NOTHING, np.where(by1, w2, w12))
        start *= r
        code[:m] -= start
        np.multiply(np.where(by2, w2, np.where(by1, w1, packed)), r, out=wide[:m])
        while (rows := wide[:m] < 1 << LOW).any():
            np.copyto(code[:m], code[:m] << 16 | flat.take(at[:m], mode="clip"), where=rows)
            at[:m] += rows
            np.copyto(wide[:m], np.maximum(wide[:m], 1) << 16, where=rows)  # damaged codes may have none left
        models.update(x << 1, x == two, x == one, by2, by1 > by2)
        out[step, :m] = x
        last, before = x.astype(np.int64), last
    return out


def _sizes(n_ids: int) -> np.ndarray:
    n = -(-n_ids // BLOCK_IDS)
    sizes = np.full(n, BLOCK_IDS)
    if n:
        sizes[-1] = n_ids - (n - 1) * BLOCK_IDS
    return sizes


def pack(ids: np.ndarray, vocabulary: int) -> bytes:
    """A chunk of blocks: the tables they start from, each block's number of ids, bytes and checksum, then their codes."""
    ids = np.asarray(ids, np.int32)
    sizes = _sizes(len(ids))
    n = len(sizes)
    if not n:
        return MAGIC + struct.pack("<IIIIII", 0, vocabulary, 0, 0, 0, 0)
    counts = np.bincount(ids, minlength=vocabulary)
    names = np.argsort(-counts, kind="stable")[: int((counts > 0).sum())]
    number = np.zeros(vocabulary, np.int32)
    number[names] = np.arange(len(names), dtype=np.int32)
    x = np.zeros(n * BLOCK_IDS, np.int32)
    x[: len(ids)] = number[ids]
    last = np.zeros(len(ids), np.int32)
    last[1:] = x[: len(ids) - 1]
    last[::BLOCK_IDS] = 0  # a block starts as after the commonest id
    class_of = _classes(x[: len(ids)], last, len(names))
    k = int(class_of.max()) + 1
    scale = max(SCALE, len(names).bit_length() + 1)
    freq = _quantised(_paired(class_of, last, x[: len(ids)], len(names), k), scale)
    del last
    tables = _Tables(class_of, freq)
    codes = _encode(np.ascontiguousarray(x.reshape(n, BLOCK_IDS).T[: int(sizes.max())]), sizes, tables)
    head = zlib.compress(names.astype("<u4").tobytes() + class_of.astype(np.uint8).tobytes() + freq.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 6)
    out = [MAGIC, struct.pack("<IIIIII", n, vocabulary, len(ids), len(names), k, len(head)), head]
    for i, code in enumerate(codes):
        block = ids[i * BLOCK_IDS : i * BLOCK_IDS + sizes[i]]
        out.append(struct.pack("<III", len(block), len(code), zlib.crc32(block.astype("<u4").tobytes())))
    return b"".join(out + codes)


def unpack(data: bytes) -> np.ndarray:
    """The ids of a chunk; a block that doesn't fit its checksum is an error."""
    if data[:4] != MAGIC:
        raise ValueError("not a chunk of token ids")
    n, _, total, n_names, k, size = struct.unpack_from("<IIIIII", data, 4)
    if not n:
        return np.zeros(0, np.int32)
    try:
        head = zlib.decompress(data[28 : 28 + size])
    except zlib.error as e:
        raise ValueError("the chunk's tables are damaged") from e
    names = np.frombuffer(head, "<u4", n_names).astype(np.int32)
    class_of = np.frombuffer(head, np.uint8, n_names, 4 * n_names).astype(np.int64)
    freq = np.ascontiguousarray(np.frombuffer(head, np.uint8, offset=5 * n_names).reshape(4, -1).T).view("<u4").reshape(k, n_names)
    at = 28 + size
    heads = [struct.unpack_from("<III", data, at + 12 * i) for i in range(n)]
    at += 12 * n
    codes = []
    for _, length, _ in heads:
        codes.append(data[at : at + length])
        at += length
    sizes = np.array([h[0] for h in heads])
    matrix = names.take(_decode(codes, sizes, _Tables(class_of, freq.astype(np.int64))), mode="clip")
    ids = np.ascontiguousarray(matrix.T)
    blocks = [ids[i, : sizes[i]] for i in range(n)]
    for i, block in enumerate(blocks):
        if zlib.crc32(block.astype("<u4").tobytes()) != heads[i][2]:
            raise ValueError(f"block {i} is damaged")
    whole = np.concatenate(blocks)
    if len(whole) != total:
        raise ValueError("the chunk is incomplete")
    return whole
