"""Word and shingle hashes of many texts at once, in numpy.

Every word's 64-bit hash is a sum of byte values times powers of its position, so that one pass
of vector operations hashes all words of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Bytes hashed at a time; bounds the scratch arrays.
CHUNK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RANDOM = np.random.Generator(np.random.PCG64(20260101))
_VALUES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)
_VALUES[_SPACE] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_STEPS = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def scramble(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: np.uint64, n: int, kept: dict = {}) -> np.ndarray:  # noqa: B006
    have = kept.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK + 1), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 4 * CHUNK:
            kept[int(base)] = have
    return have[:n]


def _hash_block(block: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    joined = b" ".join(block) + b" "
    raw = np.frombuffer(joined, np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=1))
    starts, ends = edge[0::2], edge[1::2]
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUES[raw] * _powers(_BASE, len(raw)), out=total[1:])
    h = (total[ends] - total[starts]) * _powers(_INVERSE, len(raw))[starts]
    at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in block])])
    return scramble(h ^ (ends - starts).astype(np.uint64)), np.searchsorted(starts, at)


def hashed_blocks(texts: Sequence[str | None], table: bytes | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, hashes of all words, first word of each text and the end) of blocks of texts; A-Z count as a-z.

    ``table`` maps the UTF-8 bytes first, as for bytes.translate.
    """
    block: list[bytes] = []
    size = first = 0
    for i, text in enumerate([*texts, None]):
        raw = (text or "").encode().lower()
        raw = raw.translate(table) if table else raw
        if block and (i == len(texts) or size + len(raw) > CHUNK):
            yield first, *_hash_block(block)
            block, size, first = [], 0, i
        block.append(raw)
        size += len(raw) + 1


def hashed_words(texts: Sequence[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(place of the text, hashes of its words) of every text."""
    for first, h, cut in hashed_blocks(texts):
        for k in range(len(cut) - 1):
            yield first + k, h[cut[k] : cut[k + 1]]


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, in order; fewer words make one shingle, none make none."""
    if not len(words):
        return words
    if len(words) < n:
        return scramble(np.array([np.sum(words * _STEPS[: len(words)]) + np.uint64(len(words))], np.uint64))
    out = words[: len(words) - n + 1] * _STEPS[0]
    for k in range(1, n):
        out = out + words[k : len(words) - n + 1 + k] * _STEPS[k]
    return scramble(out)


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """The distinct shingles, ascending, as signed numbers that Spark can hold."""
    return np.unique(shingles(words, n).view(np.int64))
