"""Word-shingle sets as sorted arrays of 64-bit hashes, computed over whole batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BATCH_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as far as they have been needed."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, 2 * len(cls.up), _BATCH_BYTES + 1)
            inverse = pow(_BASE, -1, 1 << 64)
            cls.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE, dtype=np.uint64)]), dtype=np.uint64)
            cls.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse, dtype=np.uint64)]), dtype=np.uint64)
        return cls.up, cls.down


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of a text: runs of bytes other than ASCII white space."""
    a = np.frombuffer(raw, dtype=np.uint8)
    if not len(a):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    inside = ~_SPACE[a]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _Powers.to(len(a) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], dtype=np.uint64)])
        h = (sums[ends] - sums[starts]) * down[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(n, size, dtype=np.uint64)
        for k in range(size):
            h = h * np.uint64(0xFF51AFD7ED558CCD) + words[k : k + n]
            h ^= h >> np.uint64(32)
        return mix(h)


def batches_of(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts in UTF-8 with A-Z in lower case, about a megabyte at a time, and the first one's place."""
    first, some, held = 0, [], 0
    for i, t in enumerate(texts):
        raw = (t or "").encode().lower()
        if some and held + len(raw) > _BATCH_BYTES:
            yield first, some
            first, some, held = i, [], 0
        some.append(raw)
        held += len(raw) + 1
    if some:
        yield first, some


def shingle_lists(texts: list[str | None], size: int = 5) -> Iterator[np.ndarray]:
    """For each text its shingle hashes in order, repeats included. Fewer words than ``size`` make one shingle; none, none."""
    for _, some in batches_of(texts):
        words, starts = word_hashes(b"\n".join(some))
        ends = np.cumsum([len(r) + 1 for r in some])
        cuts = np.searchsorted(starts, ends)
        all_shingles = window_hashes(words, size)
        a = 0
        for b in cuts.tolist():
            if b - a >= size:
                yield all_shingles[a : b - size + 1]
            elif b > a:
                yield window_hashes(words[a:b], b - a)
            else:
                yield np.zeros(0, dtype=np.uint64)
            a = b


def shingle_sets(texts: list[str | None], size: int = 5) -> Iterator[np.ndarray]:
    """For each text its distinct shingle hashes in ascending order."""
    for x in shingle_lists(texts, size):
        yield np.unique(x)
