"""Hashed word shingles of whole texts, by numpy over the bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

CHUNK = 1 << 20  # bytes hashed at once, beyond which a single text may go
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 (fixed constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values(fold: bool) -> np.ndarray:
    """A random number per byte; with ``fold`` the same for A-Z and a-z."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    if fold:
        values[65:91] = values[97:123]
    return values


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK + CHUNK // 4)
        inverse = pow(_BASE, -1, 2**64)
        _POWERS[:] = [np.cumprod(np.append(np.uint64(1), np.full(size - 1, b, np.uint64)), dtype=np.uint64)
                      for b in (_BASE, inverse)]
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(texts: Sequence[bytes], fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of ``texts`` (with ``fold``, A-Z as a-z) and the number of its text.

    Words are runs of bytes other than 0x20 and 0x09 to 0x0D.
    """
    data = np.frombuffer(b" ".join(texts), np.uint8)
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    inside = (data != 32) & ((data < 9) | (data > 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    power, inverse = _powers(len(data))
    sums = np.append(np.uint64(0), np.cumsum(_byte_values(fold)[data] * power, dtype=np.uint64))
    hashes = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.searchsorted(ends, start, "right")


def chained(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive hashes."""
    n = max(0, len(hashes) - k + 1)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(_BASE) + hashes[i:i + n])
    return out


def chunks(texts: Sequence[bytes]) -> Iterator[range]:
    """Ranges of consecutive texts of about ``CHUNK`` bytes."""
    first = total = 0
    for i, text in enumerate(texts):
        if total and total + len(text) > CHUNK:
            yield range(first, i)
            first, total = i, 0
        total += len(text) + 1
    if first < len(texts):
        yield range(first, len(texts))


def shingle_lists(texts: Sequence[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, text by text with repeats, and where each text's begin.

    A text with fewer than k words, but one, has a single shingle of all its words. The
    boundaries have one more entry than there are texts.
    """
    hashes, of = word_hashes(texts)
    words = np.bincount(of, minlength=len(texts))
    first = np.append(0, np.cumsum(words))
    whole = of[k - 1:] == of[:len(of) - k + 1] if len(of) >= k else np.empty(0, bool)
    shingle, owner = chained(hashes, k)[whole], of[:len(whole)][whole]
    short = np.flatnonzero((words > 0) & (words < k))
    if len(short):
        own = np.array([chained(hashes[first[i]:first[i + 1]], int(words[i]))[0] for i in short], np.uint64)
        at = np.searchsorted(owner, short)
        shingle, owner = np.insert(shingle, at, own), np.insert(owner, at, short)
    return shingle, np.searchsorted(owner, np.arange(len(texts) + 1))
