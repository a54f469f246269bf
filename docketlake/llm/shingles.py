"""Word shingles of whole texts as sorted 64-bit hashes, in numpy.

Words are runs of bytes other than space and U+0009 to U+000D, with A-Z
lower-cased. Word hashes come from differences of one running polynomial sum over
the bytes, shingle hashes from the hashes of their words.
"""

from __future__ import annotations

import numpy as np

from docketlake.llm.subwords import distinct

_SEED = np.random.default_rng(20240607)
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _SEED.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _INVERSE = 6364136223846793005, pow(6364136223846793005, -1, 2**64)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: list[np.ndarray] = []


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective mix of 64-bit values; other seeds give other orders."""
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, _INVERSE)]
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "replace").lower(), np.uint8)
    if not len(data):
        return np.empty(0, np.uint64)
    inside = np.concatenate([[False], ~_WHITE[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return _hashes(data, edges[::2], edges[1::2])


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    power, inverse = _powers(len(data))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * power, dtype=np.uint64)])
    return mixed((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64)) if len(start) else np.empty(0, np.uint64)


def distinct_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the distinct words, number of each word among them, words of each text) of many texts."""
    data = np.frombuffer("\n".join(texts).encode("utf-8", "replace").lower(), np.uint8)
    inside = ~_WHITE.take(data)
    start = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]])) if len(data) else np.empty(0, np.int64)
    if not len(start):
        return np.empty(0, np.uint64), np.empty(0, np.int32), np.zeros(len(texts), np.int64)
    codes, words, cuts = distinct(data, inside, start)
    h = _hashes(words, cuts[:-1], cuts[1:])
    begin = np.cumsum([0, *(len(x.encode("utf-8", "replace")) + 1 if not x.isascii() else len(x) + 1 for x in texts)])
    return h, codes, np.diff(np.searchsorted(start, begin))


def shingle_set(text: str, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes; a text with fewer words has one for the whole sequence.

    ``words`` must be 1 to 16.
    """
    w = word_hashes(text)
    n = len(w)
    if not n:
        return w
    size = min(n, words)
    h = np.full(n - size + 1, np.uint64(size))
    for k in range(size):
        h += w[k : n - size + 1 + k] * _PLACE[k]
    h = np.sort(mixed(h))
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) > 1 else h
