"""Word shingles of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

K = 5
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array without nulls."""
    n = len(texts)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def slices(texts: pa.Array, most: int = 2 << 20):
    """(first, last) of runs of texts with about ``most`` bytes."""
    _, at = utf8(texts)
    i, n = 0, len(texts)
    while i < n:
        j = int(np.searchsorted(at, at[i] + most, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased, split at [\\x20\\x09-\\x0D]) and the number of words before each text."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    low = data + (((data >= 65) & (data <= 90)) * np.uint8(32)).astype(np.uint8)
    word = ~((low == 32) | ((low >= 9) & (low <= 13)))
    start = word.copy()
    start[1:] &= ~word[:-1]
    edge = at[:-1][at[:-1] < n]
    start[edge] = word[edge]
    first = np.flatnonzero(start)
    if len(first) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    index = np.arange(n)
    since = index - np.maximum.accumulate(np.where(start, index, 0))
    longest = int(since[word].max()) + 1
    power = np.cumprod(np.full(longest, _BASE, np.uint64))
    value = np.where(word, (low.astype(np.uint64) + np.uint64(1)) * power[np.minimum(since, longest - 1)], np.uint64(0))
    return mix(np.add.reduceat(value, first)), np.searchsorted(first, at)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer than K words has one shingle, of none no shingle."""
    out: list[np.ndarray] = []
    for i, j in slices(texts, 512 << 10):
        data, at = utf8(texts.slice(i, j - i))
        w, count = word_hashes(data, at)
        if len(w) >= K:
            h = w[: len(w) - K + 1].copy()
            for k in range(1, K):
                h = h * _STEP + w[k : len(w) - K + 1 + k]
            h = mix(h + np.uint64(K))
        for a, b in zip(count[:-1].tolist(), count[1:].tolist(), strict=True):
            if b - a >= K:
                out.append(np.unique(h[a : b - K + 1]))
            elif b > a:
                x = w[a : a + 1].copy()
                for k in range(a + 1, b):
                    x = x * _STEP + w[k : k + 1]
                out.append(mix(x + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out
