"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Induction runs a bucket at a time: what a bucket's suffixes induce is one stable sort by the preceding symbol, and
suffixes that induce into their own bucket form further waves. The names of the leftmost-S substrings make a shorter
string over a large alphabet, whose order is found by doubling the names; ``depth`` symbols are ordered, which is all
that classes of equal strings of that length need.
"""

from __future__ import annotations

import numpy as np


def s_types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (the end is smallest of all)."""
    n = len(s)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(s[1:].astype(np.int32) - s[:-1])
    step[-1] = -1
    at = np.where(step != 0, np.arange(n), n)
    following = np.minimum.accumulate(at[::-1])[::-1]
    return step[following] > 0


def _deal(queues: list, items: np.ndarray, symbols: np.ndarray) -> None:
    """Append items to the queues of their symbols, keeping their order."""
    if len(items):
        order = np.argsort(symbols, kind="stable")
        items, symbols = items[order], symbols[order]
        cuts = np.flatnonzero(np.diff(symbols, prepend=symbols[0] - 1))
        for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(items)], strict=True):
            queues[int(symbols[i])].append(items[i:j])


_NONE = np.zeros(0, np.int64)


def _join(parts: list) -> np.ndarray:
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else _NONE


def induce(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """The suffix array from the leftmost-S suffixes in order (of each bucket)."""
    marks: list = [[] for _ in range(sigma)]
    _deal(marks, lms, s[lms])
    larger: list = [[] for _ in range(sigma)]
    larger[int(s[-1])].append(np.array([len(s) - 1], np.int64))

    def waves(queue, c, own, others):
        """Scan a bucket that grows while it is scanned."""
        cur = _join(queue)
        done = []
        while len(cur):
            done.append(cur)
            prev = cur[cur > 0] - 1
            prev = prev[is_s[prev] == own]
            sym = s[prev]
            same = sym == c
            _deal(others, prev[~same], sym[~same])
            cur = prev[same]
        return _join(done)

    def scan(items, own, others):
        prev = items[items > 0] - 1
        prev = prev[is_s[prev] == own]
        _deal(others, prev, s[prev])

    for c in range(sigma):
        if larger[c]:
            larger[c] = [waves(larger[c], c, False, larger)]
        if marks[c]:
            scan(_join(marks[c]), False, larger)
    smaller: list = [[] for _ in range(sigma)]
    for c in range(sigma - 1, -1, -1):
        if smaller[c]:
            smaller[c] = [waves(smaller[c], c, True, smaller)]
        if larger[c]:
            scan(_join(larger[c])[::-1], True, smaller)
    return _join([x for c in range(sigma) for x in (_join(larger[c]), _join(smaller[c])[::-1]) if len(x)])


def _names(s: np.ndarray, order: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Names (from 1) of substrings of these lengths that start at ``order``, which is sorted."""
    a, b = order[:-1], order[1:]
    same = length[:-1] == length[1:]
    live = np.flatnonzero(same)
    k = 0
    while len(live):
        live = live[length[1:][live] > k]
        differ = s[a[live] + k] != s[b[live] + k]
        same[live[differ]] = False
        live = live[~differ]
        k += 1
    return np.concatenate([[1], 1 + np.cumsum(~same)])


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes of ``s`` (small non-negative integers), ordered at least by their first ``depth`` symbols."""
    n = len(s)
    if n == 0:
        return _NONE
    sigma = int(s.max()) + 1
    is_s = s_types(s)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    if len(lms) == 0:
        return induce(s, is_s, lms, sigma)
    # sort the leftmost-S substrings by one induction, then name them
    first = induce(s, is_s, lms, sigma)
    mark = np.zeros(n, bool)
    mark[lms] = True
    order = first[mark[first]]
    end = np.empty(n, np.int64)
    end[lms] = np.append(lms[1:] + 1, n)
    name = _names(s, order, end[order] - order)
    rank = np.empty(n, np.int64)
    rank[order] = name
    rank = rank[lms]
    # the shorter string of names: doubling, until all differ or depth symbols are compared
    reach = 1
    while rank.max() < len(rank) and 2 * reach <= 2 * depth:
        following = np.zeros_like(rank)
        following[:-reach] = rank[reach:]
        key = rank * (len(rank) + 1) + following
        at = np.argsort(key)
        new = np.empty_like(rank)
        new[at] = 1 + np.cumsum(np.diff(key[at], prepend=key[at[0]]) != 0)
        rank = new
        reach *= 2
    return induce(s, is_s, lms[np.argsort(rank, kind="stable")], sigma)


def common_prefixes(s: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Permuted: for each start the common prefix with its predecessor in ``sa``, counted up to ``most``.

    Eight symbols are compared at once; pairs that have differed drop out.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate([s.astype(np.uint8), np.zeros(most + 8, np.uint8)])
    word = padded[: n + most].astype(np.uint64)
    for k in range(1, 8):
        word |= padded[k : n + most + k].astype(np.uint64) << np.uint64(8 * k)
    out = np.zeros(n, np.int64)
    live = np.flatnonzero(before >= 0)
    got = 0
    while len(live) and got < most:
        x = word[live + got] ^ word[before[live] + got]
        equal = x == 0
        part = live[~equal]
        low = x[~equal]
        low = low & (~low + np.uint64(1))
        out[part] = got + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        live = live[equal]
        got += 8
        out[live] = got
    return np.minimum(out, np.minimum(most, n - np.arange(n)))
