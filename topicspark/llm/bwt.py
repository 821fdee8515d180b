"""Suffix order, Burrows-Wheeler transform and threshold-bounded prefixes of
one block of byte strings (numpy; a block is one task's bounded share)."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order of ``text``, a run of strings each ended by a 0 byte that
    occurs nowhere else; the ends count as distinct, ordered by place.

    Prefix doubling from 8-byte keys; only groups still tied are sorted again.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    alive = np.ones(n, bool)                     # no end among the bytes so far
    for j in range(8):
        byte = padded[j:j + n]
        alive &= byte != 0
        key = (key << np.uint64(8)) | np.where(alive, byte, np.uint64(0))
    order = np.argsort(key)
    sk = key[order]
    new = np.append(True, sk[1:] != sk[:-1])
    ended = ~alive                               # an end among the first 8 bytes: place decides
    start = np.flatnonzero(new)
    head = np.repeat(start, np.diff(np.append(start, n)))
    rank = np.empty(n, np.int64)
    rank[order] = head
    del key, sk, padded
    step = 0                                     # first round: only ties that hold an end, by place
    while True:
        size = np.diff(np.append(start, n))
        tied = np.repeat(size > 1, size)
        if step == 0:
            tied &= ended[order]
        at = np.flatnonzero(tied)
        if not len(at):
            if step:
                return order
            step = 8
            continue
        idx = order[at]
        group = head[at]
        nxt = rank[np.minimum(idx + step, n - 1)]
        if step == 0:
            nxt = np.where(ended[idx], idx, 0)
        sort = np.argsort((group << 32) | nxt)   # a block has fewer than 2^31 bytes
        order[at] = idx[sort]
        nxt, g = nxt[sort], group[sort]
        fresh = np.append(True, (g[1:] != g[:-1]) | (nxt[1:] != nxt[:-1]))
        new[at] |= fresh
        start = np.flatnonzero(new)
        head = np.repeat(start, np.diff(np.append(start, n)))
        rank[order[at]] = head[at]
        step = 2 * step or 8


def long_prefix_groups(text: np.ndarray, minimum: int) -> tuple[np.ndarray, np.ndarray]:
    """``(order, group)``: the suffix order and, for each place in it, a group
    number such that neighbours share a group iff their common prefix has at
    least ``minimum`` bytes.

    Breadth-first backward extension on the transform (Beller et al. 2013):
    level by level, an interval of suffixes with a common prefix of length l
    that ends at a boundary is extended by every byte before it, which sets
    the boundaries of value l + 1.  The expansion stops at ``minimum``; what is
    unset then has a longer common prefix.  Every boundary is set once.
    """
    n = len(text)
    order = suffix_array(text)
    before = text[order - 1]                     # the transform (the byte before suffix 0 is the last end)
    by_char = np.argsort(before, kind="stable")  # places of the transform in LF order
    lf = np.empty(n, np.int64)
    lf[by_char] = np.arange(n)
    sorted_char = before[by_char]
    same = np.append(False, sorted_char[1:] == sorted_char[:-1])
    prev = np.full(n, -1, np.int64)              # previous place with the same byte before
    prev[by_char[1:][same[1:]]] = by_char[:-1][same[1:]]
    nxt = np.full(n, n, np.int64)
    nxt[by_char[:-1][same[1:]]] = by_char[1:][same[1:]]
    lcp = np.full(n + 1, -1, np.int32)           # -1: not set
    lcp[n] = 0
    lcp[np.flatnonzero(~same)] = 0               # first suffix of each byte
    ends = int((text == 0).sum())
    lcp[:ends] = 0                               # ends are distinct
    letter = before != 0
    place = np.arange(n)
    for level in range(minimum - 1):
        new = np.flatnonzero(lcp == level)
        if not len(new):
            continue
        if len(new) * 32 > n:
            seen = np.zeros(n, np.int64)
            inside = new[new < n]
            seen[inside] = inside + 1
            np.maximum.accumulate(seen, out=seen)
            hit = letter & (seen - 1 > prev) & (prev >= 0)
            target = lf[place[hit]]
            target = target[lcp[target] < 0]
        else:
            bound = np.flatnonzero(lcp >= 0)
            low = bound[np.maximum(np.searchsorted(bound, new) - 1, 0)]
            length = new - low
            left = np.repeat(low, length)
            item = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length) + left
            end = np.repeat(new, length)
            last = letter[item] & (nxt[item] >= end)     # last of its byte within the interval
            target = lf[item[last]] + 1
            target = target[target < n]
            target = target[lcp[target] < 0]
        lcp[target] = level + 1
    group = np.cumsum(lcp[:n] >= 0) - 1
    return order, group
