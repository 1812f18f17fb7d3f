"""Longest common prefixes by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Suffixes are ordered by their first ``depth`` bytes; order beyond that does not matter to intervals
of shorter strings. From the transform, intervals are extended to the left by every byte, breadth
first: the intervals of level v are those of strings of v bytes, so the borders they set are common
prefixes of exactly v bytes. Expansion stops at the minimum length; a border that is not set by
then lies between suffixes that share at least that many bytes.
"""

from __future__ import annotations

import numpy as np

from gleaner.llm.common import ranges

#: Ends a string; no UTF-8 text has this byte.
END = 0xFF


def order_suffixes(data: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by their next ``depth`` bytes (cyclic), by prefix doubling.

    A suffix's rank is the place where those with the same known bytes begin, so it stays when it is
    alone there, and each round sorts only those that are not.
    """
    n = len(data)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = key << np.uint64(8) | np.roll(data, -j).astype(np.uint64)
    known = 8
    order = np.argsort(key)
    rank = np.empty(n, np.uint32)
    places, new = np.arange(n), np.ones(n, bool)
    while True:
        at = order[places]
        sorted_ = key if known > 8 else key[at]
        new[1:] = sorted_[1:] != sorted_[:-1]
        rank[at] = np.maximum.accumulate(np.where(new, places, 0))
        alone = new & np.append(new[1:], True)
        places = places[~alone]
        if known >= depth or not len(places):
            return order
        step = min(known, depth - known)
        at = order[places]
        after = at + step % n
        after[after >= n] -= n
        key = rank[at].astype(np.uint64) << np.uint64(32) | rank[after]
        by = np.argsort(key)
        order[places], key = at[by], key[by]
        new = np.ones(len(places), bool)
        known += step


def long_borders(data: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """For each place of the order, whether its suffix shares ``least`` bytes or more with the one before."""
    n = len(data)
    bwt = data[order - 1]
    by_byte = np.argsort(bwt, kind="stable")
    to = np.empty(n, np.int64)
    to[by_byte] = np.arange(n)  # where a place goes when the byte before is put in front
    unset = np.ones(n + 1, bool)
    unset[0] = unset[n] = False
    begin, end = np.array([0]), np.array([n])
    for _ in range(least):
        if not len(begin):
            break
        places = ranges(begin, end - begin)
        owner = np.repeat(np.arange(len(begin)), end - begin)
        target = to[places]
        code = bwt[places]
        if len(places) > n // 8:
            label = np.full(n + 1, -1, np.int64)
            label[target] = owner << 8 | code
            target = np.flatnonzero(label[:n] >= 0)
            label = label[target]
        else:
            by = np.argsort(target)
            target = target[by]
            label = (owner << 8 | code)[by]
        new = np.append(True, (target[1:] != target[:-1] + 1) | (label[1:] != label[:-1]))
        first = np.flatnonzero(new)
        starts, ends = target[first], target[np.append(first[1:], len(target)) - 1] + 1
        fresh = unset[ends]
        begin, end = starts[fresh], ends[fresh]
        unset[end] = False
    return unset[:n]


def repeated_starts(strings: list[np.ndarray], weights: np.ndarray, least: int) -> list[np.ndarray]:
    """For each string, by start, whether ``least`` bytes from there occur twice or more in all.

    A string counts ``weights`` times; starts that leave fewer than ``least`` bytes are left out.
    """
    sizes = np.array([len(x) for x in strings])
    data = np.full(int(sizes.sum()) + len(strings), END, np.uint8)
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    data[ranges(begins, sizes)] = np.concatenate(strings)
    order = order_suffixes(data, least)
    tied = long_borders(data, order, least)
    weight = np.zeros(len(data), np.int64)
    windows = np.maximum(0, sizes - least + 1)
    weight[ranges(begins, windows)] = np.repeat(weights, windows)
    group = np.cumsum(~tied) - 1  # equal for suffixes that share their first bytes
    total = np.bincount(group, weight[order], minlength=1)
    many = np.empty(len(data), bool)
    many[order] = total[group] >= 2
    return [many[a : a + w] for a, w in zip(begins.tolist(), windows.tolist())]
