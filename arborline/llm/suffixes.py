"""Suffix arrays over many sequences at once, refined by prefix doubling in numpy.

Symbols of all sequences lie in one array; suffixes are compared within a *family* (a document, or a
bucket of texts that share an anchor), and never run past the end of their own sequence. Suffixes that
are already alone in their group drop out of the doubling, so work follows what is repeated.
"""

from __future__ import annotations

import numpy as np


def ranks(*keys: np.ndarray) -> np.ndarray:
    """For each position, the first place of its group when sorted by the keys, the last key first."""
    n = len(keys[0])
    order = np.lexsort(keys) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.ones(n, bool)
    new[1:] = False
    for key in keys:
        new[1:] |= key[order[1:]] != key[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    return rank


def enhanced(rank: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and LCP array.

    ``rank``: ranks of the suffixes by their first symbols, apart between families; ``left``: symbols from each
    position to the end of its sequence. lcp[r] is the common prefix of suffixes sa[r - 1] and sa[r]; lcp[0] is 0.
    """
    n = len(rank)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    levels, h = [rank.copy()], 1
    while True:
        size = np.bincount(rank, minlength=n)
        active = np.flatnonzero(size[rank] > 1)
        if not len(active):
            break
        # rank of the suffix h further on; the end of a sequence is smaller than all, and unlike other ends
        ahead = np.where(left[active] > h, rank[np.minimum(active + h, n - 1)], -1 - active - left[active])
        by = np.lexsort((ahead, rank[active]))
        a, b = rank[active][by], ahead[by]
        group = np.ones(len(by), bool)
        group[1:] = a[1:] != a[:-1]
        new = group.copy()
        new[1:] |= b[1:] != b[:-1]
        at = np.arange(len(by))
        start = np.maximum.accumulate(np.where(group, at, 0))
        mine = np.maximum.accumulate(np.where(new, at, 0))
        rank = rank.copy()
        rank[active[by]] = a + mine - start
        levels.append(rank.copy())
        h *= 2
    sa = np.argsort(rank, kind="stable")
    lcp = np.zeros(n, np.int64)
    x, y = sa[:-1].copy(), sa[1:].copy()
    alive = np.arange(n - 1)
    for k in range(len(levels) - 1, -1, -1):
        if not len(alive):
            break
        size, lv = 1 << k, levels[k]
        i, j = x[alive], y[alive]
        inside = (i < n) & (j < n)
        same = np.zeros(len(alive), bool)
        same[inside] = lv[i[inside]] == lv[j[inside]]
        # a suffix shorter than the size is alone in its group, so equal ranks are full matches
        hit = alive[same]
        lcp[hit + 1] += size
        x[hit] += size
        y[hit] += size
        ended = np.zeros(len(alive), bool)
        ended[same] = (left[sa[hit]] <= lcp[hit + 1]) | (left[sa[hit + 1]] <= lcp[hit + 1])
        alive = alive[~ended]
    return sa, lcp


def intervals(lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Stack scan of the LCP array: (length, first, last) of every interval of suffixes whose longest common prefix has ``least`` symbols or more."""
    out: list[tuple[int, int, int]] = []
    hot = np.flatnonzero(lcp >= least)
    if not len(hot):
        return out
    breaks = np.flatnonzero(np.diff(hot) > 1) + 1
    for run in np.split(hot, breaks):
        stack: list[tuple[int, int]] = []
        for r, value in zip(run.tolist(), lcp[run].tolist(), strict=True):
            first = r - 1
            while stack and stack[-1][0] > value:
                length, first = stack.pop()
                out.append((length, first, r - 1))
            if not stack or stack[-1][0] < value:
                stack.append((value, first))
        last = int(run[-1])
        while stack:
            length, first = stack.pop()
            out.append((length, first, last))
    return out


def interval_tree(lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stack scan: which interval each place of the LCP array is the bottom of (-1 below ``least``), and the length, first and last of the intervals."""
    own = np.full(len(lcp), -1, np.int64)
    length: list[int] = []
    first: list[int] = []
    last: list[int] = []
    hot = np.flatnonzero(lcp >= least)
    if len(hot):
        for run in np.split(hot, np.flatnonzero(np.diff(hot) > 1) + 1):
            stack: list[int] = []
            ids = []
            for r, value in zip(run.tolist(), lcp[run].tolist(), strict=True):
                begin = r - 1
                while stack and length[stack[-1]] > value:
                    begin = first[stack[-1]]
                    last[stack.pop()] = r - 1
                if not stack or length[stack[-1]] < value:
                    stack.append(len(length))
                    length.append(value)
                    first.append(begin)
                    last.append(r)
                ids.append(stack[-1])
            for i in stack:
                last[i] = int(run[-1])
            own[run] = ids
    return own, *(np.array(x, np.int64) for x in (length, first, last))


def maximal(sa: np.ndarray, lcp: np.ndarray, before: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of spans whose union is that of all maximal repeats of ``least`` symbols or more.

    A maximal repeat is an interval whose suffixes differ in the symbol ``before`` them. A suffix counts with the
    deepest interval that holds it: those around it are shorter spans at the same place, and where the deepest has one
    symbol before it, the repeat begins earlier.
    """
    own, length, first, last = interval_tree(lcp, least)
    if not len(length):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    left = before[sa]
    change = np.concatenate([[0], np.cumsum(left[1:] != left[:-1])])
    diverse = change[last] > change[first]
    after = np.append(own[1:], -1)
    lengths = np.append(length, 0)  # -1 is no interval
    deep = np.where(lengths[own] >= lengths[after], own, after)
    at = np.flatnonzero((deep >= 0) & np.append(diverse, False)[deep])
    return sa[at], length[deep[at]]


def deepest(sa: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each position, the length of the deepest LCP interval that holds its suffix: its longest prefix that occurs again."""
    out = np.zeros(len(sa), np.int64)
    after = np.zeros(len(sa), np.int64)
    after[:-1] = lcp[1:]
    out[sa] = np.maximum(lcp, after)
    return out


def cover(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in a span."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + lengths, -1)
    return np.cumsum(marks[:-1]) > 0
