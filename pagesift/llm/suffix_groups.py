"""Suffix array by linear grouping construction.

Phase 1 groups the suffixes by their Lyndon prefix. Groups are intervals of
the array, at first one per symbol, and are taken in descending order. Each
suffix of the group points to the previous suffix of a lower group; the
suffixes pointed at are followed by the group's prefix, so they leave the low
part of their own group for a new group directly after it (those followed by
it more often after those less often). Phase 2 walks the array from its
smallest suffix and emits each group's suffixes in order: the suffixes whose
Lyndon prefix ends where a sorted suffix begins are found over the same
pointers. Nothing is renamed and nothing recurses.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of a sequence of integers >= 1, in ascending order.

    A suffix that is a prefix of another comes first.
    """
    n = len(symbols) + 1
    text = np.zeros(n, np.int64)  # a smallest symbol ends the sequence
    text[:-1] = symbols
    order = np.argsort(text, kind="stable")
    ranked = text[order]
    begins = np.concatenate([[0], np.nonzero(np.diff(ranked))[0] + 1])
    sizes = np.diff(np.append(begins, n))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    link = np.empty(n, np.int64)
    link[order] = np.repeat(begins, sizes)
    size = np.zeros(n + 1, np.int64)
    size[begins] = sizes
    sa, isa, group, gsize = order.tolist(), place.tolist(), link.tolist(), size.tolist()
    prev = _phase1(sa, isa, group, gsize, n)
    return np.array(_phase2(group, prev, n), np.int64)[1:]


def _phase1(sa: list[int], isa: list[int], group: list[int], gsize: list[int], n: int) -> list[int]:
    prev = [-1] * n
    times = [0] * n  # how often the current group's prefix follows a suffix
    end = n
    while end > 1:
        start = group[sa[end - 1]]
        members = sa[start:end]
        if len(members) > 1:
            members.sort()
        targets = []
        for i in members:
            p = i - 1
            while p >= 0 and group[p] > start:
                p = prev[p]
            if p >= 0 and group[p] == start:
                p = prev[p]  # the same prefix again: it belongs to the same lower suffix
            prev[i] = p
            if p >= 0:
                if not times[p]:
                    targets.append(p)
                times[p] += 1
        if len(targets) == 1 or (targets and len(members) == len(targets)):
            _move(targets, sa, isa, group, gsize)
        elif targets:
            by: dict[int, list[int]] = {}
            for p in targets:
                by.setdefault(times[p], []).append(p)
            for k in sorted(by, reverse=True):
                _move(by[k], sa, isa, group, gsize)
        for p in targets:
            times[p] = 0
        end = start
    return prev


def _move(targets: list[int], sa: list[int], isa: list[int], group: list[int], gsize: list[int]) -> None:
    """Split the targets off their groups, into new groups directly after what stays."""
    whole = []
    for p in targets:
        g = group[p]
        size = gsize[g] = gsize[g] - 1
        last = g + size
        at, other = isa[p], sa[last]
        sa[at], isa[other] = other, at
        sa[last], isa[p] = p, last
    for p in targets:
        g = group[p]
        new = g + gsize[g]
        if new == g:  # the whole group goes: it keeps its place and counts again
            whole.append(p)
        else:
            group[p] = new
            gsize[new] += 1
    for p in whole:
        gsize[group[p]] += 1


def _phase2(group: list[int], prev: list[int], n: int) -> list[int]:
    free = list(range(n))  # next free place of a group, by its first place
    sa = [0] * n
    sa[0] = n - 1
    placed = bytearray(n)
    placed[n - 1] = 1
    for i in range(n):
        p = sa[i] - 1
        while p >= 0 and not placed[p]:
            g = group[p]
            sa[free[g]] = p
            free[g] += 1
            placed[p] = 1
            p = prev[p]
    return sa
