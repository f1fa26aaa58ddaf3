"""Suffix array by linear grouping (operator 11's sort), without recursion or renaming.

Suffixes start in one group per first symbol.  Groups are taken in descending
order.  Each suffix of the group at hand points to the nearest position before
it whose group is smaller (a previous-smaller pointer, found by following the
pointers made so far).  A position hit by c pointers is followed by c copies
of the group's word, so it leaves its group for a new one right behind, higher
with larger c.  When all groups are done, each holds the suffixes with one
longest Lyndon prefix.  The second pass walks the array from its smallest
suffix and lets every suffix put those whose Lyndon prefix ends at it into
their group's next free place.  Both passes touch each suffix a constant
number of times, pointer walks amortised.
"""

from __future__ import annotations

import numpy as np


def _groups(symbols: list[int]) -> tuple[list[int], list[int], list[int], list[int], int]:
    """(group of each suffix, previous-smaller pointers, group sizes, next group in ascending order, first group)."""
    n = len(symbols)
    kinds = sorted(set(symbols))
    number = {s: g for g, s in enumerate(kinds)}
    group = [number[s] for s in symbols]
    members: list[list[int]] = [[] for _ in kinds]
    for i, g in enumerate(group):
        members[g].append(i)
    size = [len(m) for m in members]
    below = list(range(-1, len(kinds) - 1))
    above = list(range(1, len(kinds))) + [-1]
    done = bytearray(n + 1)  # the place n stands for "before the text" and is never done
    prev = [-1] * n
    at = len(kinds) - 1
    while at >= 0:
        here = members[at]
        if size[at] == 1:  # the common case: one pointer, at most one move
            s = here[0] if len(here) == 1 else next(x for x in here if group[x] == at)
            p = s - 1
            while done[p] and p >= 0:
                p = prev[p]
            prev[s] = p
            done[s] = 1
            members[at] = ()
            if p >= 0:
                old = group[p]
                if size[old] > 1:
                    new = len(size)
                    up = above[old]
                    size.append(1)
                    members.append([p])
                    below.append(old)
                    above.append(up)
                    above[old] = new
                    below[up] = new  # ``up`` is a group: ``at`` lies above ``old``
                    group[p] = new
                    size[old] -= 1
            at = below[at]
            continue
        else:
            here = sorted(x for x in here if group[x] == at)
            for s in here:
                done[s] = 1
            count: dict[int, int] = {}
            for s in here:
                p = s - 1
                while done[p] and p >= 0:
                    p = prev[p]
                prev[s] = p
                if p >= 0:
                    count[p] = count.get(p, 0) + 1
            by: dict[int, list[int]] = {}
            for p, c in count.items():
                by.setdefault(c, []).append(p)
            hits = sorted(by.items(), reverse=True)
        members[at] = ()
        for _, places in hits:
            made: dict[int, int] = {}
            total: dict[int, int] = {}
            for p in places:
                total[group[p]] = total.get(group[p], 0) + 1
            for p in places:
                old = group[p]
                if old not in made:
                    if total[old] == size[old]:  # nobody stays behind: the group already is where it has to be
                        continue
                    new = made[old] = len(size)
                    size.append(0)
                    members.append([])
                    up = above[old]
                    below.append(old)
                    above.append(up)
                    above[old] = new
                    if up >= 0:
                        below[up] = new
                new = made[old]
                group[p] = new
                members[new].append(p)
                size[new] += 1
                size[old] -= 1
                total[old] -= 1
        at = below[at]
    first = 0
    while below[first] >= 0:
        first = below[first]
    return group, prev, size, above, first


def suffix_array(symbols: list[int]) -> np.ndarray:
    """Start positions of the suffixes of ``symbols`` (whole numbers from 1) in ascending order.

    A shorter suffix that is a prefix of another comes first.  An empty
    sequence has an empty array.
    """
    if not len(symbols):
        return np.zeros(0, np.int64)
    text = [*symbols, 0]  # the end mark is smaller than every symbol
    n = len(text)
    group, prev, size, above, g = _groups(text)
    free, start = [0] * len(size), 0
    while g >= 0:
        free[g] = start
        start += size[g]
        g = above[g]
    out, placed = [-1] * n, bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            placed[s] = 1
            s = prev[s]
    return np.asarray(out[1:], np.int64)
