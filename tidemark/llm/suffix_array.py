"""Suffix array of a sequence of integers by linear grouping construction."""

from __future__ import annotations

import numpy as np


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The starts of the suffixes of s in ascending order; a suffix that begins another one comes before it.

    Phase 1 groups suffixes by their longest Lyndon prefix. Groups begin as single characters and are finished in
    descending order: each member of a finished group points to the previous suffix of a lower, unfinished group, whose
    own prefix then takes in the member's prefix, as often as members point there; suffixes that take in as much are
    split off as a group right above their old one. Phase 2 orders each group by what follows the prefix: that suffix
    is always smaller, so one walk over the ranks in ascending order puts every suffix into the next free place of its
    group. No names are sorted again at a deeper level; both phases do a constant amount of work for each suffix."""
    n = len(s)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    values, of = np.unique(s, return_inverse=True)
    group = of.tolist()  # the group of each suffix
    by_value = np.argsort(of, kind="stable")
    bounds = np.searchsorted(of[by_value], np.arange(len(values) + 1))
    members = [by_value[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    width = [1] * len(values)  # the length of the prefix that a group's suffixes share
    below = list(range(-1, len(values) - 1))  # the next lower group, and the next higher one
    above = list(range(1, len(values))) + [-1]
    previous = [-1] * n
    done = bytearray(n)
    current = len(values) - 1
    finished = []
    while current >= 0:
        now = [i for i in members[current] if group[i] == current]
        members[current] = now
        if now:
            finished.append(current)
            for i in now:
                done[i] = 1
            # members ascend, and so do the suffixes that they point to: equal ones are neighbours
            targets, last, times = [], -1, 0
            for i in now:
                p = i - 1
                while p >= 0 and done[p]:
                    p = previous[p]
                previous[i] = p
                if p == last:
                    times += 1
                else:
                    if last >= 0:
                        targets.append((last, times))
                    last, times = p, 1
            if last >= 0:
                targets.append((last, times))
            made: dict[tuple[int, int], list[int]] = {}
            for p, k in targets:
                old = group[p]
                if (old, k) in made:
                    made[old, k].append(p)
                else:
                    made[old, k] = [p]
            # of one old group, those that take in more come higher; each new group goes above those before it
            tail: dict[int, int] = {}
            for old, k in sorted(made) if len(made) > 1 else made:
                new, under, moved = len(members), tail.get(old, old), made[old, k]
                over = above[under]
                members.append(moved)
                width.append(width[old] + k * width[current])
                below.append(under)
                above.append(over)
                above[under] = below[over] = new
                tail[old] = new
                for p in moved:
                    group[p] = new
        current = below[current]
    # phase 2
    order = finished[::-1]
    sizes = np.array([len(members[g]) for g in order])
    place = np.zeros(len(members), dtype=np.int64)
    place[order] = np.cumsum(sizes) - sizes
    free = place.tolist()
    groups = np.array(group)
    follows = np.arange(n) + np.array(width)[groups]
    kids = np.argsort(follows, kind="stable")
    first = np.searchsorted(follows[kids], np.arange(n + 2)).tolist()
    kid_list, out = kids.tolist(), [0] * n
    for i in kid_list[first[n] : first[n + 1]]:  # what follows the whole text is the empty suffix, the smallest
        g = group[i]
        out[free[g]] = i
        free[g] += 1
    for r in range(n):
        x = out[r]
        for i in kid_list[first[x] : first[x + 1]]:
            g = group[i]
            out[free[g]] = i
            free[g] += 1
    return np.array(out, dtype=np.int64)
