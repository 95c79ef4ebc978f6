"""Suffix array of an integer string by linear grouping (no renaming, no recursion)."""

from __future__ import annotations

import numpy as np


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of ``text`` (numbers of 1 or more) in ascending order.

    First suffixes are grouped by their Lyndon prefix. Groups are processed in descending order: each
    member finds the nearest suffix before it in a lower group (its previous-smaller pointer), whose
    prefix the group's prefix extends, as often as the group points there. Such suffixes leave their
    group for a new one right above it, more extensions higher up. Then the order is emitted in
    ascending order: behind every emitted suffix, the chain of previous-smaller pointers names the
    suffixes that come next in their groups.
    """
    n = len(text)
    if not n:
        return []
    members: list[set[int]] = []
    group = [0] * n
    symbols: dict[int, list[int]] = {}
    for i, symbol in enumerate(text):
        symbols.setdefault(symbol, []).append(i)
    for number, symbol in enumerate(sorted(symbols)):
        members.append(set(symbols[symbol]))
        for i in symbols[symbol]:
            group[i] = number
    below, above = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    above[-1] = -1
    done = [False] * len(members)
    previous = [-1] * n
    current = len(members) - 1
    while current >= 0:
        done[current] = True
        if len(members[current]) == 1:                     # a lone suffix extends one other, or none
            i, = members[current]
            p = i - 1
            while p >= 0 and done[group[p]]:
                p = previous[p]
            previous[i] = p
            if p >= 0 and len(members[group[p]]) > 1:
                old, number = group[p], len(members)
                members[old].remove(p)
                members.append({p})
                done.append(False)
                upper = above[old]
                below.append(old), above.append(upper)
                above[old] = number
                if upper >= 0:
                    below[upper] = number
                group[p] = number
            current = below[current]
            continue
        own = sorted(members[current])
        reached: dict[int, int] = {}
        for i in own:
            p = i - 1
            while p >= 0 and done[group[p]]:
                p = previous[p]
            previous[i] = p
            if p >= 0:
                reached[p] = reached.get(p, 0) + 1
        parted: dict[int, list[int]] = {}
        for p in reached:
            parted.setdefault(group[p], []).append(p)
        for old, extended in parted.items():
            if len(extended) == len(members[old]) and len({reached[p] for p in extended}) == 1:
                continue                                   # the whole group is extended alike
            by_times: dict[int, list[int]] = {}
            for p in extended:
                by_times.setdefault(reached[p], []).append(p)
            for times in sorted(by_times, reverse=True):   # each right above the old group
                number, moved = len(members), by_times[times]
                members.append(set(moved))
                done.append(False)
                upper = above[old]
                below.append(old), above.append(upper)
                above[old] = number
                if upper >= 0:
                    below[upper] = number
                for p in moved:
                    group[p] = number
            members[old].difference_update(extended)
        current = below[current]

    # emit
    lowest = 0
    while below[lowest] >= 0:
        lowest = below[lowest]
    free, at, current = [0] * len(members), 0, lowest
    while current >= 0:
        free[current] = at
        at += len(members[current])
        current = above[current]
    order, placed = [-1] * n, [False] * n

    def place(p):
        while p >= 0 and not placed[p]:
            placed[p] = True
            number = group[p]
            order[free[number]] = p
            free[number] += 1
            p = previous[p]

    place(n - 1)                                           # behind the end of the text
    for i in range(n):
        place(order[i] - 1)
    return order


def common_prefixes(text, order, most: int | None = None) -> np.ndarray:
    """Length of the common prefix of each suffix in ``order`` with the one before it; the first is 0. Lengths beyond
    ``most`` are given as ``most``."""
    text, order = np.append(np.asarray(text, np.int64), 0), np.asarray(order, np.int64)
    n = len(order)
    out = np.zeros(n, np.int64)
    left = np.arange(1, n)                                 # whose prefixes agree as far as they were compared
    size = 0
    while len(left) and (most is None or size < most):
        a, b = order[left - 1] + size, order[left] + size
        left = left[(a < n) & (b < n) & (text[np.minimum(a, n)] == text[np.minimum(b, n)])]
        size += 1
        out[left] = size
    return out
