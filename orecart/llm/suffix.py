"""Suffix sorting by linear grouping construction.

Phase 1 keeps suffixes in groups, a group being a run of the array and its first index its name, so
names are in order. Groups are taken from the highest down. For each member the pointer to the
previous suffix in a lower group is set; the suffixes pointed at move to a new group just above their
old one, those with more pointers from this group higher. In the end every group shares its longest
Lyndon prefix. Phase 2 walks the array once in ascending order and, from each suffix's left
neighbour along the pointers, emits suffixes at the front of their groups. Nothing is renamed and
nothing recurses.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in lexicographic order; a suffix precedes its extensions."""
    n = len(symbols)
    first = np.argsort(symbols, kind="stable")
    ordered = symbols[first]
    opens = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if n else np.zeros(0, np.int64)
    place = np.empty(n, np.int64)
    place[first] = np.arange(n)
    group = np.empty(n, np.int64)
    group[first] = np.repeat(opens, np.diff(np.append(opens, n)))
    sa, pos, name = first.tolist(), place.tolist(), group.tolist()
    width = np.zeros(n, np.int64)
    width[opens] = np.diff(np.append(opens, n))
    size = width.tolist()
    before = [-1] * n

    end = n
    while end:
        g = name[sa[end - 1]]
        if end - g == 1:  # a group of one points once
            s = sa[g]
            j = s - 1
            while j >= 0 and name[j] >= g:
                j = before[j]
            before[s] = j
            end = g
            if j >= 0:
                q = name[j]
                k = size[q]
                if k > 1:
                    last = q + k - 1
                    at, other = pos[j], sa[last]
                    sa[at], sa[last], pos[other], pos[j] = other, j, at, last
                    size[q], size[last], name[j] = k - 1, 1, last
            continue
        count: dict[int, int] = {}
        for s in sorted(sa[g:end]):
            j = s - 1
            while j >= 0 and name[j] >= g:
                j = before[j]
            before[s] = j
            if j >= 0:
                count[j] = count.get(j, 0) + 1
        layers: dict[int, dict[int, list[int]]] = {}
        for p, times in count.items():
            layers.setdefault(times, {}).setdefault(name[p], []).append(p)
        for times in sorted(layers, reverse=True):
            for q, moved in layers[times].items():
                k, m = size[q], len(moved)
                if k == m:
                    continue
                last = q + k
                for p in moved:
                    last -= 1
                    at, other = pos[p], sa[last]
                    sa[at], sa[last], pos[other], pos[p] = other, p, at, last
                    name[p] = last
                for p in moved:
                    name[p] = last
                size[q], size[last] = k - m, m
        end = g

    out, front, done = [-1] * n, list(range(n)), bytearray(n)
    s = n - 1
    for i in range(n + 1):
        if i:
            s = out[i - 1] - 1
        while s >= 0 and not done[s]:
            g = name[s]
            at = front[g]
            out[at] = s
            front[g] = at + 1
            done[s] = 1
            s = before[s]
    return np.array(out, np.int64)
