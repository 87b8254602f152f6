"""Suffix arrays by linear grouping.

Phase 1 starts with one group of suffixes for each first symbol and takes the groups from the
greatest down. For each suffix of the group at hand it finds the nearest place to its left whose group
is lower (the previous smaller pointer, found by jumping along pointers already set). Those places are
split off their own groups, by how many suffixes of the current group point to them, into new groups
just above what stays behind. In the end a group holds the suffixes with one Lyndon prefix (the longest
prefix that is a Lyndon word), groups are in order, and the pointers give each suffix the nearest
smaller suffix to its left.

Phase 2 emits. A suffix is its Lyndon prefix followed by the next smaller suffix, so inside a group the
order is that of these followers: each suffix that is placed lets the suffixes that it follows take the
next free places of their groups. No names are computed again and nothing recurs.
"""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """The starts of the suffixes of text in order; a suffix that is a prefix of another comes first."""
    n = len(text)
    by_symbol: dict[int, list[int]] = {}
    for i, symbol in enumerate(text):
        by_symbol.setdefault(symbol, []).append(i)
    lists = [by_symbol[symbol] for symbol in sorted(by_symbol)]
    group = [0] * n
    for g, places in enumerate(lists):
        for i in places:
            group[i] = g
    size = [len(x) for x in lists]
    # the order of groups is a linked list, as new ones come in between
    lower, upper = list(range(-1, len(lists) - 1)), list(range(1, len(lists) + 1))
    done = bytearray(n)  # its group is the current one or a greater one
    previous = [-1] * n
    order: list[int] = []
    current = len(lists) - 1
    while current >= 0:
        # a suffix that has been split off is still in the list of the group that it left
        own = [i for i in lists[current] if group[i] == current]
        own.sort()
        for i in own:
            done[i] = 1
        hits: dict[int, int] = {}
        for s in own:
            p = s - 1
            while p >= 0 and done[p]:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                hits[p] = hits.get(p, 0) + 1
        by_count: dict[int, list[int]] = {}
        for p, k in hits.items():
            by_count.setdefault(k, []).append(p)
        for k in sorted(by_count, reverse=True):
            leaving: dict[int, list[int]] = {}
            for p in by_count[k]:
                leaving.setdefault(group[p], []).append(p)
            for g, places in leaving.items():
                if len(places) == size[g]:
                    continue  # nothing would stay behind
                new, above = len(lists), upper[g]
                lists.append(places)
                size.append(len(places))
                size[g] -= len(places)
                for p in places:
                    group[p] = new
                lower.append(g)
                upper.append(above)
                lower[above] = upper[g] = new
        lists[current] = own
        order.append(current)
        current = lower[current]
    free, at = [0] * len(lists), 0
    for g in reversed(order):
        free[g] = at
        at += len(lists[g])
    out = [-1] * n
    place, stop = n - 1, -1  # the empty suffix comes first and follows the last one
    for i in range(n + 1):
        while place != stop:
            g = group[place]
            out[free[g]] = place
            free[g] += 1
            place = previous[place]
        if i < n:
            place, stop = out[i] - 1, previous[out[i]]
    return out


def common_prefixes(text: list[int], order: list[int]) -> list[int]:
    """For each suffix in order, the symbols that it shares with the one before it."""
    n = len(text)
    rank = [0] * n
    for r, i in enumerate(order):
        rank[i] = r
    out, h = [0] * n, 0
    for i in range(n):
        if r := rank[i]:
            j = order[r - 1]
            while i + h < n and j + h < n and text[i + h] == text[j + h]:
                h += 1
            out[r] = h
            h = h - 1 if h else 0
        else:
            h = 0
    return out
