"""Suffix arrays by linear grouping.

Suffixes are grouped by their longest Lyndon prefix. Groups are processed in descending order: each suffix of a group
points to the previous suffix in a smaller group, whose prefix then grows by the group's own, so it moves to a larger
subgroup. When all groups are done, one ascending pass emits the order inside every group: suffixes with equal Lyndon
prefixes are ordered as the suffixes that follow these prefixes. No recursion and no renaming.
"""

from __future__ import annotations


def lyndon_groups(symbols: list[int]) -> tuple[list[list[int]], list[int]]:
    """Groups of suffixes in ascending order, and the length of each suffix's longest Lyndon prefix."""
    n = len(symbols)
    by_symbol: dict[int, list[int]] = {}
    for i, s in enumerate(symbols):
        by_symbol.setdefault(s, []).append(i)
    members = [by_symbol[s] for s in sorted(by_symbol)]
    group = [0] * n
    for g, own in enumerate(members):
        for i in own:
            group[i] = g
    # The groups as a list in order, linked both ways.
    below = list(range(-1, len(members) - 1))
    above = list(range(1, len(members) + 1))
    top = len(members) - 1
    length = [1] * n
    smaller = [-1] * n  # the previous suffix in a smaller group, known once a suffix's own group is processed
    done = bytearray(n)
    descending = []
    while top >= 0:
        own = sorted(i for i in members[top] if group[i] == top)
        members[top] = own
        if own:
            descending.append(own)
            times: dict[int, int] = {}
            for s in own:
                p = s - 1
                while p >= 0 and done[p]:
                    p = smaller[p]
                smaller[s] = p
                done[s] = 1
                if p >= 0:
                    times[p] = times.get(p, 0) + 1
            size = length[own[0]]
            by_times: dict[int, list[int]] = {}
            for p, k in times.items():
                by_times.setdefault(k, []).append(p)
            # More copies of the prefix make a suffix larger: these leave first, later ones come between them and the rest.
            for k in sorted(by_times, reverse=True):
                fresh: dict[int, int] = {}
                for p in by_times[k]:
                    old = group[p]
                    new = fresh.get(old)
                    if new is None:
                        new = fresh[old] = len(members)
                        members.append([])
                        upper = above[old]
                        below.append(old)
                        above.append(upper)
                        below[upper] = above[old] = new
                    members[new].append(p)
                    group[p] = new
                    length[p] += k * size
        top = below[top]
    descending.reverse()
    return descending, length


def suffix_array(symbols: list[int]) -> list[int]:
    """Start positions of all suffixes in ascending order; a suffix that is a prefix of another comes first."""
    n = len(symbols)
    groups, length = lyndon_groups(symbols)
    slot = [0] * n
    group = [0] * n
    at = 0
    for g, own in enumerate(groups):
        slot[g] = at
        at += len(own)
        for i in own:
            group[i] = g
    # Suffixes by the suffix that follows their Lyndon prefix.
    waiting: list[list[int] | None] = [None] * (n + 1)
    for i in range(n):
        follows = i + length[i]
        if waiting[follows] is None:
            waiting[follows] = [i]
        else:
            waiting[follows].append(i)
    order = [0] * n
    for k in range(-1, n):
        found = waiting[n if k < 0 else order[k]]
        if found:
            for i in found:
                g = group[i]
                order[slot[g]] = i
                slot[g] += 1
    return order


def common_prefixes(symbols: list[int], order: list[int]) -> list[int]:
    """For each place of the order, the symbols that its suffix shares with the one before it."""
    n = len(symbols)
    rank = [0] * n
    for k, i in enumerate(order):
        rank[i] = k
    shared = [0] * n
    h = 0
    for i in range(n):
        k = rank[i]
        if k == 0:
            h = 0
            continue
        j = order[k - 1]
        while i + h < n and j + h < n and symbols[i + h] == symbols[j + h]:
            h += 1
        shared[k] = h
        if h:
            h -= 1
    return shared
