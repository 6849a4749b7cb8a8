"""Suffix arrays by linear grouping (no recursion, no renaming), for small alphabets of integers inside tasks."""

from __future__ import annotations

from itertools import groupby


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of ``text`` in lexicographic order; a proper prefix comes first.

    Phase 1 sorts suffixes into groups by their Lyndon prefix, the longest Lyndon word they begin with. Groups are taken
    from the highest down. Each suffix of the group points to the nearest suffix before it in a lower group; what is
    pointed at has its Lyndon prefix extended by that of the group, once per pointer, so it moves into a new group
    just above its own, the higher the more pointers it has. Phase 2 reads the order off: the suffixes are walked in their
    final order, and from the one before each, along the pointers, every suffix takes the next place of its group.
    """
    n = len(text)
    members: list[set[int]] = []
    group = [0] * n
    below: list[int] = []  # the next lower group
    last = -1
    for _, same in groupby(sorted(range(n), key=text.__getitem__), key=text.__getitem__):
        own = list(same)
        for i in own:
            group[i] = len(members)
        below.append(last)
        last = len(members)
        members.append(set(own))
    highest = last
    above = [-1] * len(members)
    for g, b in enumerate(below):
        if b >= 0:
            above[b] = g
    done = [False] * len(members)
    pointer = [-1] * n
    at = highest
    while at >= 0:
        done[at] = True
        counts: dict[int, int] = {}
        for i in sorted(members[at]):
            j = i - 1
            while j >= 0 and done[group[j]]:
                j = pointer[j]
            pointer[i] = j
            if j >= 0:
                counts[j] = counts.get(j, 0) + 1
        # most pointers first, so that fewer end up lower
        for _, same in groupby(sorted(counts, key=lambda j: (-counts[j], group[j])), key=lambda j: (counts[j], group[j])):
            moved = list(same)
            old = group[moved[0]]
            if len(moved) == len(members[old]):
                continue  # all of a group: its place among the groups stays
            new = len(members)
            for j in moved:
                group[j] = new
            members[old].difference_update(moved)
            members.append(set(moved))
            done.append(False)
            up = above[old]
            above.append(up)
            below.append(old)
            above[old] = new
            if up >= 0:
                below[up] = new
        at = below[at]
    place = [0] * len(members)
    g, free = 0 if members else -1, 0
    while g >= 0 and below[g] >= 0:
        g = below[g]
    while g >= 0:
        place[g] = free
        free += len(members[g])
        g = above[g]
    out = [0] * n
    placed = [False] * n

    def walk(j: int) -> None:
        while j >= 0 and not placed[j]:
            placed[j] = True
            out[place[group[j]]] = j
            place[group[j]] += 1
            j = pointer[j]

    walk(n - 1)  # before the end of the text
    for i in range(n):
        walk(out[i] - 1)
    return out
