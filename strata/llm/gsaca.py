"""Suffix arrays by linear grouping construction.

Suffixes are grouped by their longest Lyndon prefix. Groups are taken in descending order; each member finds its previous smaller
suffix, the nearest suffix before it of a lower group, over pointers of suffixes that are done; as often as a group's members point to
the same suffix, that suffix's prefix grows by the group's, and it moves to a new group just above its old one. Afterwards the groups,
from the lowest, give the order: each placed suffix places its left neighbour and that one's chain of previous smaller suffixes, at the front
of their groups. Nothing is renamed recursively.
"""

from __future__ import annotations


def suffix_array(symbols: list[int]) -> list[int]:
    """The suffix array of a sequence of integers, any alphabet; ties end with the shorter suffix first."""
    n = len(symbols) + 1
    if n == 1:
        return []
    group = [0] * n  # of each suffix; the last is the empty one, alone in the lowest group
    members: list[list[int]] = [[n - 1]]
    above: list[int] = []  # linked list of the groups in ascending order
    below: list[int] = [-1]
    of_symbol: dict[int, int] = {}
    for s in sorted(set(symbols)):
        of_symbol[s] = len(members)
        below.append(len(members) - 1)
        members.append([])
    for i, s in enumerate(symbols):
        g = of_symbol[s]
        group[i] = g
        members[g].append(i)
    above = [*range(1, len(members)), -1]
    previous = [-1] * n
    done = bytearray(n)
    front: list[int] = [0] * len(members)
    size = [len(m) for m in members]  # of each group, without those that moved on
    end, g = n, len(members) - 1
    while g >= 0:
        own = members[g]
        if size[g] < len(own):
            own = [s for s in own if group[s] == g]
        members[g] = []
        if len(own) == 1:
            s = own[0]
            end -= 1
            front[g] = end
            p = s - 1
            while p >= 0 and done[p]:
                p = previous[p]
            previous[s] = p
            done[s] = 1
            if p >= 0 and size[group[p]] > 1:  # one that is alone in its group stays there
                grown = ((p, 1),)
            else:
                g = below[g]
                continue
        else:
            own.sort()
            end -= len(own)
            front[g] = end
            count: dict[int, int] = {}
            for s in own:
                p = s - 1
                while p >= 0 and done[p]:
                    p = previous[p]
                if p >= 0 and group[p] == g:
                    p = previous[p]
                previous[s] = p
                if p >= 0:
                    count[p] = count.get(p, 0) + 1
            for s in own:
                done[s] = 1
            grown = count.items() if len(count) == 1 else sorted(count.items(), key=lambda x: -x[1])
        made: dict[tuple[int, int], int] = {}
        for p, k in grown:  # the larger count first: each new group goes right above the old one, below those made before it
            old = group[p]
            new = made.get((old, k))
            if new is None:
                if size[old] == 1:
                    continue
                new = made[(old, k)] = len(members)
                members.append([])
                front.append(0)
                size.append(0)
                up = above[old]
                above.append(up)
                below.append(old)
                above[old] = new
                below[up] = new  # groups that grow lie below g, so there is one above
            group[p] = new
            size[old] -= 1
            size[new] += 1
            members[new].append(p)
        g = below[g]
    order_of: list[int] = [-1] * n
    order_of[0] = n - 1
    placed = bytearray(n)
    placed[n - 1] = 1
    for i in range(n):
        j = order_of[i] - 1
        while j >= 0 and not placed[j]:
            h = group[j]
            order_of[front[h]] = j
            front[h] += 1
            placed[j] = 1
            j = previous[j]
    return order_of[1:]


def common_prefixes(symbols: list[int], order: list[int], most: int) -> list[int]:
    """For each place of the suffix array the length, at most ``most``, that its suffix shares with the one before it."""
    n = len(symbols)
    rank = [0] * n
    for r, s in enumerate(order):
        rank[s] = r
    out, h = [0] * n, 0
    for s in range(n):
        r = rank[s]
        if not r:
            h = 0
            continue
        t = order[r - 1]
        room = n - (s if s > t else t)
        if room > most:
            room = most
        if h > room:
            h = room
        while h < room and symbols[s + h] == symbols[t + h]:
            h += 1
        out[r] = h
        if h:
            h -= 1
    return out
