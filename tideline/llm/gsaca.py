"""Suffix arrays by linear grouping, without recursion or renaming."""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """The suffix array of ``text``, whose last symbol must be smaller than all others.

    First, suffixes are grouped by their Lyndon prefix. Groups are taken from the highest down; each suffix of a group
    finds its previous smaller suffix by following the pointers of the suffixes already done. A suffix that is
    pointed at gets the group's prefix appended to its own, once for each pointer, so it moves to a new
    group right above its old one, higher for more pointers. Then the suffixes are put in order: taken in their final
    order, each one's left neighbour and the chain of previous smaller suffixes from there take the next free
    places of their groups. Both passes touch every suffix a bounded number of times.
    """
    n = len(text)
    members: list[list[int]] = []
    by_symbol: dict[int, list[int]] = {}
    for i, symbol in enumerate(text):
        by_symbol.setdefault(symbol, []).append(i)
    group = [0] * n
    for number, symbol in enumerate(sorted(by_symbol)):
        own = by_symbol[symbol]
        members.append(own)
        for i in own:
            group[i] = number
    below = list(range(-1, len(members) - 1))
    above = list(range(1, len(members) + 1))
    above[-1] = -1
    done = bytearray(n)
    smaller = [-1] * n
    falling: list[list[int]] = []
    at = len(members) - 1
    while at >= 0:
        own = [i for i in members[at] if group[i] == at]
        if own:
            for i in own:
                done[i] = 1
            own.sort()
            falling.append(own)
            pointed: dict[int, int] = {}
            for i in own:
                j = i - 1
                while j >= 0 and done[j]:
                    j = smaller[j]
                smaller[i] = j
                if j >= 0:
                    pointed[j] = pointed.get(j, 0) + 1
            moves: dict[tuple[int, int], list[int]] = {}
            for j, times in pointed.items():
                key = (times, group[j])
                if key in moves:
                    moves[key].append(j)
                else:
                    moves[key] = [j]
            for (_, old), moved in sorted(moves.items(), key=lambda m: -m[0][0]) if len(moves) > 1 else moves.items():
                new = len(members)
                members.append(moved)
                high = above[old]
                above.append(high)
                below.append(old)
                above[old] = new
                if high >= 0:
                    below[high] = new
                for j in moved:
                    group[j] = new
        at = below[at]
    free, place = [0] * len(members), 0
    for own in reversed(falling):
        free[group[own[0]]] = place
        place += len(own)
    order = [0] * n
    order[0] = n - 1
    free[group[n - 1]] = 1
    done = bytearray(n)
    done[n - 1] = 1
    for i in range(n):
        j = order[i] - 1
        while j >= 0 and not done[j]:
            own = group[j]
            spot = free[own]
            order[spot] = j
            free[own] = spot + 1
            done[j] = 1
            j = smaller[j]
    return order
