"""Suffix arrays by linear grouping.

Suffixes start in groups by first letter. Groups are processed from the highest to the
lowest. For each member of a group, the previous-smaller pointer leads to the nearest
earlier suffix in a lower group; those suffixes are extended by the group's Lyndon prefix,
once for every member that points to them, and so move to new groups right after their
old ones, fewer extensions first. When all groups are done, every suffix stands in the group
of its longest Lyndon prefix, and groups are in order. One pass over the growing suffix
array then emits each group's members: a sorted suffix releases the suffix before it, and
along the previous-smaller pointers all those that it was waiting for. There is
no renaming and no recursion, and the work is linear (U. Baier, 2016).
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """The suffix array of a sequence of small non-negative integers.

    A suffix that is a prefix of another one comes before it.
    """
    n = len(text) + 1
    if n == 1:
        return []
    # Letter 0 is the end mark, below all others.
    letters = [c + 1 for c in text] + [0]
    counts = [0] * (max(letters) + 2)
    for c in letters:
        counts[c + 1] += 1
    for c in range(1, len(counts)):
        counts[c] += counts[c - 1]
    # A group is a range of ``order``; its first place names it.
    fill = counts[:]
    order, place, first = [0] * n, [0] * n, [0] * n
    for i, c in enumerate(letters):
        order[fill[c]] = i
        place[i] = fill[c]
        fill[c] += 1
        first[i] = counts[c]
    size = [0] * n
    for c in range(len(counts) - 1):
        if counts[c + 1] > counts[c]:
            size[counts[c]] = counts[c + 1] - counts[c]
    prev = [-1] * n
    end = n
    while end > 0:
        start = first[order[end - 1]]
        members = order[start:end]
        end = start
        if len(members) == 1:  # by far the most common case
            i = members[0]
            p = i - 1
            while p >= 0 and first[p] >= start:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                group = first[p]
                left = size[group] - 1
                if left:
                    last = group + left
                    if (at := place[p]) != last:
                        other = order[last]
                        order[at], place[other] = other, at
                        order[last], place[p] = p, last
                    size[group], size[last], first[p] = left, 1, last
            continue
        pointed: dict[int, int] = {}
        # In text order, so that members met on the way have their pointers already.
        members.sort()
        for i in members:
            p = i - 1
            while p >= 0 and first[p] >= start:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if not pointed:
            continue
        levels: dict[int, list[int]] = {}
        for p, k in pointed.items():
            levels.setdefault(k, []).append(p)
        for k in sorted(levels, reverse=True):
            moved: dict[int, int] = {}
            for p in levels[k]:
                group = first[p]
                done = moved.get(group, 0)
                last = group + size[group] - 1 - done
                if (at := place[p]) != last:
                    other = order[last]
                    order[at], place[other] = other, at
                    order[last], place[p] = p, last
                moved[group] = done + 1
            for group, count in moved.items():
                left = size[group] - count
                if left:
                    new = group + left
                    size[group], size[new] = left, count
                    for at in range(new, new + count):
                        first[order[at]] = new
    # Emission: ``fill`` is each group's next free place.
    out, nxt, placed = [-1] * n, list(range(n)), bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for at in range(n):
        i = out[at] - 1
        while i >= 0 and not placed[i]:
            group = first[i]
            out[nxt[group]] = i
            nxt[group] += 1
            placed[i] = 1
            i = prev[i]
    return out[1:]


def common_prefixes(text: Sequence[int], order: Sequence[int]) -> list[int]:
    """For each place of the suffix array, the common prefix with the suffix before it (Kasai and others, 2001)."""
    n = len(order)
    rank = [0] * n
    for at, i in enumerate(order):
        rank[i] = at
    out, h = [0] * n, 0
    for i in range(n):
        if not rank[i]:
            h = 0
            continue
        j = order[rank[i] - 1]
        top = n - max(i, j)
        while h < top and text[i + h] == text[j + h]:
            h += 1
        out[rank[i]] = h
        if h:
            h -= 1
    return out
