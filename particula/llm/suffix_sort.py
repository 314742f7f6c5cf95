"""Suffix array by linear grouping.

Suffixes are grouped by their longest Lyndon prefix. Groups are taken from the
highest down: every member points at the nearest suffix before it in a lower
group (its previous smaller one, found by following pointers that are known
already), and the suffixes pointed at leave their group for a new one just
above it, those with more pointers higher. When the lowest group is reached the
groups are final. The order inside the groups is then emitted from the smallest
suffix on: each sorted suffix places the suffixes whose Lyndon prefix ends
before it, along the same pointers. No names are given anew and nothing recurs.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np


def _first_groups(text: np.ndarray) -> tuple[list[int], list[int], list[int], list[int]]:
    """Groups by first symbol: suffixes in group order, their places, their group's start, and sizes by start."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    ranked = text[order]
    opens = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    starts = np.flatnonzero(opens)
    size = np.zeros(n, np.int64)
    size[starts] = np.diff(np.append(starts, n))
    group = np.empty(n, np.int64)
    group[order] = starts[np.cumsum(opens) - 1]
    return order.tolist(), place.tolist(), group.tolist(), size.tolist()


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffixes of ``text`` in order. The last symbol must be smaller than all others."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    order, place, group, size = _first_groups(text)
    before = [-1] * n
    end = n - 1
    while end >= 0:
        s = order[end]
        start = group[s]
        if start == end:
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = before[p]
            before[s] = p
            end -= 1
            if p < 0:
                continue
            g = group[p]
            held = size[g]
            if held > 1:  # else it is alone already, and stays where it is
                size[g] = held = held - 1
                last = g + held
                other, at = order[last], place[p]
                order[at], place[other] = other, at
                order[last], place[p] = p, last
                group[p] = last
                size[last] = 1
            continue
        pointers: dict[int, int] = {}
        pointed = 0
        for s in sorted(order[start : end + 1]):
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = before[p]
            before[s] = p
            if p >= 0:
                pointed += 1
                if p in pointers:
                    pointers[p] += 1
                else:
                    pointers[p] = 1
        if len(pointers) == pointed:  # one pointer each
            levels = [pointers]
        else:
            most_first = sorted(pointers, key=pointers.__getitem__, reverse=True)
            levels = [list(x) for _, x in groupby(most_first, key=pointers.__getitem__)]
        for level in levels:
            moving = [p for p in level if size[group[p]] > 1]
            for p in moving:
                g = group[p]
                size[g] -= 1
                last = g + size[g]
                other, at = order[last], place[p]
                order[at], place[other] = other, at
                order[last], place[p] = p, last
            for p in moving:
                group[p] += size[group[p]]
            for p in moving:
                size[group[p]] += 1
        end = start - 1
    # the order inside the groups; a group's start moves on as it fills
    out = [-1] * n
    fill = list(range(n))
    placed = bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[fill[g]] = s
            fill[g] += 1
            placed[s] = 1
            s = before[s]
    return np.array(out, np.int64)
