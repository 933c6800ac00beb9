"""Plain versions of the operators, over all rows on the driver; for small inputs only."""

from __future__ import annotations

import re
from collections import defaultdict

WORD = re.compile("[^\x20\x09-\x0D]+")


def lower(text: str | None) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def shingles(text: str | None, words: int) -> set[tuple[str, ...]]:
    each = WORD.findall(lower(text))
    return {tuple(each[i : i + words]) for i in range(max(1, len(each) - words + 1))} if each else set()


def near_components(rows: list[tuple[int, str | None]], words: int, percent: int) -> dict[int, int]:
    """Smallest id reachable over links between all pairs."""
    sets = {i: shingles(t, words) for i, t in rows}
    holders = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            holders[x].add(i)
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in sets.items():
        common = defaultdict(int)
        for x in s:
            for j in holders[x]:
                if j < i:
                    common[j] += 1
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}
