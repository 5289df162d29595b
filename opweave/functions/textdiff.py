"""The shortest edit script between two sequences (Myers 1986, greedy)."""

from __future__ import annotations

from collections.abc import Sequence

import regex


def graphemes(text: str) -> list[str]:
    return regex.findall(r"\X", text)


def edits(a: Sequence, b: Sequence) -> list[tuple[int, int, Sequence]]:
    """Splices (position in ``a``, how many to delete, what to insert) that make ``b`` of ``a``, from the end to the start."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    pairs = _common(x, y)
    out = []
    i = j = 0
    for p, q in [*pairs, (len(x), len(y))]:
        if p > i or q > j:
            out.append((lo + i, p - i, y[j:q]))
        i, j = p + 1, q + 1
    return out[::-1]


def _common(x: Sequence, y: Sequence) -> list[tuple[int, int]]:
    """Matching positions along a furthest-reaching path."""
    n, m = len(x), len(y)
    reach = {1: 0}
    trail = []
    for d in range(n + m + 1):
        trail.append(dict(reach))
        for k in range(-d, d + 1, 2):
            i = reach[k + 1] if k == -d or (k != d and reach[k - 1] < reach[k + 1]) else reach[k - 1] + 1
            while i < n and i - k < m and x[i] == y[i - k]:
                i += 1
            reach[k] = i
            if i >= n and i - k >= m:
                return _walk_back(trail, n, m)
    return []


def _walk_back(trail: list[dict[int, int]], i: int, j: int) -> list[tuple[int, int]]:
    out = []
    for d in range(len(trail) - 1, -1, -1):
        reach, k = trail[d], i - j
        before = k + 1 if k == -d or (k != d and reach[k - 1] < reach[k + 1]) else k - 1
        pi = reach[before]
        pj = pi - before
        while i > pi and j > pj and i > 0 and j > 0:
            i, j = i - 1, j - 1
            out.append((i, j))
        if d:
            i, j = pi, pj
    return out[::-1]
