"""Alignment of two lists of names: a longest common subsequence in O(ND) time and linear space, or a windowed resynchronisation.

E. W. Myers' furthest-reaching paths, run backwards from the ends of both lists: reach[k] is the least place of the left list from which
diagonal k gets to the end with so many elements left unpaired. A walk from the start then knows at every mismatch which element to leave
out: the left one whenever that loses nothing. The walk needs the levels from last to first; they are made again from halves of the way
(a copy of `reach` a halving), so that memory stays linear in the lists.
"""

from __future__ import annotations

import numpy as np

RESYNC = 64
_KEPT = 32  # levels kept at once


def _run(a: np.ndarray, b: np.ndarray) -> int:
    """How many first elements of two lists are equal."""
    at, step, n = 0, 64, min(len(a), len(b))
    while at < n:
        differ = np.flatnonzero(a[at : min(n, at + step)] != b[at : min(n, at + step)])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, step * 2
    return n


class _Levels:
    """reach[k + shift] for the diagonals k = i - j of lists a and b; a level touches every second diagonal."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b, self.shift = a, b, len(b) + 1
        self.never = len(a) + len(b) + 2
        start = np.full(len(a) + len(b) + 3, self.never, np.int64)
        last = len(a) - len(b)
        start[last + self.shift] = self.extended(np.array([last]), np.array([len(a)]))[0]
        self.start = start

    def extended(self, k: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Each place moved towards the start over equal elements of its diagonal."""
        a, b, live = self.a, self.b, np.arange(len(x))
        for _ in range(8):
            live = live[(x[live] > 0) & (x[live] > k[live])]
            live = live[a[x[live] - 1] == b[x[live] - k[live] - 1]]
            if not len(live):
                return x
            x[live] -= 1
        for t in live.tolist():
            x[t] -= _run(a[: x[t]][::-1], b[: x[t] - k[t]][::-1])
        return x

    def forward(self, reach: np.ndarray, level: int) -> np.ndarray:
        """`reach` of the level before becomes that of this one, in place; gives the diagonals it touches."""
        n, m = len(self.a), len(self.b)
        first, last = max(-m, n - m - level), min(n, n - m + level)
        k = np.arange(first + (first - (n - m - level)) % 2, last + 1, 2)
        at = k + self.shift
        x = np.maximum(np.minimum(reach[at + 1] - 1, reach[at - 1]), np.maximum(0, k))
        reach[at] = self.extended(k, x)
        return k

    def distance(self) -> int:
        """How many elements of both lists stay unpaired."""
        reach, level = self.start.copy(), 0
        while reach[self.shift] > 0:
            level += 1
            self.forward(reach, level)
        return level

    def walk(self, reach: np.ndarray, low: int, high: int, i: int, j: int, out: list[tuple[int, int, int]]) -> tuple[int, int]:
        """From (i, j), `high` unpaired elements from the end, to a place `low` from it; (kind, i, length) of the pieces go to `out`."""
        if high - low > _KEPT:
            half = (low + high) // 2
            later = reach.copy()
            for level in range(low + 1, half + 1):
                self.forward(later, level)
            i, j = self.walk(later, half, high, i, j, out)
            return self.walk(reach, low, half, i, j, out)
        kept, now = [reach], reach
        for level in range(low + 1, high):
            now = now.copy()
            self.forward(now, level)
            kept.append(now)
        for level in range(high, low, -1):
            if run := _run(self.a[i:], self.b[j:]):
                out.append((0, i, run))
                i, j = i + run, j + run
            if i < len(self.a) and i + 1 >= kept[level - 1 - low][i + 1 - j + self.shift]:
                out.append((1, i, 1))
                i += 1
            else:
                out.append((2, j, 1))
                j += 1
        return i, j


def common_subsequence(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the alignment: places of a and of b, -1 for none. Equal elements pair at once; at a mismatch the left one is left out if that costs no pair."""
    same = _run(a, b)
    levels = _Levels(a[same:], b[same:])
    out: list[tuple[int, int, int]] = [(0, -same, same)] if same else []
    i, j = levels.walk(levels.start.copy(), 0, levels.distance(), 0, 0, out)
    if run := _run(levels.a[i:], levels.b[j:]):
        out.append((0, i, run))
    left, right, x, y = [], [], 0, 0
    for kind, _, run in out:
        left.append(np.full(run, -1) if kind == 2 else np.arange(x, x + run))
        right.append(np.full(run, -1) if kind == 1 else np.arange(y, y + run))
        x, y = x + run * (kind != 2), y + run * (kind != 1)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def resynchronised(a: np.ndarray, b: np.ndarray, window: int = RESYNC) -> tuple[np.ndarray, np.ndarray]:
    """A forward scan: at a mismatch the side that finds the other's element after fewer skips moves on to it, the left one of ties; if neither
    does within the window, one element of each side stays unpaired."""
    left, right, i, j = [], [], 0, 0

    def add(x: int, y: int, run: int) -> None:
        nonlocal i, j
        left.append(np.arange(i, i + run) if x else np.full(run, -1))
        right.append(np.arange(j, j + run) if y else np.full(run, -1))
        i, j = i + run * x, j + run * y

    while i < len(a) and j < len(b):
        if run := _run(a[i:], b[j:]):
            add(1, 1, run)
            continue
        in_a, in_b = (np.flatnonzero(rest == other) for rest, other in ((a[i + 1 : i + 1 + window], b[j]), (b[j + 1 : j + 1 + window], a[i])))
        if not len(in_a) and not len(in_b):
            add(1, 0, 1)
            add(0, 1, 1)
        elif not len(in_b) or (len(in_a) and in_a[0] <= in_b[0]):
            add(1, 0, int(in_a[0]) + 1)
        else:
            add(0, 1, int(in_b[0]) + 1)
    add(1, 0, len(a) - i)
    add(0, 1, len(b) - j)
    return np.concatenate(left), np.concatenate(right)
