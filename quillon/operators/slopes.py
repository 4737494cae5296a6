"""Pairs of tracks whose slopes are alike over the time they share, found by windows on sorted values instead of among all pairs.

A track is a parabola: from a to b (microseconds), with slope s (an hour) at its middle m and curvature c, which has few values.  Two tracks' score is the rms of their
slopes' difference over the common time plus the length of that time times the difference of 2 c.  It is at least the difference in the middle of the common time
plus the second part.  So tracks of one c are near only if slopes brought to time 0 are; tracks of two, only if besides the common time is short: one ends soon
after the other begins, or one is short and lies within the other, whose slope at its middle is near its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

HOUR = 3.6e9


def spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of every place from lo to before hi of each row."""
    n = np.maximum(hi - lo, 0)
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(len(i)) + np.repeat(lo - np.cumsum(n) + n, n)


class Near:
    """Tracks (a, b, s, c, m as arrays) to be searched for those near to others.  shifts: hours by which a track searched for may be moved in time before its
    slopes are compared."""

    def __init__(self, y: dict[str, np.ndarray], shifts: tuple[float, ...] = (0.0,)) -> None:
        self.y, self.shifts = y, shifts
        self.base = y["a"].min() if len(y["a"]) else 0
        self.kinds = np.unique(y["c"])
        self.own = {c: np.flatnonzero(y["c"] == c) for c in self.kinds}
        self.by_time = {}
        for name in ("a", "b"):
            order = y[name].argsort(kind="stable")
            self.by_time[name] = order, y[name][order]
        self.by_slope: dict[tuple[float, float], tuple[np.ndarray, np.ndarray]] = {}

    def _sorted(self, by: float, kind: float) -> tuple[np.ndarray, np.ndarray]:
        """Tracks of a curvature in the order of slopes brought to time 0 by another, and these slopes."""
        if (by, kind) not in self.by_slope:
            own = self.own[kind]
            at = self.y["s"][own] - 2 * by * (self.y["m"][own] - self.base) / HOUR
            order = at.argsort(kind="stable")
            self.by_slope[by, kind] = own[order], at[order]
        return self.by_slope[by, kind]

    def _around(self, by: float, kind: float, centre: np.ndarray, reach: np.ndarray) -> list[tuple]:
        """Windows of reach about centre less each shift's part, none twice; negative reach: none."""
        order, at = self._sorted(by, kind)
        found, last = [], np.zeros(len(centre), np.int64)
        for step in np.unique([-2 * kind * s for s in self.shifts]):
            lo = np.maximum(np.searchsorted(at, centre + step - reach, "left"), last)
            last = np.maximum(np.where(reach >= 0, np.searchsorted(at, centre + step + reach, "right"), 0), last)
            found.append((order, lo, np.where(reach >= 0, last, lo)))
        return found

    def windows(self, x: dict[str, np.ndarray], most: np.ndarray) -> list[tuple]:
        """(case, order, lo, hi): for each of x, all of one curvature, where those lie that can have a score of at most ``most``, each in one window only."""
        c = x["c"][0]
        start, middle, end = ((x[n] - self.base) / HOUR for n in ("a", "m", "b"))
        reach, level = most * (1 + 1e-9) + 1e-6 + 1e-11 * np.abs(x["s"]), x["s"] - 2 * c * middle
        others = [k for k in self.kinds if k != c]
        found = [(0, *w) for w in self._around(c, c, level, reach)] if c in self.own else []
        if others:
            # common time up to which curvature alone isn't too much
            common = np.ceil(np.minimum(reach / min(2 * abs(c - k) for k in others), 1e4) * HOUR).astype(np.int64) + 2
            order, at = self.by_time["a"]
            found.append((1, order, np.searchsorted(at, np.maximum(x["a"] + 1, x["b"] - common), "left"), np.searchsorted(at, x["b"], "left")))
            order, at = self.by_time["b"]
            found.append((2, order, np.searchsorted(at, x["a"], "right"), np.searchsorted(at, np.minimum(x["b"] - 1, x["a"] + common), "right")))
        for k in others:
            found += [(3, *w) for w in self._around(k, k, x["s"] - 2 * k * middle, reach - 2 * abs(c - k) * (end - start))]
            found += [(4, *w) for w in self._around(c, k, level, reach)]
        return found

    def bound(self, x: dict[str, np.ndarray], k: int, apart: str, at_once: int = 1 << 20) -> np.ndarray:
        """What the k-th least score of each of x is at most, by the nearest slopes among tracks of its own curvature that have time in common and differ in the
        column apart; infinite where there aren't so many."""
        most = np.full(len(x["c"]), np.inf)
        for c in set(np.unique(x["c"])) & set(self.own):
            order, at = self._sorted(c, c)
            y, rows = {n: self.y[n][order] for n in ("a", "b", apart)}, np.flatnonzero(x["c"] == c)
            level = x["s"] - 2 * c * (x["m"] - self.base) / HOUR
            width = 8
            while len(rows):
                left = []
                for start in range(0, len(rows), max(1, at_once // (2 * width))):
                    own = rows[start : start + max(1, at_once // (2 * width))]
                    place = np.searchsorted(at, level[own])[:, None] + np.arange(-width, width)
                    there = (place >= 0) & (place < len(at))
                    place = np.where(there, place, 0)
                    there &= (x["a"][own, None] < y["b"][place]) & (y["a"][place] < x["b"][own, None]) & (x[apart][own, None] != y[apart][place])
                    most[own] = np.partition(np.where(there, np.abs(level[own, None] - at[place]), np.inf), k - 1, axis=1)[:, k - 1]
                    left.append(own[np.isinf(most[own])])
                rows = np.concatenate(left) if width < len(at) else rows[:0]
                width = min(8 * width, len(at))
        return most

    def pairs(self, x: dict[str, np.ndarray], windows: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of x and of the searched tracks that the windows hold and that have time in common, each pair once."""
        y = self.y
        for case, order, lo, hi in windows:
            i, place = spread(lo, hi)
            j = order[place]
            later, ends = y["a"][j] > x["a"][i], x["b"][i] <= y["b"][j]
            if case == 0:
                there = (x["a"][i] < y["b"][j]) & (y["a"][j] < x["b"][i])
            elif case == 1:
                there = later & ends & (x["c"][i] != y["c"][j])
            elif case == 2:
                there = ~later & ~ends & (x["c"][i] != y["c"][j])
            else:
                there = ~later & ends if case == 3 else later & ~ends
            yield i[there], j[there]


def alike(x: dict[str, np.ndarray], rows: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, dict[str, np.ndarray]]]:
    """Rows of each curvature and their columns."""
    rows = np.arange(len(x["c"])) if rows is None else rows
    for c in np.unique(x["c"][rows]):
        own = rows[x["c"][rows] == c]
        yield own, {n: v[own] for n, v in x.items()}


def places(windows: list[tuple]) -> np.ndarray:
    """How many places the windows of each row hold."""
    return sum(np.maximum(hi - lo, 0) for _, _, lo, hi in windows)


def stretches(windows: list[tuple], at_once: int) -> Iterator[tuple[slice, list[tuple]]]:
    """Slices of rows whose windows hold about so many places together, and these windows."""
    ends = np.cumsum(places(windows))
    start, n = 0, len(ends)
    while start < n:
        before = ends[start - 1] if start else 0
        part = slice(start, max(start + 1, int(np.searchsorted(ends, before + at_once, "right"))))
        yield part, [(case, order, lo[part], hi[part]) for case, order, lo, hi in windows]
        start = part.stop


def taken(cost, one: dict[str, np.ndarray], other: dict[str, np.ndarray], most: float, unit: float, at_once: int = 1 << 20) -> tuple[np.ndarray, ...]:
    """Greedy one-to-one matching by (cost, row, column) of pairs whose cost is at most ``most``: rows, columns and costs.

    ``cost`` is a function of both sides' columns that gives each pair's cost: its score to the nearest multiple of unit, infinite where there is none.  Pairs are listed
    up to a cost that goes up in steps, so that few are listed at once: whom a step takes isn't searched for any more.
    """
    rows, columns, found = np.arange(len(one["c"])), np.arange(len(other["c"])), []
    done, upto, last = -1, 64, round(most / unit)  # in units

    def listed(x, near, own, upto, limit):
        """Pairs of some rows of x up to a cost, in order; none if these are more than a limit."""
        held, n = [], 0
        for kind, z in alike(x, own):
            for part, windows in stretches(near.windows(z, np.full(len(kind), (upto + 0.6) * unit)), at_once):
                for i, j in near.pairs({c: v[part] for c, v in z.items()}, windows):
                    i = kind[part][i]
                    value = cost({c: v[i] for c, v in x.items()}, {c: v[j] for c, v in near.y.items()})
                    there = value <= (upto + 0.25) * unit
                    held.append((i[there], j[there], value[there]))
                    n += len(held[-1][0])
                    if n > limit:
                        return None
        i, j, value = (np.concatenate(v) for v in zip(*held, strict=True))
        order = np.lexsort((j, i, value))
        return i[order], j[order], value[order]

    while len(rows) and len(columns) and done < last:
        x, near = {c: v[rows] for c, v in one.items()}, Near({c: v[columns] for c, v in other.items()})
        count = lambda upto: sum(int(places(near.windows(z, np.full(len(own), (upto + 0.6) * unit))).sum()) for own, z in alike(x))  # noqa: B023, E731
        step = max(1, done)
        upto = last if len(rows) * len(columns) <= at_once else min(upto, last)
        while upto > done + step and count(upto) > max(at_once, 64 * len(rows)):
            upto = done + max(step, (upto - done) // 4)
        pairs = None
        while upto > done + 1 and (pairs := listed(x, near, np.arange(len(rows)), upto, 8 * at_once)) is None:
            upto = done + max(1, (upto - done) // 4)
        # of pairs of one cost the rows can be read in order, some at once; of more, all together
        free_rows, free_columns = np.ones(len(rows), bool), np.ones(len(columns), bool)
        for own in [None] if pairs else np.array_split(np.arange(len(rows)), 1 + count(upto) // at_once):
            i, j, value = pairs or listed(x, near, own, upto, np.inf)
            k = _first(i, j, free_rows, free_columns)
            free_rows[i[k]] = free_columns[j[k]] = False
            found.append((rows[i[k]], columns[j[k]], value[k]))
        rows, columns = rows[free_rows], columns[free_columns]
        done, upto = upto, 4 * upto + 1
    return tuple(np.concatenate([f[n] for f in found]) if found else np.zeros(0, np.int64) for n in range(3))


def _first(i: np.ndarray, j: np.ndarray, free_rows: np.ndarray, free_columns: np.ndarray) -> list[int]:
    """Places of the pairs that are taken, in order, each row and column once."""
    left, right, out = bytearray(free_rows.tobytes()), bytearray(free_columns.tobytes()), []
    for n, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        if left[a] and right[b]:
            left[a] = right[b] = 0
            out.append(n)
    return out
