"""Chains of points: tracks detected before they are thresholded, least-cost path covers with hints refitted, and the order along successor links.

Tracks and covers are dealt by path, and a task works on the arrays of whole paths; nothing is cut at midnight or at any other fixed time.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import grouped
from quillon.operators.intervals import near_pairs
from quillon.sources.shared import kept

# --- order along links -------------------------------------------------------------------------------------------


def linked_order(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, head and place (from 0) of nodes (node) on the chains that links (a, b: b follows a) make.

    Each node looks ahead to the one before it, then to the one before that one's, and so on: spans double, so a chain takes rounds as the
    logarithm of its length.  A node with two successors or two predecessors, and a cycle, are errors.  Rounds are kept in the checkpoint folder.
    """
    links = kept(links.select("a", "b").distinct())
    twice = links.groupBy("a").count().where("count > 1").select("a").union(links.groupBy("b").count().where("count > 1").select("b")).head(1)
    if twice:
        raise ValueError(f"node {twice[0][0]} has two links of one kind")
    state = nodes.select("node").distinct().join(links.select(F.col("b").alias("node"), F.col("a").alias("before")), "node", "left")
    state = kept(state.select("node", F.coalesce("before", "node").alias("head"), F.col("before").isNotNull().cast("long").alias("place"), F.col("before").isNull().alias("done")))
    most = state.count()
    span = 1
    while not state.where("not done").isEmpty():
        if span > 2 * most:
            raise ValueError(f"links make a cycle, which holds node {state.where('not done').first()['node']}")
        ahead = state.select(F.col("node").alias("head"), F.col("head").alias("_h"), F.col("place").alias("_p"), F.col("done").alias("_d"))
        # what has reached its head doesn't travel again
        moved = state.where("not done").join(ahead, "head").select("node", F.col("_h").alias("head"), (F.col("place") + F.col("_p")).alias("place"), F.col("_d").alias("done"))
        state = kept(state.where("done").union(moved))
        span *= 2
    return state.select("node", "head", "place")


# --- track before detect -----------------------------------------------------------------------------------------


def _best_chains(t: np.ndarray, ident: np.ndarray, f: np.ndarray, w: np.ndarray, slopes: np.ndarray, gap: float, gate: float, period: float, point: float, bend: float, wait: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score, length and the place before (or -1) of each point's best chain that ends in it, for each slope; ties to the longer chain, then the smaller id."""
    first, last = np.searchsorted(t, t - gap, "left"), np.searchsorted(t, t, "left")
    score, length, before = np.empty((len(t), len(slopes))), np.ones((len(t), len(slopes)), np.int64), np.full((len(t), len(slopes)), -1)
    every = np.arange(len(slopes))
    for start in range(0, len(t), 256):
        stop = min(start + 256, len(t))
        many = (last - first)[start:stop]
        j = np.repeat(np.arange(start, stop), many)
        begin = np.cumsum(many) - many
        i = np.arange(len(j)) - np.repeat(begin, many) + first[j]
        dt = t[j] - t[i]
        off = np.abs(np.mod((f[j] - f[i])[:, None] - slopes * dt[:, None] + period / 2, period) - period / 2)
        cost = np.where((off <= gate) & (dt <= gap)[:, None], bend * (off / gate) ** 2, np.inf)
        rest = (wait * dt)[:, None]
        for k in range(start, stop):
            alone = w[k] - point
            score[k] = alone
            n, b, lo = many[k - start], begin[k - start], first[k]
            if not n:
                continue
            found = score[lo : lo + n] + w[k] - point - cost[b : b + n] - rest[b : b + n]
            at = found.argmax(axis=0)
            top = found[at, every]
            if (tied := (found == top).sum(axis=0) > 1).any():
                for s in np.flatnonzero(tied & (top > -np.inf)):
                    equal = np.flatnonzero(found[:, s] == top[s])
                    at[s] = equal[np.lexsort((ident[lo + equal], -length[lo + equal, s]))[0]]
            better = top >= alone
            score[k][better], length[k][better], before[k][better] = top[better], length[lo + at, every][better] + 1, lo + at[better]
    return score, length, before


def _best_track(t: np.ndarray, ident: np.ndarray, f: np.ndarray, w: np.ndarray, slopes: np.ndarray, gap: float, gate: float, period: float, point: float, bend: float, wait: float, support: int, span: float):
    """Places of the best track's points, its slope, intercept, rms, first time and span; None without one."""
    score, length, before = _best_chains(t, ident, f, w, slopes, gap, gate, period, point, bend, wait)
    best = None
    for s in range(len(slopes)):
        top = np.flatnonzero(score[:, s] == score[:, s].max())
        k = int(top[np.lexsort((ident[top], -length[top, s]))[0]])
        total, chain = float(score[k, s]), []
        while k >= 0:
            chain.append(k)
            k = int(before[k, s])
        own = np.array(chain[::-1])
        dt = t[own] - t[own[0]]
        if len(own) < support or dt[-1] < span:
            continue
        lifted = f[own] + period * grouped.half_up((f[own[0]] + slopes[s] * dt - f[own]) / period)
        fit = grouped.line(dt, lifted)
        if fit is None:
            continue
        off = lifted - fit[1] - fit[0] * dt
        if np.abs(off).max() <= gate and (best is None or (total, len(own), -s) > best[0]):
            best = (total, len(own), -s), own, *fit, float(np.sqrt((off * off).mean())), float(t[own[0]]), float(dt[-1])
    return best and best[1:]


def detected_tracks(points: DataFrame, keys: list[str], slopes: list[float], gap: float, gate: float, period: float, point: float, bend: float, wait: float, support: int, span: float, tracks: int) -> DataFrame:
    """Up to so many tracks of each key, best first: keys, track, id, place, slope, intercept (at the track's first time) and rms.

    points: keys, id (long), t, f and w (doubles).  For each assumed slope the best chain of points is that with the most weight, less ``point`` for each
    point, ``bend`` for leaving the slope by the gate (squared), and ``wait`` for each unit of time between points; points of one time don't follow each other, and
    values are equal modulo the period.  A slope's chain is fitted by a line; it counts if it has the support and the span and no point
    of it is off by more than the gate.  The best (weight of its chain, points, slope) is a track; its points and all others within the gate of its line and its
    time go, and the search is repeated.  Points travel once, to where their key is.
    """
    assumed = np.array(slopes)

    def fit(ident, t, f, w):
        left, found = np.arange(len(ident)), []
        for track in range(1, tracks + 1):
            best = _best_track(t[left], ident[left], f[left], w[left], assumed, gap, gate, period, point, bend, wait, support, span) if len(left) else None
            if best is None:
                break
            own, slope, intercept, rms, t0, length = best
            found.append((np.full(len(own), track), ident[left[own]], np.arange(1, len(own) + 1), *[np.full(len(own), x) for x in (slope, intercept, rms)]))
            dt = t[left] - t0
            gone = (dt >= 0) & (dt <= length) & (np.abs(grouped.wrapped(f[left] - intercept - slope * dt, period)) <= gate)
            gone[own] = True
            left = left[~gone]
        return [np.concatenate([x[n] for x in found]) for n in range(6)] if found else [np.zeros(0)] * 6

    columns = ["id", "t", "f", "w"]
    whole = points.select(*keys, *columns).dropna()
    schema = ", ".join([*[f"{k} long" for k in keys], "track int, id long, place int, slope double, intercept double, rms double"])
    return grouped.by_keys(whole, keys, ["t", "id"], columns, schema, grouped.each_key(fit, keys, columns, [np.int32, np.int64, np.int32, float, float, float]))


# --- least-cost path cover ---------------------------------------------------------------------------------------


def matched(edges: list[tuple[int, int, float]], ends: float) -> dict[int, int]:
    """Successors of least total cost: each node has one successor and one predecessor at most, an edge costs what it says, and a node
    without a successor costs ``ends``.  Nodes come in one by one, each by the cheapest chain of changes (Dijkstra over costs less prices)."""
    out: dict[int, list[tuple[int, float]]] = {}
    for u, v, c in sorted(edges):
        if c < ends:
            out.setdefault(u, []).append((v, c))
    follow: dict[int, int] = {}
    owner: dict[int, int] = {}
    price: dict[int, float] = {}
    for root in out:
        dist: dict[int, float] = {}
        back: dict[int, int] = {}
        closed: list[int] = []
        end, best, last = None, ends, root  # the root may stay without a successor
        heap: list[tuple[float, int, int]] = [(c - price.get(v, 0.0), v, root) for v, c in out[root]]
        heapq.heapify(heap)
        while heap and heap[0][0] < best:
            d, v, u = heapq.heappop(heap)
            if v in dist:
                continue
            dist[v], back[v] = d, u
            if v not in owner:
                end, best = v, d
                break
            closed.append(v)
            w = owner[v]
            held = next(c for x, c in out[w] if x == v) - price.get(v, 0.0)
            if d + ends - held < best:  # w may give v up and have no successor
                end, best, last = None, d + ends - held, w
            for x, c in out[w]:
                if x not in dist:
                    heapq.heappush(heap, (d + c - price.get(x, 0.0) - held, x, w))
        for v in closed:
            price[v] = price.get(v, 0.0) + min(0.0, dist[v] - best)
        if end is None:
            if last == root:
                continue
            end = follow.pop(last)
        while True:  # every node on the way takes over what the next gives up
            u = back[end]
            free = follow.get(u)
            follow[u], owner[end] = end, u
            if u == root:
                break
            end = free
    return follow


def link_costs(points: DataFrame, keys: list[str], reach: int, step: float, weights: tuple[float, float, float, float], most: tuple[float, float, float]) -> DataFrame:
    """keys, a, b, status, missed and cost of the pairs of points at most ``reach`` apart in time.

    points: keys, id, t (integer), f, slope and acceleration, the latter two by unit ``step`` of t.  weights: of the errors in value, slope and acceleration, each as a
    share of what is allowed (most), and of a step that was missed.
    """
    side = lambda s: points.select(*keys, *[F.col(c).alias(f"{s}{c}") for c in ("id", "t", "f", "slope", "acceleration")])
    pairs = near_pairs(side("x"), side("y"), keys, "xt", "yt", reach)
    dt = (F.col("yt") - F.col("xt")) / F.lit(step)
    off = F.abs(F.col("yf") - F.col("xf") - F.col("xslope") * dt - 0.5 * F.col("xacceleration") * dt * dt)
    turn, bend = F.abs(F.col("yslope") - F.col("xslope")), F.abs(F.col("yacceleration") - F.col("xacceleration"))
    missed = F.greatest(F.bround(dt, 0) - 1, F.lit(0.0))
    cost = weights[0] * off / most[0] + weights[1] * turn / most[1] + weights[2] * bend / most[2] + weights[3] * missed
    status = F.when(off > most[0], "frequency").when(turn > most[1], "slope").when(bend > most[2], "acceleration").otherwise("admissible")
    return pairs.select(*keys, F.col("xid").alias("a"), F.col("yid").alias("b"), "xt", "yt", status.alias("status"), missed.cast("long").alias("missed"), cost.alias("cost"))


def _links(ident: np.ndarray, t: np.ndarray, f: np.ndarray, slope: np.ndarray, acceleration: np.ndarray, reach: int, step: float, weights: tuple[float, float, float, float], most: tuple[float, float, float], ends: float) -> list[tuple[int, int, float]]:
    """The links of one key's points that are admissible and cost less than ``ends``, as ``link_costs`` has them."""
    found = []
    for i, j in grouped.later(t, reach):
        dt = (t[j] - t[i]) / step
        off = np.abs(f[j] - f[i] - slope[i] * dt - 0.5 * acceleration[i] * dt * dt)
        turn, bend = np.abs(slope[j] - slope[i]), np.abs(acceleration[j] - acceleration[i])
        missed = np.maximum(np.rint(dt) - 1, 0.0)
        cost = weights[0] * off / most[0] + weights[1] * turn / most[1] + weights[2] * bend / most[2] + weights[3] * missed
        own = np.flatnonzero((off <= most[0]) & (turn <= most[1]) & (bend <= most[2]) & (cost < ends))
        found += zip(ident[i[own]].tolist(), ident[j[own]].tolist(), cost[own].tolist(), strict=True)
    return found


def _hints(chain: np.ndarray, t: np.ndarray, f: np.ndarray, slope: np.ndarray, acceleration: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """Slopes and accelerations of least-squares parabolas (lines for two points) through the chains (numbers of each point's); single points keep theirs."""
    n = np.bincount(chain)
    t0 = np.full(len(n), np.iinfo(np.int64).max)
    np.minimum.at(t0, chain, t)
    u, g = (t - t0[chain]) / step, f - (np.bincount(chain, f) / n)[chain]
    s0, s1, s2, s3, s4 = (np.bincount(chain, u**k) for k in range(5))
    y0, y1, y2 = (np.bincount(chain, u**k * g) for k in range(3))
    with np.errstate(divide="ignore", invalid="ignore"):
        line = (s0 * y1 - s1 * y0) / (s0 * s2 - s1 * s1)
        # the parabola by the sums about the means of u and u^2
        a, b, c = s2 - s1 * s1 / s0, s3 - s1 * s2 / s0, s4 - s2 * s2 / s0
        p, q = y1 - s1 * y0 / s0, y2 - s2 * y0 / s0
        det = a * c - b * b
        curved = (s0 > 2) & (np.abs(det) > 1e-9 * a * c)
        c1, c2 = np.where(curved, (p * c - q * b) / det, line), np.where(curved, (a * q - b * p) / det, 0.0)
    several = (n > 1)[chain]
    return np.where(several, c1[chain] + 2 * c2[chain] * u, slope), np.where(several, 2 * c2[chain], acceleration)


def covered_paths(points: DataFrame, keys: list[str], reach: int, step: float, weights: tuple[float, float, float, float], most: tuple[float, float, float], ends: float, rounds: int = 12) -> DataFrame:
    """The cover of each key's points by paths of least cost, refitted until it stays: keys, id, head, place, converged and rounds.

    A path costs ``ends`` and each of its links what ``link_costs`` says; a link is worth its cost below ``ends``.  After a round each point's slope and
    acceleration are those of its path, and links are weighed again.  A key is done when none of its links changes (converged), or after ``rounds`` rounds, with the
    last one's cover.  Points travel once, to where their key is; their links, which are weighed anew in each round, stay there.
    """

    def fit(ident, t, f, slope, acceleration):
        place_of = {x: k for k, x in enumerate(ident.tolist())}
        before = None
        for k in range(1, max(2, rounds) + 1):
            follow = matched(_links(ident, t, f, slope, acceleration, reach, step, weights, most, ends), ends)
            head, place = ident.copy(), np.zeros(len(ident), np.int64)
            for start in follow.keys() - set(follow.values()):
                a, n = start, 0
                while a in follow:
                    a, n = follow[a], n + 1
                    head[place_of[a]], place[place_of[a]] = start, n
            # single points keep their hints, so without a link the next round would find none either
            if not follow and before is None:
                converged, k = True, 2
                break
            converged = follow == before
            if converged or k >= max(2, rounds):
                break
            before = follow
            slope, acceleration = _hints(np.unique(head, return_inverse=True)[1], t, f, slope, acceleration, step)
        return ident, head, place, np.full(len(ident), converged), np.full(len(ident), k)

    columns = ["id", "t", "f", "slope", "acceleration"]
    # a point without a time or value has no links, but is a path
    whole = points.select(*keys, "id", F.coalesce("t", F.lit(0)).alias("t"), F.when(F.col("t").isNotNull(), F.col("f")).alias("f"), "slope", "acceleration").dropna(subset=[*keys, "id"])
    schema = ", ".join([*[f"{k} long" for k in keys], "id long, head long, place long, converged boolean, rounds int"])
    return grouped.by_keys(whole, keys, ["t", "id"], columns, schema, grouped.each_key(fit, keys, columns, [np.int64, np.int64, np.int64, bool, np.int32]))
