"""Polygons from rings as they come: crossing, touching, nested, in any order and direction.

A point belongs to a polygon if a ray from it crosses the rings an odd number of times. built() gives the
boundary of that set as simple rings: outer ones run counter-clockwise, holes clockwise, so areas (and
areas within a circle) add up with their signs, whatever the number of outers, holes, and islands in holes.
"""

from __future__ import annotations

from collections import defaultdict
from math import atan2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column

#: Degrees within which two corners are one (some micrometres).
SAME = 1e-11
#: Pairs of edges that are compared at once.
PAIRS = 1 << 22
RINGS = pa.list_(pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())])))
KIND = "array<array<struct<lon:double,lat:double>>>"


def crossings(a: np.ndarray, b: np.ndarray) -> list[list[np.ndarray]]:
    """For edges a[i]-b[i]: the points where others cross, touch or overlap each."""
    out: list[list[np.ndarray]] = [[] for _ in a]
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.argsort(low[:, 0], kind="stable")
    starts = low[order, 0]
    stop = np.searchsorted(starts, high[order, 0], "right")
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and (stop[i:j].max() - i) * (j - i) < PAIRS:
            j += 1
        # an edge meets only edges that begin (in lon) before it ends
        n = np.maximum(stop[i:j] - np.arange(i, j) - 1, 0)
        left = np.repeat(np.arange(i, j), n)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        x, y = order[left], order[right]
        near = (low[x, 1] <= high[y, 1]) & (low[y, 1] <= high[x, 1])
        x, y = x[near], y[near]
        p, q, r, s = a[x], a[y], b[x] - a[x], b[y] - a[y]
        across = r[:, 0] * s[:, 1] - r[:, 1] * s[:, 0]
        skew = np.abs(across) > 1e-12 * np.hypot(*r.T) * np.hypot(*s.T)
        with np.errstate(divide="ignore", invalid="ignore"):
            t = ((q - p)[:, 0] * s[:, 1] - (q - p)[:, 1] * s[:, 0]) / across
            u = ((q - p)[:, 0] * r[:, 1] - (q - p)[:, 1] * r[:, 0]) / across
        hit = skew & (t >= -1e-12) & (t <= 1 + 1e-12) & (u >= -1e-12) & (u <= 1 + 1e-12)
        for k in np.flatnonzero(hit).tolist():
            at = p[k] + t[k] * r[k]
            out[x[k]].append(at)
            out[y[k]].append(at)
        for k in np.flatnonzero(~skew).tolist():  # parallel: ends of one that lie on the other
            for e, f in ((x[k], y[k]), (y[k], x[k])):
                d = b[e] - a[e]
                size = d @ d
                for end in (a[f], b[f]):
                    along = (end - a[e]) @ d / size
                    if 0 < along < 1 and np.hypot(*(a[e] + along * d - end)) <= SAME:
                        out[e].append(end)
        i = j
    return out


def boundary(rings: list[np.ndarray]) -> list[np.ndarray]:
    """The boundary of what closed rings hold by the even-odd rule: closed simple rings, outer ones counter-clockwise."""
    rings = [r[np.append(True, (np.diff(r, axis=0) != 0).any(axis=1))] for r in rings]
    rings = [r for r in rings if len(r) > 3]
    if not rings:
        return []
    a, b = np.concatenate([r[:-1] for r in rings]), np.concatenate([r[1:] for r in rings])
    corners: dict[tuple[int, int], tuple[float, float]] = {}

    def corner(p: np.ndarray) -> tuple[float, float]:
        """One of the corners that are the same point."""
        x, y = int(round(p[0] / SAME)), int(round(p[1] / SAME))
        for key in ((x + i, y + j) for i in (0, -1, 1) for j in (0, -1, 1)):
            if key in corners:
                return corners[key]
        corners[x, y] = (float(p[0]), float(p[1]))
        return corners[x, y]

    for p in a:
        corner(p)
    odd: set[tuple[tuple[float, float], tuple[float, float]]] = set()
    for start, end, cuts in zip(a, b, crossings(a, b), strict=True):
        way = end - start
        stops = [corner(p) for p in [start, *sorted(cuts, key=lambda p, s=start, w=way: (p - s) @ w), end]]
        for p, q in zip(stops, stops[1:], strict=False):
            if p != q:
                odd ^= {(min(p, q), max(p, q))}  # what is drawn twice is no border
    if not odd:
        return []
    edges = np.array(sorted(odd))
    p, q = edges[:, 0], edges[:, 1]  # in the order of lon, then lat
    middle = (p + q) / 2
    upright = p[:, 0] == q[:, 0]
    inside = np.zeros(len(edges), bool)  # above the edge; left of it if it is upright
    for k in range(len(edges)):
        x, y = middle[k]
        if upright[k]:
            over = (p[:, 1] > y) != (q[:, 1] > y)
            at = p[over, 0] + (y - p[over, 1]) / (q[over, 1] - p[over, 1]) * (q[over, 0] - p[over, 0])
            inside[k] = (np.count_nonzero(at < x) - np.count_nonzero((at < x) & (np.flatnonzero(over) == k))) % 2
        else:
            over = (p[:, 0] <= x) & (q[:, 0] > x)
            over[k] = False
            at = p[over, 1] + (x - p[over, 0]) / (q[over, 0] - p[over, 0]) * (q[over, 1] - p[over, 1])
            inside[k] = np.count_nonzero(at > y) % 2
    out: dict[tuple[float, float], list[tuple[float, float]]] = defaultdict(list)
    for k, (u, v) in enumerate(edges.tolist()):
        u, v = tuple(u), tuple(v)
        out[u if inside[k] else v].append(v if inside[k] else u)  # what it holds lies on its left
    made = []
    while out:
        start = here = min(out)
        ring, back = [start], None
        while True:
            ways = out[here]
            if back is None or len(ways) == 1:
                there = ways[0]
            else:  # the sharpest turn to the left, so that rings that touch stay apart
                came = atan2(back[1] - here[1], back[0] - here[0])
                there = min(ways, key=lambda w, h=here, c=came: (c - atan2(w[1] - h[1], w[0] - h[0])) % (2 * pi) or 2 * pi)
            ways.remove(there)
            if not ways:
                del out[here]
            back, here = here, there
            if here in ring:  # a corner met again closes a ring of its own, as where a hole touches its outer ring
                k = ring.index(here)
                made.append(np.array([*ring[k:], here]))
                del ring[k + 1 :]
            else:
                ring.append(here)
            if here == start:
                break
    return made


def built(rings: Column) -> Column:
    """boundary() of arrays of closed rings; null where they hold nothing."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf(KIND)
    def build(rows: pa.Array) -> pa.Array:
        out = []
        for own in rows.to_pylist():
            found = boundary([np.array([(p["lon"], p["lat"]) for p in r]) for r in own if r]) if own else []
            out.append([[{"lon": x, "lat": y} for x, y in r.tolist()] for r in found] or None)
        return pa.array(out, RINGS)

    return build(rings)
