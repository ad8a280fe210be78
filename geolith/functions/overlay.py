"""Overlay of areas on a lattice of whole numbers: edges are cut where they meet, labelled by what lies on both sides, and chosen.

Coordinates are whole numbers from 0 to ``STEPS``, so that orientations are exact in 64 bits. Areas are given by directed edges
with the area on their left; an edge has a count for each of several layers, and a point belongs to a layer if its winding
number there is positive, so that a layer may be any number of overlapping rings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Steps of the lattice to the side of a cell. Products of differences stay below 2^60.
STEPS = 1 << 28
#: Candidate pairs of edges that are tested at a time.
PAIRS = 1 << 21


def merged(edges: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each undirected edge (x0, y0, x1, y1) once, from its lesser end, with its counts; those that cancel go."""
    turned = (edges[:, 0] > edges[:, 2]) | (edges[:, 0] == edges[:, 2]) & (edges[:, 1] > edges[:, 3])
    edges = np.where(turned[:, None], edges[:, [2, 3, 0, 1]], edges)
    counts = np.where(turned[:, None], -counts, counts)
    use = (edges[:, :2] != edges[:, 2:]).any(1)
    edges, counts = edges[use], counts[use]
    if not len(edges):
        return edges, counts
    order = np.lexsort(edges.T[::-1])
    edges, counts = edges[order], counts[order]
    new = np.flatnonzero(np.concatenate([[True], (edges[1:] != edges[:-1]).any(1)]))
    edges, counts = edges[new], np.add.reduceat(counts, new, axis=0)
    use = (counts != 0).any(1)
    return edges[use], counts[use]


def close_pairs(edges: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of edges, sorted by their left ends, whose boxes touch, some at a time."""
    low, high = np.minimum(edges[:, 1], edges[:, 3]), np.maximum(edges[:, 1], edges[:, 3])
    last = np.searchsorted(edges[:, 0], edges[:, 2], "right")
    sizes = last - np.arange(len(edges)) - 1
    ends, start = np.cumsum(sizes), 0
    while start < len(edges):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, "right")))
        n = sizes[start:stop]
        i = np.repeat(np.arange(start, stop), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        use = (low[i] <= high[j]) & (low[j] <= high[i])
        yield i[use], j[use]
        start = stop


def turn(a: np.ndarray, b: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Twice the signed area of the triangles a, b, p."""
    return (b[:, 0] - a[:, 0]) * (p[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (p[:, 0] - a[:, 0])


def meetings(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges that have to be cut, and the points where: ends of others on them, and crossings, rounded to the lattice."""
    which, where = [], []
    for i, j in close_pairs(edges):
        p, q, r, s = edges[i, :2], edges[i, 2:], edges[j, :2], edges[j, 2:]
        sides = [turn(r, s, p), turn(r, s, q), turn(p, q, r), turn(p, q, s)]
        for k, point, a, b, own in ((0, p, r, s, j), (1, q, r, s, j), (2, r, p, q, i), (3, s, p, q, i)):
            on = (sides[k] == 0) & (np.minimum(a, b) <= point).all(1) & (point <= np.maximum(a, b)).all(1) & (point != a).any(1) & (point != b).any(1)
            which.append(own[on])
            where.append(point[on])
        cross = (np.sign(sides[0]) * np.sign(sides[1]) < 0) & (np.sign(sides[2]) * np.sign(sides[3]) < 0)
        t = sides[0][cross] / (sides[0][cross] - sides[1][cross].astype(float))
        at = p[cross] + np.rint((q[cross] - p[cross]) * t[:, None]).astype(np.int64)
        which += [i[cross], j[cross]]
        where += [at, at]
    if not which:
        return np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
    which, where = np.concatenate(which), np.concatenate(where)
    inner = (where != edges[which, :2]).any(1) & (where != edges[which, 2:]).any(1)
    return which[inner], where[inner]


def noded(edges: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that meet at common ends only. Rounded crossings may move an edge over another, so cutting goes on until nothing meets."""
    edges, counts = merged(edges, counts)
    while True:
        which, where = meetings(edges)
        if not len(which):
            return edges, counts
        which = np.concatenate([which, np.arange(len(edges)), np.arange(len(edges))])
        where = np.concatenate([where, edges[:, :2], edges[:, 2:]])
        along = ((where - edges[which, :2]) * (edges[which, 2:] - edges[which, :2])).sum(1)
        order = np.lexsort((where[:, 1], where[:, 0], along, which))
        which, where = which[order], where[order]
        same = which[1:] == which[:-1]
        edges, counts = merged(np.hstack([where[:-1][same], where[1:][same]]), counts[which[1:][same]])


def windings(edges: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The winding numbers right above each noded edge's middle; right of it, if the edge is upright."""
    out = np.zeros_like(counts)
    middle = edges[:, :2] + edges[:, 2:]
    order = np.argsort(middle[:, 0], kind="stable")
    size = max(1, PAIRS // max(1, len(edges)))
    for start in range(0, len(edges), size):
        rows = order[start : start + size]
        x, y = middle[rows, 0][:, None], middle[rows, 1][:, None]
        near = np.flatnonzero((2 * edges[:, 0] <= x.max()) & (2 * edges[:, 2] > x.min()))
        f = edges[near]
        above = (2 * f[:, 0] <= x) & (x < 2 * f[:, 2]) & ((f[:, 2] - f[:, 0]) * (y - 2 * f[:, 1]) < (f[:, 3] - f[:, 1]) * (x - 2 * f[:, 0]))
        out[rows] = -np.rint(above.astype(float) @ counts[near].astype(float)).astype(np.int64)
    return out


def overlay(edges: np.ndarray, counts: np.ndarray, rule: Callable[..., np.ndarray]) -> np.ndarray:
    """The directed border of the points for which ``rule`` of their membership in each layer holds."""
    edges, counts = noded(edges, counts)
    if not len(edges):
        return edges
    upper, upright = windings(edges, counts), edges[:, 0] == edges[:, 2]
    lower = upper + np.where(upright[:, None], counts, -counts)
    a, b = rule(*(upper > 0).T), rule(*(lower > 0).T)
    use, left = a != b, np.where(upright, b, a)
    return np.where(left[use][:, None], edges[use], edges[use][:, [2, 3, 0, 1]])


def doubled_area(edges: np.ndarray) -> float:
    """Twice the area in a closed set of directed edges."""
    return float((edges[:, 0].astype(float) * edges[:, 3] - edges[:, 2].astype(float) * edges[:, 1]).sum())


def on_border(points: np.ndarray, size: int = STEPS) -> np.ndarray:
    return ((points == 0) | (points == size)).any(1)


def seams(edges: np.ndarray, size: int = STEPS) -> np.ndarray:
    """Which edges lie on the border of the cell."""
    return ((edges[:, :2] == edges[:, 2:]) & ((edges[:, :2] == 0) | (edges[:, :2] == size))).any(1)


def followers(edges: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The edge after each one, -1 if it ends at one of the nodes where ``stops``: of several the first clockwise from the way back, so that areas which touch in a point stay apart."""
    starts = np.lexsort((edges[:, 1], edges[:, 0]))
    keys = edges[starts, 0] * (2 * STEPS) + edges[starts, 1]
    ends = edges[:, 2] * (2 * STEPS) + edges[:, 3]
    a, b = np.searchsorted(keys, ends), np.searchsorted(keys, ends, "right")
    out = np.where(b > a, starts[np.minimum(a, len(starts) - 1)], -1)
    angle = np.arctan2(*(edges[:, 2:] - edges[:, :2]).T[::-1])
    for k in np.flatnonzero(b - a > 1).tolist():
        found = starts[a[k] : b[k]]
        round_ = np.mod(angle[k] + np.pi - angle[found], 2 * np.pi)
        out[k] = found[np.argmin(np.where(round_ < 1e-12, 2 * np.pi, round_))]
    out[stops] = -1
    return out


def chains(edges: np.ndarray, size: int = STEPS) -> tuple[list[np.ndarray], np.ndarray]:
    """The edges inside a cell as lines from border to border or rings (first point repeated), and those on its border."""
    seam = seams(edges, size)
    inner, rest = edges[~seam], edges[seam]
    if not len(inner):
        return [], rest
    after = followers(inner, on_border(inner[:, 2:], size))
    begin = np.ones(len(inner), bool)
    begin[after[after >= 0]] = False
    left, out, follow = np.ones(len(inner), bool), [], after.tolist()
    for first in [*np.flatnonzero(begin).tolist(), *np.flatnonzero(~begin).tolist()]:
        if left[first]:
            line, k = [], first
            while k >= 0 and left[k]:
                left[k] = False
                line.append(k)
                k = follow[k]
            out.append(np.vstack([inner[line, :2], inner[line[-1], 2:]]))
    return out, rest


def faults(polygons: list[list[np.ndarray]]) -> list[str]:
    """What is wrong with polygons, each a shell and its holes, on a lattice of ``STEPS`` over their extent: nothing, if they are valid.

    ``not_finite``, ``too_few_points``, ``self_intersection`` of a ring (it meets itself), ``overlapping_rings`` (rings cross or have an
    edge in common, a hole isn't in its shell, holes or polygons overlap). Rings may touch in points.
    """
    rings = [ring for p in polygons for ring in p]
    if not rings or any(len(r) < 3 for r in rings):
        return ["too_few_points"]
    points = np.vstack(rings)
    if not np.isfinite(points).all():
        return ["not_finite"]
    low, extent = points.min(0), max(float(np.ptp(points, 0).max()), 1e-300)
    out, edges, counts = set(), [], []
    for p in polygons:
        for k, ring in enumerate(p):
            own = np.rint((ring - low) / extent * (STEPS - 1)).astype(np.int64)
            around = np.hstack([own, np.roll(own, -1, 0)])
            around = around[(around[:, :2] != around[:, 2:]).any(1)]
            size = doubled_area(around)
            found, n = noded(around, np.ones((len(around), 1), np.int64))
            ends = np.unique(np.vstack([found[:, :2], found[:, 2:]]), axis=0, return_counts=True)[1] if len(found) else np.zeros(0)
            if size == 0 or len(found) != len(around) or (abs(n) != 1).any() or (ends != 2).any():
                out.add("self_intersection")
            edges.append(around)
            counts.append(np.full(len(around), 1 if (size > 0) == (k == 0) else -1))
    every, n = noded(np.vstack(edges), np.concatenate(counts)[:, None])
    upper = windings(every, n)
    lower = upper + np.where((every[:, 0] == every[:, 2])[:, None], n, -n)
    total = sum(float(np.hypot(*(e[:, 2:] - e[:, :2]).T).sum()) for e in edges)
    left = float(np.hypot(*(every[:, 2:] - every[:, :2]).T).sum())
    if "self_intersection" not in out and (((upper < 0) | (upper > 1) | (lower < 0) | (lower > 1)).any() or total - left > 1e-6 * total):
        out.add("overlapping_rings")
    return sorted(out)


def inside_stretches(lines: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of straight lines (x0, y0, x1, y1) the number and the ends, from 0 to 1, of the stretches inside of or on a closed set of edges."""
    which, low, high = [], [], []
    step = max(1, PAIRS // max(1, len(edges)))
    ex, ey = edges[:, 2] - edges[:, 0], edges[:, 3] - edges[:, 1]
    for a in range(0, len(lines), step):
        own = lines[a : a + step]
        dx, dy = own[:, 2] - own[:, 0], own[:, 3] - own[:, 1]
        gx, gy = edges[:, 0] - own[:, :1], edges[:, 1] - own[:, 1:2]
        cross = dx[:, None] * ey - dy[:, None] * ex
        with np.errstate(all="ignore"):
            t, u = (gx * ey - gy * ex) / cross, (gx * dy[:, None] - gy * dx[:, None]) / cross
        square = (dx * dx + dy * dy)[:, None]
        along = (cross == 0) & (gx * dy[:, None] - gy * dx[:, None] == 0)  # on one straight line: its ends count
        ends = [np.where((t > 0) & (t < 1) & (u >= 0) & (u <= 1), t, 0.0)]
        with np.errstate(all="ignore"):
            ends += [np.where(along, np.clip((x * dx[:, None] + y * dy[:, None]) / square, 0, 1), 0.0) for x, y in ((gx, gy), (gx + ex, gy + ey))]
        cuts = np.sort(np.hstack([np.zeros((len(own), 1)), np.nan_to_num(np.hstack(ends)), np.ones((len(own), 1))]), 1)
        i, j = np.nonzero(cuts[:, 1:] - cuts[:, :-1] > 1e-12)
        s, e = cuts[i, j], cuts[i, j + 1]
        x, y = own[i, 0] + dx[i] * (s + e) / 2, own[i, 1] + dy[i] * (s + e) / 2
        for c in range(0, len(i), step):
            px, py = x[c : c + step, None], y[c : c + step, None]
            turned = ex * (py - edges[:, 1]) - ey * (px - edges[:, 0])
            box = (np.minimum(edges[:, 0], edges[:, 2]) - 1 <= px) & (px <= np.maximum(edges[:, 0], edges[:, 2]) + 1) & (np.minimum(edges[:, 1], edges[:, 3]) - 1 <= py) & (py <= np.maximum(edges[:, 1], edges[:, 3]) + 1)
            on = (box & (abs(turned) <= np.hypot(ex, ey))).any(1)  # within a step, by which an edge may be rounded
            up, down = (edges[:, 1] <= py) & (py < edges[:, 3]), (edges[:, 3] <= py) & (py < edges[:, 1])
            use = on | (((up & (turned > 0)).sum(1) - (down & (turned < 0)).sum(1)) != 0)
            which.append(i[c : c + step][use] + a)
            low.append(s[c : c + step][use])
            high.append(e[c : c + step][use])
    if not which:
        return (np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    return np.concatenate(which), np.concatenate(low), np.concatenate(high)
