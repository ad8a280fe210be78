"""Geometry on the plane and the ellipsoid: numpy for shapes, Column expressions for points."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The WGS84 ellipsoid, and the centre of the equal-area projection.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
CENTRE_LAT, CENTRE_LON = 45.0, 134.0
E2 = FLATTENING * (2 - FLATTENING)
E1 = math.sqrt(E2)


def _q(sin: Column | float):
    s = sin
    log = F.log if isinstance(s, Column) else math.log
    return (1 - E2) * (s / (1 - E2 * s * s) - 1 / (2 * E1) * log((1 - E1 * s) / (1 + E1 * s)))


def equal_area(lon: Column, lat: Column, lat0: float = CENTRE_LAT, lon0: float = CENTRE_LON) -> tuple[Column, Column]:
    """Metres in the ellipsoidal Lambert azimuthal equal-area projection."""
    s0 = math.sin(math.radians(lat0))
    qp, q1 = _q(1.0 - 1e-15), _q(s0)
    b1, rq = math.asin(q1 / qp), SEMI_MAJOR * math.sqrt(qp / 2)
    m1 = math.cos(math.radians(lat0)) / math.sqrt(1 - E2 * s0 * s0)
    d = SEMI_MAJOR * m1 / (rq * math.cos(b1))
    b = F.asin(_q(F.sin(F.radians(lat))) / qp)
    dl = F.radians(lon - lon0)
    k = rq * F.sqrt(2 / (1 + math.sin(b1) * F.sin(b) + math.cos(b1) * F.cos(b) * F.cos(dl)))
    return k * d * F.cos(b) * F.sin(dl), k / d * (math.cos(b1) * F.sin(b) - math.sin(b1) * F.cos(b) * F.cos(dl))


def equal_area_inverse(x: float, y: float, lat0: float = CENTRE_LAT, lon0: float = CENTRE_LON) -> tuple[float, float]:
    """Longitude and latitude of a projected point."""
    s0 = math.sin(math.radians(lat0))
    qp, q1 = _q(1.0 - 1e-15), _q(s0)
    b1, rq = math.asin(q1 / qp), SEMI_MAJOR * math.sqrt(qp / 2)
    d = SEMI_MAJOR * math.cos(math.radians(lat0)) / math.sqrt(1 - E2 * s0 * s0) / (rq * math.cos(b1))
    rho = math.hypot(x / d, d * y)
    if rho == 0:
        return lon0, lat0
    c = 2 * math.asin(rho / (2 * rq))
    q = qp * (math.cos(c) * math.sin(b1) + d * y * math.sin(c) * math.cos(b1) / rho)
    lat = math.asin(max(-1.0, min(1.0, q / 2)))
    for _ in range(30):
        s = math.sin(lat)
        step = (1 - E2 * s * s) ** 2 / (2 * math.cos(lat)) * (q / (1 - E2) - s / (1 - E2 * s * s) + 1 / (2 * E1) * math.log((1 - E1 * s) / (1 + E1 * s)))
        lat += step
        if abs(step) < 1e-14:
            break
    lon = math.atan2(x * math.sin(c), d * rho * math.cos(b1) * math.cos(c) - d * d * y * math.sin(b1) * math.sin(c))
    return lon0 + math.degrees(lon), math.degrees(lat)


def geodesic(lon1, lat1, lon2, lat2) -> np.ndarray:
    """Metres between points on the ellipsoid, by Vincenty's inverse formula."""
    b = SEMI_MAJOR * (1 - FLATTENING)
    u1, u2 = (np.arctan((1 - FLATTENING) * np.tan(np.radians(np.asarray(v, float)))) for v in (lat1, lat2))
    dl = np.radians(np.asarray(lon2, float) - np.asarray(lon1, float))
    lam = dl.copy() if isinstance(dl, np.ndarray) else np.array(dl)
    for _ in range(100):
        s = np.hypot(np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam))
        c = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
        sigma = np.arctan2(s, c)
        with np.errstate(all="ignore"):
            alpha = np.where(s > 0, np.cos(u1) * np.cos(u2) * np.sin(lam) / s, 0.0)
            cos2a = 1 - alpha**2
            mid = np.where(cos2a > 0, c - 2 * np.sin(u1) * np.sin(u2) / cos2a, 0.0)
        k = FLATTENING / 16 * cos2a * (4 + FLATTENING * (4 - 3 * cos2a))
        new = dl + (1 - k) * FLATTENING * alpha * (sigma + k * s * (mid + k * c * (2 * mid**2 - 1)))
        if np.max(np.abs(new - lam), initial=0) < 1e-13:
            break
        lam = new
    uu = cos2a * (SEMI_MAJOR**2 - b**2) / b**2
    aa = 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu)))
    bb = uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu)))
    d = bb * s * (mid + bb / 4 * (c * (2 * mid**2 - 1) - bb / 6 * mid * (4 * s**2 - 3) * (4 * mid**2 - 3)))
    return b * aa * (sigma - d)


@F.pandas_udf(T.DoubleType())
def geodesic_m(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.Series:
    return pd.Series(geodesic(lon1.to_numpy(), lat1.to_numpy(), lon2.to_numpy(), lat2.to_numpy()))


def area(ring: np.ndarray) -> float:
    """Signed area of a ring of points, open or closed."""
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def clip_half_plane(ring: np.ndarray, a: float, b: float, c: float) -> np.ndarray:
    """The part of a ring where a x + b y <= c."""
    if not len(ring):
        return ring
    side = ring @ np.array([a, b]) - c
    out = []
    for i in range(len(ring)):
        j = (i + 1) % len(ring)
        if side[i] <= 0:
            out.append(ring[i])
        if (side[i] < 0 < side[j]) or (side[j] < 0 < side[i]):
            out.append(ring[i] + (ring[j] - ring[i]) * side[i] / (side[i] - side[j]))
    return np.array(out).reshape(-1, 2)


def clip_convex(ring: np.ndarray, window: np.ndarray) -> np.ndarray:
    """The part of a ring inside a convex ring."""
    if area(window) < 0:
        window = window[::-1]
    for p, q in zip(window, np.roll(window, -1, 0), strict=True):
        a, b = q[1] - p[1], p[0] - q[0]
        ring = clip_half_plane(ring, a, b, a * p[0] + b * p[1])
    return ring


class Rings:
    """Many rings as flat arrays: the points of ring k are ``at[k]`` to ``at[k + 1]``; a ring may be empty."""

    def __init__(self, x: np.ndarray, y: np.ndarray, at: np.ndarray):
        self.x, self.y, self.at = x, y, at

    @classmethod
    def of(cls, rings: list) -> Rings:
        """Of sequences of points, closed or not; repeated last points go."""
        parts = [np.array([np.asarray(p, float) for p in r], float).reshape(-1, 2) for r in rings]
        parts = [p[:-1] if len(p) > 1 and (p[0] == p[-1]).all() else p for p in parts]
        flat = np.concatenate(parts) if parts else np.zeros((0, 2))
        return cls(flat[:, 0], flat[:, 1], np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64))

    def __len__(self) -> int:
        return len(self.at) - 1

    @property
    def ring(self) -> np.ndarray:
        """The ring of each point."""
        return np.repeat(np.arange(len(self)), np.diff(self.at))

    @property
    def following(self) -> np.ndarray:
        """The next point of each point's ring."""
        out = np.arange(1, len(self.x) + 1)
        some = np.diff(self.at) > 0
        out[self.at[1:][some] - 1] = self.at[:-1][some]
        return out

    def take(self, rows: np.ndarray) -> Rings:
        """Copies of some rings."""
        sizes = np.diff(self.at)[rows]
        at = np.concatenate([[0], np.cumsum(sizes)])
        points = np.arange(at[-1]) + np.repeat(self.at[rows] - at[:-1], sizes)
        return Rings(self.x[points], self.y[points], at)

    def clipped(self, a, b, c) -> Rings:
        """The parts where a x + b y <= c, with a value for each ring."""
        ring, n = self.ring, len(self)
        a, b, c = (np.broadcast_to(np.asarray(v, float), n)[ring] for v in (a, b, c))
        side = a * self.x + b * self.y - c
        after = self.following
        inside, other = side <= 0, side[after] if len(side) else side
        cross = (side < 0) & (other > 0) | (side > 0) & (other < 0)
        place = np.cumsum(inside.astype(np.int64) + cross) - cross
        x, y = (np.empty(int(inside.sum() + cross.sum())) for _ in range(2))
        x[place[inside] - 1], y[place[inside] - 1] = self.x[inside], self.y[inside]
        t = side[cross] / (side[cross] - other[cross])
        x[place[cross]] = self.x[cross] + (self.x[after[cross]] - self.x[cross]) * t
        y[place[cross]] = self.y[cross] + (self.y[after[cross]] - self.y[cross]) * t
        sizes = np.bincount(ring, inside.astype(np.int64) + cross, n).astype(np.int64) if n else np.zeros(0, np.int64)
        return Rings(x, y, np.concatenate([[0], np.cumsum(sizes)]))

    def areas(self) -> np.ndarray:
        """Signed areas, relative to each ring's first point."""
        first = np.minimum(self.at[:-1], max(0, len(self.x) - 1))
        ring, after = self.ring, self.following
        if not len(self.x):
            return np.zeros(len(self))
        x, y = self.x - self.x[first][ring], self.y - self.y[first][ring]
        return np.bincount(ring, x * y[after] - x[after] * y, len(self)) / 2

    def boxes(self) -> np.ndarray:
        """x0, y0, x1, y1 of each ring, infinite for an empty one."""
        out = np.stack([np.full(len(self), v) for v in (np.inf, np.inf, -np.inf, -np.inf)], 1)
        some = np.diff(self.at) > 0
        starts = self.at[:-1][some]
        if len(starts):
            for k, (values, best) in enumerate(((self.x, np.minimum), (self.y, np.minimum), (self.x, np.maximum), (self.y, np.maximum))):
                out[some, k] = best.reduceat(values, starts)
        return out


def shape_rings(shape) -> list[np.ndarray]:
    """The rings of a shape, which is a ring, a list of rings, or a list of lists of rings; every ring of areas within others an odd number of times is a hole."""
    depth, inner = 0, shape
    while hasattr(inner, "__len__") and len(inner):
        depth, inner = depth + 1, inner[0]
    if depth <= 2:
        return [shape] if depth else []
    return list(shape) if depth == 3 else [r for part in shape for r in part]


def signed(shape) -> list[np.ndarray]:
    """The rings of a shape: those around areas counterclockwise, those around holes clockwise."""
    rings = [np.array([np.asarray(p, float) for p in r], float).reshape(-1, 2) for r in shape_rings(shape)]
    rings = [r for r in rings if len(r) > 2 and area(r) != 0]
    if len(rings) == 1:
        return rings if area(rings[0]) > 0 else [rings[0][::-1]]
    out, sizes = [], [abs(area(r)) for r in rings]
    for k, ring in enumerate(rings):
        larger = [other for other, size in zip(rings, sizes, strict=True) if size > sizes[k]]
        depth = 0
        if larger:
            x, y = (np.array([v]) for v in inner_point(ring))
            depth = sum(bool(contains([other], x, y)[0]) for other in larger)
        out.append(ring if (area(ring) > 0) == (depth % 2 == 0) else ring[::-1])
    return out


def fan(rings: Rings, owner: np.ndarray) -> tuple[Rings, np.ndarray, np.ndarray]:
    """Triangles from each owner's first point to the edges of its rings, all counterclockwise; their owners; and their signs.

    Summed with their signs, the triangles cover each point of a shape once and any other point not at all.
    """
    first = np.unique(owner, return_index=True)[1]
    point = np.empty(int(owner.max(initial=-1)) + 1, np.int64)
    point[owner[first]] = rings.at[first]
    ring, after = rings.ring, rings.following
    own = owner[ring]
    o = point[own]
    turn = (rings.x - rings.x[o]) * (rings.y[after] - rings.y[o]) - (rings.x[after] - rings.x[o]) * (rings.y - rings.y[o])
    use = turn != 0
    i, j = np.flatnonzero(use), after[use]
    i, j = np.where(turn[use] > 0, i, j), np.where(turn[use] > 0, j, i)
    corners = np.stack([o[use], i, j], 1).ravel()
    return Rings(rings.x[corners], rings.y[corners], np.arange(0, len(corners) + 1, 3)), own[use], np.sign(turn[use])


def within_triangles(rings: Rings, triangles: Rings) -> Rings:
    """The part of ring k inside the counterclockwise triangle k."""
    x, y = triangles.x.reshape(-1, 3), triangles.y.reshape(-1, 3)
    for k in range(3):
        j = (k + 1) % 3
        a, b = y[:, j] - y[:, k], x[:, k] - x[:, j]
        rings = rings.clipped(a, b, a * x[:, k] + b * y[:, k])
    return rings


def flat_shapes(shapes: list) -> tuple[Rings, np.ndarray]:
    """The signed rings of many shapes, and the shape of each."""
    found = [signed(s) for s in shapes]
    return Rings.of([r for f in found for r in f]), np.repeat(np.arange(len(shapes)), [len(f) for f in found])


def products(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions i, j with equal values in two ascending arrays."""
    a, b = np.searchsorted(right, left), np.searchsorted(right, left, "right")
    i = np.repeat(np.arange(len(left)), b - a)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)


def intersection_areas(left: list, right: list) -> np.ndarray:
    """Common area of each pair of shapes, which may be concave, have holes and several parts."""
    a, of_a = flat_shapes(left)
    b, of_b = flat_shapes(right)
    if not len(a) or not len(b):
        return np.zeros(len(left))
    triangles, own, sign = fan(b, of_b)
    order = np.argsort(own, kind="stable")
    triangles, own, sign = triangles.take(order), own[order], sign[order]
    i, j = products(of_a, own)
    box_a, box_b = a.boxes()[i], triangles.boxes()[j]
    use = (box_a[:, :2] < box_b[:, 2:]).all(1) & (box_b[:, :2] < box_a[:, 2:]).all(1)
    i, j = i[use], j[use]
    common = within_triangles(a.take(i), triangles.take(j)).areas()
    return np.maximum(0.0, np.bincount(own[j], common * sign[j], len(left)))


def area_edges(shape) -> tuple[np.ndarray, float]:
    """The edges (x0, y0, x1, y1) of a shape's :func:`signed` rings, one after the other, without the upright ones, which no area lies under; and its area.

    The area is that of each ring from its own corner, added up: a hole's place rounds nothing, and a box's area is the product of its sides.
    """
    rings = signed(shape)
    edges = np.vstack([np.hstack([r, np.roll(r, -1, 0)]) for r in rings]) if rings else np.zeros((0, 4))
    return edges[edges[:, 0] != edges[:, 2]].ravel(), math.fsum(map(area, rings))


def border_edges(shape) -> tuple[np.ndarray, float]:
    """The edges (x0, y0, x1, y1) of a shape's rings, one after the other; their area isn't needed."""
    rings = [np.array([np.asarray(p, float) for p in r], float).reshape(-1, 2) for r in shape_rings(shape)]
    return np.vstack([np.hstack([r, np.roll(r, -1, 0)]) for r in rings]).ravel() if rings else np.zeros(0), math.nan


def split_sums(values: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums by group, which ascend from 0, in two numbers that are to be added: terms that cancel leave no rounding behind.

    Each value is cut into a multiple of a step, a 2^27th of its group's largest, and a rest. Multiples of one step add up exactly.
    """
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    step = np.zeros(group[-1] + 1)
    step[group[starts]] = np.ldexp(1.5, np.frexp(np.maximum.reduceat(np.abs(values), starts))[1] + 26)  # the unit in its last place is the step
    step = step[group]
    high = (values + step) - step
    return np.bincount(group, high), np.bincount(group, values - high)


def stretches(sizes: np.ndarray, most: int = 1 << 17) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to ``most``, or of one row."""
    total, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def common_areas(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Common area of each pair of shapes, pair k's being the :func:`area_edges` ``at[k]`` to ``at[k + 1]`` of ``a`` and ``bt[k]`` to ``bt[k + 1]`` of ``b``.

    A shape is what lies under its upper edges less what lies under its lower ones, so that the areas under both of two edges add up, with
    their signs, to the common area. ``base`` is a height near the pair. Edges that lie off the other shape cancel to nothing, as areas are
    held against limits that some meet exactly.
    """
    out, rest = np.zeros((2, len(base)))
    pair = np.repeat(np.arange(len(base)), np.diff(at))
    counts = np.diff(bt)[pair]
    (ax, ay, ar, am, asign), (bx, by, br, bm, bsign) = _lines(a), _lines(b)
    ay, by = ay - base[pair], by - np.repeat(base, np.diff(bt))
    for low, high in stretches(counts, 1 << 15):
        n = counts[low:high]
        i = np.repeat(np.arange(low, high), n)
        j = np.arange(len(i)) + np.repeat(bt[pair[low:high]] - (np.cumsum(n) - n), n)
        left, right = np.maximum(ax[i], bx[j]), np.minimum(ar[i], br[j])
        use = np.flatnonzero(left < right)
        if not len(use):
            continue
        i, j, left, right = i[use], j[use], left[use], right[use]
        y, z, u, v, x, w = ay[i], by[j], am[i], bm[j], ax[i], bx[j]
        e0, e1, f0, f1 = y + (left - x) * u, y + (right - x) * u, z + (left - w) * v, z + (right - w) * v
        first, last = np.minimum(e0, f0), np.minimum(e1, f1)
        double = first + last
        p, q = e0 - f0, e1 - f1
        k = np.flatnonzero(p * q < 0)  # the edges cross: what is under both has a corner there
        if len(k):
            t = p[k] / (p[k] - q[k])
            middle = e0[k] + t * (e1[k] - e0[k])
            double[k] = t * (first[k] + middle) + (1 - t) * (middle + last[k])
        own = pair[i]
        high, low = split_sums(asign[i] * bsign[j] * double * (right - left), own - own[0])
        some = slice(own[0], own[-1] + 1)
        before, total = out[some], out[some] + high
        more = total - before
        rest[some] += (before - (total - more)) + (high - more) + low  # what rounding left out of the total
        out[some] = total
    return np.maximum((out + rest) / 2, 0.0)


def _lines(edges: np.ndarray) -> tuple[np.ndarray, ...]:
    """The left end, right end's x, slope and direction of edges."""
    ahead = edges[:, 0] < edges[:, 2]
    x, y = np.where(ahead, edges[:, 0], edges[:, 2]), np.where(ahead, edges[:, 1], edges[:, 3])
    return x, y, np.where(ahead, edges[:, 2], edges[:, 0]), (edges[:, 3] - edges[:, 1]) / (edges[:, 2] - edges[:, 0]), np.where(ahead, 1.0, -1.0)


def covered_points(edges: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the shape of :func:`border_edges` ``at[k]`` to ``at[k + 1]`` covers point k, as :func:`contains` tells."""
    out, sizes = np.zeros(len(x), bool), np.diff(at)
    for low, high in stretches(sizes):
        some = np.flatnonzero(sizes[low:high]) + low
        if not len(some):
            continue
        n = sizes[low:high]
        x0, y0, x1, y1 = edges[at[low] : at[high]].T
        px, py = np.repeat(x[low:high], n), np.repeat(y[low:high], n)
        cross = (x1 - x0) * (py - y0) - (y1 - y0) * (px - x0)
        border = (cross == 0) & (np.minimum(x0, x1) <= px) & (px <= np.maximum(x0, x1)) & (np.minimum(y0, y1) <= py) & (py <= np.maximum(y0, y1))
        with np.errstate(all="ignore"):
            odd = ((y0 > py) != (y1 > py)) & (px < (x1 - x0) * (py - y0) / (y1 - y0) + x0)
        starts = at[some] - at[low]
        out[some] = np.bitwise_xor.reduceat(odd, starts) | np.bitwise_or.reduceat(border, starts)
    return out


def shape_areas(shapes: list) -> np.ndarray:
    rings, own = flat_shapes(shapes)
    return np.bincount(own, rings.areas(), len(shapes)) if len(rings) else np.zeros(len(shapes))


def contains(rings: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether a shape's rings cover each point: an odd number of them is around it, or it is on a border."""
    inside, border = np.zeros(len(x), bool), np.zeros(len(x), bool)
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, np.roll(ring, -1, 0), strict=True):
            cross = (x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)
            border |= (cross == 0) & (np.minimum(x0, x1) <= x) & (x <= np.maximum(x0, x1)) & (np.minimum(y0, y1) <= y) & (y <= np.maximum(y0, y1))
            if y0 != y1:
                inside ^= ((y0 > y) != (y1 > y)) & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
    return inside | border


def inner_point(ring: np.ndarray) -> tuple[float, float]:
    """A point inside: the middle of the widest stretch at half height between vertices near the centre."""
    ys = np.unique(ring[:, 1])
    mid = (ys.min() + ys.max()) / 2
    k = int(np.clip(np.searchsorted(ys, mid), 1, len(ys) - 1))
    y = (ys[k - 1] + ys[k]) / 2
    xs = sorted(float((x1 - x0) * (y - y0) / (y1 - y0) + x0) for (x0, y0), (x1, y1) in zip(ring, np.roll(ring, -1, 0), strict=True) if (y0 > y) != (y1 > y))
    a, b = max(zip(xs[::2], xs[1::2], strict=True), key=lambda s: s[1] - s[0])
    return (a + b) / 2, float(y)


def open_ring(ring) -> np.ndarray:
    """A ring's points without those that repeat the one before."""
    points = np.array([np.asarray(p, float) for p in ring], float).reshape(-1, 2)
    return points[(points != np.roll(points, 1, 0)).any(1)] if len(points) > 1 else points


def normal_ring(ring, clockwise: bool = True) -> np.ndarray:
    """A closed ring in one direction from its least point, of several equal ones the one with the least points behind it."""
    points = open_ring(ring)
    if not len(points):
        return points
    if (area(points) > 0) == clockwise:
        points = points[::-1]
    least = np.flatnonzero((points == points[np.lexsort((points[:, 1], points[:, 0]))[0]]).all(1))
    points = min((np.roll(points, -int(k), 0) for k in least), key=lambda p: p.tolist() if len(least) > 1 else [])
    return np.vstack([points, points[:1]])


def polygons_of(shape) -> list[list]:
    """The polygons of a shape, each a shell and its holes: of a ring, a polygon or several."""
    depth, inner = 0, shape
    while hasattr(inner, "__len__") and len(inner):
        depth, inner = depth + 1, inner[0]
    return [] if not depth else [[shape]] if depth <= 2 else [list(shape)] if depth == 3 else [list(p) for p in shape]


def normal_form(shape) -> bytes:
    """Well-known binary of a shape's polygons: shells clockwise, holes the other way, from their least points, in ascending order. Equal for equal shapes."""
    polygons = sorted([normal_ring(p[0]).tolist(), *sorted(normal_ring(h, False).tolist() for h in p[1:])] for p in polygons_of(shape))
    made = [b"\x01" + np.array([3, len(rings)], "<u4").tobytes() + b"".join(np.array([len(r)], "<u4").tobytes() + np.array(r, "<f8").tobytes() for r in rings) for rings in polygons]
    return made[0] if len(made) == 1 else b"\x01" + np.array([6, len(made)], "<u4").tobytes() + b"".join(made)


@F.pandas_udf(T.BinaryType())
def shape_form(shape: pd.Series) -> pd.Series:
    """:func:`normal_form` of shapes, null for null."""
    return pd.Series([normal_form(s) if s is not None else None for s in shape], dtype=object)


def circle(x: float, y: float, r: float, quarter: int = 64) -> np.ndarray:
    """A circle as a polygon with ``quarter`` edges to a quarter, clockwise from the east."""
    t = -np.arange(4 * quarter) * math.pi / (2 * quarter)
    return np.stack([x + r * np.cos(t), y + r * np.sin(t)], 1)


def voronoi(sites: np.ndarray, k: int, frame: np.ndarray) -> np.ndarray:
    """The part of a convex frame that is nearer to site k than to any other."""
    ring = frame
    for j in np.argsort(np.hypot(*(sites - sites[k]).T), kind="stable").tolist():
        if j != k and len(ring):
            d = sites[j] - sites[k]
            ring = clip_half_plane(ring, d[0], d[1], float(d @ (sites[j] + sites[k]) / 2))
    return ring


def clip_line(line: np.ndarray, ring: np.ndarray) -> list[np.ndarray]:
    """The stretches of a line inside a ring, without points."""
    out: list[list[np.ndarray]] = []
    for p, q in zip(line[:-1], line[1:], strict=True):
        cuts = [0.0, 1.0]
        for a, b in zip(ring, np.roll(ring, -1, 0), strict=True):
            d, e = q - p, b - a
            den = d[0] * e[1] - d[1] * e[0]
            if den:
                t, u = ((a[0] - p[0]) * e[1] - (a[1] - p[1]) * e[0]) / den, ((a[0] - p[0]) * d[1] - (a[1] - p[1]) * d[0]) / den
                if 0 < t < 1 and 0 <= u <= 1:
                    cuts.append(float(t))
        cuts = sorted(set(cuts))
        for s, t in zip(cuts[:-1], cuts[1:], strict=True):
            mid = p + (q - p) * (s + t) / 2
            if contains([ring], np.array([mid[0]]), np.array([mid[1]]))[0]:
                a, b = p + (q - p) * s, p + (q - p) * t
                if out and np.allclose(out[-1][-1], a):
                    out[-1].append(b)
                else:
                    out.append([a, b])
    return [np.array(x) for x in out]


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """From a point to a segment of the plane."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / square))).otherwise(0.0)
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


#: Nodes and weights of Gauss and Legendre for what is integrated along a geodesic.
NODES, WEIGHTS = np.polynomial.legendre.leggauss(24)
#: Square of the authalic radius; the ellipsoid's area is 4 pi times this.
AUTHALIC2 = SEMI_MAJOR**2 / 2 + SEMI_MAJOR**2 * (1 - FLATTENING) ** 2 / 2 * math.atanh(E1) / E1


def _auxiliary(lat1: np.ndarray, lat2: np.ndarray, dlon: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of geodesics between latitudes (radians) over a difference of longitude: reduced latitudes, difference of longitude on the auxiliary sphere, sine and cosine of the azimuth at the equator, and arcs from the equator.

    The longitude is found by going round: the sphere's difference gives the azimuth, along which the ellipsoid's correction is integrated.
    """
    b1, b2 = (np.arctan((1 - FLATTENING) * np.tan(v)) for v in (lat1, lat2))
    omega = dlon.copy()
    ep2 = E2 / (1 - E2)
    for _ in range(60):
        y, x = np.cos(b2) * np.sin(omega), np.cos(b1) * np.sin(b2) - np.sin(b1) * np.cos(b2) * np.cos(omega)
        far = np.hypot(x, y)
        with np.errstate(all="ignore"):
            s1 = np.where(far > 0, y / far, 0.0)
            c1 = np.where(far > 0, x / far, 1.0)
        sin0 = s1 * np.cos(b1)
        cos0 = np.hypot(c1, s1 * np.sin(b1))
        arc1 = np.where((b1 == 0) & (c1 == 0), 0.0, np.arctan2(np.sin(b1), c1 * np.cos(b1)))
        arc2 = arc1 + np.arctan2(far, np.sin(b1) * np.sin(b2) + np.cos(b1) * np.cos(b2) * np.cos(omega))
        k2 = (ep2 * cos0**2)[:, None]
        t = (arc1 + arc2)[:, None] / 2 + (arc2 - arc1)[:, None] / 2 * NODES
        slow = (2 - FLATTENING) / (1 + (1 - FLATTENING) * np.sqrt(1 + k2 * np.sin(t) ** 2))
        new = dlon + FLATTENING * sin0 * (slow @ WEIGHTS) * (arc2 - arc1) / 2
        done = np.max(np.abs(new - omega), initial=0.0) <= 1e-16
        omega = new
        if done:
            break
    return b1, b2, omega, sin0, cos0, arc1, arc2


def _excess(x: np.ndarray) -> np.ndarray:
    """t(x) = x + sqrt(1 / x + 1) asinh(sqrt(x)), with its limit 1 + ... at 0."""
    root = np.sqrt(np.maximum(x, 1e-300))
    return x + np.where(x > 1e-14, np.sqrt(1 + np.maximum(x, 1e-300)) * np.arcsinh(root) / root, 1.0)


def under_geodesics(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Square metres between geodesics and the equator, positive for those to the east in the north, and their differences of longitude, at most half a turn.

    Each edge's area is the excess on the auxiliary sphere, and what the ellipsoid adds to it, integrated along the edge.
    """
    dlon = np.radians(np.remainder(np.asarray(lon2, float) - np.asarray(lon1, float) + 180, 360) - 180)
    p1, p2 = (np.radians(np.asarray(v, float)) for v in (lat1, lat2))
    b1, b2, omega, sin0, cos0, arc1, arc2 = _auxiliary(p1, p2, dlon)
    h1, h2 = np.tan(b1 / 2), np.tan(b2 / 2)
    excess = 2 * np.arctan2(np.sin(omega / 2) * (h1 + h2), np.cos(omega / 2) * (1 + h1 * h2))
    ep2 = E2 / (1 - E2)
    t = (arc1 + arc2)[:, None] / 2 + (arc2 - arc1)[:, None] / 2 * NODES
    k2 = (ep2 * cos0**2)[:, None] * np.sin(t) ** 2
    gap = ep2 - k2
    near = gap < 1e-9
    slope = (_excess(np.full_like(k2, ep2)) - _excess(k2)) / np.where(near, 1.0, gap)
    slope = np.where(near, 4 / 3, slope)  # only where an edge runs along a meridian, over the pole, and the term counts nothing
    more = -((slope * np.sin(t) / 2) @ WEIGHTS) * (arc2 - arc1) / 2
    return AUTHALIC2 * excess + E2 * SEMI_MAJOR**2 * cos0 * sin0 * more, dlon


def geodesic_areas(shapes: list) -> np.ndarray:
    """Square metres inside of shapes of longitudes and latitudes whose edges are geodesics; any number of rings, those within others being holes.

    A ring may cross the antimeridian. One that goes round a pole encloses it. Rings are taken as the smaller side of what they part the ellipsoid into.
    """
    out = np.zeros(len(shapes))
    for i, shape in enumerate(shapes):
        rings = [np.array([np.asarray(p, float) for p in r], float).reshape(-1, 2) for r in shape_rings(shape)]
        found = []
        for ring in rings:
            after = np.roll(ring, -1, 0)
            own, turns = under_geodesics(ring[:, 0], ring[:, 1], after[:, 0], after[:, 1])
            total = abs(float(own.sum()))
            if abs(float(turns.sum())) > math.pi:  # round a pole
                total = 2 * math.pi * AUTHALIC2 - total
            found.append(min(total, 4 * math.pi * AUTHALIC2 - total))
        plane = [np.stack([np.rad2deg(np.unwrap(np.radians(r[:, 0]))), r[:, 1]], 1) for r in rings]
        for k, ring in enumerate(plane):
            depth = 0
            larger = [other for j, other in enumerate(plane) if found[j] > found[k]]
            if larger and len(ring) > 2 and area(ring) != 0:
                x, y = (np.array([v]) for v in inner_point(ring))
                depth = sum(bool(contains([other], x, y)[0]) for other in larger)
            out[i] += found[k] * (1 if depth % 2 == 0 else -1)
    return out


@F.pandas_udf(T.DoubleType())
def geodesic_area(shape: pd.Series) -> pd.Series:
    """Square metres of shapes of longitudes and latitudes on the ellipsoid; null and empty ones have none."""
    return pd.Series(geodesic_areas([s if s is not None else [] for s in shape]), dtype="float64")
