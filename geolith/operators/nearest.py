"""Nearest partners over a k-d partition of the right side.

The right side lies in leaves of some thousand rows, whose boxes the driver knows. A point visits the leaf with the nearest
box first, then, in order of their distance, those whose boxes are nearer than its best partner. A leaf takes its visitors in
groups of bounded size, so that neither a far outlier nor a dense region makes a large task. A right side of few rows is sent to
all tasks, and points find their partners where they are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolith.functions.scalars import finite
from geolith.operators.tables import BROADCAST_ROWS, Stored

#: Rows of a leaf, leaves at most, and sampled rows to a leaf, which only shape the leaves.
LEAF_ROWS, MOST_LEAVES, SAMPLE = 2048, 8192, 32
#: Visitors that a leaf takes at once, and distances held at once.
VISITORS, HELD = 4096, 1 << 21
ENDS = ("ax", "ay", "bx", "by")


def segments(lines: DataFrame, line_id: str, longest: float, kx: float = 1.0, ky: float = 1.0) -> DataFrame:
    """The stretches of lines (``line``: an array of points) in a scaled plane, cut so that none is longer: id, ax, ay, bx, by."""
    ends = lines.where(F.size("line") > 1).select(line_id, F.explode(F.arrays_zip(F.slice("line", 1, F.size("line") - 1).alias("a"), F.slice("line", 2, F.size("line") - 1).alias("b"))).alias("s"))
    ends = ends.select(line_id, (F.col("s.a")[0] * kx).alias("ax"), (F.col("s.a")[1] * ky).alias("ay"), (F.col("s.b")[0] * kx).alias("bx"), (F.col("s.b")[1] * ky).alias("by"))
    n = F.greatest(F.lit(1), F.ceil(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) / longest)).cast("int")
    ends = ends.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = lambda c, k: (F.col(f"a{c}") + (F.col(f"b{c}") - F.col(f"a{c}")) * (k / F.col("n")))
    return ends.select(line_id, *(at(c, F.col("k") + i).alias(f"{p}{c}") for p, i in (("a", 0), ("b", 1)) for c in "xy"))


def planes(points: np.ndarray, leaves: int) -> list[tuple[int, float, int, int]]:
    """A tree that halves points at the median of their wider side: axis, value, and the numbers of both children, negative for leaves."""
    tree: list[tuple[int, float, int, int]] = []
    made = 0

    def split(own: np.ndarray, n: int) -> int:
        nonlocal made
        axis = int(np.argmax(np.ptp(own, 0))) if len(own) else 0
        value = float(np.median(own[:, axis])) if len(own) else 0.0
        low = own[:, axis] < value
        if n <= 1 or not low.any():
            made += 1
            return -made
        node = len(tree)
        tree.append((axis, value, 0, 0))
        tree[node] = (axis, value, split(own[low], n // 2), split(own[~low], n - n // 2))
        return node

    split(points, leaves)
    return tree


def leaf_of(tree: list[tuple[int, float, int, int]]):
    """A function of columns x, y: the leaf of a point."""
    axis, value, left, right = (np.array(c) for c in zip(*tree, strict=True)) if tree else (np.zeros(0),) * 4

    @F.pandas_udf(T.IntegerType())
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        node = np.zeros(len(x), np.int64) if len(axis) else np.full(len(x), -1)
        points = np.stack([x.to_numpy(), y.to_numpy()])
        while (inner := np.flatnonzero(node >= 0)).size:
            at = node[inner]
            node[inner] = np.where(points[axis[at], inner] < value[at], left[at], right[at])
        return pd.Series(-node - 1, dtype="int32")

    return of


def partitioned(right: DataFrame, stored: Stored, rows: int) -> tuple[DataFrame, np.ndarray]:
    """One row for each leaf (leaf, rows by id) of a stored table (id, ax, ay, bx, by) of ``rows`` rows, and the leaves' boxes."""
    leaves = min(MOST_LEAVES, -(-rows // LEAF_ROWS))
    centre = [((F.col(f"a{c}") + F.col(f"b{c}")) / 2).alias(c) for c in "xy"]
    sample = right.select(*centre).sample(min(1.0, 1.2 * SAMPLE * leaves / rows), seed=7).limit(2 * SAMPLE * leaves).toPandas().to_numpy()
    tree = planes(sample.reshape(-1, 2), leaves)
    one = F.array_sort(F.collect_list(F.struct("id", *ENDS))).alias("rows")
    box = [f(F.least(f"a{c}", f"b{c}") if f is F.min else F.greatest(f"a{c}", f"b{c}")).alias(f"{n}{c}") for n, f in (("low", F.min), ("high", F.max)) for c in "xy"]
    made = stored(right.withColumn("leaf", leaf_of(tree)(*((F.col(f"a{c}") + F.col(f"b{c}")) / 2 for c in "xy"))).groupBy("leaf").agg(one, *box), rows_a_file=64)
    boxes = np.full((len(tree) + 1, 4), np.inf)
    for r in made.select("leaf", "lowx", "lowy", "highx", "highy").collect():
        boxes[r[0]] = r[1:]
    return made.select("leaf", "rows"), boxes


def bounds(boxes: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least distance of each point from each box; a little less, so that rounding excludes nothing."""
    dx = np.maximum(np.maximum(boxes[:, 0] - x[:, None], x[:, None] - boxes[:, 2]), 0)
    dy = np.maximum(np.maximum(boxes[:, 1] - y[:, None], y[:, None] - boxes[:, 3]), 0)
    return np.hypot(dx, dy) * (1 - 1e-12)


def to_visit(boxes: np.ndarray, x: np.ndarray, y: np.ndarray, best: np.ndarray, seen: int, more: int) -> tuple[np.ndarray, np.ndarray]:
    """Points and the leaves they visit next: from place ``seen`` to ``more`` places on in the order of their distances, if near enough."""
    points, leaves = [], []
    step = max(1, HELD // max(1, len(boxes)))
    for a in range(0, len(x), step):
        b = bounds(boxes, x[a : a + step], y[a : a + step])
        order = np.argsort(b, axis=1, kind="stable")[:, seen : seen + more]
        near = np.take_along_axis(b, order, 1)
        i, j = np.nonzero((near <= best[a : a + step, None]) & np.isfinite(near))
        points.append(i + a)
        leaves.append(order[i, j])
    return (np.concatenate(points), np.concatenate(leaves)) if points else (np.zeros(0, np.int64),) * 2


def best_of(ends: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest of some stretches (ax, ay, bx, by) to each point, the first among equals, and the distance."""
    which, far = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
    step = max(1, HELD // max(1, len(ends)))
    ax, ay, dx, dy = ends[:, 0], ends[:, 1], ends[:, 2] - ends[:, 0], ends[:, 3] - ends[:, 1]
    square = dx * dx + dy * dy
    lines = bool((square > 0).any())
    for a in range(0, len(x), step):
        px, py = x[a : a + step, None], y[a : a + step, None]
        if lines:
            t = np.clip(((px - ax) * dx + (py - ay) * dy) / np.where(square > 0, square, 1.0), 0.0, 1.0)
            d = np.hypot(px - (ax + t * dx), py - (ay + t * dy))
        else:
            d = np.hypot(px - ax, py - ay)
        which[a : a + step] = np.argmin(d, 1)
        far[a : a + step] = d[np.arange(len(d)), which[a : a + step]]
    return which, far


def _by_broadcast(points: DataFrame, parts: DataFrame, boxes: np.ndarray, kind: T.DataType) -> DataFrame:
    """All points' partners, with the counted right side at every task."""
    held: dict[int, tuple[list, np.ndarray]] = {r["leaf"]: ([x["id"] for x in r["rows"]], np.array([[x[c] for c in ENDS] for x in r["rows"]])) for r in parts.collect()}
    shared = points.sparkSession.sparkContext.broadcast(held)
    schema = T.StructType([points.schema["n"], T.StructField("id", kind), T.StructField("distance", T.DoubleType())])

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaves = shared.value
        for frame in frames:
            x, y = frame["x"].to_numpy(), frame["y"].to_numpy()
            best, ids = np.full(len(frame), np.inf), np.full(len(frame), None, object)
            rows, seen, more = np.arange(len(frame)), 0, 1
            while len(rows):
                i, leaf = to_visit(boxes, x[rows], y[rows], best[rows], seen, more)
                for k in np.unique(leaf).tolist():
                    own = rows[i[leaf == k]]
                    names, ends = leaves[k]
                    which, far = best_of(ends, x[own], y[own])
                    for p, w, d in zip(own.tolist(), which.tolist(), far.tolist(), strict=True):
                        if d < best[p] or d == best[p] and names[w] < ids[p]:
                            best[p], ids[p] = d, names[w]
                rows, seen, more = rows[np.unique(i)], seen + more, 4 * more
            yield pd.DataFrame({"n": frame["n"], "id": ids, "distance": best})

    return points.mapInPandas(work, schema)


def _by_visits(points: DataFrame, parts: DataFrame, boxes: np.ndarray, kind: T.DataType, stored: Stored) -> DataFrame:
    """All points' partners by rounds of visits."""
    shared = points.sparkSession.sparkContext.broadcast(boxes)
    visit = T.StructType([T.StructField("n", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("leaf", T.IntegerType())])
    found = T.StructType([*visit.fields[:3], T.StructField("distance", T.DoubleType()), T.StructField("id", kind)])

    def going(seen: int, more: int) -> Callable:
        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                i, leaf = to_visit(shared.value, *(frame[c].to_numpy() for c in ("x", "y", "best")), seen, more)
                yield frame[["n", "x", "y"]].iloc[i].assign(leaf=leaf.astype(np.int32))

        return work

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for visitors, rows in zip(frame["visitors"], frame["rows"], strict=True):
                p = np.array([[v["n"], v["x"], v["y"]] for v in visitors], object)
                x, y = p[:, 1].astype(float), p[:, 2].astype(float)
                which, far = best_of(np.array([[r[c] for c in ENDS] for r in rows]), x, y)
                yield pd.DataFrame({"n": p[:, 0].astype(np.int64), "x": x, "y": y, "distance": far, "id": [rows[w]["id"] for w in which.tolist()]})

    pending, out, seen, more = points.withColumn("best", F.lit(math.inf)), None, 0, 1
    while True:
        visits = stored(pending.select("n", "x", "y", "best").mapInPandas(going(seen, more), visit))
        counts = visits.groupBy("leaf").count().withColumn("parts", F.ceil(F.col("count") / VISITORS)).drop("count")  # a row for each leaf
        groups = visits.join(F.broadcast(counts), "leaf").groupBy("leaf", F.pmod(F.xxhash64("n"), F.col("parts")).alias("part")).agg(F.collect_list(F.struct("n", "x", "y")).alias("visitors"))
        rows = groups.join(parts, "leaf").select("visitors", "rows").mapInPandas(meet, found)
        if out is not None:
            rows = rows.union(out.join(visits.select("n").distinct(), "n", "left_semi").select("n", "x", "y", "distance", "id"))
        best = stored(rows.groupBy("n", "x", "y").agg(F.min(F.struct("distance", "id")).alias("b")).select("n", "x", "y", "b.distance", "b.id"))
        old, out = out, best if out is None else stored(out.join(best, "n", "left_anti").union(best))
        stored.drop(visits, *([old] if old is not None else []))
        seen, more = seen + more, 4 * more
        if seen >= len(boxes) or best.isEmpty():
            return out.select("n", "id", "distance")
        pending = best.withColumnRenamed("distance", "best")


def _partners(left: DataFrame, right: DataFrame, left_id: str, kind: T.DataType, most: int) -> DataFrame:
    """left id, _right and distance of the nearest right row (id, ax, ay, bx, by) of each left row (left id, x, y)."""
    stored = Stored(left.sparkSession)
    left = left.withColumnRenamed(left_id, "_left")
    points = stored(left.where(finite(F.col("x")) & finite(F.col("y"))).withColumn("n", F.monotonically_increasing_id()))
    for c in ENDS:
        right = right.where(finite(F.col(c)))
    right = stored(right.groupBy(*ENDS).agg(F.min("id").alias("id")).where(F.col("id").isNotNull()).select("id", *ENDS))
    rows = right.count()
    if not rows:
        return points.select(F.col("_left").alias(left_id), F.lit(None).cast(kind).alias("_right"), F.lit(0.0).alias("distance")).limit(0)
    parts, boxes = partitioned(right, stored, rows)
    found = _by_broadcast(points.select("n", "x", "y"), parts, boxes, kind) if rows <= most else _by_visits(points.select("n", "x", "y"), parts, boxes, kind, stored)
    best = points.select("n", "_left").join(found, "n").groupBy("_left").agg(F.min(F.struct("distance", "id")).alias("b"))
    return best.select(F.col("_left").alias(left_id), F.col("b.id").alias("_right"), F.col("b.distance").alias("distance"))


def nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, kx: float = 1.0, ky: float = 1.0, most: int = BROADCAST_ROWS // 4) -> DataFrame:
    """The nearest right point (x, y) of each left point in a plane scaled by (kx, ky), ties to the least id: (left id, right id, distance).

    Points without finite coordinates or a right id, and all points if the right side is empty, have no row; of points with one
    left id the nearest counts. ``most``: rows of the right side up to which it is sent to all tasks.
    """
    scaled = lambda df, name: df.select(name, (F.col("x") * kx).cast("double").alias("x"), (F.col("y") * ky).cast("double").alias("y"))
    own = scaled(right, right_id).select(F.col(right_id).alias("id"), *(F.col(c).alias(f"{p}{c}") for p in "ab" for c in "xy"))
    found = _partners(scaled(left, left_id), own, left_id, right.schema[right_id].dataType, most)
    return found.select(left_id, F.col("_right").alias(right_id), "distance")


def nearest_line(points: DataFrame, lines: DataFrame, point_id: str, kx: float = 1.0, ky: float = 1.0, start: float = 1.0, most: int = BROADCAST_ROWS // 4) -> DataFrame:
    """(point id, distance) to the union of lines (``line``: an array of points) in a scaled plane; without lines, and for points without coordinates, no row.

    ``start``: half the length of the stretches that lines are cut into.
    """
    own = segments(lines.withColumn("_line", F.monotonically_increasing_id()), "_line", 2 * start, kx, ky).withColumnRenamed("_line", "id")
    scaled = points.select(point_id, (F.col("x") * kx).cast("double").alias("x"), (F.col("y") * ky).cast("double").alias("y"))
    return _partners(scaled, own, point_id, T.LongType(), most).select(point_id, "distance")
