"""Union, difference, intersection, buffers and outlines of areas, in the cells of a grid.

Shapes are cut into cells; what meets in a cell is overlaid there, exactly on the cell's lattice. Areas add up over cells.
An outline is put together by exchanges: edges on the borders of cells cancel where the area goes on, what remains is joined
end to end, and rings find their first piece by pointer doubling. No task holds more than a cell or a piece of a ring.

A *piece* is a row of keys, ``_cx``, ``_cy`` and ``edges``: five numbers for each edge, its ends on the cell's lattice and its layer.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolith.functions import overlay as kernel
from geolith.functions.geo import circle, flat_shapes, open_ring, polygons_of, shape_rings
from geolith.functions.overlay import STEPS
from geolith.operators.spatial import cut_to_cells, levels
from geolith.operators.tables import Stored, small

#: Side of a cell; a power of two makes halves, quarters and so on exact.
SIZE = 1024.0
#: Edges of one cell that are overlaid at once; more of a union are joined in several turns.
MOST_EDGES = 20_000
CELL = ("_cx", "_cy")
LONGS = T.ArrayType(T.LongType())


def _kept(df: DataFrame, names: Sequence[str]) -> list[T.StructField]:
    return [df.schema[n] for n in names]


def _filled(ring: DataFrame, column: str) -> DataFrame:
    return ring.where(F.col(column).isNotNull() & (F.size(column) > 0))


def cut(shapes: DataFrame, keys: Sequence[str], layer: int = 0, size: float = SIZE) -> DataFrame:
    """The pieces of shapes (``ring``: a ring, a polygon with holes or several polygons) in the cells they touch; a null or empty shape has none."""
    schema = T.StructType([*_kept(shapes, keys), *(T.StructField(c, T.LongType()) for c in CELL), T.StructField("edges", LONGS)])

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rings, own = flat_shapes(frame["ring"].tolist())
            parts, row, at = cut_to_cells(rings, size)
            box = np.stack([at["x"], at["y"]], 1) if len(row) else np.zeros((0, 2), np.int64)
            ring = parts.ring
            points = np.clip(np.rint(np.stack([parts.x, parts.y], 1) / (size / STEPS)).astype(np.int64) - box[ring] * STEPS, 0, STEPS)
            edges = np.hstack([points, points[parts.following], np.full((len(points), 1), layer)]) if len(points) else np.zeros((0, 5), np.int64)
            which = np.stack([own[row[ring]], *box[ring].T], 1) if len(points) else np.zeros((0, 3), np.int64)
            order = np.lexsort(which.T[::-1])
            which, edges = which[order], edges[order]
            new = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]).any(1)])) if len(which) else np.zeros(0, np.int64)
            found = which[new]
            out = {k: frame[k].to_numpy()[found[:, 0]] for k in keys} | {c: found[:, i + 1] for i, c in enumerate(CELL)}
            lists = pd.Series([e.ravel() for e in np.split(edges, new[1:])] if len(new) else [], dtype=object)
            yield pd.DataFrame(out | {"edges": lists}, columns=[f.name for f in schema])

    return _filled(shapes.select(*keys, "ring"), "ring").mapInPandas(work, schema)


def overlaid(pieces: DataFrame, keys: Sequence[str], layers: int, rule: Callable[..., np.ndarray], size: float = SIZE) -> DataFrame:
    """For each key and cell: ``edges`` around the points for which ``rule`` of their layers holds, as a piece of layer 0, and ``area``.

    ``rule`` takes a boolean array for each layer, as ``lambda a, b: a & ~b``. It must not hold for points in no layer.
    """
    schema = T.StructType([*_kept(pieces, keys), *(T.StructField(c, T.LongType()) for c in CELL), T.StructField("edges", LONGS), T.StructField("area", T.DoubleType())])

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lists, areas = [], np.zeros(len(frame))
            for k, flat in enumerate(frame["edges"]):
                rows = np.asarray(flat, np.int64).reshape(-1, 5)
                counts = np.zeros((len(rows), layers), np.int64)
                counts[np.arange(len(rows)), rows[:, 4]] = 1
                found = kernel.overlay(rows[:, :4], counts, rule)
                areas[k] = kernel.doubled_area(found) / 2 * (size / STEPS) ** 2
                lists.append(np.hstack([found, np.zeros((len(found), 1), np.int64)]).ravel())
            frame = frame.assign(edges=pd.Series(lists, dtype=object, index=frame.index), area=areas)
            yield frame[[f.name for f in schema]][[len(x) > 0 for x in lists]]

    met = pieces.groupBy(*keys, *CELL).agg(F.flatten(F.collect_list("edges")).alias("edges"))
    return met.mapInPandas(work, schema)


def dissolved(pieces: DataFrame, keys: Sequence[str], size: float = SIZE, most: int = MOST_EDGES) -> DataFrame:
    """The union of all pieces of a key (all in one layer). Cells of more than ``most`` edges are joined in parts first."""
    stored = Stored(pieces.sparkSession)
    only = lambda a: a
    pieces = stored(pieces)
    hot = pieces.groupBy(*keys, *CELL).agg(F.sum(F.size("edges") / 5).alias("_n")).where(F.col("_n") > most)
    hot = stored(hot.select(*keys, *CELL, F.ceil(F.col("_n") / most).alias("_parts")))
    if not hot.isEmpty():
        on = [*keys, *CELL]
        salted = pieces.join(small(hot), on).withColumn("_part", F.pmod(F.xxhash64("edges"), F.col("_parts"))).drop("_parts")
        parts = overlaid(salted.distinct(), [*keys, "_part"], 1, only, size).drop("area", "_part")
        pieces = pieces.join(small(hot), on, "left_anti").union(parts.select(*pieces.columns))
    return overlaid(pieces, keys, 1, only, size)


def areas(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys and ``area``."""
    return cells.groupBy(*keys).agg(F.sum("area").alias("area"))


def layered(cells: DataFrame, layer: int) -> DataFrame:
    """Overlaid cells as pieces of another layer."""
    moved = F.transform("edges", lambda e, i: F.when(i % 5 == 4, F.lit(layer).cast("long")).otherwise(e))
    return cells.withColumn("edges", moved).drop("area")


def on_cells_of(pieces: DataFrame, others: DataFrame, keys: Sequence[str], common: Sequence[str] = ()) -> DataFrame:
    """The pieces of shapes without a key, for each key of ``others`` that has a piece in the same cell (and equal values of ``common``)."""
    wanted = others.select(*keys, *CELL, *(c for c in common if c not in keys)).distinct()
    return wanted.join(pieces, [*CELL, *common]).select(*keys, *CELL, "edges")


def capsules(shapes: DataFrame, keys: Sequence[str], radius: str | float, quarter: int = 16) -> DataFrame:
    """Rings whose union is all that lies within ``radius`` of a shape: the shape, and a ring around each of its edges; a point's is a circle.

    ``radius`` is a number or a column; arcs have ``quarter`` edges to a quarter circle. ``ring`` may be a point, a line or an area; with
    ``line`` in place of it, ends are not joined.
    """
    line = "line" in shapes.columns
    far = F.col(radius) if isinstance(radius, str) else F.lit(float(radius))
    source = shapes.select(*keys, F.col("line" if line else "ring").alias("ring"), far.alias("_far"))
    schema = T.StructType([*_kept(shapes, keys), T.StructField("ring", T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))))])
    point = levels(source, "ring") == 1

    def around(p: np.ndarray, q: np.ndarray, r: float) -> list:
        if (p == q).all():
            return circle(*p, r, quarter).tolist()
        a = math.atan2(*(q - p)[::-1])
        t = np.arange(2 * quarter + 1) * math.pi / (2 * quarter)
        side = lambda c, b: np.stack([c[0] + r * np.cos(b + t), c[1] + r * np.sin(b + t)], 1)
        return np.vstack([side(q, a - math.pi / 2), side(p, a + math.pi / 2)]).tolist()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows, rings = [], []
            for k, (shape, r) in enumerate(zip(frame["ring"], frame["_far"], strict=True)):
                for found in [[shape]] if point else shape_rings(shape):
                    p = np.array([np.asarray(x, float) for x in found]).reshape(-1, 2)
                    ends = p[1:] if line and len(p) > 1 else np.roll(p, -1, 0)
                    made = [[around(a, b, r)] for a, b in zip(p, ends, strict=False) if len(p) == 1 or (a != b).any()]
                    rows += [k] * len(made)
                    rings += made
                if not point and not line:
                    rows.append(k)
                    rings.append([[list(map(float, x)) for x in found] for found in shape_rings(shape)])
            yield pd.DataFrame({c: frame[c].to_numpy()[rows] for c in keys} | {"ring": pd.Series(rings, dtype=object)}, columns=[f.name for f in schema])

    return _filled(source, "ring").where(F.col("_far") > 0).mapInPandas(work, schema)


def stretches(lines: DataFrame, line_id: str, size: float = SIZE) -> DataFrame:
    """The stretches of lines (``line``: an array of points), cut at the borders of cells: line, _k, its number, from _s to _e of it, _cx, _cy, and ``at``, its ends on the cell's lattice."""
    schema = T.StructType([lines.schema[line_id], *(T.StructField(c, k) for c, k in (("_k", T.LongType()), ("_s", T.DoubleType()), ("_e", T.DoubleType()), ("_cx", T.LongType()), ("_cy", T.LongType()), ("at", T.ArrayType(T.DoubleType()))))])

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, line in zip(frame[line_id], frame["line"], strict=True):
                p = np.array([np.asarray(x, float) for x in line], float).reshape(-1, 2)
                rows = []
                for k, (a, b) in enumerate(zip(p[:-1], p[1:], strict=True)):
                    if (a == b).all():
                        continue
                    cuts = [np.array([0.0, 1.0])]
                    for c in (0, 1):
                        lo, hi = sorted((a[c], b[c]))
                        at = np.arange(np.floor(lo / size) + 1, np.ceil(hi / size)) * size
                        cuts.append((at - a[c]) / (b[c] - a[c]) if len(at) else at)
                    t = np.unique(np.concatenate(cuts))
                    rows.append(np.column_stack([np.full(len(t) - 1, k), t[:-1], t[1:], a + np.outer(t[:-1], b - a), a + np.outer(t[1:], b - a)]))
                if rows:
                    r = np.vstack(rows)
                    cell = np.floor((r[:, 3:5] + r[:, 5:7]) / 2 / size)
                    local = np.clip((r[:, 3:] - np.tile(cell, 2) * size) / (size / STEPS), 0, STEPS)
                    yield pd.DataFrame({line_id: [name] * len(r), "_k": r[:, 0].astype(np.int64), "_s": r[:, 1], "_e": r[:, 2], "_cx": cell[:, 0].astype(np.int64), "_cy": cell[:, 1].astype(np.int64), "at": pd.Series(list(local), dtype=object)})

    return lines.where(F.size("line") > 1).select(line_id, "line").mapInPandas(work, schema)


def lines_within(lines: DataFrame, pieces: DataFrame, line_id: str, keys: Sequence[str], size: float = SIZE, most: int = 2000) -> DataFrame:
    """The parts of lines inside of or on areas, given as pieces or overlaid cells: line, keys, ``part``, ``length`` and ``line`` (its points).

    Lines are cut at the borders of cells and at the areas' edges there; what is inside is joined again along the line. Points and
    parts without length go. A cell takes ``most`` stretches of lines at a time.
    """
    cut_ = Stored(lines.sparkSession)(stretches(lines, line_id, size))
    parts = cut_.groupBy(*CELL).agg(F.ceil(F.count("*") / most).alias("_parts"))
    row = F.struct(F.col(line_id).alias("line"), *(F.col(c).alias(c[1:]) for c in ("_k", "_s", "_e")), "at")
    groups = cut_.join(parts, list(CELL)).groupBy(*CELL, F.pmod(F.xxhash64(line_id, "_k", "_s"), F.col("_parts")).alias("_part")).agg(F.collect_list(row).alias("own"))
    schema = T.StructType([lines.schema[line_id], *_kept(pieces, keys), T.StructField("_k", T.LongType()), T.StructField("_s", T.DoubleType()), T.StructField("_e", T.DoubleType())])

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for n, (own, flat) in enumerate(zip(frame["own"], frame["edges"], strict=True)):
                which, s, e = kernel.inside_stretches(np.array([np.asarray(r["at"], float) for r in own]).reshape(-1, 4), np.asarray(flat, np.int64).reshape(-1, 5)[:, :4].astype(float))
                of = [own[w] for w in which.tolist()]
                low, high = (np.array([r[c] for r in of], float) for c in "se")
                yield pd.DataFrame({line_id: [r["line"] for r in of], **{k: [frame[k].iloc[n]] * len(of) for k in keys}, "_k": np.array([r["k"] for r in of], np.int64), "_s": low + (high - low) * s, "_e": low + (high - low) * e}, columns=[f.name for f in schema])

    found = groups.join(pieces.select(*keys, *CELL, "edges"), list(CELL)).select("own", "edges", *keys).mapInPandas(work, schema)
    along = Window.partitionBy(line_id, *keys).orderBy("_k", "_s")
    gap = F.col("_k") + F.col("_s") - F.lag(F.col("_k") + F.col("_e")).over(along) > 1e-9
    found = found.withColumn("part", F.sum(F.coalesce(gap, F.lit(True)).cast("long")).over(along) - 1)
    # Consecutive stretches of one straight piece are one; each piece has its ends.
    found = found.groupBy(line_id, *keys, "part", "_k").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"))
    found = found.join(lines.select(F.col(line_id), F.col("line").alias("_line")), line_id)
    at = lambda t, c: F.col("_line")[F.col("_k").cast("int")][c] + (F.col("_line")[F.col("_k").cast("int") + 1][c] - F.col("_line")[F.col("_k").cast("int")][c]) * F.col(t)
    ends = found.select(line_id, *keys, "part", "_k", F.array(at("_s", 0), at("_s", 1)).alias("_a"), F.array(at("_e", 0), at("_e", 1)).alias("_b"))
    length = F.hypot(F.col("_b")[0] - F.col("_a")[0], F.col("_b")[1] - F.col("_a")[1])
    whole = ends.groupBy(line_id, *keys, "part").agg(F.sum(length).alias("length"), F.array_sort(F.collect_list(F.struct("_k", "_a", "_b"))).alias("_p"))
    points = F.concat(F.array(F.get("_p", F.lit(0))["_a"]), F.transform("_p", lambda p: p["_b"]))
    return whole.where("length > 0").select(line_id, *keys, "part", "length", points.alias("line"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def shape_faults(shape: pd.Series) -> pd.Series:
    """What is wrong with shapes (a ring, a polygon or several): an empty array for valid ones, null for null; see :func:`geolith.functions.overlay.faults`."""
    return pd.Series([kernel.faults([[open_ring(r) for r in p] for p in polygons_of(s)]) if s is not None else None for s in shape], dtype=object)


def _lines(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys, xs, ys on the lattice of the plane, ``seam``: the lines of a cell's edges from border to border, and its edges on the border."""
    schema = T.StructType([*_kept(cells, keys), T.StructField("xs", LONGS), T.StructField("ys", LONGS), T.StructField("seam", T.BooleanType())])

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows, xs, ys, seam = [], [], [], []
            for k, (flat, cx, cy) in enumerate(zip(frame["edges"], frame["_cx"], frame["_cy"], strict=True)):
                lines, rest = kernel.chains(np.asarray(flat, np.int64).reshape(-1, 5)[:, :4])
                lines += list(rest.reshape(-1, 2, 2))
                xs += [x[:, 0] + cx * STEPS for x in lines]
                ys += [x[:, 1] + cy * STEPS for x in lines]
                seam += [False] * (len(lines) - len(rest)) + [True] * len(rest)
                rows += [k] * len(lines)
            yield pd.DataFrame({c: frame[c].to_numpy()[rows] for c in keys} | {"xs": pd.Series(xs, dtype=object), "ys": pd.Series(ys, dtype=object), "seam": np.array(seam, bool)}, columns=[f.name for f in schema])

    return cells.select(*keys, *CELL, "edges").mapInPandas(work, schema)


def _borders(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What remains of the edges on borders of cells where those of both sides don't cancel: keys, xs, ys."""
    a, b = (F.array(F.col("xs")[i], F.col("ys")[i]) for i in (0, 1))
    upright = F.col("xs")[0] == F.col("xs")[1]
    own = lines.where("seam").select(*keys, upright.alias("up"), F.when(upright, F.col("xs")[0]).otherwise(F.col("ys")[0]).alias("at"), *(F.when(upright, p[1]).otherwise(p[0]).alias(n) for p, n in ((a, "f"), (b, "t"))))
    low, sign = F.least("f", "t"), F.signum(F.col("t") - F.col("f")).cast("long")
    ends = F.explode(F.array(F.struct(low.alias("pos"), sign.alias("d")), F.struct(F.greatest("f", "t").alias("pos"), (-sign).alias("d"))))
    side = [*keys, "up", "at", "band"]
    sums = own.select(*keys, "up", "at", F.floor(low / STEPS).alias("band"), ends.alias("e")).groupBy(*side, "e.pos").agg(F.sum("e.d").alias("d"))
    along = Window.partitionBy(*side).orderBy("pos")
    rest = sums.withColumn("n", F.sum("d").over(along)).withColumn("next", F.lead("pos").over(along)).where("n <> 0 and next is not null")
    ends = F.when(F.col("n") > 0, F.array("pos", "next")).otherwise(F.array("next", "pos"))
    same = F.array("at", "at")
    return rest.select(*keys, F.when(F.col("up"), same).otherwise(ends).alias("xs"), F.when(F.col("up"), ends).otherwise(same).alias("ys"))


def outline(cells: DataFrame, keys: Sequence[str], size: float = SIZE) -> DataFrame:
    """The rings around overlaid cells: keys, ``ring`` (a number), ``seq``, ``xs``, ``ys``; the pieces of a ring by seq, each from the end of the one before to its own end.

    Areas lie on the left. Rings that touch in a point stay apart. Edges may be cut where they cross the grid.
    """
    stored = Stored(cells.sparkSession)
    names, keys = list(keys), [f"_key{i}" for i in range(len(keys))]  # a key may be called as a column here is
    lines = stored(_lines(cells.select(*(F.col(n).alias(k) for n, k in zip(names, keys, strict=True)), *CELL, "edges"), keys))
    closed = (F.element_at("xs", 1) == F.element_at("xs", -1)) & (F.element_at("ys", 1) == F.element_at("ys", -1))
    whole = lines.where(~F.col("seam") & closed).withColumn("ring", -1 - F.monotonically_increasing_id()).select(*keys, "ring", F.lit(0).cast("long").alias("seq"), "xs", "ys")
    open_ = lines.where(~F.col("seam") & ~closed).select(*keys, "xs", "ys").union(_borders(lines, keys))
    arcs = stored(open_.withColumn("id", F.monotonically_increasing_id()))
    step = lambda c, i, j: F.element_at(c, i) - F.element_at(c, j)
    ends = arcs.select(*keys, "id", F.element_at("xs", -1).alias("x"), F.element_at("ys", -1).alias("y"), F.atan2(step("ys", -1, -2), step("xs", -1, -2)).alias("a"))
    starts = arcs.select(*keys, F.col("id").alias("next"), F.element_at("xs", 1).alias("x"), F.element_at("ys", 1).alias("y"), F.atan2(step("ys", 2, 1), step("xs", 2, 1)).alias("b"))
    round_ = F.pmod(F.col("a") + math.pi - F.col("b"), F.lit(2 * math.pi))
    after = ends.join(starts, [*keys, "x", "y"]).groupBy("id").agg(F.min(F.struct(F.when(round_ < 1e-12, 2 * math.pi).otherwise(round_), "next")).alias("n"))
    state, far = stored(after.select("id", "n.next", F.col("id").alias("ring"), F.lit(0).cast("long").alias("d"))), 1
    while True:
        other = state.select(F.col("id").alias("next"), F.col("next").alias("then"), F.col("ring").alias("least"), F.col("d").alias("more"))
        less = F.col("least") < F.col("ring")
        new = stored(state.join(other, "next").select("id", F.col("then").alias("next"), F.least("ring", "least").alias("ring"), F.when(less, F.col("more") + far).otherwise(F.col("d")).alias("d"), less.alias("moved")))
        more = not new.where("moved").isEmpty()
        stored.drop(state)
        state, far = new, 2 * far
        if not more:
            break
    found = arcs.join(state.select("id", "ring", (-F.col("d")).alias("seq")), "id").select(*keys, "ring", "seq", "xs", "ys")
    unit = size / STEPS
    return found.union(whole).select(*(F.col(k).alias(n) for n, k in zip(names, keys, strict=True)), "ring", "seq", *(F.transform(c, lambda v: v * F.lit(unit)).alias(c) for c in ("xs", "ys")))


def shapes_of(rings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys and ``ring``, the rings of each key as one shape; for outlines that fit into a row."""
    points = F.arrays_zip(F.col("xs").alias("x"), F.col("ys").alias("y"))
    parts = F.array_sort(F.collect_list(F.struct("seq", F.slice(points, 2, F.size(points)).alias("p"))))
    one = rings.groupBy(*keys, "ring").agg(parts.alias("parts"))
    one = one.select(*keys, F.transform(F.flatten(F.transform("parts", lambda p: p["p"])), lambda p: F.array(p["x"], p["y"])).alias("one"))
    return one.groupBy(*keys).agg(F.collect_list("one").alias("ring"))

