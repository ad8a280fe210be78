"""Spatial joins over cells: points and radii, nearest, polygons, overlaps.

Both sides get cells of a grid, one of them also the neighbouring or covered cells, and meet in an
equi-join that Spark shuffles, broadcasts or splits as it sees fit; an exact test follows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from geolith.functions.geo import Rings, area_edges, border_edges, common_areas, covered_points, fan, flat_shapes, intersection_areas, products, shape_areas, within_triangles
from geolith.operators.nearest import nearest, nearest_line, segments
from geolith.operators.tables import Stored


__all__ = ["nearest", "nearest_line", "segments"]


def _cells(df: DataFrame, x: Column, y: Column, size: float, around: int) -> DataFrame:
    cx, cy = F.floor(x / size), F.floor(y / size)
    if not around:
        return df.withColumn("_cx", cx).withColumn("_cy", cy)
    span = lambda c: F.explode(F.sequence(c - around, c + around))
    return df.withColumn("_cx", span(cx)).withColumn("_cy", span(cy))


def pairs_within(left: DataFrame, right: DataFrame, left_id: str, right_id: str, radius: float, kx: float = 1.0, ky: float = 1.0) -> DataFrame:
    """(left id, right id, distance) of points (x, y) at most ``radius`` apart in a plane scaled by (kx, ky)."""
    scaled = lambda df, name, p: df.select(F.col(name).alias(f"{p}_id"), (F.col("x") * kx).alias(f"{p}x"), (F.col("y") * ky).alias(f"{p}y"))
    a = _cells(scaled(left, left_id, "a"), F.col("ax"), F.col("ay"), radius, 0)
    b = _cells(scaled(right, right_id, "b"), F.col("bx"), F.col("by"), radius, 1)
    d = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    return a.join(b, ["_cx", "_cy"]).withColumn("distance", d).where(F.col("distance") <= radius).select(F.col("a_id").alias(left_id), F.col("b_id").alias(right_id), "distance")


def nearby_pairs(points: DataFrame, name: str, radius: float) -> DataFrame:
    """Pairs a < b of points at most ``radius`` apart."""
    other = points.select(F.col(name).alias("other"), "x", "y")
    return pairs_within(points, other, name, "other", radius).where(F.col(name) < F.col("other"))


def reached(buildings: DataFrame, places: DataFrame, building_id: str, place: str, size: float = 1000.0) -> DataFrame:
    """(building, place, distance, radius) of all places (x, y) whose own radius reaches a building (x, y); a place covers the cells its radius reaches."""
    b = _cells(buildings.select(building_id, "x", "y"), F.col("x"), F.col("y"), size, 0)
    p = places.select(F.col(place), F.col("x").alias("px"), F.col("y").alias("py"), "radius")
    for axis in ("x", "y"):
        c = F.col(f"p{axis}")
        p = p.withColumn(f"_c{axis}", F.explode(F.sequence(F.floor((c - F.col("radius")) / size), F.floor((c + F.col("radius")) / size))))
    d = F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))
    return b.join(p, ["_cx", "_cy"]).withColumn("distance", d).where(F.col("distance") <= F.col("radius")).select(building_id, place, "distance", "radius")


def assigned(buildings: DataFrame, places: DataFrame, building_id: str, place: str) -> DataFrame:
    """The place of each building: least of (distance / radius, distance, name) among places whose radius reaches it."""
    return best_places(buildings, places, building_id, place).select(building_id, F.col(f"best.{place}").alias(place), F.col("best.distance").alias("distance"))


def best_places(buildings: DataFrame, places: DataFrame, building_id: str, place: str, size: float = 1000.0) -> DataFrame:
    """building and ``best``: the least of (relative, distance, place) among places whose radius reaches it, relative being distance / radius.

    Where radii overlap much, a part of every radius is searched first, and a part twice as large for the buildings in which it
    found nothing: all places below the part were met then, so that the best of them is the best of all.
    """
    best = F.min(F.struct((F.col("distance") / F.col("radius")).alias("relative"), "distance", place)).alias("best")
    part, out, stored = first_part(buildings, places, size), None, None
    pending = buildings.select(building_id, "x", "y")
    while True:
        near = places.select(place, "x", "y", (F.col("radius") * part).alias("radius"))
        found = reached(pending, near, building_id, place, size * part).withColumn("radius", F.col("radius") / part).groupBy(building_id).agg(best)
        if part < 1:
            stored = stored or Stored(buildings.sparkSession)
            found = stored(found.where(F.col("best.relative") < part))  # a place that wasn't met has a relative distance of at least this
        out = found if out is None else out.union(found)
        if part >= 1:
            return out
        done = found.select(F.col(building_id).alias("_done"))
        pending = stored(pending.join(done, F.col(building_id).eqNullSafe(F.col("_done")), "left_anti"))
        if pending.isEmpty():
            return out
        part *= 2


def first_part(buildings: DataFrame, places: DataFrame, size: float, most: int = 256, few: int = 32) -> float:
    """The part of their radii, a power of two, in which places meet about ``few`` candidates for a building; 1 where whole radii give no more than ``most``."""
    at = _cells(buildings.select("x", "y"), F.col("x"), F.col("y"), size, 0).groupBy("_cx", "_cy").agg(F.count("*").alias("n"))
    boxes = places.where("radius >= 0").select(*((F.col(k) + F.col("radius") * i).alias(f"{k}{e}") for k in "xy" for e, i in ((0, -1), (1, 1))))
    covers = box_cells(boxes, size).groupBy("_cx", "_cy").agg(F.count("*").alias("m"))
    met, n = at.join(covers, ["_cx", "_cy"], "left").agg(F.sum(F.col("n").cast("double") * F.coalesce("m", F.lit(0))), F.sum("n")).first()
    candidates = (met or 0.0) / (n or 1)
    return 1.0 if candidates <= most else 2.0 ** max(-20, math.floor(math.log2(few / candidates) / 2))


def box_cells(df: DataFrame, size: float) -> DataFrame:
    """One row for each cell that a row's box (x0, y0, x1, y1) touches."""
    for axis in ("x", "y"):
        df = df.withColumn(f"_c{axis}", F.explode(F.sequence(F.floor(F.col(f"{axis}0") / size), F.floor(F.col(f"{axis}1") / size))))
    return df


def cell_size(boxes: DataFrame, cells: int = 8) -> float | None:
    """The size of cells of which boxes touch about ``cells`` on average, so that large boxes among small ones don't make very many."""
    w, h = (F.col(f"{k}1") - F.col(f"{k}0") for k in "xy")
    n, area, sides = boxes.where("x0 is not null and y0 is not null").agg(F.count("*"), F.sum(w * h), F.sum(w + h)).first()
    more = (cells - 1) * n
    return (sides + math.sqrt(sides * sides + 4 * more * area)) / (2 * more) or None if n else None


def by_cell(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both sides joined by cells (_cx, _cy), which are spread over all tasks however few bytes they are: many rows meet in a cell."""
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = (df.repartition(n, "_cx", "_cy") for df in (left, right))
    return a.hint("merge").join(b, ["_cx", "_cy"])


def levels(df: DataFrame, column: str) -> int:
    """How deep a shape's arrays are: 2 for a ring, 3 for a polygon, 4 for a multipolygon."""
    n, kind = 0, df.schema[column].dataType
    while isinstance(kind, T.ArrayType):
        n, kind = n + 1, kind.elementType
    return n


def with_box(df: DataFrame, ring: str = "ring") -> DataFrame:
    """x0, y0, x1, y1 of a shape: a ring, a polygon with holes, or a multipolygon."""
    points = F.col(ring)
    for _ in range(levels(df, ring) - 2):
        points = F.flatten(points)
    for axis, of in (("x", lambda p: p[0]), ("y", lambda p: p[1])):
        values = F.transform(points, of)
        df = df.withColumn(f"{axis}0", F.array_min(values)).withColumn(f"{axis}1", F.array_max(values))
    return df


def _is_box(shapes: DataFrame, ring: str = "ring") -> Column:
    """Whether a ring is its box (x0, y0, x1, y1): four corners, one after the other. A test by the box is exact for it."""
    if levels(shapes, ring) != 2:
        return F.lit(False)
    p = F.col(ring)
    at = lambda i, k: F.get(F.get(p, F.lit(i)), F.lit(k))
    same = lambda i, j, k: at(i, k) == at(j, k)
    turns = [same(0, 1, k) & same(1, 2, 1 - k) & same(2, 3, k) & same(3, 0, 1 - k) for k in (0, 1)]
    whole = (F.size(p) == 4) & ~same(0, 2, 0) & ~same(0, 2, 1) & (turns[0] | turns[1])
    return F.coalesce(whole, F.lit(False))


def edged(shapes: DataFrame, name: str, edges: Callable[..., tuple[np.ndarray, float]], column: str = "ring") -> DataFrame:
    """Name, box, ``edges`` (four numbers each) and ``size``, the area, of each shape with a box; made once for a shape, in tasks of about equal rows."""
    numbers = [T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1")]
    schema = T.StructType([shapes.schema[name], *numbers, T.StructField("edges", T.ArrayType(T.DoubleType())), T.StructField("size", T.DoubleType())])

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [edges(shape) for shape in frame[column]]
            yield frame.drop(columns=column).assign(edges=pd.Series([e for e, _ in found], dtype=object, index=frame.index), size=[size for _, size in found])

    boxes = with_box(shapes.select(name, column), column).where("x0 is not null and y0 is not null")
    return boxes.select(name, *(F.col(f.name).cast("double") for f in numbers), column).repartition(F.col(name)).mapInPandas(work, schema)


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The edges of a column of arrays, and where those of each row start and the last one's end."""
    column = batch.column(name)
    at = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]].reshape(-1, 4), (at - at[0]) // 4


def _arrow(df: DataFrame, schema: T.StructType, work: Callable[[pa.RecordBatch], tuple[np.ndarray | None, list]]) -> DataFrame:
    """The first columns of the rows that ``work`` names, and the new columns that it gives."""
    made = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, new = work(batch)
            columns = [batch.column(i) for i in range(len(schema) - len(new))]
            columns = columns if kept is None else [c.filter(pa.array(kept)) for c in columns]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*columns, *map(pa.array, new)], made, strict=True)], schema=made)

    return df.mapInArrow(run, schema)


@F.pandas_udf(T.DoubleType())
def common_area(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(intersection_areas(a.tolist(), b.tolist()), dtype="float64")


def points_in_polygons(points: DataFrame, polygons: DataFrame, point_id: str, polygon_id: str, size: float = 1000.0) -> DataFrame:
    """(point id, polygon id) of each polygon (``ring``, of any number of rings) that covers a point; borders belong to polygons."""
    shapes = with_box(polygons.select(polygon_id, "ring"))
    size = min(size, cell_size(shapes) or size)
    p = _cells(points.select(point_id, "x", "y"), F.col("x"), F.col("y"), size, 0)
    is_box = _is_box(shapes)
    on = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    near = by_cell(p, box_cells(edged(shapes.where(~is_box).select(polygon_id, "ring"), polygon_id, border_edges), size)).where(on)
    boxes = by_cell(p, box_cells(shapes.where(is_box).select(polygon_id, "x0", "y0", "x1", "y1"), size)).where(on).select(point_id, polygon_id)
    at = [F.col(c).cast("double").alias(f"_{c}") for c in "xy"]
    rows = near.select(F.col(point_id).alias("_point"), F.col(polygon_id).alias("_polygon"), *at, "edges")
    work = lambda batch: (covered_points(*_lists(batch, "edges"), *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("_x", "_y"))), [])
    schema = T.StructType([T.StructField("_point", points.schema[point_id].dataType), T.StructField("_polygon", polygons.schema[polygon_id].dataType)])
    return boxes.union(_arrow(rows, schema, work).select(F.col("_point").alias(point_id), F.col("_polygon").alias(polygon_id)))


def containing(points: DataFrame, polygons: DataFrame, point_id: str, polygon_id: str) -> DataFrame:
    """Polygons of each point as a sorted array; none and several are kept apart from one."""
    hits = points_in_polygons(points, polygons, point_id, polygon_id).groupBy(point_id).agg(F.array_sort(F.collect_set(polygon_id)).alias("hits"))
    return points.join(hits, point_id, "left").withColumn("hits", F.coalesce("hits", F.array().cast(T.ArrayType(polygons.schema[polygon_id].dataType))))


def overlapping_boxes(df: DataFrame, name: str, size: float) -> DataFrame:
    """Pairs a < b of boxes with a common area: (a, b, area). A pair counts in the cell of its common corner only."""
    cells = box_cells(df.select(name, "x0", "y0", "x1", "y1"), size)
    left = cells.select(F.col(name).alias("a"), *(F.col(c).alias(f"a{c}") for c in ("x0", "y0", "x1", "y1")), "_cx", "_cy")
    right = cells.select(F.col(name).alias("b"), *(F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")), "_cx", "_cy")
    lo = {k: F.greatest(f"a{k}0", f"b{k}0") for k in "xy"}
    hi = {k: F.least(f"a{k}1", f"b{k}1") for k in "xy"}
    once = (F.floor(lo["x"] / size) == F.col("_cx")) & (F.floor(lo["y"] / size) == F.col("_cy"))
    return left.join(right, ["_cx", "_cy"]).where((F.col("a") < F.col("b")) & once & (lo["x"] < hi["x"]) & (lo["y"] < hi["y"])).select("a", "b", ((hi["x"] - lo["x"]) * (hi["y"] - lo["y"])).alias("area"))


def box_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, size: float) -> DataFrame:
    """(left id, right id) of boxes of two tables with a common area, each pair once."""
    side = lambda df, name, p: box_cells(df.select(name, "x0", "y0", "x1", "y1"), size).select(F.col(name), *(F.col(c).alias(f"{p}{c}") for c in ("x0", "y0", "x1", "y1")), "_cx", "_cy")
    lo, hi = ({k: f(f"a{k}{i}", f"b{k}{i}") for k in "xy"} for f, i in ((F.greatest, 0), (F.least, 1)))
    once = (F.floor(lo["x"] / size) == F.col("_cx")) & (F.floor(lo["y"] / size) == F.col("_cy"))
    return side(left, left_id, "a").join(side(right, right_id, "b"), ["_cx", "_cy"]).where(once & (lo["x"] < hi["x"]) & (lo["y"] < hi["y"])).select(left_id, right_id)


def overlaps(polygons: DataFrame, name: str, least_area: float = 1.0, least_ratio: float = 0.05, nested_ratio: float = 0.95, size: float = 1000.0) -> DataFrame:
    """Pairs a < b of polygons with a common area over the limits, relative to the smaller; nested ones are flagged."""
    shapes = edged(polygons, name, area_edges)
    rows = area_pairs(shapes, shapes, name, name, size, F.col("a") < F.col("b")).withColumn("smaller", F.least("size_a", "size_b"))
    rows = rows.withColumn("ratio", F.col("area") / F.col("smaller")).where((F.col("area") > least_area) & (F.col("ratio") >= least_ratio))
    return rows.select("a", "b", "area", "ratio", (F.col("ratio") >= nested_ratio).alias("nested"))


def area_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, size: float, which: Column | None = None) -> DataFrame:
    """a, b, size_a, size_b and ``area``, the common one, of the shapes (id, box, ``edges``, ``size``) of two tables whose boxes have a common area.

    A pair meets in the cell of its common corner, with its edges, so that pairs aren't exchanged.
    """
    box = ("x0", "y0", "x1", "y1")
    side = lambda df, n, p: box_cells(df, size).select(F.col(n).alias(p), F.col("size").alias(f"size_{p}"), F.col("edges").alias(f"edges_{p}"), *(F.col(c).alias(f"{p}{c}") for c in box), "_cx", "_cy")
    lo, hi = ({k: f(f"a{k}{i}", f"b{k}{i}") for k in "xy"} for f, i in ((F.greatest, 0), (F.least, 1)))
    once = (F.floor(lo["x"] / size) == F.col("_cx")) & (F.floor(lo["y"] / size) == F.col("_cy"))
    met = by_cell(side(left, left_id, "a"), side(right, right_id, "b")).where(once & (lo["x"] < hi["x"]) & (lo["y"] < hi["y"]))
    met = met if which is None else met.where(which)
    rows = met.select("a", "b", "size_a", "size_b", "edges_a", "edges_b", lo["y"].alias("base"))
    number = T.DoubleType()
    schema = T.StructType([T.StructField("a", left.schema[left_id].dataType), T.StructField("b", right.schema[right_id].dataType), *(T.StructField(c, number) for c in ("size_a", "size_b", "area"))])
    work = lambda batch: (None, [common_areas(*_lists(batch, "edges_a"), *_lists(batch, "edges_b"), batch.column("base").to_numpy(zero_copy_only=False))])
    return _arrow(rows, schema, work)


@F.pandas_udf(T.DoubleType())
def ring_area(ring: pd.Series) -> pd.Series:
    return pd.Series(shape_areas(ring.tolist()), dtype="float64")


def cut_to_cells(rings: Rings, size: float, cut: str = "xy") -> tuple[Rings, np.ndarray, dict[str, np.ndarray]]:
    """The parts of rings in the cells of a grid that their boxes touch, the ring of each part, and the cells' numbers."""
    rows, cells = np.arange(len(rings)), {}
    for k, axis in enumerate(cut):
        box = rings.boxes()
        some = np.flatnonzero(np.isfinite(box[:, 0]))
        first, last = (np.floor(box[some, j] / size).astype(np.int64) for j in (k, k + 2))
        counts = last - first + 1
        part = np.repeat(some, counts)
        number = np.arange(len(part)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)
        a, b = (1.0, 0.0) if axis == "x" else (0.0, 1.0)
        rings = rings.take(part).clipped(-a, -b, -number * size).clipped(a, b, (number + 1) * size)
        rows, cells = rows[part], {c: v[part] for c, v in cells.items()} | {axis: number}
    return rings, rows, cells


def pieces(domains: DataFrame, domain: str, size: float) -> DataFrame:
    """The part of each domain in each cell of a grid: domain, _cx, _cy, ``whole``, and ``window``, signed rings unless the cell is ``whole`` inside."""
    kind = domains.schema[domain].dataType
    schema = T.StructType([T.StructField(domain, kind), T.StructField("_cx", T.LongType()), T.StructField("_cy", T.LongType()), T.StructField("whole", T.BooleanType()), T.StructField("window", T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))))])

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, shape in zip(frame[domain], frame["ring"], strict=True):
                rings, _ = flat_shapes([shape])
                parts, _, cells = cut_to_cells(rings, size)
                areas, out = parts.areas(), {}
                for k in np.flatnonzero(areas != 0).tolist():
                    found = out.setdefault((int(cells["x"][k]), int(cells["y"][k])), [0.0, []])
                    found[0] += areas[k]
                    found[1].append(np.stack([parts.x[parts.at[k] : parts.at[k + 1]], parts.y[parts.at[k] : parts.at[k + 1]]], 1).tolist())
                rows = [(name, x, y, a >= size * size * (1 - 1e-12), [] if a >= size * size * (1 - 1e-12) else found) for (x, y), (a, found) in out.items()]
                yield pd.DataFrame(rows, columns=[f.name for f in schema])

    return domains.select(domain, "ring").mapInPandas(cut, schema)


def parts_by_cell(rings: Rings, own: np.ndarray, windows: list, whole: np.ndarray, cells: np.ndarray, size: float, grid: float) -> tuple[np.ndarray, ...]:
    """Pair, ix, iy and area of the parts of each pair's rings inside its window, a part of one cell of ``size``, in the cells of ``grid``."""
    low = cells[own] * size
    rings = rings.clipped(-1, 0, -low[:, 0]).clipped(1, 0, low[:, 0] + size).clipped(0, -1, -low[:, 1]).clipped(0, 1, low[:, 1] + size)
    sign, part = np.ones(len(rings)), np.flatnonzero(~whole)
    if len(part):
        flat = Rings.of([r for k in part for r in windows[k]])
        of = np.repeat(part, [len(windows[k]) for k in part])
        triangles, to, turn = fan(flat, of)
        order = np.argsort(to, kind="stable")
        triangles, to, turn = triangles.take(order), to[order], turn[order]
        i, j = products(own, to)
        a, b = rings.boxes()[i], triangles.boxes()[j]
        use = (a[:, :2] < b[:, 2:]).all(1) & (b[:, :2] < a[:, 2:]).all(1)
        i, j = i[use], j[use]
        inner, kept = within_triangles(rings.take(i), triangles.take(j)), np.flatnonzero(whole[own])
        outer = rings.take(kept)
        rings = Rings(np.concatenate([inner.x, outer.x]), np.concatenate([inner.y, outer.y]), np.concatenate([inner.at, outer.at[1:] + inner.at[-1]]))
        own, sign = np.concatenate([own[i], own[kept]]), np.concatenate([turn[j], np.ones(len(kept))])
    fine, row, at = cut_to_cells(rings, grid)
    if not len(row):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
    keys = np.stack([own[row], at["x"], at["y"]], 1)
    found, where = np.unique(keys, axis=0, return_inverse=True)
    return *found.T, np.bincount(where.reshape(-1), fine.areas() * sign[row], len(found))


def clipped_to_cells(buildings: DataFrame, domains: DataFrame, name: str, domain: str, grid: float, least_area: float = 0.01, least_part: float = 1e-8) -> DataFrame:
    """(domain, ix, iy, building, area) of each building's part in each cell of each domain it intersects.

    Shapes may be concave, have holes and several parts. Each domain is cut once into the cells of a coarse
    grid; buildings meet the pieces of their cells only, and all clipping is done for whole batches.
    """
    size = grid * max(1, math.ceil(1000.0 / grid))
    g = pieces(domains, domain, size)
    b = box_cells(with_box(buildings.select(name, "ring")), size).select(name, "ring", "_cx", "_cy")
    types = (buildings.schema[name].dataType, domains.schema[domain].dataType)
    schema = T.StructType([T.StructField(domain, types[1]), T.StructField("ix", T.LongType()), T.StructField("iy", T.LongType()), T.StructField(name, types[0]), T.StructField("area", T.DoubleType())])

    def clip(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rings, own = flat_shapes(frame["ring"].tolist())
            pair, ix, iy, areas = parts_by_cell(rings, own, frame["window"].tolist(), frame["whole"].to_numpy(bool), frame[["_cx", "_cy"]].to_numpy(), size, grid)
            use = areas > least_part
            pair = pair[use]
            yield pd.DataFrame({domain: frame[domain].to_numpy()[pair], "ix": ix[use], "iy": iy[use], name: frame[name].to_numpy()[pair], "area": areas[use]}, columns=[f.name for f in schema])

    found = b.join(g, ["_cx", "_cy"]).select(name, "ring", domain, "window", "whole", "_cx", "_cy").mapInPandas(clip, schema)
    total = F.sum("area").over(Window.partitionBy(domain, name))
    return found.withColumn("_total", total).where(F.col("_total") >= least_area).drop("_total")


def covered(points: DataFrame, polygons: DataFrame, point_id: str, polygon_id: str) -> DataFrame:
    """The points in the union of all polygons, each once, without building the union."""
    hits = points_in_polygons(points, polygons, point_id, polygon_id).select(point_id).distinct()
    return points.join(hits, point_id, "left_semi")


def valid_coordinates(df: DataFrame, column: str) -> Column:
    """Whether all points of an array of any depth are in the range of longitudes and latitudes; an empty shape isn't valid."""
    depth = levels(df, column)
    ok = lambda p: F.coalesce((F.size(p) >= 2) & F.get(p, F.lit(0)).between(-180, 180) & F.get(p, F.lit(1)).between(-90, 90), F.lit(False))

    def whole(value: Column, n: int) -> Column:
        return ok(value) if n == 1 else F.coalesce((F.size(value) > 0) & F.forall(value, lambda x: whole(x, n - 1)), F.lit(False))

    return whole(F.col(column), depth)


def polygonal(df: DataFrame, parts: str = "geometries") -> Column:
    """The polygons of a collection (an array of type and shape), without its points and lines; several overlap as they may."""
    return F.filter(F.col(parts), lambda g: g["type"].isin("Polygon", "MultiPolygon"))
