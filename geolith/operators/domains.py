"""Domains of settlements, and which settlement may claim what.

A settlement's domain is its own boundary, or else what is nearer to it than to any other settlement and within its radius,
without the boundaries of others; both only inside its municipality.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolith.functions.geo import Rings, area_edges, circle
from geolith.functions.overlay import STEPS
from geolith.functions.scalars import finite
from geolith.operators import overlay
from geolith.operators.spatial import area_pairs, best_places, cell_size, edged, points_in_polygons
from geolith.operators.tables import Stored

#: Sites in a cell of the first, finest search.
CROWD = 64
#: A common area that rounding can't have made.
SURE = 1e-3
RING = T.ArrayType(T.ArrayType(T.DoubleType()))


def nearer(frame: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The part of a convex frame that is nearer to the origin than to any of some points, and the points that it borders on or did for a while."""
    ring, used = Rings(frame[:, 0], frame[:, 1], np.array([0, len(frame)])), []
    far = np.hypot(*near.T) if len(near) else np.zeros(0)
    for k in np.argsort(far, kind="stable").tolist():
        if not len(ring.x) or far[k] >= 2 * np.hypot(ring.x, ring.y).max():
            break
        limit = float(near[k] @ near[k]) / 2
        if (ring.x * near[k, 0] + ring.y * near[k, 1] > limit).any():
            ring = ring.clipped(near[k, 0], near[k, 1], limit)
            used.append(k)
    return np.stack([ring.x, ring.y], 1), near[used]


def voronoi_cells(sites: DataFrame, site: str, quarter: int = 64) -> DataFrame:
    """site and ``ring``: what is nearer to a site (x, y) than to any other and within its ``radius``, as a circle of 4 * ``quarter`` edges.

    Sites without a radius only cut others. Two sites at one place are an error. A site meets the others within a distance that
    doubles until it is twice as far as its cell's last corner, when no other site can cut the cell; so a large radius concerns
    its own site only. What is met in one small cell of the plane is reduced to the sites that count there before it is gathered.
    """
    stored = Stored(sites.sparkSession)
    own = stored(sites.where(finite(F.col("x")) & finite(F.col("y"))).select(F.col(site).alias("_s"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("radius").cast("double").alias("radius")))
    if not own.groupBy("x", "y").count().where("count > 1").isEmpty():
        raise ValueError("several sites at one place")
    w, h, n = own.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.count("*")).first()
    size = 2 * max(w or 0, h or 0, 1e-6) / math.sqrt(max(n, 1))
    crowd = lambda s: own.groupBy(F.floor(F.col("x") / s), F.floor(F.col("y") / s)).count().agg(F.max("count")).first()[0] or 0
    while crowd(size) > CROWD:
        size /= 2
    fine, points = size, T.ArrayType(RING.elementType)
    name = own.schema["_s"]
    some = T.StructType([name, T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("radius", T.DoubleType()), T.StructField("near", points)])

    def around(near, x: float, y: float) -> np.ndarray:
        return np.array([np.asarray(p, float) for p in near], float).reshape(-1, 2) - (x, y) if near is not None else np.zeros((0, 2))

    def reduced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        square = np.array([(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0)])
        for frame in frames:
            kept = [nearer(square * r, around(near, x, y))[1] + (x, y) for x, y, r, near in zip(*(frame[c] for c in ("x", "y", "radius", "near")), strict=True)]
            yield frame.assign(near=pd.Series([k.tolist() for k in kept], dtype=object, index=frame.index))

    def cells(reach: float):
        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rings, done = [], []
                for x, y, r, near in zip(*(frame[c] for c in ("x", "y", "radius", "near")), strict=True):
                    ring, _ = nearer(circle(0.0, 0.0, r, quarter)[::-1], around(near, x, y))
                    done.append(reach >= 2 * np.hypot(*ring.T).max(initial=0.0))
                    rings.append((ring + (x, y)).tolist())
                yield frame[["_s"]].assign(ring=pd.Series(rings, dtype=object, index=frame.index), done=np.array(done, bool))

        return work

    pending, out = stored(own.where("radius > 0")), None
    made = T.StructType([name, T.StructField("ring", RING), T.StructField("done", T.BooleanType())])
    at = lambda df, around: [df.withColumn("_cx", f(F.floor(F.col("x") / size))).withColumn("_cy", f(F.floor(F.col("y") / size))) for f in ((lambda c: F.explode(F.sequence(c - 1, c + 1))) if around else (lambda c: c),)][0]
    while True:
        other = at(own.select(F.col("_s").alias("_o"), "x", "y"), True).select("_o", F.col("x").alias("ox"), F.col("y").alias("oy"), "_cx", "_cy")
        met = at(pending, False).join(other, ["_cx", "_cy"]).where((F.col("_s") != F.col("_o")) & (F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")) <= size))
        small = met.groupBy("_s", "x", "y", "radius", F.floor(F.col("ox") / fine).alias("_fx"), F.floor(F.col("oy") / fine).alias("_fy")).agg(F.collect_list(F.array("ox", "oy")).alias("near"))
        near = small.select("_s", "x", "y", "radius", "near").mapInPandas(reduced, some).groupBy("_s").agg(F.flatten(F.collect_list("near")).alias("near"))
        found = stored(pending.join(near, "_s", "left").select("_s", "x", "y", "radius", "near").mapInPandas(cells(size), made))
        done = found.where("done and size(ring) > 2").select("_s", "ring")
        out = done if out is None else out.union(done)
        pending = stored(pending.join(found.where("done").select("_s"), "_s", "left_anti"))
        if pending.isEmpty():
            return out.withColumnRenamed("_s", site)
        size *= 2


def allocation_domains(sites: DataFrame, municipalities: DataFrame, boundaries: DataFrame, site: str, municipality: str, size: float = overlay.SIZE, quarter: int = 64) -> DataFrame:
    """The domains of all sites with a ``radius`` as overlaid cells (site, _cx, _cy, edges, area); see :func:`overlay.areas` and :func:`overlay.outline`.

    ``sites``: site, municipality, x, y, radius; ``municipalities`` and ``boundaries``: their name (municipality, site) and ``ring``.
    A site with a boundary gets it; another one what is nearest to it and in its radius, outside of all boundaries. Both end at the
    municipality's border. A domain without any area has no row; :func:`without_domain` lists them.
    """
    candidates = sites.where("radius > 0").select(site, municipality)
    own = boundaries.join(candidates, site).select(site, municipality, "ring")
    free = sites.join(boundaries.select(site), site, "left_anti").select(site, "radius")
    reach = sites.select(site, "x", "y").join(free, site, "left")
    near = voronoi_cells(reach, site, quarter).join(candidates, site).select(site, municipality, "ring")
    stored = Stored(sites.sparkSession)
    shapes = stored(overlay.cut(near, [site, municipality], 0, size).withColumn("_free", F.lit(True)).union(overlay.cut(own, [site, municipality], 0, size).withColumn("_free", F.lit(False))))
    inside = overlay.on_cells_of(overlay.cut(municipalities, [municipality], 1, size), shapes, [site], [municipality])
    protected = overlay.on_cells_of(overlay.cut(boundaries, [], 2, size), shapes.where("_free"), [site])
    pieces = shapes.select(site, "_cx", "_cy", "edges").union(inside).union(protected)
    return overlay.overlaid(pieces, [site], 3, lambda a, b, c: a & b & ~c, size)


def without_domain(sites: DataFrame, cells: DataFrame, site: str) -> DataFrame:
    """Sites that should have a domain and have none."""
    return sites.where("radius > 0").select(site).join(cells.select(site), site, "left_anti")


def shared_area(cells: DataFrame, site: str, size: float = overlay.SIZE) -> DataFrame:
    """Cells where domains overlap: _cx, _cy, ``area`` that is counted more than once."""
    united = overlay.dissolved(cells.select("_cx", "_cy", "edges"), [], size).select("_cx", "_cy", F.col("area").alias("_once"))
    sums = cells.groupBy("_cx", "_cy").agg(F.sum("area").alias("_all"))
    return sums.join(united, ["_cx", "_cy"]).select("_cx", "_cy", (F.col("_all") - F.col("_once")).alias("area")).where("area > 1e-6")


def claimed(buildings: DataFrame, places: DataFrame, boundaries: DataFrame, building_id: str, place: str, protect: bool = True) -> DataFrame:
    """The place that each building (x, y) goes to: building, place, distance.

    Of the places whose radius reaches it, a place with a boundary (place, ``ring``) takes only what its boundary covers; with
    ``protect`` another one takes nothing that any boundary covers. The rest compete: the least distance / radius wins, then
    the least distance, then the name.
    """
    stored = Stored(buildings.sparkSession)
    inside = stored(points_in_polygons(buildings, boundaries, building_id, place).distinct())
    bounded = boundaries.select(place).distinct()
    own = inside.join(buildings.select(building_id, "x", "y"), building_id).join(places.select(place, F.col("x").alias("px"), F.col("y").alias("py"), "radius"), place)
    own = own.withColumn("distance", F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))).where(F.col("distance") <= F.col("radius"))
    free = buildings
    if protect:
        free = stored(buildings.select(building_id, "x", "y").join(inside.select(F.col(building_id).alias("_b")).distinct(), F.col(building_id) == F.col("_b"), "left_anti"))
    others = places.join(bounded, place, "left_anti")
    best = F.min(F.struct((F.col("distance") / F.col("radius")).alias("relative"), "distance", place)).alias("best")
    found = own.groupBy(building_id).agg(best).union(best_places(free, others, building_id, place)).groupBy(building_id).agg(F.min("best").alias("best"))
    return found.select(building_id, F.col(f"best.{place}").alias(place), F.col("best.distance").alias("distance"))


def outside(squares: DataFrame, protected: DataFrame, keys: Sequence[str], least: float = 1e-6, touching: bool = False, size: float = overlay.SIZE) -> DataFrame:
    """The squares (keys, x0, y0, x1, y1) that share no more than ``least`` with any protected area (``ring``); with ``touching``, that don't touch one either.

    Equal squares are judged once. A common area of a pair that is larger by ``SURE`` decides; only what is left, and the protected areas
    whose boxes it meets, is overlaid.
    """
    more = 2 * size / STEPS if touching else 0.0
    c = {f"{k}{i}": f(F.col(f"{k}0"), F.col(f"{k}1")).cast("double") + m for k in "xy" for i, f, m in ((0, F.least, -more), (1, F.greatest, more))}
    stored = Stored(squares.sparkSession)
    boxes = squares.select(*(v.alias(k) for k, v in c.items())).dropna().distinct().withColumn("_box", F.array(*c))
    boxes = stored(boxes.withColumn("size", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).withColumn("edges", F.array("x0", "y0", "x1", "y0", "x1", "y1", "x0", "y1")))
    rings = stored(protected.select("ring").withColumn("_p", F.monotonically_increasing_id()))
    areas = stored(edged(rings, "_p", area_edges))
    cell = min(size, cell_size(boxes.select(*c).union(areas.select(*c))) or size)
    hits = stored(area_pairs(boxes, areas, "_box", "_p", cell).where(F.col("area") > least + SURE).select(F.col("a").alias("_box")).distinct())
    rest = stored(boxes.join(hits, "_box", "left_anti").withColumn("_n", F.monotonically_increasing_id()))
    near = stored(area_pairs(rest, areas, "_n", "_p", cell).select(F.col("a").alias("_n"), F.col("b").alias("_p")))
    met = near.select("_n").distinct()
    corner = lambda x, y: F.array(F.col(x), F.col(y))
    own = stored(overlay.cut(rest.join(met, "_n").select("_n", F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1")).alias("ring")), ["_n"], 0, size))
    parts = overlay.cut(rings.join(near.select("_p").distinct(), "_p"), ["_p"], 1, size)
    pieces = own.union(own.select("_n", "_cx", "_cy").join(near, "_n").join(parts, ["_p", "_cx", "_cy"]).select("_n", "_cx", "_cy", "edges"))
    some = overlay.areas(overlay.overlaid(pieces, ["_n"], 2, lambda a, b: a & b, size), ["_n"]).where(F.col("area") > (0.0 if touching else least))
    hits = hits.union(rest.join(some.select("_n"), "_n").select("_box"))
    hit = squares.withColumn("_box", F.array(*c.values())).join(hits, "_box").select(*keys).distinct()
    return squares.join(hit, list(keys), "left_anti")
