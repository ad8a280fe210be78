"""Roads of a region: ways by class, their routes, their parts inside, and whether every route is there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolith.functions.text import route_text
from geolith.operators.match import first_routes
from geolith.operators.overlay import SIZE, cut, dissolved, lines_within

#: The classes of major roads.
MAJOR_CLASSES = ("trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link")


def region_roads(ways: DataFrame, region: DataFrame, routes: Sequence[tuple[str, Sequence[str]]], classes: Sequence[str] = MAJOR_CLASSES, size: float = SIZE) -> DataFrame:
    """Parts of roads inside the union of a region's polygons: osm_id, part, name, ref, highway, ``route``, length, line.

    ``ways``: osm_id, tags, ``line`` (points); ``region``: ``ring``. ``routes`` are names and the variants that they are known by, in the order
    in which they are looked for in a way's number and name; a way of a route has its name as ``ref``. Points outside the plane's finite numbers go.
    """
    tag = lambda k: F.coalesce(F.col("tags")[k], F.lit(""))
    text = route_text(F.concat(tag("ref"), F.lit(" "), tag("name")))
    known = [(name, [route_text(F.lit(v)) for v in variants]) for name, variants in routes]
    own = first_routes(text, known) if known else F.lit(None).cast("string")
    finite = F.filter("line", lambda p: F.coalesce((F.abs(p[0]) < float("inf")) & (F.abs(p[1]) < float("inf")), F.lit(False)))
    roads = ways.where(tag("highway").isin(*classes)).select("osm_id", tag("name").alias("name"), tag("ref").alias("_ref"), tag("highway").alias("highway"), own.alias("route"), finite.alias("line"))
    whole = dissolved(cut(region.select("ring"), [], size=size), [], size)
    parts = lines_within(roads.select("osm_id", "line"), whole, "osm_id", [], size)
    return parts.join(roads.drop("line"), "osm_id").select("osm_id", "part", "name", F.coalesce("route", "_ref").alias("ref"), "highway", "route", "length", "line")


def route_counts(parts: DataFrame, routes: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """route and ``parts`` for each route, 0 for one that has none."""
    names = parts.sparkSession.createDataFrame([(n,) for n, _ in routes], "route STRING")
    return names.join(parts.groupBy("route").agg(F.count("*").alias("n")), "route", "left").select("route", F.coalesce("n", F.lit(0)).alias("parts"))


def require_routes(counts: DataFrame) -> DataFrame:
    """The counts; a route without parts is an error."""
    missing = F.raise_error(F.concat(F.lit("route missing: "), F.col("route")))
    return counts.withColumn("parts", F.when(F.col("parts") > 0, F.col("parts")).otherwise(missing.cast("bigint")))
