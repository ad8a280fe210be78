"""Roads with their routes, traced controls, other domains, evidence of contours, and bundles."""

import pytest
from pyspark.sql import functions as F

from geolith.operators import housing, match, roads
from geolith.sources import write


def test_roads_and_routes(spark):
    ways = [(1, {"highway": "trunk", "ref": "Р-258"}, [[-500.0, 100.0], [1500.0, 100.0]]), (2, {"highway": "primary", "name": "M 60"}, [[100.0, 100.0], [float("nan"), 5.0], [100.0, 400.0]]), (3, {"highway": "service", "ref": "A-370"}, [[0.0, 0.0], [5.0, 5.0]]), (4, {"highway": "secondary"}, [[2000.0, 0.0], [2000.0, 50.0]]), (5, {"highway": "trunk", "ref": "1"}, [[5.0, 5.0]])]
    df = spark.createDataFrame(ways, "osm_id INT, tags MAP<STRING, STRING>, line ARRAY<ARRAY<DOUBLE>>")
    region = spark.createDataFrame([([[0.0, 0.0], [600.0, 0.0], [600.0, 600.0], [0.0, 600.0]],), ([[500.0, 0.0], [1000.0, 0.0], [1000.0, 600.0], [500.0, 600.0]],)], "ring ARRAY<ARRAY<DOUBLE>>")
    routes = [("one", ["R-258", "M60"]), ("two", ["A-370"])]
    parts = roads.region_roads(df, region, routes)
    assert sorted((r["osm_id"], r["ref"], r["route"], r["length"]) for r in parts.collect()) == [(1, "one", "one", 1000.0), (2, "one", "one", 300.0)]
    counts = roads.route_counts(parts, routes)
    assert sorted(map(tuple, counts.collect())) == [("one", 2), ("two", 0)]
    with pytest.raises(Exception, match="route missing: two"):
        roads.require_routes(counts).collect()
    assert roads.region_roads(df, region, []).where("route is not null").count() == 0


def test_controls_are_traced(spark):
    places = spark.createDataFrame([("a", "official_current"), ("b", "osm_unverified"), ("c", None)], "name STRING, population_quality STRING")
    found = spark.createDataFrame([("a", 5, "official_census_exact")], "name STRING, value INT, quality STRING")
    assert sorted((r["name"], r["value"], r["state"]) for r in match.traced(places, found, "name").collect()) == [("a", 5, "matched"), ("b", None, "unverified"), ("c", None, "unavailable")]
    with pytest.raises(Exception, match="can't be traced: a"):
        match.traced(places, found.limit(0), "name").collect()


def test_points_in_other_domains(spark):
    box = lambda a, b: [[a, a], [b, a], [b, b], [a, b]]
    domains = spark.createDataFrame([("k1", "One", box(0.0, 10.0)), ("k2", "Two", box(5.0, 20.0)), ("k3", "Three", box(0.0, 30.0))], "key STRING, name STRING, ring ARRAY<ARRAY<DOUBLE>>")
    points = spark.createDataFrame([("k1", 6.0, 6.0), ("k2", 15.0, 15.0), ("k9", 50.0, 50.0)], "key STRING, x DOUBLE, y DOUBLE")
    assert sorted((r["key"], r["point_in_other_domain"]) for r in housing.other_domains(points, domains, "key", "name").collect()) == [("k1", "Three;Two"), ("k2", "Three"), ("k9", "")]


def test_evidence_of_contours(spark):
    tags = F.create_map(F.lit("building"), F.lit("apartments"), F.lit("building:levels"), F.lit("5"), F.lit("addr:street"), F.lit("s"), F.lit("addr:housenumber"), F.lit("1"))
    of = lambda n, **told: spark.range(1).select(housing.building_issues(tags, F.lit(100.0), F.lit(True), F.lit(n), F.array().cast("array<string>"), F.lit(None).cast("string"), **told).alias("f")).first()["f"]
    assert of(1) == [] and of(0, alias=F.lit(True), flagged=F.lit(True)) == []
    assert of(1, alias=F.lit(True), flagged=F.lit(True), storeys_conflict=F.lit(True), area_conflict=F.lit(None).cast("boolean"), residential_exceeds=F.lit(True)) == ["dos_locality_alias_requires_review", "gis_residential_area_exceeds_gross", "official_source_has_quality_flags", "storeys_source_conflict"]
    with pytest.raises(ValueError):
        of(1, other=F.lit(True))


def test_bundles(spark, tmp_path):
    (tmp_path / "region.json").write_text("{}")
    (tmp_path / "data" / "r1" / "data").mkdir(parents=True)
    (tmp_path / "data" / "r1" / "data" / "a.geojson").write_text("[]")
    outputs = {r["path"].split("/r1/")[1]: {"bytes": r["bytes"], "sha256": r["sha256"]} for r in write.manifest(spark, str(tmp_path / "data" / "r1")).collect()}
    target = str(tmp_path / "bundle")
    made = lambda to, when="2026-01-01T00:00:00+00:00": write.bundle(spark, {"regions/r1/region.json": str(tmp_path / "region.json"), "registry.json": str(tmp_path / "region.json")}, {"r1": outputs}, to, when)
    made(target)
    assert set(write.verify_bundle(spark, target, str(tmp_path / "data"))["files"]) == {"content/registry.json", "content/regions/r1/region.json"}
    with pytest.raises(ValueError, match="exists"):
        made(target)
    with pytest.raises(ValueError, match="time zone"):
        made(target + "2", "2026-01-01T00:00:00")
    with pytest.raises(ValueError, match="not a path"):
        write.bundle(spark, {"../x": str(tmp_path / "region.json")}, {}, target + "3", "2026-01-01T00:00:00+00:00")
    (tmp_path / "data" / "r1" / "data" / "a.geojson").write_text("[1]")
    with pytest.raises(ValueError, match="changed in"):
        write.verify_bundle(spark, target, str(tmp_path / "data"))
    (tmp_path / "bundle" / "content" / "more.txt").write_text("x")
    with pytest.raises(ValueError, match="unexpected in"):
        write.verify_bundle(spark, target)
