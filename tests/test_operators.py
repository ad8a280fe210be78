"""Operators by known vectors, and invariants of their results."""

import json
import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from geolith.functions import geo
from geolith.functions.geo import geodesic
from geolith.operators import allocate, audit, grid, housing, layers, match, resolve, review, score, spatial
from geolith.plans.pipeline import Pipeline, Plugin, region_errors
from geolith.sources import read, write
from geolith.streaming import snapshots


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_largest_remainder(spark):
    df = spark.createDataFrame([("a", 1, 0, 0, 1), ("a", 1, 1, 0, 1), ("a", 1, 2, 0, 1), ("b", 100, 0, 0, 150), ("b", 100, 1, 0, 450), ("c", 594201, 0, 0, 1), ("c", 594201, 1, 0, 2), ("z", 5, 0, 0, 0)], "s STRING, p INT, ix INT, iy INT, w INT")
    found = allocate.largest_remainder(df, "s", "p", "w", ["ix", "iy"])
    assert rows(found, "s", "ix", "units") == [("a", 0, 334), ("a", 1, 333), ("a", 2, 333), ("b", 0, 25000), ("b", 1, 75000), ("c", 0, 198067000), ("c", 1, 396134000), ("z", 0, None)]
    assert allocate.conservation(found.where("s <> 'z'"), "s", "p", "units").count() == 0


def test_scenarios(spark):
    df = spark.createDataFrame([("a", 100, 1.0, 2.0), ("a", 100, 3.0, 6.0), ("b", 100, 0.0, 1.0), ("b", 100, 0.0, 1.0), ("c", 1, -1.0, 1.0)], "s STRING, t INT, u DOUBLE, v DOUBLE")
    found = allocate.redistributed(df, "s", "t", ["u", "v"])
    assert rows(found, "s", "u_share") == [("a", 25.0), ("a", 75.0), ("b", None), ("b", None), ("c", None)]
    assert rows(allocate.total_variation(found.where("s = 'a'"), "s", "u_share", "v_share"), "variation") == [(0.0,)]


def test_coarsening(spark):
    df = spark.createDataFrame([("s", 0, 0, 1000, 2), ("s", 1, 0, 1000, 2), ("s", 4, 0, 9000, 20), ("s", 5, 0, 9000, 20)], "g STRING, ix INT, iy INT, proxy INT, buildings INT")
    found = rows(grid.coarsened(df, "g", 400, 100, ["proxy"]), "ix", "iy", "span", "proxy")
    assert (0, 0, 4, 2000) in found and any(f[2] < 4 and f[0] >= 4 for f in found) and sum(f[3] for f in found) == 20000
    ids = spark.createDataFrame([("s", 0, 0, 1, "way/1"), ("s", 1, 0, 3, "way/1")], "g STRING, ix INT, iy INT, proxy INT, b STRING")
    assert rows(grid.coarsened(ids, "g", 400, 100, ["proxy"], ids="b"), "ix", "iy", "span", "proxy", "buildings") == [(0, 0, 4, 4, 1)]
    with pytest.raises(ValueError):
        grid.coarsened(df, "g", 300, 100, ["proxy"])


def test_building_proxies(spark):
    tags = [{"building": "school", "addr:housenumber": "1"}, {"building": "apartments", "building:levels": "9"}, {"building": "apartments", "building:levels": "nan"}, {"building": "yes", "addr:street": "x"}, {"building": "yes", "addr:housenumber": "1", "amenity": "fuel"}, {"building": "apartments", "amenity": "hospital", "building:levels": "5"}, {"building": "shed"}]
    df = spark.createDataFrame(list(enumerate(tags)), "i INT, tags MAP<STRING, STRING>")
    found = [r["p"] and tuple(r["p"]) for r in df.select("i", housing.proxy_parameters(F.col("tags")).alias("p")).orderBy("i").collect()]
    assert found == [None, (9.0, True, True), (5.0, True, False), (0.55, False, False), None, (5.0, True, True), None]
    flags = df.select(housing.review_flags(F.create_map(F.lit("building"), F.lit("ruins"), F.lit("disused:shop"), F.lit("x"))).alias("f")).first()["f"]
    assert flags == ["lifecycle_osm_signal_unverified"]
    over = df.where("i = 3").select(housing.overridden(housing.proxy_parameters(F.col("tags")), F.lit(200.0), F.lit("mixed"), F.lit(600.0), F.lit(None).cast("double")).alias("o")).first()["o"]
    assert tuple(over) == (3.0, True, False, True, False)


def test_links(spark):
    official = F.struct(F.lit("ольга").alias("locality"), F.lit("street").alias("street_type"), F.lit("ленина").alias("street_name"), F.lit("6").alias("house_number"))

    def status(places=("ольга",), kind="street", house="6", contours=1, gross=None, issues=()):
        array = lambda v: F.array(*map(F.lit, v)).cast("array<string>")
        street = F.struct(F.lit(kind).alias("street_type"), F.lit("ленина").alias("street_name"))
        flags = housing.link_flags(array(places), street, F.lit(house), official, F.lit(contours), F.lit(1), F.lit(100.0), F.lit(gross).cast("double"), F.lit(2.0), array(issues))
        return tuple(spark.range(1).select(housing.link_status(flags), flags).first())

    assert status() == ("text_consistent_geometry_unverified", []) and status(house="7")[0] == "quarantined_text_conflict" and status(contours=2)[0] == "ambiguous"
    assert status(places=())[0] == "locality_or_alias_review_required" and status(kind="lane")[0] == "quarantined_text_conflict"
    assert status(gross=501.0)[1] == ["gross_area_vs_footprint_requires_extent_check"] and status(issues=["duplicate_osm_address", "x"])[1] == ["duplicate_osm_address"]


def test_duplicates_and_conflicts(spark):
    df = spark.createDataFrame([("g", 2, "house"), ("g", 1, "house"), ("h", 3, "house"), ("h", 4, "apartments")], "sig STRING, id INT, kind STRING")
    found = {r["sig"]: (r["members"], r["conflicting"], r["kept"] and r["kept"]["id"]) for r in housing.deduplicated(df, "sig", ["kind"], ["id"]).collect()}
    assert found == {"g": (2, False, 1), "h": (2, True, None)}


def test_priority_limits(spark):
    df = spark.createDataFrame([("a", 30000, "official_current", 0, 0, 0, 999.0, 0.5), ("b", 30000, "guess", 0, 0, 0, 999.0, 0.5), ("c", 3000, "official_current", 0, 0, 0, 1.0, 0.5), ("d", 6000, "official_current", 3, 0, 0, 1.0, 20.0), ("e", 100, "x", 0, 0, 0, 1.0, 1.0)], "name STRING, population INT, population_quality STRING, direct INT, within INT, conflicts INT, nearest_km DOUBLE, road_km DOUBLE")
    found = [(r["name"], r["score"], r["priority"]) for r in score.priority(df).collect()]
    assert found == [("a", 100, "very high"), ("c", 59, "medium"), ("b", 49, "needs population check"), ("d", 24, "capacity exhausted")]


def test_contacts(spark):
    schema = "record INT, contact_id STRING, name STRING, kind STRING, coverage ARRAY<STRING>, specializations ARRAY<STRING>, phones ARRAY<STRING>, emails ARRAY<STRING>, websites ARRAY<STRING>, addresses ARRAY<STRING>, links ARRAY<STRING>"
    data = [(1, "", "Alpha", "agency", ["X"], [], ["8 999 111-22-33"], ["A@B.ru"], [], [], []), (2, "", "Alpha Long Name", "none", ["X"], None, ["+79991112233"], [], ["http://www.z.org"], [], []), (3, "id3", "Beta", "broker", [], [], [], ["b@c.ru"], [], [], []), (4, "", "Nobody", "", [], [], [], [], [], [], []), (5, "", " ", "", [], [], ["89991112233"], [], [], [], [])]
    found = resolve.catalogue_order(resolve.merged(resolve.normalized(spark.createDataFrame(data, schema), "region"))).collect()
    assert [(r["name"], r["records"], r["phones"], r["emails"]) for r in found] == [("Alpha Long Name", 2, ["+79991112233"], ["a@b.ru"]), ("Beta", 1, [], ["b@c.ru"])]
    assert found[0]["contact_id"].startswith("contact_") and len(found[0]["contact_id"]) == 24 and found[1]["contact_id"] == "id3" and found[1]["coverage"] == ["region"]


def test_spatial(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 0.0), (3, 1e6, 0.0)], "id INT, x DOUBLE, y DOUBLE")
    b = spark.createDataFrame([(7, 3.0, 4.0), (8, -3.0, -4.0), (9, 90.0, 0.0)], "sid INT, x DOUBLE, y DOUBLE")
    assert rows(spatial.nearest(a, b, "id", "sid"), "id", "sid", "distance") == [(1, 7, 5.0), (2, 9, 10.0), (3, 9, 999910.0)]
    assert spatial.nearest(a, b.limit(0), "id", "sid").count() == 0
    assert rows(spatial.pairs_within(a, b, "id", "sid", 10.0), "id", "sid") == [(1, 7), (1, 8), (2, 9)]
    rings = spark.createDataFrame([("l", [[0.0, 0.0], [3.0, 0.0], [3.0, 1.0], [1.0, 1.0], [1.0, 3.0], [0.0, 3.0]]), ("q", [[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0]])], "p STRING, ring ARRAY<ARRAY<DOUBLE>>")
    points = spark.createDataFrame([(1, 0.5, 2.5), (2, 1.5, 1.5), (3, 0.5, 0.5), (4, 9.0, 9.0)], "id INT, x DOUBLE, y DOUBLE")
    assert rows(spatial.containing(points, rings, "id", "p"), "id", "hits") == [(1, ["l"]), (2, ["q"]), (3, ["l", "q"]), (4, [])]
    assert rows(spatial.overlaps(rings, "p"), "a", "b", "area", "nested") == [("l", "q", pytest.approx(3.0), False)]
    cells = spatial.clipped_to_cells(rings.where("p = 'q'").withColumnRenamed("p", "b"), rings.where("p = 'l'").withColumnRenamed("p", "d"), "b", "d", 1.0)
    assert rows(cells.withColumn("area", F.round("area", 9)), "ix", "iy", "area") == [(0, 0, 1.0), (0, 1, 1.0), (1, 0, 1.0)]


def test_matching(spark):
    places = spark.createDataFrame([(1, "a", ["x"]), (2, "b", ["x"]), (3, "c", ["y"]), (4, "d", ["y"])], "place_id INT, name_key STRING, aliases ARRAY<STRING>")
    first = spark.createDataFrame([("a", "x", 10), ("b", "x", 20), ("b", "x", 21)], "name_key STRING, district_key STRING, value INT")
    second = spark.createDataFrame([("a", "x", 99), ("c", "y", 30)], "name_key STRING, district_key STRING, value INT")
    assert rows(match.official_match(places, [first, second]), "place_id", "value", "source", "ambiguous") == [(1, 10, 0, False), (2, None, None, True), (3, 30, 1, False), (4, None, None, False)]
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id INT, v STRING")
    new = spark.createDataFrame([(2, None), (3, "d"), (4, "e")], "id INT, v STRING")
    assert rows(match.snapshot_diff(old, new, "id", ["v"]), "id", "status") == [(1, "removed"), (2, "unchanged"), (3, "changed"), (4, "added")]
    sheet = spark.createDataFrame([(1, "t"), (2, None), (3, "u"), (4, None)], "r INT, h STRING").withColumn("g", F.lit(1))
    assert rows(match.carried_down(sheet, "h", "r", ["g"]), "r", "context") == [(1, "t"), (2, "t"), (3, "u"), (4, "u")]
    assert rows(match.active_rows(sheet, F.col("h") == "t", F.col("h") == "u", "r", ["g"]), "r") == [(2,)]
    key = "STRUCT<locality: STRING, street_type: STRING, street_name: STRING, house_number: STRING>"
    cards = spark.createDataFrame([(1, ("l", None, "s", "1")), (2, None)], f"id INT, key {key}")
    others = spark.createDataFrame([(9, ("l", None, "s", "1")), (8, None)], f"oid INT, key {key}")
    assert rows(match.by_address_key(cards, others, "id", "oid"), "id", "partners") == [(1, [9]), (2, None)]


def test_reviews(spark):
    schema = "name STRING, field STRING, status STRING, value STRING, reviewer STRING, reviewed_at STRING, sources ARRAY<STRING>, match_status STRING"
    data = [("a", "use", "confirmed", "mixed", "r", "d", ["s"], "confirmed"), ("a", "apartments", "reported", "4", None, None, [], "confirmed"), ("b", "use", "confirmed", "mixed", "r", "d", ["s"], "candidate"), ("c", "colour", "confirmed", None, "", "d", [], "confirmed")]
    register = spark.createDataFrame(data, schema)
    assert rows(review.register_errors(register), "name", "error") == [("c", "confirmed_without_reviewer"), ("c", "confirmed_without_source"), ("c", "confirmed_without_value"), ("c", "unknown_field")]
    assert ("a", "mixed", None) in rows(review.compiled_register(register), "name", "use", "apartments") and review.compiled_register(register).where("name = 'b'").count() == 0
    a = spark.createDataFrame([(1, 131.9, 43.1), (2, 135.0, 48.4)], "i INT, x DOUBLE, y DOUBLE")
    b = spark.createDataFrame([(7, 131.0, 43.0), (8, 135.1, 48.5), (9, 132.0, 43.9)], "j INT, x DOUBLE, y DOUBLE")
    best = {r["i"]: (r["j"], r["metres"]) for r in review.nearest_on_ellipsoid(a, b, "i", "j").collect()}
    for i, x, y in ((1, 131.9, 43.1), (2, 135.0, 48.4)):
        exact = min((float(geodesic(x, y, u, v)), j) for j, u, v in ((7, 131.0, 43.0), (8, 135.1, 48.5), (9, 132.0, 43.9)))
        assert best[i] == (exact[1], pytest.approx(exact[0]))
    cells = spark.createDataFrame([("c1", 1.0), ("c2", 2.0)], "cell STRING, area DOUBLE")
    scenarios = spark.createDataFrame([("c1", 5.0, None), ("c2", 7.0, 3.0)], "cell STRING, u DOUBLE, v DOUBLE")
    assert rows(review.scenario_overlay(scenarios, cells, "cell", ["u", "v"]), "cell", "low", "high") == [("c1", 5.0, 5.0), ("c2", 3.0, 7.0)]
    with pytest.raises(Exception, match="no such cell"):
        review.scenario_overlay(scenarios, cells.limit(1), "cell", ["u"]).collect()
    assert review.missing_ids(cells, scenarios, "cell").count() == 0


def test_contract(spark):
    df = spark.createDataFrame([("a", "1,5", 200.0), ("a", "x", 10.0), (None, "2", 10.0)], "n STRING, v STRING, lon DOUBLE").withColumn("lat", F.lit(1.0)).withColumn("g", F.lit("Point"))
    found = dict(rows(audit.violations(df, audit.Contract(("n",), ("v",), ("n",), ("Point",), "g", "lon", "lat")), "rule", "n"))
    assert found == {"required:n": 1, "numeric:v": 2, "unique:n": 1, "coordinates": 1}
    kept = audit.normalised(df.withColumn("pos", F.monotonically_increasing_id()), {"n": F.col("n"), "v": F.col("v")}, required=["n"], unique_by=["n"], order="pos")
    assert rows(kept, "n", "v") == [("a", "1,5")]
    assert audit.counts_against({"l": df}, {"l": 2, "m": 1}) == [("l", 2, 3), ("m", 1, None)]


def test_layer_queries(spark):
    df = spark.createDataFrame([(1, "Я", 5.0), (2, "а", 7.0), (3, "б", None), (4, "в", 0.0)], "id INT, name STRING, v DOUBLE")
    spec = layers.TableSpec(("id", "name"), "v", 0, (("name", "asc"),), None, "id", ("name",))
    assert [r["id"] for r in layers.layer_table(df, spec).collect()] == [2, 1]
    assert df.select(layers.popup(df, ["name", "v"], {"v": " km"}).alias("p")).first()["p"] == "name: Я\nv: 5.0 km"


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "l.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Point","coordinates":[37.62,55.75]},"properties":{"name":"demo","score":1}}]}')
    found = read.geojson(spark, str(tmp_path / "l.geojson"), "name: STRING, score: DOUBLE").collect()
    assert len(found) == 1 and found[0]["properties"]["name"] == "demo" and found[0]["geometry"]["type"] == "Point"
    (tmp_path / "p.csv").write_text("﻿name,latitude,longitude\na,55.0,60.0\n", encoding="utf-8")
    assert read.points_csv(spark, str(tmp_path / "p.csv"), "longitude", "latitude").select("lon", "lat").first() == (60.0, 55.0)
    (tmp_path / "q.csv").write_text("name,latitude,longitude\na,95.0,60.0\n")
    with pytest.raises(Exception, match="out of range"):
        read.points_csv(spark, str(tmp_path / "q.csv"), "longitude", "latitude").collect()
    df = spark.createDataFrame([(1, "=1+1", None), (2, "a & <b>", 2.5)], "n INT, t STRING, v DOUBLE")
    book = str(tmp_path / "t.xlsx")
    assert write.workbook(df, book, [["source", "x"]]) == 2
    assert "<autoFilter" in zipfile.ZipFile(book).read("xl/worksheets/sheet1.xml").decode()
    cells = {r["row"]: r["cells"] for r in read.workbook(spark, book, 1).collect()}
    assert cells[1] == {"A": "n", "B": "t", "C": "v"} and cells[2] == {"A": "1", "B": "=1+1"} and cells[3]["B"] == "a & <b>"
    with pytest.raises(ValueError):
        write.workbook(spark.createDataFrame([("x" * 32768,)], "t STRING"), book)
    write.publish(spark, {"t": df}, str(tmp_path / "out"))
    write.publish(spark, {"t": df.limit(1)}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/t")).count() == 1
    before = write.manifest(spark, str(tmp_path / "p.csv"))
    assert write.manifest_differences(before, before).count() == 0 and write.config_hash({"a": 1, "lifecycle": 2}) == write.config_hash({"a": 1})
    with pytest.raises(ValueError):
        read.inside("/r", "../x")
    write.point_to(spark, str(tmp_path / "current"), str(tmp_path / "out"))
    assert (tmp_path / "current").read_text() == str(tmp_path / "out")
    ok, errors = read.isolated({"good": lambda: df, "bad": lambda: 1 / 0})
    assert ok.count() == 2 and list(errors) == ["bad"]


def test_pages(spark):
    html = '<html><!-- <a href="x">no</a> --><style>p{}</style><p>Call 8 (999) 111-22-33 or mail A@B.ru</p><a href="tel:+79990001122">t</a><table><tr><td>a</td><th>b </th></tr></table></html>'
    page = read.parsed_pages(spark.createDataFrame([(1, html), (2, None)], "id INT, html STRING"), "id", "html")
    first = page.where("id = 1").first()
    assert first["rows"] == [["a", "b"]] and len(first["links"]) == 1 and "no" not in first["text"]
    found = read.page_contacts(page, "id", "text", "links").where("id = 1").first()
    assert found["phones"] == ["+79991112233", "+79990001122"] and found["emails"] == ["a@b.ru"]
    block = r"(?s)\[\[(.*?)\]\]"
    cards = spark.createDataFrame([(1, "[[T:City;N:2;<c 1|A st|9-18><c 2|B st|10>]]"), (2, "[[T:City;N:3;<c 1|A st|9-18>]]")], "id INT, html STRING")
    parse = lambda df: read.catalogue_cards(df, "id", "html", block, "T:(.*?);", r"N:(\d+)", r"<c (\d+)\|(.*?)\|(.*?)>")
    assert rows(parse(cards.where("id = 1")), "card_id", "address", "hours") == [("1", "A st", "9-18"), ("2", "B st", "10")]
    with pytest.raises(Exception, match="displayed count"):
        parse(cards).collect()
    for html, error in (("[[T:City;N:2;<c 1|A st|9-18><c 1|B st|10>]]", "one id"), ("[[T:City;N:1;<c 1|A|9>]][[T:Town;N:1;<c 1|B|9>]]", "one id"), ("nothing", "without cards"), (None, "without cards"), ("[[N:0;]]", "without title"), ("[[T:City;]]", "without title")):
        with pytest.raises(Exception, match=error):
            parse(spark.createDataFrame([(1, html)], "id INT, html STRING")).collect()
    shared = spark.createDataFrame([(1, "[[T:x;N:1;<c 0|A|9>]]<!-- North -->[[T:City;N:1;<c 1|A|9>]] <!--South--><!--East-->[[T:City;N:1;<c 2|A|9>]][[T:City;N:1;<c 3|A|9>]]"), (2, "[[T:y;N:1;<c 1|A|9>]]")], "id INT, html STRING")
    found = read.catalogue_cards(shared, "id", "html", block, "T:(.*?);", r"N:(\d+)", r"<c (\d+)\|(.*?)\|(.*?)>", region=r"<!--\s*(North|South|East)\s*-->")
    assert sorted((r["id"], r["block"], r["card_id"], r["region"]) for r in found.collect()) == [(1, 0, "0", None), (1, 1, "1", "North"), (1, 2, "2", "East"), (1, 3, "3", "East"), (2, 0, "1", None)]


def test_pipeline(spark, tmp_path):
    p = Pipeline({"region": "demo"})

    @p.step("double")
    def double(spark, tables):
        return {"twice": tables["numbers"].withColumn("n", F.col("n") * 2)}

    p.plug(Plugin("sum", "1", ("twice",), "total", lambda spark, t: {"total": t["twice"].agg(F.sum("n").alias("s"))}, quality_controls=(lambda df: df.where("s < 0"),)))
    numbers = spark.createDataFrame([(1,), (2,)], "n INT")
    p.build(spark, {"numbers": numbers}, str(tmp_path / "out"), ["total"])
    assert spark.read.parquet(str(tmp_path / "out/total")).first()["s"] == 6
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a").write_text("x")
    lock = p.lock(spark, str(tmp_path / "in"))
    assert p.check_lock(spark, str(tmp_path / "in"), lock) == []
    (tmp_path / "in/a").write_text("y")
    assert [s for _, s in p.check_lock(spark, str(tmp_path / "in"), lock)] == ["changed"]
    assert region_errors({"layers": {"l": {"file": "f", "value_field": "v", "bins": [{"max": 2}, {"max": 1}]}}}) == ["l: bins must ascend, an open one last"]


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "2026-01-01 00:00:00"), (1, "2026-01-01 00:30:00")], "k INT, ts STRING").selectExpr("k", "cast(ts as timestamp) ts").write.parquet(str(tmp_path / "e"))
    events = spark.readStream.schema("k INT, ts TIMESTAMP").parquet(str(tmp_path / "e"))
    seen = []
    snapshots.apply_snapshots(events, lambda df, i: seen.append(df.count()), str(tmp_path / "c")).awaitTermination()
    assert sum(seen) == 2 and snapshots.latest_states(events, "k", "ts").isStreaming


def test_nearest_on_ellipsoid_at_any_latitude(spark):
    rng = random.Random(5)
    for low, high in ((47.9, 48.1), (-70.0, 70.0)):
        a = [(k, rng.uniform(130, 132), rng.uniform(low, high)) for k in range(40)]
        b = [(k, rng.uniform(130, 132), rng.uniform(low, high)) for k in range(60)]
        left, right = (spark.createDataFrame(x, f"{n} INT, x DOUBLE, y DOUBLE") for n, x in (("i", a), ("j", b)))
        found = {r["i"]: r["j"] for r in review.nearest_on_ellipsoid(left, right, "i", "j").collect()}
        assert found == {i: min((float(geodesic(x, y, u, v)), j) for j, u, v in b)[1] for i, x, y in a}
    assert review.nearest_on_ellipsoid(left, right.limit(0), "i", "j").count() == 0


def test_nearest_line(spark):
    rng = random.Random(6)
    points = [(k, rng.uniform(-50, 50), rng.uniform(-50, 50)) for k in range(60)] + [(60, 4000.0, 0.0), (61, None, 0.0)]
    lines = [(k, [[rng.uniform(-50, 50), rng.uniform(-50, 50)] for _ in range(n)]) for k, n in enumerate((2, 4, 3, 1, 0))] + [(9, [[5.0, 5.0], [5.0, 5.0]])]
    df, roads = spark.createDataFrame(points, "id INT, x DOUBLE, y DOUBLE"), spark.createDataFrame(lines, "road INT, line ARRAY<ARRAY<DOUBLE>>")

    def distance(x, y):
        out = []
        for _, line in lines:
            for (ax, ay), (bx, by) in zip(line[:-1], line[1:]):
                n = (bx - ax) ** 2 + (by - ay) ** 2
                t = max(0, min(1, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / n)) if n else 0
                out.append(math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)))
        return min(out)

    found = {r["id"]: r["distance"] for r in spatial.nearest_line(df, roads, "id", start=3.0).collect()}
    assert found == {k: pytest.approx(distance(x, y)) for k, x, y in points if x is not None}
    assert spatial.nearest_line(df, roads.limit(0), "id").count() == 0


def test_clipping_of_shapes_with_holes(spark):
    domain = [[[[0.0, 0.0], [9.0, 0.0], [9.0, 8.0], [6.0, 8.0], [6.0, 3.0], [3.0, 3.0], [3.0, 8.0], [0.0, 8.0]]], [[[20.0, 0.0], [30.0, 0.0], [30.0, 10.0], [20.0, 10.0]], [[22.0, 2.0], [22.0, 5.0], [25.0, 5.0], [25.0, 2.0]]]]
    frame = [[[1.0, 1.0], [29.0, 1.0], [29.0, 7.0], [1.0, 7.0]], [[2.0, 2.0], [2.0, 6.0], [24.0, 6.0], [24.0, 2.0]]]
    buildings = spark.createDataFrame([("b", frame), ("far", [[[90.0, 90.0], [91.0, 90.0], [91.0, 91.0]]])], "b STRING, ring ARRAY<ARRAY<ARRAY<DOUBLE>>>")
    domains = spark.createDataFrame([("d", domain)], "d STRING, ring ARRAY<ARRAY<ARRAY<ARRAY<DOUBLE>>>>")
    found = {(r["ix"], r["iy"]): r["area"] for r in spatial.clipped_to_cells(buildings, domains, "b", "d", 1.0).collect()}
    cell = lambda x, y: (x < 9 and y < 8 and not (3 <= x < 6 and y >= 3) or 20 <= x < 30 and y < 10 and not (22 <= x < 25 and 2 <= y < 5)) and 1 <= x < 29 and 1 <= y < 7 and not (2 <= x < 24 and 2 <= y < 6)
    assert found == {(x, y): pytest.approx(1.0) for x in range(31) for y in range(11) if cell(x, y)}


def test_published_ids_go_by_name(spark):
    new = spark.createDataFrame([(1, "Zeta", "new1", ["k"]), (2, "alpha", "new2", ["k"]), (3, "Mid", "new3", ["k", "m"]), (4, "None", "new4", ["x"])], "component INT, name STRING, contact_id STRING, keys ARRAY<STRING>")
    old = spark.createDataFrame([("old", ["k"]), ("other", ["m"])], "contact_id STRING, keys ARRAY<STRING>")
    assert rows(resolve.preserved_ids(new, old), "component", "contact_id") == [(1, "new1"), (2, "old"), (3, "new3"), (4, "new4")]


def test_contact_sources(spark):
    source = "ARRAY<STRUCT<source_id: STRING, retrieved_at: STRING, url: STRING>>"
    schema = f"record INT, contact_id STRING, name STRING, kind STRING, coverage ARRAY<STRING>, specializations ARRAY<STRING>, phones ARRAY<STRING>, emails ARRAY<STRING>, websites ARRAY<STRING>, addresses ARRAY<STRING>, links ARRAY<STRING>, sources {source}"
    data = [(1, "", "Alpha", "agency", ["X"], [], ["8 999 111-22-33"], [], [], [], [], [("s", "d1", None)]), (2, "", "Alpha", "agency", ["X"], [], ["8 999 111-22-33"], ["a@b.ru"], [], [], [], [("s", "d2", None), ("t", "d2", "http://z.org//a")]), (3, "", "Beta", "broker", [], [], ["89990001122"], [], [], [], [], None)]
    found = resolve.merged(resolve.normalized(spark.createDataFrame(data, schema), "region"))
    one = {r["name"]: ([(x["source_id"], x["retrieved_at"], x["url"]) for x in r["sources"]], r["review_status"]) for r in found.collect()}
    assert one == {"Alpha": ([("s", "d2", None), ("t", "d2", "http://z.org/a")], "needs_review"), "Beta": ([], "needs_review")}
    assert resolve.catalogue_errors(found).count() == 0 and resolve.catalogue_errors(found.withColumn("kind", F.lit("?")), ("published",)).groupBy("error").count().count() == 2
    later = found.withColumn("sources", F.transform("sources", lambda x: x.withField("retrieved_at", F.lit("d9"))))
    # A record before all others moves their places in the run, which changes no contact.
    more = [(0, "", "Newcomer", "", [], [], ["8 900 000-00-00"], [], [], [], [], None), *((r[0] + 1, *r[1:]) for r in data)]
    more = resolve.merged(resolve.normalized(spark.createDataFrame(more, schema), "region"))
    assert sorted(r["status"] for r in resolve.delta(found, more).collect()) == ["added", "unchanged", "unchanged"]
    assert {r["status"] for r in resolve.delta(found, later.withColumn("review_status", F.lit("published"))).collect()} == {"unchanged"}
    assert sorted(r["status"] for r in resolve.delta(found.where("name = 'Alpha'"), later.withColumn("phones", F.array(F.lit("+1")))).collect()) == ["added", "changed"]


def test_features_round_trip(spark, tmp_path):
    text = '{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[37.6,55.7],[38,55],[37,55],[37.6,55.7]]]},"properties":{"name":"Дом"}}]}'
    (tmp_path / "l.geojson").write_text(text, encoding="utf-8")
    write.feature_lines(read.geojson(spark, str(tmp_path / "l.geojson"), "name: STRING").select("geometry", "properties.name"), str(tmp_path / "out"), "geometry", ["name"])
    lines = [json.loads(x) for f in (tmp_path / "out").glob("*.txt") for x in f.read_text(encoding="utf-8").splitlines()]
    assert lines == json.loads(text)["features"]
    assert read.feature_lines(spark, str(tmp_path / "out"), "name: STRING").select("properties.name").first()[0] == "Дом"
    write.csv(spark.createDataFrame([(1, "b")], "n INT, a STRING").coalesce(1), str(tmp_path / "csv"))
    assert next((tmp_path / "csv").glob("*.csv")).read_bytes() == "\ufeffa,n\nb,1\n".encode()
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        write.point_to(spark, str(tmp_path / "pointer"), str(tmp_path / name))
        assert (tmp_path / "pointer").read_text() == str(tmp_path / name)
    with pytest.raises(ValueError):
        write.point_to(spark, str(tmp_path / "pointer"), str(tmp_path / "three"))


def test_catalogue_coordinates(spark):
    def page(center="[133.266194, 44.157401,]", more=""):
        return f'$("#addr-id-27").click(function(){{\n  //center: [37.65, 55.71],\n map.flyTo({{center: {center}, zoom:15}});\n}});{more}'

    handler, centre = r'(?s)\$\("#addr-id-(\d+)"\)\.click\(function\(\)\{(.*?)\}\);', r"center:\s*\[\s*([-\d.]+),\s*([-\d.]+)\s*,?\s*\]"
    parse = lambda html: read.catalogue_coordinates(spark.createDataFrame([(1, html)], "id INT, html STRING"), "id", F.col("html"), handler, centre).collect()
    assert [tuple(r) for r in parse(page(more=page()))] == [(1, "27", 133.266194, 44.157401)]
    for bad in (page("[]"), page("[1, 2], center: [3, 4]"), page(more=page("[1, 2]"))):
        with pytest.raises(Exception, match="centre"):
            parse(bad)


def test_contact_sources_in_files(spark, tmp_path):
    (tmp_path / "contacts").mkdir()
    (tmp_path / "contacts/a.json").write_text('{"contacts": [{"name": "A", "phones": ["1"]}], "rows": [{"name": "R"}]}')
    (tmp_path / "contacts/b.json").write_text('[{"name": "B"}, {"name": "C", "phones": []}]')
    (tmp_path / "contacts/c.json").write_text('{"contacts": 3}')
    get = lambda path: [r["name"] for r in read.contacts_json(spark, str(tmp_path), path, "name: STRING, phones: ARRAY<STRING>").collect()]
    assert get("contacts/a.json") == ["A"] and get("contacts/b.json") == ["B", "C"]
    with pytest.raises(Exception, match="no contacts"):
        get("contacts/c.json")
    for path in ("other/a.json", "contacts/../x.json", "/contacts/a.json"):
        with pytest.raises(ValueError):
            get(path)
    fetched = lambda address, key: [r["name"] for r in read.fetched_json(spark, str(tmp_path / "contacts/a.json"), address, ["z.org"], "name: STRING", key).collect()]
    assert fetched("https://z.org/x", "rows") == ["R"]
    for address in ("http://z.org/x", "https://z.org.evil.net/", "https://z.org@evil.net/"):
        with pytest.raises(ValueError):
            fetched(address, "rows")
    page = spark.createDataFrame([("s", "http://z.org/a", "<p>8 900 111-22-33", ["z.org"], False)], "s STRING, u STRING, h STRING, hosts STRING, ok BOOLEAN".replace("hosts STRING", "hosts ARRAY<STRING>"))
    with pytest.raises(Exception, match="not allowed"):
        read.website_contacts(page, "s", "u", "h", "hosts", "ok").collect()


def test_small_rules(spark):
    df = spark.createDataFrame([("2026-01-01T00:00:00Z", "2026-01-01T00:01:00Z"), (None, "2026-01-01T00:01:00Z")], "a STRING, b STRING")
    assert [tuple(r) for r in df.select(layers.cooled_down(F.col("a"), F.col("b"), 60), layers.cooled_down(F.col("a"), F.col("b"), 61)).collect()] == [(True, False), (True, True)]
    parts = spark.createDataFrame([([("Point", [1.0]), ("Polygon", [2.0]), ("LineString", [3.0]), ("MultiPolygon", [4.0])],)], "geometries ARRAY<STRUCT<type: STRING, shape: ARRAY<DOUBLE>>>")
    assert [g["shape"] for g in parts.select(spatial.polygonal(parts).alias("g")).first()["g"]] == [[2.0], [4.0]]
    assert spark.range(1).select(review.occupancy(F.lit(5)).alias("o")).first()["o"] is None


def test_entry(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and __spark_entry__.entry(spark).limit(5).count() == 5
