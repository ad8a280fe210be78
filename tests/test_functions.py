"""Text identities, scalars and geometry, by known vectors."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geolith.functions import geo, scalars, text


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def each(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, v STRING")
    return [r["x"] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_names(spark):
    assert each(spark, text.name_key, ["Ёлки-Палки 12", "Straße", None]) == ["елкипалки12", "strasse", None]
    assert each(spark, text.label_key, ["Ёж", None]) == ["еж", ""]
    assert each(spark, text.resort_locality, ["Шмаковка КП ", "кпп"]) == ["Шмаковка", "кпп"]
    assert each(spark, text.district_key, ["Городской округ Фокино", "г. Большой Камень", "Городовиков район"]) == ["фокино", "большойкамень", "городовиков"]
    assert each(spark, text.compact, ["  a   b ", None]) == ["a b", ""]
    assert each(spark, text.token, ["  Ｐ.  Ёж "]) == ["p. еж"]


def test_streets_and_houses(spark):
    street = lambda v: [(r["street_type"], r["street_name"]) for r in each(spark, text.street_identity, v)]
    assert street(["ул.Ульяновская", "проезд Ленина", "Ленина улица", "Садовая", "мкр. Северный", None]) == [("street", "ульяновская"), ("drive", "ленина"), ("street", "ленина"), (None, "садовая"), ("microdistrict", "северный"), (None, "")]
    assert each(spark, text.house_number, ["6 корпус 2", "6/4", "д. 5 A", "7 строение 1", "3 литера Б"]) == ["6к2", "6/4", "5а", "7стр1", "3б"]
    assert each(spark, text.locality_name, ["пгт. Ольга", "село Новое", "с Ивановка", "Большой"]) == ["ольга", "новое", "ивановка", "большой"]
    assert each(spark, text.plain_number, ["6 K1"]) == ["6к1"]


def test_addresses(spark):
    found = each(spark, text.official_address, ["край, пгт. Ольга, ул. Ленина, д. 6/4", "с. Сергеевка, ДОС 388", "без дома", "Ленина, д. 1"])
    assert tuple(found[0]) == ("ольга", "street", "ленина", "6/4") and tuple(found[1]) == ("сергеевка", "quarter", "дос", "388") and found[2] is None and found[3] is None
    plain = each(spark, text.plain_address, ["г. Артем, ул. Кирова, д. 5", "одно"])
    assert tuple(plain[0]) == ("артем", "кирова", "5") and plain[1] is None
    assert [tuple(r) for r in each(spark, text.municipality_identity, ["Городской округ Артем", "ЗАТО Фокино", "Ольгинский муниципальный район"])] == [("артем", "city"), ("фокино", "zato"), ("ольгинский", "district")]
    key = one(spark, text.store_address(F.lit("г. Артем"), F.lit("ул. Кирова, д. 5")))
    assert tuple(key) == ("артем", "street", "кирова", "5") and one(spark, text.store_address(F.lit("x"), F.lit("y"))) is None


def test_candidate_class(spark):
    official = F.struct(F.lit("ольга").alias("locality"), F.lit("street").alias("street_type"), F.lit("ленина").alias("street_name"), F.lit("6").alias("house_number"))

    def cls(localities, kind="street", house="6", context=()):
        array = lambda v: F.array(*map(F.lit, v)).cast("array<string>")
        identity = F.struct(array(localities).alias("localities"), F.lit(kind).alias("street_type"), F.lit("ленина").alias("street_name"), F.lit(house).alias("house_number"))
        return one(spark, text.candidate_class(identity, official, array(context)))

    assert cls(["ольга"]) == "explicit_address_candidate" and cls([]) == "municipal_registry_candidate" and cls([], context=["ольга"]) == "osm_boundary_context_candidate"
    assert cls(["артем"]) is None and cls([], kind="lane") is None and cls([], kind=None) == "municipal_registry_candidate" and cls(["ольга"], house="7") is None and cls([], context=["а", "ольга"]) is None


def test_channels(spark):
    assert each(spark, text.phone, ["8 (999) 111-22-33", "9991112233", "12", "+7 999 111 22 33", None]) == ["+79991112233", "+79991112233", None, "+79991112233", None]
    assert each(spark, text.email, [" A@B.ru ", "no", "a@b"]) == ["a@b.ru", None, None]
    urls = ["HTTP://Ex.org.:80//a///b?q=1#f", "https://ex.org:8443", "ftp://x.org", "http://u:p@x.org", "http://", "https://ex.org:443/"]
    assert each(spark, text.web_address, urls) == ["http://ex.org/a/b?q=1", "https://ex.org:8443/", None, None, None, "https://ex.org/"]
    assert each(spark, text.link_type, ["https://t.me/x", "https://wa.me/1", "https://m.vk.com/a", "https://youtu.be/z", "https://x.org/"]) == ["telegram", "whatsapp", "vk", "youtube", "other"]
    assert each(spark, text.company_key, ["ООО «Дом»", "Агентство недвижимости Ёлка"]) == ["дом", "елка"]
    assert each(spark, text.clean_markup, ["<b>a &amp; b</b>"]) == ["a & b"] and each(spark, text.route_text, ["Р–297 Амур"]) == ["R-297AМУR"]
    assert [text.excel_column(n) for n in (1, 26, 27, 703)] == ["A", "Z", "AA", "AAA"]


def test_scalars(spark):
    assert each(spark, scalars.number, ["1 234,5", "", "x", None, "7"]) == [1234.5, None, None, None, 7.0]
    assert each(spark, lambda c: scalars.positive(c, True, 10), ["5", "5,5", "0", "11", "nan", ""]) == [5.0, None, None, None, None, None]
    assert one(spark, scalars.half_even(F.lit(2.675), F.lit(2))) == 2.67 and one(spark, scalars.half_even(F.lit(2.5), F.lit(0))) == 2.0
    assert one(spark, scalars.floor_div(F.lit(-7), 2)) == -4
    bins = ((10.0, "a"), (20.0, "b"), (None, "c"))
    assert [one(spark, scalars.bin_of(F.lit(v).cast("double"), bins)) for v in (None, 9.9, 10, 20)] == ["a", "a", "b", "c"]
    assert one(spark, scalars.first_rule(F.lit(30), ((20, "x"), (10, "y")))) == "x" and one(spark, scalars.first_rule(F.lit(5), ((20, "x"),))) is None
    status = lambda v: tuple(one(spark, scalars.reconciled(F.array(*map(F.lit, v)).cast("array<int>"))))
    assert status([]) == (None, "unknown") and status([3, 3]) == (3, "reported") and status([3, 4]) == (None, "conflicting")
    assert one(spark, scalars.known_population(F.lit(0), F.lit("not_available"))) is None


def test_projection_round_trip(spark):
    for lon, lat in ((134.0, 45.0), (131.9, 43.1), (136.5, 46.2)):
        row = spark.range(1).select(*(c.alias(n) for n, c in zip("xy", geo.equal_area(F.lit(lon), F.lit(lat)), strict=True))).first()
        back = geo.equal_area_inverse(row["x"], row["y"])
        assert math.isclose(back[0], lon, abs_tol=1e-9) and math.isclose(back[1], lat, abs_tol=1e-9)


def test_geodesic():
    assert geo.geodesic(0, 0, 0, 1)[()] == pytest.approx(110574.3886, abs=1e-3)
    assert geo.geodesic(131.9, 43.1, 131.9, 43.1)[()] == pytest.approx(0, abs=1e-9)
    assert geo.geodesic(0, 0, 1, 0)[()] == pytest.approx(111319.4908, abs=1e-3)


SQUARE = np.array([[0, 0], [2, 0], [2, 2], [0, 2]], float)
ELL = np.array([[0, 0], [3, 0], [3, 1], [1, 1], [1, 3], [0, 3]], float)


def test_polygons():
    assert geo.area(SQUARE) == 4 and geo.shape_areas([ELL, SQUARE])[0] == pytest.approx(5)
    assert geo.intersection_areas([ELL, SQUARE], [SQUARE, SQUARE + 5]).tolist() == pytest.approx([3, 0])
    assert geo.contains([ELL], np.array([0.5, 2, 3, 1]), np.array([2, 2, 0.5, 2])).tolist() == [True, False, True, True]
    assert geo.contains([ELL], *np.array(geo.inner_point(ELL))[:, None])[0]
    assert geo.normal_form(SQUARE) == geo.normal_form(np.roll(SQUARE, 2, 0)) == geo.normal_form(SQUARE[::-1]) != geo.normal_form(ELL)
    assert abs(geo.area(geo.circle(0, 0, 1))) == pytest.approx(math.pi, rel=1e-3)
    parts = geo.clip_line(np.array([[-1, 1], [4, 1]], float), SQUARE)
    assert len(parts) == 1 and parts[0].tolist() == [[0, 1], [2, 1]]
    sites = np.array([[0, 0], [4, 0], [2, 5]], float)
    frame = np.array([[-9, -9], [9, -9], [9, 9], [-9, 9]], float)
    assert sum(abs(geo.area(geo.voronoi(sites, k, frame))) for k in range(3)) == pytest.approx(324)


@settings(max_examples=60, deadline=None)
@given(st.floats(-3, 3), st.floats(-3, 3), st.floats(0.1, 4), st.floats(0.1, 4))
def test_clip_never_grows(x, y, w, h):
    ring = np.array([[x, y], [x + w, y], [x + w, y + h], [x, y + h]])
    common = geo.intersection_areas([ring], [SQUARE])[0]
    exact = max(0, min(x + w, 2) - max(x, 0)) * max(0, min(y + h, 2) - max(y, 0))
    assert common == pytest.approx(exact, abs=1e-9)


def box(x0, y0, x1, y1, turned=False):
    ring = [[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]
    return ring[::-1] if turned else ring


#: A U-shape, a frame with a hole, two islands one of which has a hole with an island, a comb.
SHAPES = [
    [[0, 0], [9, 0], [9, 8], [6, 8], [6, 3], [3, 3], [3, 8], [0, 8]],
    [box(1, 1, 8, 8), box(3, 2, 6, 5)],
    [[box(0, 0, 3, 3, True)], [box(4, 0, 11, 9), box(5, 1, 10, 8)], [box(6, 3, 8, 6)]],
    [[0, 0], [10, 0], [10, 2], [8, 2], [8, 7], [7, 7], [7, 2], [5, 2], [5, 7], [4, 7], [4, 2], [2, 2], [2, 7], [0, 7]],
]


def covered(shape):
    """Unit cells of a shape, whose corners are integers."""
    middle = np.array([(x + 0.5, y + 0.5) for x in range(12) for y in range(12)])
    return geo.contains(geo.shape_rings([np.array(r, float) for r in geo.shape_rings(shape)]), *middle.T)


def test_shapes_with_holes_and_parts():
    cells = [covered(s) for s in SHAPES]
    assert geo.shape_areas(SHAPES).tolist() == pytest.approx([c.sum() for c in cells])
    left, right = zip(*((i, j) for i in range(4) for j in range(4)))
    found = geo.intersection_areas([SHAPES[i] for i in left], [SHAPES[j] for j in right])
    assert found.tolist() == pytest.approx([(cells[i] & cells[j]).sum() for i, j in zip(left, right)])
    turned = [[[q[1], q[0]] for q in SHAPES[0]]]
    assert geo.intersection_areas(turned, [SHAPES[1]]).tolist() == pytest.approx([(cells[1] & covered(turned[0])).sum()])


def test_ragged_clipping_matches_single_rings():
    rng = np.random.default_rng(3)
    rings = [rng.random((int(rng.integers(3, 9)), 2)) for _ in range(50)] + [np.zeros((0, 2))]
    many = geo.Rings.of(rings)
    a, b, c = rng.random(51), rng.random(51), rng.random(51)
    for k, (ring, area) in enumerate(zip(rings, many.clipped(a, b, c).areas(), strict=True)):
        alone = geo.clip_half_plane(ring, a[k], b[k], c[k])
        assert area == pytest.approx(geo.area(alone) if len(alone) else 0)
