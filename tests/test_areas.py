"""Overlays, outlines, buffers, domains, protection and nearest partners against sampled points and brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geolith.functions import geo
from geolith.functions import overlay as kernel
from geolith.operators import domains, nearest, overlay

RINGS = "ARRAY<ARRAY<ARRAY<DOUBLE>>>"


def star(x, y, r, n, seed):
    """A concave ring around a point, with the centre inside."""
    g = np.random.default_rng(seed)
    t = (np.arange(n) + 0.8 * g.random(n)) / n * 2 * math.pi
    far = r * (0.4 + 0.6 * g.random(n))
    return np.stack([x + far * np.cos(t), y + far * np.sin(t)], 1)


def holed(x, y, r, seed):
    return [star(x, y, r, 17, seed).tolist(), star(x, y, r / 4, 9, seed + 1000).tolist()]


def inside(shape, p):
    return geo.contains([np.asarray(r, float) for r in shape], p[:, 0], p[:, 1])


def edges_of(rings):
    return np.vstack([np.hstack([r, np.roll(r, -1, 0)]) for r in rings])


@pytest.mark.parametrize("seed", range(30))
def test_overlay_of_whole_numbers(seed):
    """Rectangles and triangles with common edges, corners on edges and whole copies."""
    g = np.random.default_rng(seed)
    rings = []
    for _ in range(6):
        x, y = g.integers(0, 6, 2)
        a, b = g.integers(1, 4, 2)
        rings.append(1024 + 1024 * np.array([(x, y), (x + a, y), (x + a, y + b), (x, y + b)] if g.random() < 0.5 else [(x, y), (x + a, y), (x, y + a)]))
    rings.append(rings[0])
    edges, of = edges_of(rings), np.repeat(np.arange(7), [len(r) for r in rings])
    counts = np.zeros((len(edges), 2), np.int64)
    counts[np.arange(len(edges)), of % 2] = 1
    p = np.stack([1024 + 9 * 1024 * g.random(3000), 1024 + 9 * 1024 * g.random(3000)], 1)
    own = [np.any([inside([r], p) for r in rings[k::2]], 0) for k in (0, 1)]
    for rule in (lambda a, b: a | b, lambda a, b: a & b, lambda a, b: a & ~b, lambda a, b: a ^ b):
        lines, border = kernel.chains(kernel.overlay(edges, counts, rule))
        assert not len(border) and all((line[0] == line[-1]).all() for line in lines)
        assert (inside([line[:-1] for line in lines], p) != rule(*own)).sum() <= 1  # a rounded crossing moves an edge by half a step


def test_areas_that_touch_in_a_point_stay_apart():
    squares = [np.array([(4, 4), (8, 4), (8, 8), (4, 8)]), np.array([(8, 8), (12, 8), (12, 12), (8, 12)])]
    found = kernel.overlay(edges_of(squares), np.ones((8, 1), np.int64), lambda a: a)
    assert sorted(len(line) for line in kernel.chains(found)[0]) == [5, 5]


def test_empty_overlay():
    none = np.zeros((0, 4), np.int64)
    assert len(kernel.overlay(none, np.zeros((0, 1), np.int64), lambda a: a)) == 0
    square = edges_of([np.array([(4, 4), (8, 4), (8, 8), (4, 8)])])
    assert len(kernel.overlay(np.vstack([square, square]), np.repeat(np.eye(2, dtype=np.int64), 4, 0), lambda a, b: a & ~b)) == 0


@pytest.mark.parametrize("most", [120, 20_000])
def test_union_over_cells_and_its_outline(spark, most):
    """Slanted, concave shapes with holes over several cells; with few edges a turn, also joined in parts."""
    g = np.random.default_rng(4)
    shapes = [(k % 2, holed(*(g.random(2) * 5000 - 1500), 900, k)) for k in range(40)]
    cells = overlay.dissolved(overlay.cut(spark.createDataFrame([*shapes, (0, shapes[0][1]), (0, None), (1, [])], f"k INT, ring {RINGS}"), ["k"]), ["k"], most=most)
    areas = {r["k"]: r["area"] for r in overlay.areas(cells, ["k"]).collect()}
    rings = overlay.outline(cells, ["k"])
    made = {r["k"]: r["ring"] for r in overlay.shapes_of(rings, ["k"]).collect()}
    p = g.random((20_000, 2)) * 8000 - 3000
    for k in (0, 1):
        assert (inside(made[k], p) == np.any([inside(s, p) for n, s in shapes if n == k], 0)).all()
        assert geo.shape_areas([made[k]])[0] == pytest.approx(areas[k], rel=1e-9)
    first = rings.where("seq <= 0").groupBy("k", "ring").agg(F.min("seq").alias("s"), F.count("*").alias("n"), F.countDistinct("seq").alias("d"))
    assert first.where("n <> 1 - s or n <> d").isEmpty()  # pieces are numbered without gaps


def test_inclusion_and_exclusion(spark):
    g = np.random.default_rng(8)
    rows = [(k, a, b) for k in range(25) for a, b in [(holed(300.0, -200.0, 900, 10 * k), holed(*(g.random(2) * 1500 - 500), 800, 10 * k + 1))]]
    pieces = overlay.cut(spark.createDataFrame([(k, a) for k, a, _ in rows], f"k INT, ring {RINGS}"), ["k"], 0).union(overlay.cut(spark.createDataFrame([(k, b) for k, _, b in rows], f"k INT, ring {RINGS}"), ["k"], 1))
    found = [{r["k"]: r["area"] for r in overlay.areas(overlay.overlaid(pieces, ["k"], 2, rule), ["k"]).collect()} for rule in (lambda a, b: a | b, lambda a, b: a & b, lambda a, b: a & ~b)]
    for k, a, b in rows:
        common, (one, two) = geo.intersection_areas([a], [b])[0], geo.shape_areas([a, b])
        assert [f.get(k, 0.0) for f in found] == pytest.approx([one + two - common, common, one - common], rel=1e-8, abs=1e-2)


def test_buffers(spark):
    area = lambda df, r, q=64: overlay.areas(overlay.dissolved(overlay.cut(overlay.capsules(df, ["k"], r, q), ["k"]), ["k"]), ["k"]).collect()[0]["area"]
    round_ = 4 * 64 / 2 * math.sin(2 * math.pi / (4 * 64))  # a circle's area by its radius squared
    point = spark.createDataFrame([(1, [5.0, 5.0], 3000.0)], "k INT, ring ARRAY<DOUBLE>, far DOUBLE")
    assert area(point, "far") == pytest.approx(9e6 * round_)
    square = spark.createDataFrame([(1, [[0.0, 0.0], [1000.0, 0.0], [1000.0, 1000.0], [0.0, 1000.0], [0.0, 0.0]])], "k INT, ring ARRAY<ARRAY<DOUBLE>>")
    assert area(square, 100) == pytest.approx(1e6 + 4e5 + 1e4 * round_)
    line = spark.createDataFrame([(1, [[0.0, 0.0], [300.0, 400.0], [300.0, 400.0], [0.0, 800.0]])], "k INT, line ARRAY<ARRAY<DOUBLE>>")
    bend = math.acos(7 / 25)  # half circles at both ends, a sector outside of the bend; inside, both sides overlap in a kite
    assert area(line, 10) == pytest.approx(20 * 1000 + 100 * (round_ + bend / 2 - math.tan(bend / 2)), rel=1e-5)
    shape = [holed(0.0, 0.0, 500, 3)]
    grown = overlay.shapes_of(overlay.outline(overlay.dissolved(overlay.cut(overlay.capsules(spark.createDataFrame([(1, shape[0])], f"k INT, ring {RINGS}"), ["k"], 40.0), ["k"]), ["k"]), ["k"]), ["k"]).collect()[0]["ring"]
    p = np.random.default_rng(1).random((3000, 2)) * 1400 - 700
    ends = np.vstack([edges_of([np.array(r)]) for r in shape[0]])
    _, far = nearest.best_of(ends, p[:, 0], p[:, 1])
    far[inside(shape[0], p)] = 0
    clear = abs(far - 40) > 0.2  # an arc's edges are a little nearer than the arc
    assert (inside(grown, p) == (far <= 40))[clear].all()


def test_domains_are_voronoi_cells(spark):
    """Against all other sites, with one large radius among small ones, a crowd and an outlier."""
    g = np.random.default_rng(4)
    at = np.vstack([g.random((60, 2)) * 1000, 500 + g.normal(size=(90, 2)), [[1e6, 1e6]]])
    radius = np.where(np.arange(len(at)) % 20 == 0, 5000.0, g.uniform(20, 200, len(at)))
    rows = [(f"s{k}", float(x), float(y), None if k % 9 == 5 else float(r)) for k, ((x, y), r) in enumerate(zip(at, radius, strict=True))]
    found = {r["s"]: r["ring"] for r in domains.voronoi_cells(spark.createDataFrame(rows, "s STRING, x DOUBLE, y DOUBLE, radius DOUBLE"), "s").collect()}
    expected = {n: abs(geo.area(geo.voronoi(at - (x, y), k, geo.circle(0, 0, r)))) for k, (n, x, y, r) in enumerate(rows) if r}
    assert found.keys() == expected.keys()
    for n, x, y, r in rows:
        if r:
            assert abs(geo.area(np.array(found[n]) - (x, y))) == pytest.approx(expected[n], rel=1e-6)
    with pytest.raises(ValueError, match="one place"):
        domains.voronoi_cells(spark.createDataFrame([("a", 1.0, 1.0, 5.0), ("b", 1.0, 1.0, 5.0)], "s STRING, x DOUBLE, y DOUBLE, radius DOUBLE"), "s")
    assert domains.voronoi_cells(spark.createDataFrame([], "s STRING, x DOUBLE, y DOUBLE, radius DOUBLE"), "s").count() == 0


def test_allocation_domains(spark):
    """Points of a plane go where the definition says; domains share nothing."""
    g = np.random.default_rng(6)
    at = g.random((14, 2)) * 6000
    sites = [(f"s{k}", "west" if x < 3000 else "east", float(x), float(y), None if k == 13 else 1800.0) for k, (x, y) in enumerate(at)]
    lands = [("west", [star(1500, 3000, 4000, 13, 1).tolist()]), ("east", [star(4500, 3000, 4000, 13, 2).tolist()])]
    bounds = [(f"s{k}", [star(*at[k], 900, 11, 50 + k).tolist()]) for k in (2, 5)]
    cells = domains.allocation_domains(spark.createDataFrame(sites, "s STRING, m STRING, x DOUBLE, y DOUBLE, radius DOUBLE"), spark.createDataFrame(lands, f"m STRING, ring {RINGS}"), spark.createDataFrame(bounds, f"s STRING, ring {RINGS}"), "s", "m").cache()
    made = {r["s"]: r["ring"] for r in overlay.shapes_of(overlay.outline(cells, ["s"]), ["s"]).collect()}
    p = g.random((6000, 2)) * 7000 - 500
    d = np.hypot(p[:, None, 0] - at[None, :, 0], p[:, None, 1] - at[None, :, 1])
    own = {s: inside(r, p) for s, r in bounds}
    land = {m: inside(r, p) for m, r in lands}
    for k, (s, m, x, y, r) in enumerate(sites):
        if r:
            circle = geo.contains([geo.circle(x, y, r)], p[:, 0], p[:, 1])
            expected = land[m] & (own[s] if s in own else (d.argmin(1) == k) & circle & ~np.any(list(own.values()), 0))
            assert (inside(made.get(s, []), p) == expected).all(), s
    assert "s13" not in made
    wanted = spark.createDataFrame(sites, "s STRING, m STRING, x DOUBLE, y DOUBLE, radius DOUBLE")
    assert {r["s"] for r in domains.without_domain(wanted, cells, "s").collect()} == {s for s, *_, r in sites if r} - set(made)
    twice = domains.shared_area(cells.union(cells.where("s = 's2'")), "s").agg(F.sum("area")).first()[0]
    overlap = domains.shared_area(cells, "s").agg(F.coalesce(F.sum("area"), F.lit(0.0))).first()[0]
    both = (inside(made["s2"], p) & inside(made["s5"], p)).any()
    assert (overlap > 1) == both and twice - overlap == pytest.approx(overlay.areas(cells.where("s = 's2'"), ["s"]).first()["area"])


def test_claims_and_protection(spark):
    places = spark.createDataFrame([("town", 0.0, 0.0, 100.0), ("village", 60.0, 0.0, 60.0), ("far", 500.0, 0.0, 10.0)], "p STRING, x DOUBLE, y DOUBLE, radius DOUBLE")
    bounds = spark.createDataFrame([("town", [[-20.0, -20.0], [30.0, 0.0], [-20.0, 20.0]]), ("far", [[40.0, -5.0], [50.0, 0.0], [40.0, 5.0]])], "p STRING, ring ARRAY<ARRAY<DOUBLE>>")
    b = spark.createDataFrame([(1, 0.0, 0.0), (2, 29.0, 0.0), (3, 35.0, 0.0), (4, 45.0, 0.0), (5, 20.0, 15.0), (6, 300.0, 0.0)], "b INT, x DOUBLE, y DOUBLE")
    found = lambda protect: sorted((r["b"], r["p"]) for r in domains.claimed(b, places, bounds, "b", "p", protect).collect())
    assert found(True) == [(1, "town"), (2, "town"), (3, "village"), (5, "village")]  # 4 lies in the boundary of another place
    assert found(False) == [(1, "town"), (2, "town"), (3, "village"), (4, "village"), (5, "village")]
    slanted = spark.createDataFrame([(1, [[0.0, 0.0], [10.0, 10.0], [0.0, 20.0]])], "a INT, ring ARRAY<ARRAY<DOUBLE>>")
    squares = spark.createDataFrame([("in", 1.0, 5.0, 3.0, 7.0), ("corner", 7.0, 1.0, 9.0, 3.0), ("tip", 10.0, 8.0, 12.0, 12.0), ("near", 10.5, 8.0, 12.0, 12.0), ("cut", 9.0, 9.5, 11.0, 10.5)], "s STRING, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE")
    free = lambda touching: sorted(r["s"] for r in domains.outside(squares, slanted, ["s"], touching=touching).collect())
    assert free(False) == ["corner", "near", "tip"] and free(True) == ["corner", "near"]


@pytest.mark.parametrize("most", [10**6, 1])
def test_nearest_equals_brute_force(spark, monkeypatch, most):
    """Crowds, ties and far outliers on both sides, with the right side at every task and dealt out."""
    monkeypatch.setattr(nearest, "LEAF_ROWS", 60)
    g = np.random.default_rng(2)
    left = np.vstack([g.random((700, 2)) * 100, g.normal(size=(200, 2)) * 0.01, [[1e9, -1e9], [50, 1e7]]])
    right = np.vstack([np.rint(g.random((900, 2)) * 30), g.normal(size=(400, 2)) * 0.02, [[1e9, 1e9]], np.zeros((50, 2))])
    df = lambda p, n: spark.createDataFrame(pd.DataFrame({n: np.arange(len(p)), "x": p[:, 0], "y": p[:, 1]}))
    d = np.hypot((left[:, None, 0] - right[None, :, 0]) * 2, left[:, None, 1] - right[None, :, 1])
    found = nearest.nearest(df(left, "id"), df(right, "other"), "id", "other", kx=2.0, most=most).toPandas().sort_values("id")
    assert (found["other"].to_numpy() == d.argmin(1)).all() and np.allclose(found["distance"], d.min(1), rtol=1e-12)
    lines = spark.createDataFrame([(int(k), [[float(a), float(b)], [float(a) + 5 * (k % 3), float(b) - k % 7]]) for k, (a, b) in enumerate(right[:300])], "l INT, line ARRAY<ARRAY<DOUBLE>>")
    ends = np.array([[a, b, a + 5 * (k % 3), b - k % 7] for k, (a, b) in enumerate(right[:300])])
    _, far = nearest.best_of(ends, left[:, 0], left[:, 1])
    found = nearest.nearest_line(df(left, "id"), lines, "id", most=most).toPandas().sort_values("id")
    assert np.allclose(found["distance"], far, rtol=1e-9, atol=1e-9)


def test_nearest_of_nothing(spark):
    a = spark.createDataFrame([(1, 0.0, None), (2, float("nan"), 1.0), (3, 4.0, 3.0)], "id INT, x DOUBLE, y DOUBLE")
    b = spark.createDataFrame([("z", 0.0, 0.0), ("a", 0.0, 0.0), (None, 4.0, 3.0), ("n", None, 3.0)], "other STRING, x DOUBLE, y DOUBLE")
    assert [tuple(r) for r in nearest.nearest(a, b, "id", "other").collect()] == [(3, "a", 5.0)]
    assert nearest.nearest(a, b.limit(0), "id", "other").count() == 0 and nearest.nearest(a.limit(0), b, "id", "other").count() == 0


def test_lines_within_areas(spark):
    """Lengths and parts against points along the lines; lines over several cells, along borders, through holes and back again."""
    g = np.random.default_rng(12)
    shapes = [(k, holed(*(g.random(2) * 3000), 900, k)) for k in range(6)]
    lines = [(k, (g.random((int(g.integers(2, 6)), 2)) * 5000 - 1000).tolist()) for k in range(25)] + [(100, [[0.0, 0.0]]), (101, [[1.0, 1.0], [1.0, 1.0]]), (102, None)]
    frame = spark.createDataFrame(lines, "l INT, line ARRAY<ARRAY<DOUBLE>>")
    found = overlay.lines_within(frame, overlay.cut(spark.createDataFrame(shapes, f"a INT, ring {RINGS}"), ["a"]), "l", ["a"], most=7).collect()
    assert {r["l"] for r in found} < set(range(25))
    for k, line in lines[:25]:
        line = np.array(line)
        p = np.vstack([a + np.outer((np.arange(4000) + 0.5) / 4000, b - a) for a, b in zip(line[:-1], line[1:], strict=True)])
        step = np.repeat(np.hypot(*(line[1:] - line[:-1]).T) / 4000, 4000)
        for a, shape in shapes:
            on = inside(shape, p)
            own = [r for r in found if (r["l"], r["a"]) == (k, a)]
            assert sum(r["length"] for r in own) == pytest.approx(float(step[on].sum()), abs=4 * step.max() * (1 + 2 * len(own)))
            assert sum(r["length"] for r in own) == pytest.approx(sum(float(np.hypot(*np.diff(np.array(r["line"]), axis=0).T).sum()) for r in own))
            runs = int((on & ~np.concatenate([[False], on[:-1]])).sum())
            assert len(own) >= runs and all(r["length"] < 3 * step.max() for r in sorted(own, key=lambda r: -r["length"])[runs:])
    square = spark.createDataFrame([(1, [[0.0, 0.0], [3000.0, 0.0], [3000.0, 3000.0], [0.0, 3000.0]])], "a INT, ring ARRAY<ARRAY<DOUBLE>>")
    lines = spark.createDataFrame([(1, [[-10.0, 0.0], [3010.0, 0.0]]), (2, [[-10.0, 3000.0], [0.0, 3000.0], [10.0, 3010.0]]), (3, [[10.0, 10.0], [20.0, 10.0], [10.0, 10.0], [10.0, 20.0]])], "l INT, line ARRAY<ARRAY<DOUBLE>>")
    found = overlay.lines_within(lines, overlay.cut(square, ["a"]), "l", ["a"]).collect()
    assert sorted((r["l"], r["part"], round(r["length"], 4)) for r in found) == [(1, 0, 3000.0), (3, 0, 30.0)]
    assert [r["line"] for r in found if r["l"] == 3] == [[[10.0, 10.0], [20.0, 10.0], [10.0, 10.0], [10.0, 20.0]]]


def test_faults_of_shapes(spark):
    box = lambda a, b, c, d: [[a, b], [c, b], [c, d], [a, d]]
    cases = [
        ([box(0.0, 0, 10, 10)], []), ([[*box(0.0, 0, 10, 10), [0.0, 0.0], [0.0, 0.0]], box(2.0, 2, 4, 4)[::-1]], []), ([box(0.0, 0, 10, 10), box(2.0, 2, 4, 4), box(4.0, 4, 6, 6)], []),
        ([[[0.0, 0], [10, 10], [10, 0], [0, 10]]], ["self_intersection"]), ([[[0.0, 0], [10, 0], [5, 5], [10, 10], [0, 10], [5, 5]]], ["self_intersection"]), ([[[0.0, 0], [10, 0], [10, 10], [10, 0]]], ["self_intersection"]),
        ([box(0.0, 0, 10, 10), box(8.0, 8, 12, 12)], ["overlapping_rings"]), ([box(0.0, 0, 10, 10), box(20.0, 8, 22, 12)], ["overlapping_rings"]), ([box(0.0, 0, 10, 10), box(0.0, 2, 4, 4)], ["overlapping_rings"]),
        ([box(0.0, 0, 10, 10), box(2.0, 2, 6, 6), box(4.0, 4, 8, 8)], ["overlapping_rings"]), ([[[0.0, 0], [1, 1]]], ["too_few_points"]), ([[[0.0, float("nan")], [1, 1], [0, 1]]], ["not_finite"]), ([], ["too_few_points"]), (None, None),
    ]
    given = [(k, s and [[[float(x) for x in p] for p in r] for r in s]) for k, (s, _) in enumerate(cases)]
    df = spark.createDataFrame(given, f"k INT, ring {RINGS}").repartition(1)
    assert {r["k"]: r["f"] for r in df.select("k", overlay.shape_faults("ring").alias("f")).collect()} == {k: f for k, (_, f) in enumerate(cases)}
    apart, over = ([[[np.array(box(a, 0, a + 4, 4), float)] for a in at]] for at in ((0, 4), (0, 3)))
    assert kernel.faults([[np.array(box(0, 0, 4, 4), float)], [np.array(box(4, 4, 8, 8), float)]]) == [] and kernel.faults(over[0]) == kernel.faults(apart[0]) == ["overlapping_rings"]


def test_normal_forms():
    shell, hole, other = star(0, 0, 10, 9, 1), star(0, 0, 2, 5, 2), star(1, 0, 1, 4, 3)
    turned = lambda r, k: [*np.roll(r, k, 0).tolist(), np.roll(r, k, 0)[0].tolist()]
    forms = {geo.normal_form([turned(shell, a), turned(hole[::-1], b), turned(other, a)]) for a in (0, 3) for b in (0, 2)} | {geo.normal_form([shell[::-1].tolist(), other[::-1].tolist(), hole.tolist()])}
    assert len(forms) == 1 and geo.normal_form([shell.tolist()]) == geo.normal_form(shell.tolist()) != geo.normal_form([shell.tolist(), hole.tolist()])
    assert geo.normal_form([[shell.tolist()], [hole.tolist()]]) == geo.normal_form([[hole.tolist()], [shell[::-1].tolist()]]) and geo.normal_form([]) == geo.normal_form([])
    assert np.frombuffer(geo.normal_form([shell.tolist()])[1:13], "<u4").tolist() == [3, 1, 10]


def test_geodesic_areas():
    """Parts of the ellipsoid between meridians and the equator, known values, and triangles as the sum of their parts."""
    whole = 4 * math.pi * geo.AUTHALIC2
    of = lambda *rings: float(geo.geodesic_areas([list(map(list, rings))])[0])
    assert whole == pytest.approx(510065621724088.4, rel=1e-14)
    for west, east in ((0, 90), (170, -170), (5, 5.001)):
        assert of([(west, 0), (east, 0), (west, 90)]) == pytest.approx(whole / 2 * ((east - west) % 360) / 360, rel=1e-9)
    assert of([(0, 89), (90, 89), (180, 89), (270, 89)]) == pytest.approx(24952305678.0, abs=1)
    assert of([(-1, 0), (0, -1), (1, 0), (0, 1)]) == pytest.approx(24619419146.0, abs=1)
    for a, b, c, p in (((130, 45), (138, 47), (133, 52), (134, 48)), ((10, -5), (40, 3), (20, 30), (22, 10)), ((178, 50), (-170, 52), (-175, 60), (-178, 54))):
        assert of([a, b, p]) + of([b, c, p]) + of([c, a, p]) == pytest.approx(of([a, b, c]), rel=1e-12)
        hole = [tuple(np.array(p) + d) for d in ((0, 0), (0.5, 0), (0, 0.5))]
        assert of([c, b, a], hole) == pytest.approx(of([a, b, c]) - of(hole), rel=1e-12)
    assert geo.geodesic_areas([[], [[(1, 1)]]]).tolist() == [0.0, 0.0]
