"""Queries of overlays, outlines, buffers, domains and protection over the shared tables.

Adapters draw slanted shapes: a unit of the turned coordinates u, v is a square of 128 on its tip, x = 8 (u + v), y = 8 (v - u), so that
SQL can count units where the engine overlays edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geolith.functions.geo import geodesic_area, shape_form
from geolith.operators import domains, overlay
from geolith.plans.catalog import PLACES, STORES, places, query, stores, t


def corner(u: Column, v: Column) -> Column:
    return F.array((8 * (u + v)).cast("double"), (8 * (v - u)).cast("double"))


def turned(u0, v0, u1, v1) -> Column:
    """The ring of a rectangle in the turned coordinates."""
    c = [F.col(x) if isinstance(x, str) else x for x in (u0, v0, u1, v1)]
    return F.array(corner(c[0], c[1]), corner(c[2], c[1]), corner(c[2], c[3]), corner(c[0], c[3]))


def frames(spark, sf_dir) -> DataFrame:
    """Customers as slanted frames with a slanted hole."""
    k = F.col("c_custkey")
    df = t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", (k * 37 % 200).alias("u0"), (k * 91 % 200).alias("v0"), (6 + k % 7).alias("w"), (6 + k % 5).alias("h"))
    u, v, w, h = (F.col(c) for c in ("u0", "v0", "w", "h"))
    return df.withColumn("ring", F.array(turned(u, v, u + w, v + h), turned(u + 2, v + 2, u + w - 2, v + h - 2)))


FRAMES = """f as (select c_custkey, c_nationkey, c_custkey * 37 % 200 as u0, c_custkey * 91 % 200 as v0, 6 + c_custkey % 7 as w, 6 + c_custkey % 5 as h from customer),
    i as (select *, unnest(range(0, w)) as i from f), j as (select *, unnest(range(0, h)) as j from i),
    k as (select c_custkey, c_nationkey, u0 + i as u, v0 + j as v from j where not (i >= 2 and i < w - 2 and j >= 2 and j < h - 2)),
    n as (select c_nationkey, u, v, bool_or(c_custkey % 2 = 0) as even, bool_or(c_custkey % 2 = 1) as odd from k group by 1, 2, 3)"""


@query(f"with {FRAMES} select c_nationkey, count(*) * 128.0::double as united, count(*) filter (even and odd) * 128.0::double as common, count(*) filter (even and not odd) * 128.0::double as only_even from n group by 1")
def overlay_areas(spark, sf_dir):
    """Union, intersection and difference of the frames of even and odd customers of a nation."""
    df = frames(spark, sf_dir)
    pieces = overlay.cut(df.where("c_custkey % 2 = 0"), ["c_nationkey"], 0).union(overlay.cut(df.where("c_custkey % 2 = 1"), ["c_nationkey"], 1))
    rules = {"united": lambda a, b: a | b, "common": lambda a, b: a & b, "only_even": lambda a, b: a & ~b}
    found = [overlay.areas(overlay.overlaid(pieces, ["c_nationkey"], 2, rule), ["c_nationkey"]).withColumn("what", F.lit(name)) for name, rule in rules.items()]
    rows = found[0].union(found[1]).union(found[2]).groupBy("c_nationkey").pivot("what", list(rules)).agg(F.round(F.sum("area"), 3))
    return rows.na.fill(0.0, list(rules))


@query(f"""with {FRAMES}, e as (select a.c_nationkey, count(*) as sides from n a, (select * from (values (1, 0), (-1, 0), (0, 1), (0, -1)) as d(du, dv)) d
      where not exists (select 1 from n b where b.c_nationkey = a.c_nationkey and b.u = a.u + du and b.v = a.v + dv) group by 1)
    select n.c_nationkey, count(*) * 128.0::double as area, any_value(sides) as sides from n join e using (c_nationkey) group by 1""")
def outline_sides(spark, sf_dir):
    """The rings around a nation's frames, traced over the cells' borders: their area, and their length in sides of a unit."""
    cells = overlay.dissolved(overlay.cut(frames(spark, sf_dir), ["c_nationkey"]), ["c_nationkey"])
    steps = F.sequence(F.lit(1), F.size("xs") - 1)
    ends = lambda c, i: (F.get(c, i - 1), F.get(c, i))
    length = F.aggregate(steps, F.lit(0.0), lambda s, i: s + F.hypot(ends("xs", i)[1] - ends("xs", i)[0], ends("ys", i)[1] - ends("ys", i)[0]))
    double = F.aggregate(steps, F.lit(0.0), lambda s, i: s + ends("xs", i)[0] * ends("ys", i)[1] - ends("xs", i)[1] * ends("ys", i)[0])
    rows = overlay.outline(cells, ["c_nationkey"]).select("c_nationkey", length.alias("length"), double.alias("double"))
    return rows.groupBy("c_nationkey").agg(F.round(F.sum("double") / 2, 3).alias("area"), F.round(F.sum("length") / (8 * 2**0.5)).cast("bigint").alias("sides"))


@query("""with p as (select c_nationkey, c_custkey * 37 % 200 as u, c_custkey * 91 % 200 as v, 1 + c_custkey % 4 as r from customer), i as (select *, unnest(range(-r, r)) as i from p), j as (select *, unnest(range(-r, r)) as j from i)
    select c_nationkey, count(distinct (u + i, v + j)) * 128.0::double as area from j group by 1""")
def buffered_places(spark, sf_dir):
    """What is within a radius of a nation's customers; circles of four edges."""
    k = F.col("c_custkey")
    df = t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", corner(k * 37 % 200, k * 91 % 200).alias("ring"), (16.0 * (1 + k % 4)).alias("radius"))
    cells = overlay.dissolved(overlay.cut(overlay.capsules(df, ["c_nationkey", "c_custkey"], "radius", quarter=1), ["c_nationkey"]), ["c_nationkey"])
    return overlay.areas(cells, ["c_nationkey"]).select("c_nationkey", F.round("area", 3).alias("area"))


def rows_of_sites(spark, sf_dir) -> DataFrame:
    """Suppliers as settlements, those of a nation in a slanted row with 8 units between them."""
    number = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    return t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", (8 * number).alias("u"), (1000 * F.col("s_nationkey")).alias("v"))


@query("""with s as (select s_suppkey, s_nationkey, 8 * row_number() over (partition by s_nationkey order by s_suppkey) as u, 1000 * s_nationkey as v from supplier),
    m as (select s_nationkey, 6 as lo, 8 * count(*) - 1 as hi from s group by 1),
    b as (select s_suppkey, u - 6 as u0, u + 6 as u1, v - 2 as v0, v + 2 as v1, s_nationkey from s where s_suppkey % 7 = 3),
    c as (select s_suppkey, s_nationkey, u0 + i as u, v0 + j as v, true as own from (select *, unnest(range(0, 12)) as i from b), (select unnest(range(0, 4)) as j)
      union all select s_suppkey, s_nationkey, u - 4 + i, v - 4 + j, false from (select *, unnest(range(0, 8)) as i from s where s_suppkey % 7 <> 3), (select unnest(range(0, 8)) as j)),
    d as (select c.* from c join m using (s_nationkey) where c.u >= lo and c.u < hi and c.v >= 1000 * s_nationkey - 3 and c.v < 1000 * s_nationkey + 3)
    select s_suppkey, count(*) * 128.0::double as area from d where own or not exists (select 1 from b where b.s_nationkey = d.s_nationkey and d.u >= b.u0 and d.u < b.u1 and d.v >= b.v0 and d.v < b.v1) group by 1""")
def domain_areas(spark, sf_dir):
    """Nearest-site domains inside a municipality without the boundaries of others; every seventh site has a boundary of its own."""
    sites = rows_of_sites(spark, sf_dir)
    u, v = F.col("u"), F.col("v")
    bounded = sites.where("s_suppkey % 7 = 3").select("s_suppkey", turned(u - 6, v - 2, u + 6, v + 2).alias("ring"))
    lands = sites.groupBy("s_nationkey").agg(F.count("*").alias("n"), F.first("v").alias("v")).select("s_nationkey", turned(F.lit(6), v - 3, 8 * F.col("n") - 1, v + 3).alias("ring"))
    at = sites.select("s_suppkey", "s_nationkey", (8.0 * (u + v)).alias("x"), (8.0 * (v - u)).alias("y"), F.lit(300.0).alias("radius"))
    cells = domains.allocation_domains(at, lands, bounded, "s_suppkey", "s_nationkey")
    return overlay.areas(cells, ["s_suppkey"]).select("s_suppkey", F.round("area", 3).alias("area"))


def diamonds(spark, sf_dir, every: int) -> DataFrame:
    """Boundaries of some stores: squares on their tips."""
    b = (200 + F.col("store_id") % 5 * 40).cast("double")
    x, y = F.col("x"), F.col("y")
    ring = F.array(F.array(x + b, y), F.array(x, y + b), F.array(x - b, y), F.array(x, y - b))
    return stores(spark, sf_dir).where(F.col("store_id") % every == 0).select("store_id", ring.alias("ring"))


@query(f"""with {PLACES}, {STORES}, z as (select *, 800 + store_id % 7 * 100 as radius, store_id % 5 = 0 as bounded, 200 + store_id % 5 * 40 as b from s),
    d as (select p.c_custkey, z.*, sqrt((p.x - z.x) * (p.x - z.x) + (p.y - z.y) * (p.y - z.y)) as d, bounded and abs(p.x - z.x) + abs(p.y - z.y) <= b as inside from p, z),
    c as (select distinct c_custkey from d where inside), r as (select * from d where d <= radius and (inside or (not bounded and not exists (select 1 from c where c.c_custkey = d.c_custkey)))),
    k as (select *, row_number() over (partition by c_custkey order by d / radius, d, store_id) as n from r)
    select c_custkey, store_id, round(d, 6) as distance from k where n = 1""")
def claimed_buildings(spark, sf_dir):
    """Buildings go to the place they are nearest to by its radius; boundaries keep others out."""
    p = stores(spark, sf_dir).withColumn("radius", (800 + F.col("store_id") % 7 * 100).cast("double"))
    return domains.claimed(places(spark, sf_dir), p, diamonds(spark, sf_dir, 5), "c_custkey", "store_id").withColumn("distance", F.round("distance", 6))


@query(f"""with {PLACES}, {STORES}, b as (select *, 200 + store_id % 5 * 40 as b from s where store_id % 3 = 0)
    select c_custkey from p where not exists (select 1 from b where greatest(0, floor(p.x / 100) * 100 - b.x, b.x - floor(p.x / 100) * 100 - 100) + greatest(0, floor(p.y / 100) * 100 - b.y, b.y - floor(p.y / 100) * 100 - 100) < b)""")
def squares_outside(spark, sf_dir):
    """The squares of buildings that share no area with a slanted boundary."""
    x, y = (F.floor(F.col(c) / 100) * 100 for c in "xy")
    squares = places(spark, sf_dir).select("c_custkey", x.alias("x0"), y.alias("y0"), (x + 100).alias("x1"), (y + 100).alias("y1"))
    return domains.outside(squares, diamonds(spark, sf_dir, 3), ["c_custkey"]).select("c_custkey")


@query(f"""with {STORES}, b as (select *, 200 + store_id % 5 * 40 as b from s where store_id % 3 = 0), r as (select n_nationkey as road, n_nationkey * 401 % 10009 as y from nation)
    select road, store_id, 1 as parts, round(least(10008.0::double, b.x + b - abs(b.y - r.y)) - greatest(0.0::double, b.x - b + abs(b.y - r.y)), 4) as length from r, b
    where abs(b.y - r.y) < b and least(10008, b.x + b - abs(b.y - r.y)) > greatest(0, b.x - b + abs(b.y - r.y))""")
def road_lengths(spark, sf_dir):
    """The parts of roads inside of slanted boundaries; each road has a bend without an angle."""
    y = (F.col("n_nationkey") * 401 % 10009).cast("double")
    roads = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("road"), F.array(F.array(F.lit(0.0), y), F.array(F.lit(5000.5), y), F.array(F.lit(10008.0), y)).alias("line"))
    found = overlay.lines_within(roads, overlay.cut(diamonds(spark, sf_dir, 3), ["store_id"]), "road", ["store_id"])
    return found.groupBy("road", "store_id").agg(F.count("*").cast("int").alias("parts"), F.round(F.sum("length"), 4).alias("length"))


@query("""select c_custkey, round((1 + c_custkey % 20) / 360.0::double * 510065621724088.44::double / 2 / 1000000, 2) as km2 from customer""")
def geodesic_wedges(spark, sf_dir):
    """Areas between two meridians, the equator and the pole on the ellipsoid; some cross the antimeridian."""
    k = F.col("c_custkey")
    lon, wide = k * 7 % 360 - 180, 1 + k % 20
    at = lambda x, y: F.array(x.cast("double"), F.lit(float(y)))
    ring = F.array(at(lon, 0), at(F.pmod(lon + wide + 180, F.lit(360)) - 180, 0), at(lon, 90))
    return t(spark, sf_dir, "customer").select("c_custkey", F.round(geodesic_area(ring) / 1e6, 2).alias("km2"))


@query("""with f as (select c_custkey, c_custkey * 37 % 40 as u0, c_custkey * 91 % 40 as v0, 6 + c_custkey % 3 as w, 6 + c_custkey % 2 as h, c_custkey % 11 as bad from customer)
    select case bad when 3 then 'overlapping_rings' when 5 then 'self_intersection' when 7 then 'too_few_points' else 'valid' end as state, count(*) as shapes, case when any_value(bad) not in (3, 5, 7) then count(distinct (u0, v0, w, h)) end as different from f group by 1""")
def shape_states(spark, sf_dir):
    """Shapes by what is wrong with them; the valid ones by their normal forms, each written from another point on and half of them turned."""
    k = F.col("c_custkey")
    df = t(spark, sf_dir, "customer").select("c_custkey", (k * 37 % 40).alias("u"), (k * 91 % 40).alias("v"), (6 + k % 3).alias("w"), (6 + k % 2).alias("h"))
    u, v, w, h = (F.col(c) for c in ("u", "v", "w", "h"))
    c = [corner(u, v), corner(u + w, v), corner(u + w, v + h), corner(u, v + h)]
    hole = lambda far: turned(u + 2 + far, v + 2, u + w - 2 + far, v + h - 2)
    ring = F.when(k % 4 == 0, F.array(*c, c[0])).when(k % 4 == 1, F.array(*c[1:], *c[:2])).when(k % 4 == 2, F.array(*c[::-1])).otherwise(F.array(c[2], c[3], c[3], c[0], c[1]))
    ring = F.when(k % 11 == 5, F.array(c[0], c[2], c[1], c[3])).when(k % 11 == 7, F.array(c[0], c[1], c[1])).otherwise(ring)
    shape = F.array(ring, F.when(k % 11 == 3, hole(w - 3)).otherwise(hole(F.lit(0))))
    shape = F.when((k % 11).isin(5, 7), F.array(ring)).otherwise(shape)
    equal = df.groupBy(shape.alias("shape")).agg(F.count("*").alias("n"))  # equal shapes are judged once
    rows = equal.select(overlay.shape_faults("shape").alias("faults"), F.sha2(shape_form("shape"), 256).alias("form"), "n")
    state = F.when(F.size("faults") == 0, "valid").otherwise(F.array_join("faults", ","))
    return rows.groupBy(state.alias("state")).agg(F.sum("n").alias("shapes"), F.countDistinct("form").alias("n")).select("state", "shapes", F.when(F.col("state") == "valid", F.col("n")).alias("different"))
