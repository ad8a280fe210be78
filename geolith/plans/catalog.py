"""The query catalogue: each operator over the shared tables through a documented adapter, with its SQL.

Adapters give the operators the columns they need: customers are settlements or contacts, suppliers are
stores or registers, line items are building parts in grid cells. They are projections of whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geolith.functions import scalars, text
from geolith.functions.geo import CENTRE_LAT, CENTRE_LON, E1, E2, FLATTENING, SEMI_MAJOR, equal_area
from geolith.operators import allocate, audit, grid, housing, layers, match, resolve, review, score, spatial
from geolith.sources import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def population(key: str):
    return (2500 + (F.col(key) * 7919) % 97500).cast("bigint")


def cells(spark: SparkSession, sf_dir: str, wide: int = 8, group: int | None = None) -> DataFrame:
    """settlement, ix, iy, proxy and buildings: line items of orders."""
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    settlement = F.col("o_custkey") % group if group else F.col("o_custkey")
    rows = rows.select(settlement.alias("settlement"), (F.col("l_partkey") % wide).alias("ix"), (F.col("l_suppkey") % wide).alias("iy"), F.col("l_quantity").cast("bigint").alias("proxy"), F.col("l_orderkey").alias("building"))
    return grid.accumulate(rows, ["settlement", "ix", "iy"], ["proxy"], "building")


def cells_sql(wide: int = 8, group: int | None = None) -> str:
    s = f"o_custkey % {group}" if group else "o_custkey"
    return f"select {s} as settlement, l_partkey % {wide} as ix, l_suppkey % {wide} as iy, cast(sum(cast(l_quantity as bigint)) as bigint) as proxy, count(distinct l_orderkey) as buildings from lineitem join orders on l_orderkey = o_orderkey group by 1, 2, 3"


def alloc_sql(units: int, order: str) -> str:
    return f"""with c as ({cells_sql()}), w as (select *, 2500 + (settlement * 7919) % 97500 as pop, cast(sum(proxy) over (partition by settlement) as hugeint) as tot from c),
    n as (select *, (cast(pop as hugeint) * {units} * proxy) % tot as rem, cast(pop as hugeint) * {units} * proxy as num from w), u as (select *, (num - rem) // tot as base from n),
    k as (select *, row_number() over (partition by settlement order by rem desc, {order}) as rk, pop * {units} - sum(base) over (partition by settlement) as missing from u)"""


ALLOCATED = "cast(base + case when rk <= missing then 1 else 0 end as bigint)"
VISIT = "ix // 4, iy // 4, (ix // 2) % 2 + 2 * ((iy // 2) % 2), ix % 2 + 2 * (iy % 2)"


@query(alloc_sql(1000, "ix, iy") + f" select settlement, ix, iy, {ALLOCATED} as units from k")
def alloc_largest_remainder(spark, sf_dir):
    rows = cells(spark, sf_dir).withColumn("population", population("settlement"))
    return allocate.largest_remainder(rows, "settlement", "population", "proxy", ["ix", "iy"]).select("settlement", "ix", "iy", "units")


@query(alloc_sql(1, VISIT) + f" select settlement, ix, iy, {ALLOCATED} as persons from k")
def alloc_visit_order(spark, sf_dir):
    rows = cells(spark, sf_dir).withColumn("population", population("settlement")).withColumn("visit", grid.visit_order(F.col("ix"), F.col("iy"), F.lit(1), 4))
    return allocate.largest_remainder(rows, "settlement", "population", "proxy", ["visit"], units=1, name="persons").select("settlement", "ix", "iy", "persons")


@query(alloc_sql(1000, "ix, iy") + f", s as (select settlement, any_value(pop) as pop, cast(sum({ALLOCATED}) as bigint) as allocated from k group by 1) select count(*) as settlements, count_if(pop * 1000 <> allocated) as violations, cast(sum(allocated) as bigint) as allocated from s")
def alloc_conservation(spark, sf_dir):
    rows = alloc_largest_remainder(spark, sf_dir).withColumn("population", population("settlement"))
    bad = allocate.conservation(rows, "settlement", "population", "units").select("settlement", F.lit(True).alias("bad"))
    sums = rows.groupBy("settlement").agg(F.sum("units").alias("allocated")).join(bad, "settlement", "left")
    return sums.agg(F.count("*").alias("settlements"), F.count("bad").alias("violations"), F.sum("allocated").alias("allocated"))


@query(cells_sql())
def grid_accumulate(spark, sf_dir):
    return cells(spark, sf_dir)


def _levels(wide: int, group: int, spans=(4, 2, 1)) -> str:
    parts = [f"c as ({cells_sql(wide, group)})"]
    for s in spans:
        area = repr(float((s * 100 / 1000) ** 2))
        parts.append(f"l{s} as (select settlement, ix // {s} as x, iy // {s} as y, cast(sum(proxy) as bigint) as proxy, cast(sum(buildings) as bigint) as buildings, {s} > 1 and (sum(buildings) >= 12 or cast(sum(proxy) as double) / cast('{area}' as double) >= 80000) as crowded from c group by 1, 2, 3)")
    return "with " + ", ".join(parts)


@query(_levels(16, 50) + """ select settlement, x * 4 as ix, y * 4 as iy, 4 as span, proxy, buildings from l4 where not crowded
    union all select settlement, x * 2, y * 2, 2, proxy, buildings from l2 where not crowded and exists (select 1 from l4 where l4.settlement = l2.settlement and l4.x = l2.x // 2 and l4.y = l2.y // 2 and l4.crowded)
    union all select settlement, x, y, 1, proxy, buildings from l1 where exists (select 1 from l4 where l4.settlement = l1.settlement and l4.x = l1.x // 4 and l4.y = l1.y // 4 and l4.crowded)
    and exists (select 1 from l2 where l2.settlement = l1.settlement and l2.x = l1.x // 2 and l2.y = l1.y // 2 and l2.crowded)""")
def grid_coarsen(spark, sf_dir):
    return grid.coarsened(cells(spark, sf_dir, 16, 50), "settlement", 400, 100, ["proxy"])


def _distinct_levels(spans=(4, 2, 1)) -> str:
    parts = ["c as (select o_custkey % 50 as settlement, l_partkey % 16 as ix, l_suppkey % 16 as iy, l_orderkey as building, sum(cast(l_quantity as bigint)) as proxy from lineitem join orders on l_orderkey = o_orderkey group by 1, 2, 3, 4)"]
    for s in spans:
        parts.append(f"l{s} as (select settlement, ix // {s} as x, iy // {s} as y, cast(sum(proxy) as bigint) as proxy, count(distinct building) as buildings, {s} > 1 and (count(distinct building) >= 40 or cast(sum(proxy) as double) / cast('{(s * 100 / 1000) ** 2!r}' as double) >= 9000) as crowded from c group by 1, 2, 3)")
    return "with " + ", ".join(parts)


COARSE = """ select settlement, x * 4 as ix, y * 4 as iy, 4 as span, proxy, buildings from l4 where not crowded
    union all select settlement, x * 2, y * 2, 2, proxy, buildings from l2 where not crowded and exists (select 1 from l4 where l4.settlement = l2.settlement and l4.x = l2.x // 2 and l4.y = l2.y // 2 and l4.crowded)
    union all select settlement, x, y, 1, proxy, buildings from l1 where exists (select 1 from l4 where l4.settlement = l1.settlement and l4.x = l1.x // 4 and l4.y = l1.y // 4 and l4.crowded)
    and exists (select 1 from l2 where l2.settlement = l1.settlement and l2.x = l1.x // 2 and l2.y = l1.y // 2 and l2.crowded)"""


@query(_distinct_levels() + COARSE)
def grid_coarsen_distinct(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy((F.col("o_custkey") % 50).alias("settlement"), (F.col("l_partkey") % 16).alias("ix"), (F.col("l_suppkey") % 16).alias("iy"), F.col("l_orderkey").alias("building")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("proxy"))
    return grid.coarsened(rows, "settlement", 400, 100, ["proxy"], ids="building", split_buildings=40, split_density=9000.0)


@query(f"with c as ({cells_sql(8, 100)}) select settlement, count(*) as cells, cast(sum(buildings) as bigint) as buildings, max(proxy / 10000.0::double) as max_density, cast(sum(10000) as bigint) as area_km2, '100' as grid_sizes from c group by 1")
def settlement_summary(spark, sf_dir):
    rows = cells(spark, sf_dir, 8, 100).withColumn("area", F.lit(10000)).withColumn("size", F.lit(100))
    return grid.settlement_summary(rows, "settlement", "proxy", "area", "size", "buildings").withColumn("grid_sizes", F.array_join("grid_sizes", ","))


def places(spark, sf_dir):
    return t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", (F.col("c_custkey") * 7919 % 10007).cast("double").alias("x"), (F.col("c_custkey") * 104729 % 10009).cast("double").alias("y"))


def stores(spark, sf_dir):
    return t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("store_id"), "s_nationkey", (F.col("s_suppkey") * 6007 % 10007).cast("double").alias("x"), (F.col("s_suppkey") * 3001 % 10009).cast("double").alias("y"))


PLACES = "p as (select c_custkey, c_nationkey, cast(c_custkey * 7919 % 10007 as double) as x, cast(c_custkey * 104729 % 10009 as double) as y from customer)"
STORES = "s as (select s_suppkey as store_id, s_nationkey, cast(s_suppkey * 6007 % 10007 as double) as x, cast(s_suppkey * 3001 % 10009 as double) as y from supplier)"
PAIRS = f"{PLACES}, {STORES}, d as (select p.c_custkey, s.store_id, sqrt((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)) as d from p, s)"


@query(f"with {PAIRS}, r as (select *, row_number() over (partition by c_custkey order by d, store_id) as k from d) select c_custkey, store_id, round(d, 6) as distance from r where k = 1")
def nearest_facility(spark, sf_dir):
    return spatial.nearest(places(spark, sf_dir), stores(spark, sf_dir), "c_custkey", "store_id").withColumn("distance", F.round("distance", 6))


@query(f"with {PAIRS} select c_custkey, count(*) as stores, round(min(d), 6) as nearest from d where d <= 700 group by 1")
def within_radius(spark, sf_dir):
    rows = spatial.pairs_within(places(spark, sf_dir), stores(spark, sf_dir), "c_custkey", "store_id", 700.0)
    return rows.groupBy("c_custkey").agg(F.count("*").alias("stores"), F.round(F.min("distance"), 6).alias("nearest"))


@query(f"with {STORES} select a.store_id as store_id, b.store_id as other, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) as distance from s a, s b where a.store_id < b.store_id and sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 400")
def nearby_pairs(spark, sf_dir):
    return spatial.nearby_pairs(stores(spark, sf_dir), "store_id", 400.0).select("store_id", "other", F.round("distance", 6).alias("distance"))


@query(f"with {PAIRS}, r as (select c_custkey, store_id, d, 800 + store_id % 7 * 100 as radius from d), k as (select *, row_number() over (partition by c_custkey order by d / radius, d, store_id) as n from r where d <= radius) select c_custkey, store_id, round(d, 6) as distance from k where n = 1")
def building_assignment(spark, sf_dir):
    p = stores(spark, sf_dir).withColumn("radius", (800 + F.col("store_id") % 7 * 100).cast("double"))
    return spatial.assigned(places(spark, sf_dir), p, "c_custkey", "store_id").withColumn("distance", F.round("distance", 6))


ROAD = "(select n_nationkey as k, [[n_nationkey * 401 % 10007, 0], [n_nationkey * 733 % 10007, 2500], [n_nationkey * 97 % 10007, 2500], [n_nationkey * 59 % 10007, 9000]] as line from nation where n_nationkey % 3 = 0)"
NEAR_ROAD = f"""with {PLACES}, s as (select unnest([1, 2, 3]) as i, line from {ROAD}), e as (select cast(line[i][1] as double) as ax, cast(line[i][2] as double) as ay, cast(line[i + 1][1] as double) as bx, cast(line[i + 1][2] as double) as v from s),
    d as (select c_custkey, x, y, ax, ay, bx, v, case when ax = bx and ay = v then 0 else greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (v - ay)) / ((bx - ax) * (bx - ax) + (v - ay) * (v - ay)))) end as t from p, e)
    select c_custkey, min(sqrt((x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (v - ay)) ** 2)) as distance from d group by 1"""


def roads(spark, sf_dir):
    """A bent road for every third nation."""
    k = F.col("n_nationkey")
    point = lambda f, y: F.array((k * f % 10007).cast("double"), F.lit(float(y)))
    return t(spark, sf_dir, "nation").where(k % 3 == 0).select(k.alias("road"), F.array(point(401, 0), point(733, 2500), point(97, 2500), point(59, 9000)).alias("line"))


@query(f"""with {PAIRS}, n as (select c_custkey, min(d) as nearest_km, count_if(d <= 700) as within from d group by 1), l as (select s_nationkey as k, count(*) as direct from supplier where s_suppkey % 2 = 0 group by 1),
    w as ({NEAR_ROAD}),
    b as (select c.c_custkey, c_name as name, 2500 + (c.c_custkey * 7919) % 97500 as population, case c.c_custkey % 3 when 0 then 'high' when 1 then 'medium' else 'low' end as confidence,
      case when c.c_custkey % 2 = 0 and l.direct > 0 then l.direct else n.within end as existing, case when c.c_custkey % 4 = 0 then 1 else 0 end as conflicts, distance / 200 as road, nearest_km from customer c join n using (c_custkey) join w using (c_custkey) left join l on l.k = c.c_nationkey),
    e as (select *, greatest(1, population // 5000) as cap, existing + 0.5::double * conflicts as effective from b),
    r as (select *, round_even(least(100.0::double, least(30.0::double, 30.0::double * population / 20000) + 30.0::double * greatest(0.0::double, cap - effective) / cap
      + case when existing = 0 and conflicts = 0 then 15 when existing = 0 then 8 else 5 end + case when road <= 1 then 15 when road <= 3 then 10 when road <= 10 then 5 else 0 end + case confidence when 'high' then 10 when 'medium' then 7 else 0 end), 0) as s0 from e),
    z as (select *, least(s0, case when greatest(0, cap - existing) = 0 then 29 else 100 end, case when confidence = 'low' then 49 else 100 end, case when population < 5000 then 59 else 100 end) as sc from r)
    select c_custkey, cast(existing as bigint) as existing, cast(greatest(0, cap - existing) as bigint) as additional, confidence, cast(sc as bigint) as score,
      case when sc >= 80 then 'very high' when sc >= 65 then 'high' when sc >= 50 then 'medium' when confidence = 'low' then 'needs population check' when sc >= 30 then 'low' else 'capacity exhausted' end as priority, round(nearest_km, 6) as nearest_km from z""")
def priority_score(spark, sf_dir):
    rules = score.Rules(fallback_km=700.0, longitude_km=1.0, latitude_km=1.0)
    s = stores(spark, sf_dir)
    p = t(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name")).join(places(spark, sf_dir), "c_custkey")
    quality = F.when(F.col("c_custkey") % 3 == 0, "official_current").when(F.col("c_custkey") % 3 == 1, "official_census_exact").otherwise("estimated")
    p = p.withColumn("population", population("c_custkey")).withColumn("population_quality", quality)
    labels = score.label_counts(s.where("store_id % 2 = 0").withColumn("place", F.col("s_nationkey").cast("string")), "place")
    p = score.store_distances(p, s, "c_custkey", rules)
    own = F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey").cast("string"))
    p = p.join(labels, own == F.col("label"), "left")
    p = p.withColumn("conflicts", (F.col("c_custkey") % 4 == 0).cast("int"))
    far = spatial.nearest_line(p.select("c_custkey", "x", "y"), roads(spark, sf_dir), "c_custkey", start=200.0)
    p = p.join(far.select("c_custkey", (F.col("distance") / 200).alias("road_km")), "c_custkey")
    found = score.priority(p, rules)
    return found.select("c_custkey", "existing", "additional", "confidence", "score", "priority", F.round("nearest_km", 6).alias("nearest_km"))


@query("""with c as (select c_custkey as id, regexp_replace(lower(c_name), '[^а-яa-z0-9]+', '', 'g') as k, 'nation' || c_nationkey as d from customer),
    a as (select k, d, id * 10 as v from c where id % 3 = 0 union all select k, d, id * 10 from c where id % 30 = 0), b as (select k, d, id * 100 as v from c where id % 2 = 0),
    x as (select c.id, count(a.v) as n, min(a.v) as v from c left join a using (k, d) group by 1), y as (select c.id, count(b.v) as n, min(b.v) as v from c left join b using (k, d) group by 1)
    select c.id as place_id, case when x.n = 1 then x.v when x.n = 0 and y.n = 1 then y.v end as value, case when x.n = 1 then 0 when x.n = 0 and y.n = 1 then 1 end as source, x.n > 1 or (x.n = 0 and y.n > 1) as ambiguous from c join x using (id) join y using (id)""")
def official_match(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("place_id"), text.name_key(F.col("c_name")).alias("name_key"), text.district_key(F.concat(F.lit("Район nation "), F.col("c_nationkey").cast("string"))).alias("district_key"))
    row = lambda df, k: df.select("name_key", "district_key", (F.col("place_id") * k).alias("value"))
    current = row(c.where("place_id % 3 = 0"), 10).union(row(c.where("place_id % 30 = 0"), 10))
    return match.official_match(c.withColumn("aliases", F.array("district_key")), [current, row(c.where("place_id % 2 = 0"), 100)]).select("place_id", "value", "source", "ambiguous")


@query("select n_regionkey as area, cast(sum(case when n_nationkey % 6 <> 5 then n_nationkey * 10 end) as bigint) as value, bool_and(n_nationkey % 6 <> 5) as complete from nation group by 1")
def merged_controls(spark, sf_dir):
    n = t(spark, sf_dir, "nation")
    areas = n.groupBy(F.col("n_regionkey").alias("area")).agg(F.array_join(F.array_sort(F.collect_list("n_name")), " + ").alias("official_name"))
    rows = n.where("n_nationkey % 6 <> 5").select(F.col("n_name").alias("name"), (F.col("n_nationkey") * 10).alias("value"))
    return match.merged_controls(areas, rows, "area", "official_name")


@query("select c_custkey, 2500 + (c_custkey * 7919) % 97500 as population_before, case when c_custkey % 9 = 0 then c_custkey else 2500 + (c_custkey * 7919) % 97500 end as population_after from customer where c_custkey % 9 = 0 and c_custkey <> 2500 + (c_custkey * 7919) % 97500")
def change_log(spark, sf_dir):
    before = t(spark, sf_dir, "customer").select("c_custkey", population("c_custkey").alias("population"))
    after = before.withColumn("population", F.when(F.col("c_custkey") % 9 == 0, F.col("c_custkey")).otherwise(F.col("population")))
    return match.change_log(before, after, "c_custkey", ["population"])


@query("select o_orderkey, case when coalesce(o_totalprice, 0) < 50000 then 'low' when coalesce(o_totalprice, 0) < 150000 then 'middle' when coalesce(o_totalprice, 0) < 300000 then 'high' else 'top' end as bin from orders")
def bins_choropleth(spark, sf_dir):
    bins = ((50000.0, "low"), (150000.0, "middle"), (300000.0, "high"), (None, "top"))
    return t(spark, sf_dir, "orders").select("o_orderkey", scalars.bin_of(F.col("o_totalprice"), bins).alias("bin"))


@query("select o_orderkey, case o_orderstatus when 'F' then '#111111' when 'O' then '#222222' else case when o_totalprice < 100000 then '#333333' else '#444444' end end as colour from orders")
def category_lookup(spark, sf_dir):
    df = t(spark, sf_dir, "orders")
    return layers.styled(df, "o_totalprice", "o_orderstatus", ((100000.0, "#333333"), (None, "#444444")), {"F": "#111111", "O": "#222222"}, None, 0).select("o_orderkey", "colour")


@query("select p_partkey, p_name, p_size, p_retailprice from part where coalesce(p_size, 0) > 10 order by p_size desc, p_name asc, p_partkey asc limit 500")
def layer_table(spark, sf_dir):
    spec = layers.TableSpec(("p_partkey", "p_name", "p_size", "p_retailprice"), "p_size", 10, (("p_size", "desc"), ("p_name", "asc")), 500, "p_partkey")
    return layers.layer_table(t(spark, sf_dir, "part"), spec)


@query("select p_partkey, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as n from part")
def row_ordinal(spark, sf_dir):
    return layers.ordinal(t(spark, sf_dir, "part"), [F.desc("p_retailprice"), F.asc("p_partkey")], ["p_brand"]).select("p_partkey", F.col("n").cast("bigint").alias("n"))


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
def related_semi_join(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("Key "), F.col("c_custkey").cast("string")).alias("k"))
    o = t(spark, sf_dir, "orders").select(F.concat(F.lit("KEY "), F.col("o_custkey").cast("string")).alias("ok"), "o_totalprice")
    return layers.related(c, o, "k", "ok", "o_totalprice", 300000).select("c_custkey")


@query("select c_custkey, min(o_orderkey % 1000) as x0, min(o_orderkey % 777) as y0, max(o_orderkey % 1000) as x1, max(o_orderkey % 777) as y1 from customer join orders on o_custkey = c_custkey group by 1")
def related_bbox(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("k"))
    o = t(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("ok"), (F.col("o_orderkey") % 1000).alias("x"), (F.col("o_orderkey") % 777).alias("y"))
    return layers.related_box(c, o, "k", "ok").select("c_custkey", "x0", "y0", "x1", "y1")


@query("with r as (select c_mktsegment as segment, c_nationkey as nation, c_acctbal as balance, c_custkey, row_number() over (partition by lower(trim(c_mktsegment)), c_nationkey order by c_custkey) as k from customer) select segment, nation, balance, 'demo' as layer from r where k = 1")
def normalize_layer(spark, sf_dir):
    c = t(spark, sf_dir, "customer")
    balance = scalars.number(F.replace(F.col("c_acctbal").cast("string"), F.lit("."), F.lit(",")))
    return audit.normalised(c, {"segment": F.col("c_mktsegment"), "nation": F.col("c_nationkey"), "balance": balance}, {"layer": "demo"}, ["segment"], ["segment", "nation"], "c_custkey")


@query("""with u as (select count(*) as m from lineitem group by l_orderkey, l_linenumber having count(*) > 1) select 'unique:l_orderkey,l_linenumber' as rule, cast(sum(m - 1) as bigint) as n from u having sum(m - 1) > 0
    union all select 'coordinates', count(*) from lineitem where not (l_quantity * 4 between -180 and 180 and l_quantity * 2 between -90 and 90) having count(*) > 0
    union all select 'geometry_type', count(*) from lineitem where l_returnflag not in ('A', 'N') having count(*) > 0""")
def validate_contract(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").withColumn("lon", F.col("l_quantity") * 4).withColumn("lat", F.col("l_quantity") * 2)
    contract = audit.Contract(("l_orderkey", "l_shipdate"), ("l_tax",), ("l_orderkey", "l_linenumber"), ("A", "N"), "l_returnflag", "lon", "lat")
    return audit.violations(rows, contract)


@query("select conv_id, turn, last_value(case when role = 'user' then turn end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and current row) as context from conversations")
def context_carry_down(spark, sf_dir):
    rows = t(spark, sf_dir, "conversations").withColumn("head", F.when(F.col("role") == "user", F.col("turn")))
    return match.carried_down(rows, "head", "turn", ["conv_id"]).select("conv_id", "turn", "context")


@query("""with s as (select conv_id, turn, last_value(case when role = 'user' and turn % 4 = 0 then 1 when role = 'user' then 0 end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and current row) as s, role = 'user' and turn % 4 = 0 as start from conversations)
    select conv_id, turn from s where s = 1 and not start""")
def active_section(spark, sf_dir):
    starts = (F.col("role") == "user") & (F.col("turn") % 4 == 0)
    return match.active_rows(t(spark, sf_dir, "conversations"), starts, F.col("role") == "user", "turn", ["conv_id"]).select("conv_id", "turn")


@query("select sha256(coalesce(text, '')) as signature, count(*) as members, count(distinct (lang, source)) > 1 as conflicting, case when count(distinct (lang, source)) = 1 then min(doc_id) end as kept from documents group by 1")
def exact_dedup_conflict(spark, sf_dir):
    d = t(spark, sf_dir, "documents").withColumn("signature", F.sha2(F.coalesce("text", F.lit("")), 256))
    return housing.deduplicated(d, "signature", ["lang", "source"], ["doc_id"]).withColumn("kept", F.col("kept.doc_id"))


@query("select o_custkey, o_orderpriority, count(*) as members, min(o_orderkey) as first_id, max(o_orderkey) as last_id from orders where o_custkey is not null and o_orderpriority is not null group by 1, 2 having count(*) > 1")
def duplicate_groups(spark, sf_dir):
    return match.duplicate_groups(t(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], "o_orderkey")


@query("""with a as (select distinct o_orderkey as id, o_orderstatus as s, o_custkey as c from orders where o_orderkey % 10 <> 0), b as (select distinct o_orderkey as id, o_orderstatus as s, case when o_orderkey % 13 = 0 then -1 else o_custkey end as c from orders where o_orderkey % 7 <> 0)
    select coalesce(a.id, b.id) as id, case when a.id is null then 'added' when b.id is null then 'removed' when a.s is not distinct from b.s and a.c is not distinct from b.c then 'unchanged' else 'changed' end as status from a full join b on a.id = b.id""")
def snapshot_diff(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s"), F.col("o_custkey").alias("c"))
    new = o.where("id % 7 <> 0").withColumn("c", F.when(F.col("id") % 13 == 0, F.lit(-1)).otherwise(F.col("c"))).distinct()
    return match.snapshot_diff(o.where("id % 10 <> 0").distinct(), new, "id", ["s", "c"])


def _addresses(spark, sf_dir):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # texts are parsed in all tasks, however few files there are
    c, s = t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").repartition(n, "c_custkey"), t(spark, sf_dir, "supplier")
    k = F.col("c_custkey")
    street = text.street_identity(F.concat(F.lit("ул. Ленина "), (k % 3).cast("string")), normal_form=False)
    house = text.house_number(F.concat(F.lit("Дом "), (k % 5).cast("string"), F.lit(" корпус "), (k % 2).cast("string")), normal_form=False)
    town = lambda x: F.concat(F.lit("town"), x.cast("string"))
    none = F.array().cast("array<string>")
    identity = F.struct(F.when(k % 4 == 0, none).otherwise(F.array(text.locality_name(F.concat(F.lit("г. "), town(k % 5)), normal_form=False))).alias("localities"), street["street_type"].alias("street_type"), street["street_name"].alias("street_name"), house.alias("house_number"))
    addresses = c.select(k.alias("address_id"), F.col("c_nationkey").alias("municipality"), identity.alias("identity"), F.when(k % 8 == 0, F.array(town(k % 5))).otherwise(none).alias("context"))
    m = F.col("s_suppkey")
    official = text.official_address(F.concat(F.lit("край, г. "), town(m % 5), F.lit(", Ленина "), (m % 3).cast("string"), F.lit(" улица, д. "), (m % 5).cast("string"), F.lit("К"), (m % 2).cast("string")), normal_form=False)
    register = s.select(m.alias("house_id"), F.col("s_nationkey").alias("municipality"), official.alias("official"))
    return addresses, register


def _links(spark, sf_dir):
    return match.typed_address_candidates(*_addresses(spark, sf_dir), "address_id", "house_id")


LINKS = """l as (select c_custkey as address_id, s_suppkey as house_id, case when c_custkey % 4 <> 0 then case when c_custkey % 5 = s_suppkey % 5 then 'explicit_address_candidate' end
    when c_custkey % 8 = 0 then case when c_custkey % 5 = s_suppkey % 5 then 'osm_boundary_context_candidate' end else 'municipal_registry_candidate' end as class
    from customer join supplier on c_nationkey = s_nationkey and c_custkey % 3 = s_suppkey % 3 and c_custkey % 5 = s_suppkey % 5 and c_custkey % 2 = s_suppkey % 2)"""


@query(f"with {LINKS} select address_id, house_id, class from l where class is not null")
def typed_address_match(spark, sf_dir):
    return _links(spark, sf_dir)


@query(f"with {LINKS}, k as (select * from l where class is not null), r as (select address_id, count(distinct house_id) as rights from k group by 1), f as (select house_id, count(distinct address_id) as lefts from k group by 1) select address_id, house_id, class, rights, lefts, rights > 1 or lefts > 1 as ambiguous from k join r using (address_id) join f using (house_id)")
def match_ambiguity(spark, sf_dir):
    return match.typed_address_ambiguity(*_addresses(spark, sf_dir), "address_id", "house_id")


@query(f"with {LINKS}, r as (select address_id, min(case class when 'explicit_address_candidate' then 1 when 'osm_boundary_context_candidate' then 2 else 3 end) as r from l where class is not null group by 1) select address_id, case r when 1 then 'explicit_address_candidate' when 2 then 'osm_boundary_context_candidate' else 'municipal_registry_candidate' end as class from r")
def match_classes(spark, sf_dir):
    return match.strongest(_links(spark, sf_dir), "address_id", "class", ["explicit_address_candidate", "osm_boundary_context_candidate", "municipal_registry_candidate"])


@query("select l_orderkey, case when count(distinct l_returnflag) = 1 then min(l_returnflag) end as value, case when count(distinct l_returnflag) = 1 then 'reported' else 'conflicting' end as status from lineitem group by 1")
def field_reconcile(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("v"))
    return rows.withColumn("r", scalars.reconciled(F.col("v"))).select("l_orderkey", "r.value", "r.status")


KINDS = ("apartments", "yes", "house", "retail", "residential", "yes", "shed")


def _tags():
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (k % len(KINDS)).cast("int") + 1)
    size = F.when(k % 5 == 0, "nan").when(k % 5 == 1, F.lit("")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(",5")))
    return F.map_from_arrays(F.array(*map(F.lit, ("building", "building:levels", "amenity", "addr:street"))), F.array(kind, size, F.when(k % 11 == 0, "school").otherwise("cafe"), F.when(k % 3 == 0, "").otherwise("x")))


@query(f"""with b as (select p_partkey as k, ['{"','".join(KINDS)}'][p_partkey % {len(KINDS)} + 1] as kind, case when p_partkey % 5 > 1 and p_size + 0.5 between 0.5 and 80 then p_size + 0.5 end as stated from part),
    w as (select *, kind in ('apartments', 'house', 'residential') as explicit, case when kind in ('apartments', 'house', 'residential') then 1.0 when kind = 'yes' and k % 11 <> 0 and k % 3 <> 0 then 0.55 else 0 end as weight from b)
    select k as p_partkey, cast(coalesce(stated, case kind when 'apartments' then 5 when 'residential' then 2 else 1 end) as double) * cast(weight as double) as proxy, explicit, stated is not null as observed from w where weight > 0""")
def proxy_classification(spark, sf_dir):
    found = t(spark, sf_dir, "part").select("p_partkey", housing.proxy_parameters(_tags()).alias("q"))
    return found.where("q is not null").select("p_partkey", "q.proxy", "q.explicit", "q.observed")


KIND = f"['{"','".join(KINDS)}'][p_partkey % {len(KINDS)} + 1]"


@query(f"""with b as (select p_partkey, {KIND} as kind, p_partkey % 11 = 0 as school, p_partkey % 5 as m, p_size, p_partkey % 3 = 0 as nostreet from part), r as (select *, kind in ('apartments', 'house', 'residential') as res from b)
    select p_partkey, case when res then 'mixed' when kind = 'retail' or school then 'non_residential' end as use, array_to_string(list_sort(list_filter([
      case when res and (kind = 'retail' or school) then 'residential_facility_conflict' end, case when m <> 1 then 'invalid_or_fractional_osm_storeys' end,
      case when p_size * 10 not between 12 and 80000 then 'footprint_area_outside_model_range' end, case when res or (kind = 'yes' and not school and not nostreet) then 'storeys_assumed_by_model' end,
      case when not (res or kind = 'retail' or school) then 'building_use_unknown' end, 'address_incomplete', case when p_partkey % 4 > 1 then 'multiple_official_address_rows' end], lambda x: x is not null)), ';') as issues from r""")
def building_issues(spark, sf_dir):
    none = F.array().cast("array<string>")
    issues = housing.building_issues(_tags(), F.col("p_size") * 10, F.lit(True), F.col("p_partkey") % 4, none, F.lit(None).cast("string"))
    return t(spark, sf_dir, "part").select("p_partkey", housing.reported_use(_tags()).alias("use"), F.array_join(issues, ";").alias("issues"))


@query("select c_custkey, case when c_custkey % 10 = 0 then 'covered_by_own_model' when c_custkey % 7 = 0 then 'population_unknown' when (c_custkey * 7919) % 5000 < 2500 then 'below_2500_threshold' else 'above_threshold_without_model' end as reason from customer")
def coverage_reason(spark, sf_dir):
    k = F.col("c_custkey")
    known = scalars.known_population(k * 7919 % 5000, F.when(k % 7 == 0, "not_available").otherwise("official_current"))
    return t(spark, sf_dir, "customer").select("c_custkey", housing.coverage_reason(k % 10 == 0, known).alias("reason"))


@query(f"with c as ({cells_sql()}) select settlement, ix, iy, case when buildings >= 3 and proxy % 50 / cast(proxy as double) >= 0.7 then 'medium' else 'low' end as confidence from c")
def cell_confidence(spark, sf_dir):
    return cells(spark, sf_dir).select("settlement", "ix", "iy", housing.cell_confidence(F.col("proxy") % 50, F.col("proxy"), F.col("buildings"), F.lit(100)).alias("confidence"))


@query("""select s_suppkey, array_to_string(list_sort(list_filter([case when s_suppkey % 9 = 0 then 'missing_or_invalid_coordinates' end, case when s_suppkey % 9 <> 0 and s_suppkey % 3 = 0 then 'coordinate_outside_region' end,
    case when s_suppkey % 9 <> 0 and s_suppkey % 3 = 2 then 'ambiguous_municipality' end, case when s_suppkey % 3 > 0 and s_suppkey % 4 = 0 then 'other_region_card_in_region' end, case when s_suppkey % 8 = 0 then 'locality_not_parsed' end,
    case when s_suppkey % 5 = 0 then 'address_requires_manual_normalization' end, case when s_suppkey % 7 <> 0 and s_suppkey % 3 > 0 and s_suppkey % 2 = 1 then 'catalog_locality_municipality_conflict' end,
    case when s_suppkey % 7 <> 0 and s_suppkey * 100 % 20000 > 15000 then 'more_than_15km_from_named_place_point' end, case when s_suppkey % 8 <> 0 and s_suppkey % 7 = 0 then 'named_locality_not_in_local_point_catalog' end,
    case when s_suppkey % 400 > 200 then 'address_matching_store_more_than_200m_away' end, case when s_suppkey % 3 > 1 then 'multiple_store_address_candidates' end, case when s_suppkey % 9 <> 0 and s_suppkey % 6 = 0 then 'not_on_mapped_building_not_proven_coordinate_error' end], lambda x: x is not null)), ';') as flags from supplier""")
def store_flags(spark, sf_dir):
    k = F.col("s_suppkey")
    flags = housing.store_flags(k % 9 != 0, k % 3, k % 4 != 0, F.when(k % 8 != 0, "town"), F.when(k % 5 != 0, "key"), F.when(k % 7 != 0, k * 100 % 20000), k % 2 == 0, k % 400, k % 3, k % 6 != 0)
    return t(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(flags, ";").alias("flags"))


@query(f"""with c as ({cells_sql()}), w as (select *, 2500 + (settlement * 7919) % 97500 as pop, proxy % 7 as v from c), s as (select *, sum(proxy) over (partition by settlement) as tp, sum(v) over (partition by settlement) as tv from w),
    x as (select settlement, ix, iy, cast(pop * proxy as double) / cast(tp as double) as a, case when tv > 0 then cast(pop * v as double) / cast(tv as double) end as b from s) select settlement, ix, iy, a as proxy_share, b as v_share, least(a, b) as low, greatest(a, b) as high from x""")
def scenario_redistribution(spark, sf_dir):
    rows = cells(spark, sf_dir).withColumn("population", population("settlement")).withColumn("v", F.col("proxy") % 7)
    rows = allocate.redistributed(rows, "settlement", "population", ["proxy", "v"])
    low, high = allocate.envelope("proxy_share", "v_share")
    return rows.select("settlement", "ix", "iy", "proxy_share", "v_share", low.alias("low"), high.alias("high"))


@query(f"with c as ({cells_sql()}) select settlement, cast(sum(abs(proxy - buildings)) as double) / 2 as variation from c group by 1")
def total_variation(spark, sf_dir):
    return allocate.total_variation(cells(spark, sf_dir), "settlement", "proxy", "buildings")


@query("with r as (select doc_id, lang, row_number() over (partition by lang order by sha256('review' || doc_id), doc_id) as k from documents) select doc_id, lang, cast(k as bigint) as sample_rank from r where k <= 20")
def stratified_sample(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "lang")
    return match.stratified_sample(d, "lang", "doc_id", 20, "review").withColumn("sample_rank", F.col("sample_rank").cast("bigint"))


@query("select flag, count(*) as n from (select unnest([case when o_totalprice > 200000 then 'large' end, case when o_orderstatus = 'F' then 'closed' end, case when o_orderpriority like '1%' then 'urgent' end]) as flag from orders) where flag is not null group by 1")
def counts_by_flag(spark, sf_dir):
    flags = F.array_compact(F.array(F.when(F.col("o_totalprice") > 200000, "large"), F.when(F.col("o_orderstatus") == "F", "closed"), F.when(F.col("o_orderpriority").startswith("1"), "urgent")))
    return audit.flag_counts(t(spark, sf_dir, "orders").withColumn("flags", flags), "flags")


@query("select o_custkey % 25 as municipality, count_if(o_orderstatus = 'F') as F, count_if(o_orderstatus = 'O') as O, count_if(o_orderstatus = 'P') as P from orders group by 1")
def coverage_pivot(spark, sf_dir):
    return audit.coverage_pivot(t(spark, sf_dir, "orders").withColumn("municipality", F.col("o_custkey") % 25), "municipality", "o_orderstatus", ["F", "O", "P"])


@query("select coalesce(a.k, b.k) as municipality, coalesce(a.n, 0) as old, coalesce(b.n, 0) as new, coalesce(b.n, 0) - coalesce(a.n, 0) as change from (select o_custkey % 25 as k, count(*) as n from orders where o_orderkey % 3 = 0 group by 1) a full join (select o_custkey % 25 as k, count(*) as n from orders where o_orderkey % 5 = 0 and o_custkey % 25 > 3 group by 1) b on a.k = b.k")
def count_changes(spark, sf_dir):
    o = t(spark, sf_dir, "orders").withColumn("municipality", F.col("o_custkey") % 25)
    return audit.count_changes(o.where("o_orderkey % 3 = 0"), o.where("o_orderkey % 5 = 0 and municipality > 3"), "municipality")


def _boxes(spark, sf_dir):
    k = F.col("s_suppkey")
    return stores(spark, sf_dir).withColumnRenamed("store_id", "s_suppkey").select("s_suppkey", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 200 + k % 5 * 100).alias("x1"), (F.col("y") + 150 + k % 7 * 100).alias("y1"))


def _ring(x0, y0, x1, y1):
    p = lambda x, y: F.array(F.col(x).cast("double"), F.col(y).cast("double"))
    return F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1))


BOXES = f"{STORES}, b as (select store_id as k, x as x0, y as y0, x + 200 + store_id % 5 * 100 as x1, y + 150 + store_id % 7 * 100 as y1 from s)"


@query(f"with {PLACES}, {BOXES} select c_custkey, k as s_suppkey from p, b where x between x0 and x1 and y between y0 and y1")
def point_in_polygon(spark, sf_dir):
    polygons = _boxes(spark, sf_dir).withColumn("ring", _ring("x0", "y0", "x1", "y1"))
    return spatial.points_in_polygons(places(spark, sf_dir), polygons, "c_custkey", "s_suppkey")


@query(f"with {BOXES} select l.k as a, r.k as b, (least(l.x1, r.x1) - greatest(l.x0, r.x0)) * (least(l.y1, r.y1) - greatest(l.y0, r.y0)) as area from b l, b r where l.k < r.k and greatest(l.x0, r.x0) < least(l.x1, r.x1) and greatest(l.y0, r.y0) < least(l.y1, r.y1)")
def overlap_pairs(spark, sf_dir):
    return spatial.overlapping_boxes(_boxes(spark, sf_dir), "s_suppkey", 1000.0)


@query(f"""with {BOXES}, o as (select l.k as a, r.k as b, (least(l.x1, r.x1) - greatest(l.x0, r.x0)) * (least(l.y1, r.y1) - greatest(l.y0, r.y0)) as area, least((l.x1 - l.x0) * (l.y1 - l.y0), (r.x1 - r.x0) * (r.y1 - r.y0)) as smaller
    from b l, b r where l.k < r.k and greatest(l.x0, r.x0) < least(l.x1, r.x1) and greatest(l.y0, r.y0) < least(l.y1, r.y1)) select a, b, round(area, 3) as area, area / smaller >= 0.95 as nested from o where area > 1 and area / smaller >= 0.06""")
def polygon_overlaps(spark, sf_dir):
    polygons = _boxes(spark, sf_dir).withColumn("ring", _ring("x0", "y0", "x1", "y1"))
    return spatial.overlaps(polygons, "s_suppkey", least_ratio=0.06).select("a", "b", F.round("area", 3).alias("area"), "nested")


def _frames(spark, sf_dir):
    """Boxes with a hole, which is the middle ninth and as often clockwise as not."""
    b = _boxes(spark, sf_dir)
    for c in ("x", "y"):
        third = (F.col(f"{c}1") - F.col(f"{c}0")) / 3
        b = b.withColumn(f"h{c}0", F.col(f"{c}0") + third).withColumn(f"h{c}1", F.col(f"{c}1") - third)
    hole = _ring("hx0", "hy0", "hx1", "hy1")
    return b.withColumn("ring", F.array(_ring("x0", "y0", "x1", "y1"), F.when(F.col("s_suppkey") % 2 == 0, hole).otherwise(F.reverse(hole))))


#: Signed boxes of each frame: its outside, less its hole.
FRAMES = f"{BOXES}, f as (select k, 1 as sign, x0, y0, x1, y1 from b union all select k, -1, x0 + (x1 - x0) / 3, y0 + (y1 - y0) / 3, x1 - (x1 - x0) / 3, y1 - (y1 - y0) / 3 from b)"
COMMON = "greatest(0, least(l.x1, r.x1) - greatest(l.x0, r.x0)) * greatest(0, least(l.y1, r.y1) - greatest(l.y0, r.y0))"


@query(f"with {PLACES}, {FRAMES} select c_custkey, f.k as s_suppkey from p join f on f.sign = 1 and x between x0 and x1 and y between y0 and y1 where not exists (select 1 from f h where h.k = f.k and h.sign = -1 and x > h.x0 + 1e-9 and x < h.x1 - 1e-9 and y > h.y0 + 1e-9 and y < h.y1 - 1e-9)")
def point_in_frame(spark, sf_dir):
    return spatial.points_in_polygons(places(spark, sf_dir), _frames(spark, sf_dir), "c_custkey", "s_suppkey")


@query(f"""with {FRAMES}, o as (select l.k as a, r.k as b, sum(l.sign * r.sign * {COMMON}) as area from f l join f r on l.k < r.k and least(l.x1, r.x1) > greatest(l.x0, r.x0) and least(l.y1, r.y1) > greatest(l.y0, r.y0) group by 1, 2),
    z as (select k, sum(sign * (x1 - x0) * (y1 - y0)) as size from f group by 1), v as (select a, b, area, area / least(x.size, y.size) as ratio from o join z x on x.k = a join z y on y.k = b) select a, b, round(area, 3) as area, ratio >= 0.95 as nested from v where area > 1 and ratio >= 0.06""")
def frame_overlaps(spark, sf_dir):
    return spatial.overlaps(_frames(spark, sf_dir), "s_suppkey", least_ratio=0.06).select("a", "b", F.round("area", 3).alias("area"), "nested")


#: Signed boxes of two domains: an L, and two islands of which one has a lake.
LANDS = (("ell", 1, 0, 0, 2500, 10800), ("ell", 1, 2500, 0, 5000, 5000), ("isles", 1, 6000, 1000, 8000, 3000), ("isles", 1, 8500, 4000, 10000, 9000), ("isles", -1, 9000, 5000, 9500, 6000))


@query(f"""with {FRAMES}, d(domain, sign, x0, y0, x1, y1) as (values {", ".join(map(repr, LANDS))}), g as (select l.k, r.domain, l.sign * r.sign as sign, greatest(l.x0, r.x0) as x0, greatest(l.y0, r.y0) as y0, least(l.x1, r.x1) as x1, least(l.y1, r.y1) as y1 from f l join d r on least(l.x1, r.x1) > greatest(l.x0, r.x0) and least(l.y1, r.y1) > greatest(l.y0, r.y0)),
    e as (select *, unnest(range(cast(floor(x0 / 100) as bigint), cast(floor(x1 / 100) as bigint) + 1)) as ix from g), h as (select *, unnest(range(cast(floor(y0 / 100) as bigint), cast(floor(y1 / 100) as bigint) + 1)) as iy from e),
    a as (select domain, ix, iy, k, sum(sign * greatest(0, least(x1, ix * 100 + 100) - greatest(x0, ix * 100)) * greatest(0, least(y1, iy * 100 + 100) - greatest(y0, iy * 100))) as area from h group by 1, 2, 3, 4) select domain, ix, iy, k as s_suppkey, round(cast(area as double), 3) as area from a where area > 0.001""")
def frames_on_lands(spark, sf_dir):
    box = lambda x0, y0, x1, y1: [[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]
    ell = [[[[0.0, 0.0], [5000.0, 0.0], [5000.0, 5000.0], [2500.0, 5000.0], [2500.0, 10800.0], [0.0, 10800.0]]]]
    isles = [[box(6000.0, 1000.0, 8000.0, 3000.0)], [box(8500.0, 4000.0, 10000.0, 9000.0), box(9000.0, 5000.0, 9500.0, 6000.0)]]
    lands = spark.createDataFrame([("ell", ell), ("isles", isles)], "domain STRING, ring ARRAY<ARRAY<ARRAY<ARRAY<DOUBLE>>>>")
    return spatial.clipped_to_cells(_frames(spark, sf_dir), lands, "s_suppkey", "domain", 100.0, least_part=0.001).withColumn("area", F.round("area", 3))


SQUARES = "q as (select ix * 100 + iy as cell, ix * 700 as x0, iy * 900 as y0, ix * 700 + 600 as x1, iy * 900 + 800 as y1 from range(15) a(ix), range(12) c(iy))"


@query(f"""with {FRAMES}, {SQUARES}, p as (select f.k, q.cell, sum(f.sign * greatest(0, least(f.x1, q.x1) - greatest(f.x0, q.x0)) * greatest(0, least(f.y1, q.y1) - greatest(f.y0, q.y0))) as part from f join q on least(f.x1, q.x1) > greatest(f.x0, q.x0) and least(f.y1, q.y1) > greatest(f.y0, q.y0) group by 1, 2),
    z as (select k, sum(sign * (x1 - x0) * (y1 - y0)) as size from f group by 1), w as (select p.cell, part, case when k % 3 = 0 then 1.0 else 0.55 end as weight, k % 9 + 1 as levels, k % 3 = 0 as explicit, k % 2 = 0 as observed, k % 5 = 0 as lifecycle from p join z using (k) where part > 1e-6 and size between 12 and 80000), v as (select *, part * cast(weight as double) * levels as full_ from w)
    select cell, round(sum(part * cast(weight as double)), 2) as footprint_only, round(sum(case when explicit then full_ else 0 end), 2) as explicit_only, round(sum(case when lifecycle then 0 else full_ end), 2) as lifecycle_excluded, round(sum(case when observed then full_ else full_ / 2 end), 2) as assumed_half, round(sum(case when observed then full_ else full_ * 2 end), 2) as assumed_double, round(sum(full_), 2) as baseline from v group by 1""")
def published_cell_weights(spark, sf_dir):
    k = F.col("s_suppkey")
    b = _frames(spark, sf_dir).select("s_suppkey", "ring", (k % 9 + 1).alias("levels"), F.when(k % 3 == 0, 1.0).otherwise(0.55).alias("weight"), (k % 3 == 0).alias("explicit"), (k % 2 == 0).alias("observed"), (k % 5 == 0).alias("lifecycle"))
    q = spark.range(15).selectExpr("id as ix").selectExpr("ix", "explode(sequence(0, 11)) as iy").selectExpr("ix * 100 + iy as cell", "ix * 700 as x0", "iy * 900 as y0", "ix * 700 + 600 as x1", "iy * 900 + 800 as y1")
    found = allocate.cell_weights(b, q.select("cell", F.array(_ring("x0", "y0", "x1", "y1")).alias("ring")), "s_suppkey", "cell", least_part=1e-6)
    return found.select("cell", *(F.round(c, 2).alias(c) for c in ("footprint_only", "explicit_only", "lifecycle_excluded", "assumed_half", "assumed_double", "baseline")))


@query(f"select c_custkey, round(distance, 5) + 0 as distance from ({NEAR_ROAD})")
def nearest_road(spark, sf_dir):
    return spatial.nearest_line(places(spark, sf_dir), roads(spark, sf_dir), "c_custkey", start=200.0).select("c_custkey", (F.round("distance", 5) + 0).alias("distance"))


@query("select s_nationkey as page, 'Город ' || s_nationkey as title, cast(s_suppkey as varchar) as card_id, 'Ленина ул., дом ' || s_suppkey as address, '8:00 до ' || (20 + s_suppkey % 4) || ':00' as hours, case when s_suppkey % 5 <> 0 then 130 + s_suppkey % 100 / 10.0::double end as lon, case when s_suppkey % 5 <> 0 then 42 + s_suppkey % 70 / 10.0::double end as lat from supplier")
def store_catalogue(spark, sf_dir):
    """Catalogue pages made of suppliers, one page a nation; a fifth of the cards has no handler, and each handler has a line that doesn't count."""
    k = F.col("s_suppkey")
    card = F.format_string('<div id="addr-id-%d" class="item"> <div>Ленина ул., дом %d</div> <div>8:00 до %d:00</div> </div>', k, k, 20 + k % 4)
    handler = F.format_string('$("#addr-id-%d").click(function(){\n//center: [37.6, 55.7],\nmap.flyTo({center: [%s, %s,], zoom:15});\n});', k, (130 + k % 100 / 10.0).cast("string"), (42 + k % 70 / 10.0).cast("string"))
    pages = t(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("page")).agg(F.concat_ws("", F.collect_list(card)).alias("cards"), F.concat_ws("\n", F.collect_list(F.when(k % 5 != 0, handler))).alias("handlers"), F.count("*").alias("n"))
    html = F.format_string("<html>[block]<h2>Город %d</h2>магазинов: %d %s[/block]%s</html>", "page", "n", "cards", "handlers")
    patterns = (r"(?s)\[block\](.*?)\[/block\]", "<h2>(.*?)</h2>", r"магазинов: (\d+)", r'(?s)<div id="addr-id-(\d+)" class="item">\s*<div>(.*?)</div>\s*<div>(.*?)</div>\s*</div>', r'(?s)\$\("#addr-id-(\d+)"\)\.click\(function\(\)\{(.*?)\}\);', r"center:\s*\[\s*([-\d.]+),\s*([-\d.]+)\s*,?\s*\]")
    return read.catalogue(pages.select("page", html.alias("html")), "page", F.col("html"), *patterns).drop("block")


@query(f"""with {BOXES}, d as (select 'west' as domain, 0 as u0, 5000 as u1 union all select 'east', 5000, 10400), g as (select k, x0, y0, x1, y1, domain, u0, u1 from b, d where x0 < u1 and x1 > u0),
    e as (select *, unnest(range(cast(floor(x0 / 100) as bigint), cast(floor(x1 / 100) as bigint) + 1)) as ix from g), f as (select *, unnest(range(cast(floor(y0 / 100) as bigint), cast(floor(y1 / 100) as bigint) + 1)) as iy from e),
    a as (select domain, ix, iy, k, (least(x1, u1, ix * 100 + 100) - greatest(x0, u0, ix * 100)) as w, (least(y1, 10800, iy * 100 + 100) - greatest(y0, iy * 100)) as h from f) select domain, ix, iy, k as s_suppkey, round(cast(w * h as double), 3) as area from a where w > 0 and h > 0""")
def clipped_cells(spark, sf_dir):
    b = _boxes(spark, sf_dir).withColumn("ring", _ring("x0", "y0", "x1", "y1"))
    d = spark.createDataFrame([("west", [[0.0, 0.0], [5000.0, 0.0], [5000.0, 10800.0], [0.0, 10800.0]]), ("east", [[5000.0, 0.0], [10400.0, 0.0], [10400.0, 10800.0], [5000.0, 10800.0]])], "domain STRING, ring ARRAY<ARRAY<DOUBLE>>")
    return spatial.clipped_to_cells(b, d, "s_suppkey", "domain", 100.0).withColumn("area", F.round("area", 3))


def _projection_sql() -> str:
    import math

    q = lambda s: f"({1 - E2} * (({s}) / (1 - {E2} * ({s}) * ({s})) - {1 / (2 * E1)} * ln((1 - {E1} * ({s})) / (1 + {E1} * ({s})))))"
    num = lambda s: (1 - E2) * (s / (1 - E2 * s * s) - 1 / (2 * E1) * math.log((1 - E1 * s) / (1 + E1 * s)))
    s0 = math.sin(math.radians(CENTRE_LAT))
    qp = num(1.0 - 1e-15)
    b1, rq = math.asin(num(s0) / qp), SEMI_MAJOR * math.sqrt(qp / 2)
    d = SEMI_MAJOR * math.cos(math.radians(CENTRE_LAT)) / math.sqrt(1 - E2 * s0 * s0) / (rq * math.cos(b1))
    return f"""with p as (select c_custkey, radians(130 + c_custkey % 80 / 10.0::double - {CENTRE_LON}) as dl, radians(42 + c_custkey % 60 / 10.0::double) as lat from customer), b as (select c_custkey, dl, asin({q("sin(lat)")} / {qp}) as b from p),
    k as (select *, {rq} * sqrt(2 / (1 + {math.sin(b1)} * sin(b) + {math.cos(b1)} * cos(b) * cos(dl))) as k from b) select c_custkey, round(k * {d} * cos(b) * sin(dl), 3) + 0 as x, round(k / {d} * ({math.cos(b1)} * sin(b) - {math.sin(b1)} * cos(b) * cos(dl)), 3) + 0 as y from k"""


@query(_projection_sql())
def equal_area_points(spark, sf_dir):
    k = F.col("c_custkey")
    x, y = equal_area(130 + k % 80 / 10.0, 42 + k % 60 / 10.0)
    return t(spark, sf_dir, "customer").select("c_custkey", (F.round(x, 3) + 0).alias("x"), (F.round(y, 3) + 0).alias("y"))


def _contacts(spark, sf_dir):
    k = F.col("c_custkey")
    c = t(spark, sf_dir, "customer")
    some = lambda *v: F.array(*v)
    rows = c.select(
        k.alias("record"), F.lit("").alias("contact_id"), F.concat(F.lit("  ООО  "), F.col("c_name")).alias("name"), F.when(k % 3 == 0, "Agency").otherwise("shop").alias("kind"),
        some(F.lit("City"), F.lit("city ")).alias("coverage"), some().cast("array<string>").alias("specializations"),
        some(F.format_string("8 (900) %03d-%02d-%02d", k % 400, k % 400 % 100, F.lit(7)), F.lit("12")).alias("phones"), some(F.format_string("USER%d@Example.com", k % 700), F.lit("no mail")).alias("emails"),
        some(F.format_string("HTTP://Site%d.example.org:80//a//b#top", k)).alias("websites"), some().cast("array<string>").alias("addresses"), some(F.format_string("https://t.me/u%d", k)).alias("links"),
    )
    return resolve.normalized(rows, "region")


@query("select c_custkey as record, 'ООО ' || c_name as name, case when c_custkey % 3 = 0 then 'agency' else 'other' end as kind, 'City' as coverage, printf('+7900%03d%02d07', c_custkey % 400, c_custkey % 400 % 100) as phones, printf('user%d@example.com', c_custkey % 700) as emails, printf('http://site%d.example.org/a/b', c_custkey) as websites, 'telegram' as links from customer")
def contact_normalize(spark, sf_dir):
    joined = [F.array_join(c, ",").alias(c) for c in ("coverage", "phones", "emails", "websites")]
    return _contacts(spark, sf_dir).select("record", "name", "kind", *joined, F.array_join(F.transform("links", lambda x: x["type"]), ",").alias("links"))


@query("""with recursive k as (select c_custkey as r, 'p' || c_custkey % 400 as key from customer union all select c_custkey, 'e' || c_custkey % 700 from customer), f as (select key, min(r) as f from k group by 1), e as (select r as a, f as b from k join f using (key) where r <> f union select f, r from k join f using (key) where r <> f),
    w as (select c_custkey as n, c_custkey as c from customer union select e.a, w.c from w join e on e.b = w.n), m as (select n, min(c) as c from w group by 1) select c as component, count(*) as records, count(distinct n % 400) as phones, count(distinct n % 700) as emails from m group by 1""")
def contact_components(spark, sf_dir):
    found = resolve.merged(_contacts(spark, sf_dir))
    return found.select("component", "records", F.size("phones").cast("bigint").alias("phones"), F.size("emails").cast("bigint").alias("emails"))


@query("""with c as (select c_custkey as k, lower(c_name) as name, 'new' || c_custkey as id from customer), b as (select k // 3 as g, max(name) as name from c where k % 5 <> 4 group by 1), w as (select b.g, c.k from b join c on c.k // 3 = b.g and c.name = b.name and c.k % 5 <> 4)
    select case when w.k is not null and c.k // 3 % 2 = 0 then 'old' || c.k // 3 else c.id end as contact_id, c.k as component from c left join w on w.k = c.k""")
def contact_stable_ids(spark, sf_dir):
    """Up to three contacts claim an old id; names fall as components rise, so that the last component is first by name."""
    k = F.col("c_custkey")
    own = F.concat(F.lit("d:"), F.floor(k / 3).cast("string"))
    keys = F.when(k % 5 == 4, F.array(own, F.concat(F.lit("p:"), F.floor(k / 3).cast("string")))).otherwise(F.array(own))
    name = F.translate(F.lower("c_name"), "0123456789", "9876543210")
    c = t(spark, sf_dir, "customer").select(k.alias("component"), name.alias("name"), F.concat(F.lit("new"), k.cast("string")).alias("contact_id"), keys.alias("keys"))
    g = c.select(F.floor(F.col("component") / 3).alias("g")).distinct().where("g % 2 = 0")
    old = g.select(F.concat(F.lit("old"), F.col("g").cast("string")).alias("contact_id"), F.array(F.concat(F.lit("d:"), F.col("g").cast("string"))).alias("keys"))
    rival = g.select(F.concat(F.lit("rival"), F.col("g").cast("string")).alias("contact_id"), F.array(F.concat(F.lit("p:"), F.col("g").cast("string"))).alias("keys"))
    return resolve.preserved_ids(c, old.union(rival)).select("contact_id", "component")


def _versions(spark, sf_dir, new: bool):
    k = F.col("c_custkey")
    source = F.array(F.struct(F.lit("registry").alias("source_id"), F.lit("2026-02-02" if new else "2026-01-01").alias("retrieved_at"), F.when((k % 17 == 0) & F.lit(new), "http://a.example.org/").alias("url")))
    phones = F.array(F.format_string("+7900%07d", k + F.when((k % 13 == 0) & F.lit(new), 1).otherwise(0)))
    c = t(spark, sf_dir, "customer").where(k % 10 != 0 if not new else k % 7 != 0)
    return c.select(F.concat(F.lit("c-"), k.cast("string")).alias("contact_id"), F.col("c_name").alias("name"), phones.alias("phones"), source.alias("sources"), F.lit("needs_review" if new else "published").alias("review_status"))


@query("""select 'c-' || c_custkey as contact_id, case when c_custkey % 10 = 0 then 'added' when c_custkey % 7 = 0 then 'removed' when c_custkey % 13 = 0 or c_custkey % 17 = 0 then 'changed' else 'unchanged' end as status from customer where c_custkey % 10 <> 0 or c_custkey % 7 <> 0""")
def contact_delta(spark, sf_dir):
    """When a source was read and the state of the review differ everywhere and count nowhere."""
    return resolve.delta(_versions(spark, sf_dir, False), _versions(spark, sf_dir, True))


@query("""with r as (select c_custkey as k, 'c-' || lpad(cast(c_custkey // 2 * 2 + case when c_custkey % 30 = 1 then 0 else c_custkey % 2 end as varchar), 6, '0') || case when c_custkey % 41 = 0 then 'X' else '' end as id from customer)
    select id as contact_id, unnest(list_filter([case when k % 41 = 0 then 'contact_id' end, case when k % 9 = 0 then 'kind' end, case when k % 5 = 0 then 'phones' end, case when k % 6 = 0 then 'emails' end, case when k % 8 = 0 then 'websites' end, case when k % 12 = 0 then 'coverage' end, case when k % 14 = 0 then 'sources' end], lambda x: x is not null)) as error from r
    union all select id, 'duplicate' from r group by 1 having count(*) > 1""")
def contact_validation(spark, sf_dir):
    k, none = F.col("c_custkey"), F.array().cast("array<string>")
    number = F.floor(k / 2) * 2 + F.when(k % 30 == 1, 0).otherwise(k % 2)
    one = lambda bad, x, y: F.array(F.when(bad, x).otherwise(y))
    c = t(spark, sf_dir, "customer").select(
        F.concat(F.lit("c-"), F.lpad(number.cast("string"), 6, "0"), F.when(k % 41 == 0, "X").otherwise("")).alias("contact_id"), F.col("c_name").alias("name"), F.when(k % 9 == 0, "shop").otherwise("agency").alias("kind"),
        one(k % 5 == 0, "8 (900) 111-22-33", "+79001112233").alias("phones"), one(k % 6 == 0, "User@Example.com", "user@example.com").alias("emails"), one(k % 8 == 0, "HTTP://Example.org:80//a", "http://example.org/a").alias("websites"),
        one(k % 12 == 0, "", "City").alias("coverage"), none.alias("specializations"), none.alias("addresses"), F.array(F.struct(F.lit("telegram").alias("type"), F.lit("telegram").alias("label"), F.lit("https://t.me/u").alias("url"))).alias("links"),
        F.array(F.struct(F.when(k % 14 == 0, "Bad id").otherwise("registry").alias("source_id"), F.lit("2026-01-01").alias("retrieved_at"), F.lit(None).cast("string").alias("url"))).alias("sources"), F.lit("needs_review").alias("review_status"),
    )
    return resolve.catalogue_errors(c)


@query("select c_custkey from customer where c_mktsegment = 'BUILDING' and contains(lower(c_name), '7')")
def contact_search(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("kind"), *(F.array().cast("array<string>").alias(x) for x in resolve.LISTS))
    return resolve.searched(c, text="7", kind="BUILDING").select("c_custkey")


@query("select distinct c_mktsegment as value from customer where c_mktsegment <> ''")
def facets(spark, sf_dir):
    return resolve.facets(t(spark, sf_dir, "customer"), "c_mktsegment")


ROUTES = (("R1", ("1",)), ("R2", ("2", "3")), ("R9", ("99999",)))


@query("with p as (select case when upper(replace(p_name, ' ', '')) like '%1%' then 'R1' when upper(replace(p_name, ' ', '')) like '%2%' or upper(replace(p_name, ' ', '')) like '%3%' then 'R2' when upper(replace(p_name, ' ', '')) like '%99999%' then 'R9' end as route from part), r as (select unnest(['R1', 'R2', 'R9']) as route) select r.route, count(p.route) as n from r left join p using (route) group by 1")
def road_route_match(spark, sf_dir):
    found = t(spark, sf_dir, "part").select(match.first_routes(text.route_text(F.col("p_name")), ROUTES).alias("route")).groupBy("route").agg(F.count("*").alias("n"))
    routes = spark.createDataFrame([(r,) for r, _ in ROUTES], "route STRING")
    return routes.join(found, "route", "left").select("route", F.coalesce("n", F.lit(0)).alias("n"))


@query("select doc_id, strlen(text) as bytes, sha256(text) as sha256 from documents")
def manifest_hash(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("bigint").alias("bytes"), F.sha2("text", 256).alias("sha256"))


@query("select coalesce(a.o_custkey, b.c_custkey) as c_custkey, case when b.c_custkey is null then 'unexpected' else 'missing' end as side from (select distinct case when o_custkey % 11 = 0 then -o_custkey else o_custkey end as o_custkey from orders where o_custkey % 7 <> 0) a full join customer b on a.o_custkey = b.c_custkey where a.o_custkey is null or b.c_custkey is null")
def key_differences(spark, sf_dir):
    k = F.col("o_custkey")
    o = t(spark, sf_dir, "orders").where(k % 7 != 0).select(F.when(k % 11 == 0, -k).otherwise(k).alias("c_custkey"))
    return audit.key_differences(t(spark, sf_dir, "customer"), o, ["c_custkey"])


@query(f"with c as ({cells_sql()}), s as (select settlement, sum(proxy) as found from c group by 1) select settlement, cast(found as bigint) as found, case when settlement % 50 = 0 then cast(found as bigint) + 1 else cast(found as bigint) end as expected from s where settlement % 50 = 0")
def control_reconciliation(spark, sf_dir):
    c = cells(spark, sf_dir)
    controls = c.groupBy("settlement").agg(F.sum("proxy").alias("v")).withColumn("v", F.col("v") + (F.col("settlement") % 50 == 0).cast("int"))
    return audit.reconciled(c, controls, "settlement", "proxy", "v")


@query("select cast(p_partkey as varchar) as name, max(case when p_partkey % 2 = 0 then 'residential' end) as use, max(case when p_partkey % 2 = 1 then cast(p_size as varchar) end) as above_ground_storeys, cast(null as varchar) as residential_premises_area_m2, cast(null as varchar) as apartments from part where p_partkey % 3 = 0 and p_partkey % 5 <> 0 group by 1")
def register_compile(spark, sf_dir):
    k = F.col("p_partkey")
    rows = t(spark, sf_dir, "part").select(
        k.cast("string").alias("name"), F.when(k % 2 == 0, "use").otherwise("above_ground_storeys").alias("field"), F.when(k % 5 == 0, "reported").otherwise("confirmed").alias("status"),
        F.when(k % 2 == 0, "residential").otherwise(F.col("p_size").cast("string")).alias("value"), F.lit("r").alias("reviewer"), F.lit("2026-01-01").alias("reviewed_at"), F.array(F.lit("s")).alias("sources"), F.when(k % 3 == 0, "confirmed").otherwise("candidate").alias("match_status"),
    )
    return review.compiled_register(rows)


@query("select distinct c_custkey, s_suppkey from customer join supplier on (c_custkey % 6 = s_suppkey % 6 or (c_custkey + 1) % 6 = s_suppkey % 6) and c_custkey % 4 = s_suppkey % 4 and c_custkey % 5 = s_suppkey % 5 where c_custkey % 2 = 1 or c_nationkey = s_nationkey")
def locality_candidates(spark, sf_dir):
    k, m = F.col("c_custkey"), F.col("s_suppkey")
    a = t(spark, sf_dir, "customer").select("c_custkey", F.array(k % 6, (k + 1) % 6).alias("localities"), (k % 4).alias("street"), (k % 5).alias("number"), F.when(k % 2 == 0, F.col("c_nationkey")).alias("municipality"))
    r = t(spark, sf_dir, "supplier").select("s_suppkey", (m % 6).alias("locality"), (m % 4).alias("street"), (m % 5).alias("number"), F.col("s_nationkey").alias("municipality"))
    return review.locality_candidates(a, r, "c_custkey", "s_suppkey")


@query(f"with {BOXES} select k as s_suppkey from b where k % 4 <> 0 and not exists (select 1 from b p where p.k % 4 = 0 and greatest(b.x0, p.x0) < least(b.x1, p.x1) and greatest(b.y0, p.y0) < least(b.y1, p.y1))")
def unprotected_cells(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    return review.unprotected(b.where("s_suppkey % 4 <> 0"), b.where("s_suppkey % 4 = 0"), "s_suppkey").select("s_suppkey")


@query(f"with {BOXES}, o as (select l.k % 3 as u, r.k % 3 as v, (least(l.x1, r.x1) - greatest(l.x0, r.x0)) * (least(l.y1, r.y1) - greatest(l.y0, r.y0)) as area from b l, b r where l.k < r.k and greatest(l.x0, r.x0) < least(l.x1, r.x1) and greatest(l.y0, r.y0) < least(l.y1, r.y1)) select least(u, v) as first, greatest(u, v) as second, count(*) as pairs, sum(area) as area from o group by 1, 2")
def overlaps_by_owner(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    return review.overlaps_by_owner(spatial.overlapping_boxes(b, "s_suppkey", 1000.0), b.withColumn("owner", F.col("s_suppkey") % 3), "s_suppkey", "owner")


def _geodesic_sql(rounds: int = 8) -> str:
    """Vincenty's inverse formula over all pairs, with its iteration written out."""
    f, a = FLATTENING, SEMI_MAJOR
    axis = a * (1 - f)
    parts = [f"g as (select c_custkey, store_id, atan((1 - {f}) * tan(radians(42 + p.y / 2500))) as u1, atan((1 - {f}) * tan(radians(42 + s.y / 2500))) as u2, radians(s.x / 2000 - p.x / 2000) as dl from p, s)", "i0 as (select *, dl as lam from g)"]
    sigma = "sqrt((cos(u2) * sin(lam)) ** 2 + (cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam)) ** 2) as sn, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) as cs, atan2(sn, cs) as sg, case when sn > 0 then cos(u1) * cos(u2) * sin(lam) / sn else 0 end as al, 1 - al * al as ca, case when ca > 0 then cs - 2 * sin(u1) * sin(u2) / ca else 0 end as md"
    for k in range(rounds):
        parts.append(f"j{k} as (select *, {sigma}, {f} / 16 * ca * (4 + {f} * (4 - 3 * ca)) as kk from i{k})")
        parts.append(f"i{k + 1} as (select c_custkey, store_id, u1, u2, dl, dl + (1 - kk) * {f} * al * (sg + kk * sn * (md + kk * cs * (2 * md * md - 1))) as lam from j{k})")
    parts.append(f"m as (select *, {sigma}, ca * {(a * a - axis * axis) / (axis * axis)} as uu, 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu))) as aa, uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu))) as bb, bb * sn * (md + bb / 4 * (cs * (2 * md * md - 1) - bb / 6 * md * (4 * sn * sn - 3) * (4 * md * md - 3))) as dd, {axis} * aa * (sg - dd) as metres from i{rounds})")
    return f"with {PLACES}, {STORES}, {', '.join(parts)}, r as (select c_custkey, store_id, metres, row_number() over (partition by c_custkey order by metres, store_id) as n from m) select c_custkey, store_id, round(metres, 2) as metres from r where n = 1"


@query(_geodesic_sql())
def nearest_on_ellipsoid(spark, sf_dir):
    degrees = lambda df: df.withColumn("x", 130 + F.col("x") / 2000).withColumn("y", 42 + F.col("y") / 2500)
    return review.nearest_on_ellipsoid(degrees(places(spark, sf_dir)), degrees(stores(spark, sf_dir)), "c_custkey", "store_id").withColumn("metres", F.round("metres", 2))


#: The pages' text, for the entities that they have, and their markup without comments, scripts and styles.
VISIBLE = r"""with a as (select page_id, regexp_replace(regexp_replace(coalesce(html, ''), '<!--.*?-->', ' ', 'gs'), '<(script|style)\b[^>]*>.*?</(script|style)>', ' ', 'gs') as h from pages), b as (select page_id, h, regexp_replace(h, '<[^>]*>', ' ', 'g') as t from a),
    u as (select page_id, h, replace(replace(replace(replace(replace(replace(replace(t, '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') as t from b), v as (select page_id, h, trim(regexp_replace(t, '[\s\x{a0}]+', ' ', 'g')) as t from u)"""


@query(VISIBLE + r""" select page_id, cast(length(t) as int) as text_chars, cast(len(list_filter(regexp_extract_all(h, '(?s)<tr\b.*?(?:</tr>|$)'), lambda r: regexp_matches(r, '</t[dh]>'))) as int) as table_rows, cast(len(regexp_extract_all(h, '<a\b[^>]*\bhref="[^"]+"')) as int) as links from v""")
def html_visible_rows(spark, sf_dir):
    found = read.parsed_pages(t(spark, sf_dir, "pages"), "page_id", "html")
    return found.select("page_id", F.length("text").alias("text_chars"), F.size("rows").alias("table_rows"), F.size("links").alias("links"))


@query(VISIBLE + r""", c as (select page_id, lpad(cast(page_id % 100 as varchar), 2, '0') as n, list_transform(regexp_extract_all(t, '[\w.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), lambda x: lower(x)) as m,
      list_transform(regexp_extract_all(t, '(?:^|[^0-9])((?:\+?7|8)[\s()\-]*(?:[0-9][\s()\-]*){9}[0-9])[\s()\-]*(?:[^0-9]|$)', 1), lambda x: '+7' || regexp_replace(x, '[^0-9]', '', 'g')[-10:]) as p from v)
    select page_id, array_to_string(list_sort(list_distinct(list_concat(p, ['+79' || n || '1112233'], case when page_id % 3 = 0 then ['+79' || n || '9998877'] else [] end))), ';') as phones,
      array_to_string(list_sort(list_distinct(list_concat(m, ['info' || page_id % 50 || '@example.com'], case when page_id % 4 = 0 then ['sales@example.org'] else [] end))), ';') as emails from c""")
def page_contacts(spark, sf_dir):
    """Pages followed by some more contacts: in text, twice in other spellings, in links, and in comments, which don't count."""
    k = F.col("page_id")
    text = F.format_string("<!-- 8 900 000-00-00 --><p>call 8 (9%02d) 111-22-33, +7 9%02d 111 22 33, <i>Info%d@Example.com</i> 12345", k % 100, k % 100, k % 50)
    tel = F.when(k % 3 == 0, F.format_string('<a href="tel:+79%02d9998877">t</a>', k % 100)).otherwise("")
    mail = F.when(k % 4 == 0, '<a href="mailto:Sales@example.org?subject=x">m</a>').otherwise("")
    pages = t(spark, sf_dir, "pages").withColumn("html", F.concat(F.col("html"), text, tel, mail))
    found = read.page_contacts(read.parsed_pages(pages, "page_id", "html"), "page_id", "text", "links")
    return found.select("page_id", F.array_join(F.array_sort("phones"), ";").alias("phones"), F.array_join(F.array_sort("emails"), ";").alias("emails"))


@query("select c_custkey, case when c_custkey % 4 = 0 then null else 'n' || c_nationkey end as nation, cast(c_custkey % 7 as varchar) as deep from customer")
def dotted_paths(spark, sf_dir):
    k = F.col("c_custkey")
    document = F.to_json(F.struct(F.struct(F.when(k % 4 != 0, F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).alias("nation"), F.struct((k % 7).alias("c.d")).alias("b")).alias("a")))
    c = t(spark, sf_dir, "customer").select("c_custkey", document.alias("d"))
    return c.select("c_custkey", layers.value_at(F.col("d"), "a.nation").alias("nation"), F.coalesce(layers.value_at(F.col("d"), "a.b.c"), F.get_json_object(F.col("d"), "$.a.b['c.d']")).alias("deep"))


@query("select p_partkey, replace(replace(replace(replace(replace('<' || p_name || '> & \"' || p_brand || '\" ''x''', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') as markup, case when p_partkey % 3 = 0 then 'https://a.example/' || p_partkey end as link from part")
def escaped_markup(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("<"), F.col("p_name"), F.lit('> & "'), F.col("p_brand"), F.lit("\" 'x'"))
    address = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("https://a.example/"), k)).when(F.col("p_partkey") % 3 == 1, "javascript:alert(1)").otherwise("https://")
    return t(spark, sf_dir, "part").select("p_partkey", layers.escaped(text).alias("markup"), layers.safe_link(address).alias("link"))


@query("select n_nationkey, cast(row_number() over (order by coalesce(case when n_nationkey % 3 = 0 then n_nationkey % 5 end, case when n_nationkey % 2 = 0 then 2 end, 0), n_nationkey) as bigint) as place, case when n_nationkey % 4 = 0 or n_nationkey % 9 >= 5 then 0.7 else 0.1 end as opacity, n_nationkey || case when n_nationkey % 10 = 1 and n_nationkey % 100 <> 11 then ' слой' when n_nationkey % 10 in (2, 3, 4) and n_nationkey % 100 not in (12, 13, 14) then ' слоя' else ' слоёв' end as layers from nation")
def layer_drawing(spark, sf_dir):
    k = F.col("n_nationkey")
    specs = t(spark, sf_dir, "nation").select(k, F.when(k % 3 == 0, k % 5).alias("z_index"), F.when(k % 2 == 0, 2).alias("order"), k.alias("position"))
    opacity = layers.fill_opacity(F.lit(5), F.when(k % 4 != 0, k % 9), F.lit(0.7), F.lit(0.1))
    return layers.ordinal(specs, layers.draw_order(), [], "place").select("n_nationkey", F.col("place").cast("bigint").alias("place"), opacity.alias("opacity"), layers.plural(k, "слой", "слоя", "слоёв").alias("layers"))


REVIEW = "select p_partkey, row_number() over (order by p_partkey % 3 = 0, p_size not in (7, 9), p_retailprice desc, p_partkey) as place from part"


@query(f"with r as ({REVIEW}) select p_partkey from r where place <= 300")
def review_queue(spark, sf_dir):
    candidates = F.when(F.col("p_partkey") % 3 != 0, "h1;h2").otherwise("")
    order = review.review_order(candidates, F.col("p_size"), (7, 9), F.col("p_retailprice"), F.col("p_partkey"))
    return t(spark, sf_dir, "part").orderBy(*order).limit(300).select("p_partkey")


@query("select p_partkey, row_number() over (order by not (p_partkey % 5 = 0 or p_partkey % 7 = 0), p_size not in (7, 9), p_retailprice desc, p_partkey) as place from part qualify place <= 1000")
def map_findings(spark, sf_dir):
    k = F.col("p_partkey")
    issues = F.array_compact(F.array(F.when(k % 5 == 0, "storeys_source_conflict"), F.when(k % 7 == 0, "gross_area_source_conflict"), F.lit("address_incomplete")))
    found = review.map_findings(t(spark, sf_dir, "part"), issues, ("storeys_source_conflict", "gross_area_source_conflict"), F.col("p_size"), (7, 9), F.col("p_retailprice"), k)
    return found.select("p_partkey", F.row_number().over(Window.orderBy((~(F.array_contains(issues, "storeys_source_conflict") | F.array_contains(issues, "gross_area_source_conflict"))).asc(), (~F.col("p_size").isin(7, 9)).asc(), F.desc("p_retailprice"), k.asc())).cast("bigint").alias("place"))


@query("select p_partkey as name, p_brand as settlement, ['ambiguous', 'quarantined', 'alias_review'][p_partkey % 5 + 1] as prior_status, 'a' || p_partkey as preferred_candidates, 'a' || p_partkey || ';b' as all_candidates, 'x; y' as official_addresses, false as geometry_verified from part where p_partkey % 5 < 3")
def triage_extract(spark, sf_dir):
    k = F.col("p_partkey")
    state = F.element_at(F.array(*map(F.lit, ("ambiguous", "quarantined", "alias_review", "confirmed", "none"))), (k % 5 + 1).cast("int"))
    own = F.concat(F.lit("a"), k.cast("string"))
    rows = t(spark, sf_dir, "part").select(k.alias("name"), F.col("p_brand").alias("settlement"), state.alias("match_status"), F.array(own).alias("preferred"), F.array(own, F.lit("b")).alias("candidates"), F.array(F.lit("x"), F.lit("y")).alias("addresses"))
    return review.triage(rows)


@query("select p_partkey as name, p_brand as settlement, '[\"e' || p_partkey || '\"]' as program_evidence, cast(null as bigint) as current_residents, 'programme_address_only_no_completion_proof' as status from part where p_partkey % 6 = 0")
def resettlement_extract(spark, sf_dir):
    k = F.col("p_partkey")
    rows = t(spark, sf_dir, "part").select(k.alias("name"), F.col("p_brand").alias("settlement"), F.when(k % 6 == 0, F.array(F.concat(F.lit("e"), k.cast("string")))).otherwise(F.array().cast("array<string>")).alias("evidence"))
    return review.resettlement(rows)


@query("select c_custkey, c_custkey % 4 <> 0 and c_custkey % 50 <> 49 as point, c_custkey % 4 <> 0 and c_custkey % 6 <> 0 as polygon from customer")
def nested_coordinates(spark, sf_dir):
    k = F.col("c_custkey")
    point = F.array(F.when(k % 4 == 0, 181.0).otherwise(10.0), F.when(k % 50 == 49, -90.5).otherwise(-90.0))
    polygon = F.array(F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.when(k % 4 == 0, 200.0).otherwise(180.0), F.lit(5.0))), F.when(k % 6 == 0, F.array().cast("array<array<double>>")).otherwise(F.array(F.array(F.lit(0.0), F.lit(0.0)))))
    c = t(spark, sf_dir, "customer").select("c_custkey", point.alias("p"), polygon.alias("g"))
    return c.select("c_custkey", spatial.valid_coordinates(c, "p").alias("point"), spatial.valid_coordinates(c, "g").alias("polygon"))


@query(f"with {PLACES}, {BOXES} select distinct c_custkey from p, b where x between x0 and x1 and y between y0 and y1")
def covered_by_any(spark, sf_dir):
    polygons = _boxes(spark, sf_dir).withColumn("ring", _ring("x0", "y0", "x1", "y1"))
    return spatial.covered(places(spark, sf_dir), polygons, "c_custkey", "s_suppkey").select("c_custkey")


@query("select s_nationkey as source, array_to_string(list_sort(list('+7900' || lpad(cast(s_suppkey as varchar), 7, '0'))), ';') as phones, array_to_string(list_sort(list(distinct 'm' || s_suppkey % 3 || '@example.org')), ';') as emails, count(*) as websites, array_to_string(list_sort(list(distinct 'https://t.me/u' || s_suppkey % 4)), ';') as links from supplier group by 1")
def website_sources(spark, sf_dir):
    k = F.col("s_suppkey")
    html = F.format_string('<p>Call 8 900 %07d</p><a href="mailto:M%d@Example.org?subject=a">m</a><a href="https://t.me/u%d">t</a><a href="/local">l</a>', k, k % 3, k % 4)
    pages = t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("source"), F.format_string("http://Site%d.example.org//p%d", F.col("s_nationkey"), k).alias("url"), html.alias("html"), F.array(F.format_string("site%d.example.org", F.col("s_nationkey"))).alias("hosts"), F.lit(True).alias("allowed"))
    found = read.website_contacts(pages, "source", "url", "html", "hosts", "allowed")
    return found.select("source", F.array_join("phones", ";").alias("phones"), F.array_join("emails", ";").alias("emails"), F.size("websites").cast("bigint").alias("websites"), F.array_join("links", ";").alias("links"))


@query(f"""select p_partkey, case when k in ('apartments', 'house', 'residential') then 'mixed' when k = 'retail' or p_partkey % 11 = 0 then 'non_residential' end as use, case when k in ('apartments', 'house', 'residential') or k = 'retail' or p_partkey % 11 = 0 then 'reported' else 'unknown' end as use_status, case when p_partkey % 5 > 1 then p_size + 0.5 end as storeys, 'unknown' as apartments_status from (select *, {KIND} as k from part)""")
def reported_observations(spark, sf_dir):
    found = t(spark, sf_dir, "part").select("p_partkey", review.reported_fields(_tags(), F.col("p_partkey").cast("string")).alias("f"))
    return found.select("p_partkey", "f.use.value", "f.use.status", F.col("f.above_ground_storeys.value").cast("double").alias("storeys"), F.col("f.apartments.status").alias("apartments_status")).toDF("p_partkey", "use", "use_status", "storeys", "apartments_status")


@query("""select s_suppkey, 'елка ' || s_suppkey as token, 'артем' || s_suppkey % 9 as locality, 'ленина' as street, (s_suppkey % 50) || 'вк2' as number, 'Горное' as resort, 'лесной' || s_suppkey % 7 as municipality, case s_suppkey % 3 when 0 then 'district' when 1 then 'city' else 'municipal' end as category,
    'находка' as store_locality, 'пограничная' as store_street, (s_suppkey % 40) || 'вк1' as store_number, case when s_suppkey % 4 <> 0 then 'Чугуевка' end as rural, 'A & <B> ' || s_suppkey as markup from supplier""")
def text_identities(spark, sf_dir):
    k = F.col("s_suppkey")
    n = lambda m: (k % m).cast("string")
    category = F.when(k % 3 == 0, "муниципальный район").when(k % 3 == 1, "городской округ").otherwise("")
    m = text.municipality_identity(F.concat(F.lit("Лесной"), n(7), F.lit(" "), category))
    key = text.store_address(F.lit("г. Находка"), F.concat(F.lit("Пограничная ул., дом "), n(40), F.lit("В корпус 1")))
    card = text.rural_card(F.lit("Край"), F.when(k % 4 != 0, F.lit("с. Чугуевка, Титова ул., дом 42")).otherwise("неизвестный адрес"), "Край")
    return t(spark, sf_dir, "supplier").select(
        "s_suppkey", text.token(F.concat(F.lit("  Ёлка  "), k.cast("string"))).alias("token"), text.plain_locality(F.concat(F.lit("г. Артём"), n(9))).alias("locality"), text.plain_street(F.lit("ул. Ленина")).alias("street"), text.plain_number(F.concat(n(50), F.lit(" B K2"))).alias("number"), text.resort_locality(F.lit("Горное  КП")).alias("resort"),
        m["name"].alias("municipality"), m["category"].alias("category"), key["locality"].alias("store_locality"), key["street_name"].alias("store_street"), key["house_number"].alias("store_number"), card["locality"].alias("rural"), text.clean_markup(F.concat(F.lit("<b>A &amp; &lt;B&gt;</b> "), k.cast("string"))).alias("markup"),
    )


@query(f"""with b as (select p_partkey, p_size, {KIND} as kind, p_partkey % 3 <> 0 as street, p_partkey as n from part)
    select p_partkey, case when kind in ('apartments', 'house', 'residential') then 1.0::double when kind = 'retail' then 0.0::double when kind = 'yes' and street then 0.55::double else 0.0::double end as weight,
      case when kind in ('apartments', 'house', 'residential') then 'explicit_residential' when kind = 'retail' then 'excluded_non_residential' when kind = 'yes' and street then 'ambiguous_addressed' else 'excluded_unclassified' end as reason,
      case when kind in ('apartments', 'house', 'residential') then 'mixed_use_requires_residential_area' else '' end as review,
      case when n % 4 = 0 and n > 0 then 'residential_area' when n % 4 = 1 then 'occupied_apartments' when n % 4 = 2 then 'floors' end as method, cast(case when n % 4 = 0 and n > 0 then n when n % 4 = 1 then p_size * 0.5 when n % 4 = 2 then p_size * 10 end as double) as confirmed,
      case when n % 5 = 0 then 'premises_exceed_gross' when n % 5 = 1 then 'residential_exceed_premises;residential_exceed_gross' else '' end as areas, least(18.0, greatest(3.0, 6 + p_size * 0.5))::double as radius, case when p_size >= 40 then 'large' when p_size >= 10 then 'middle' when p_size >= 20 then 'never' else 'small' end as rule,
      case when p_size <= 25 then 17 when p_size <= 40 then 16 else 15 end as zoom, p_size >= 30 as labelled, 'p_size: ' || p_size || ' m' as popup, case when street then 1 else 0 end as address_tags from b""")
def housing_rules(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    none = F.lit(None).cast("double")
    pick = lambda m, v: F.when(k % 4 == m, v).otherwise(none)
    w = housing.confirmed_weight(pick(0, k.cast("double")), pick(1, size.cast("double")), pick(1, F.lit(0.5)), pick(2, size.cast("double")), F.lit(10.0))
    areas = scalars.area_issues(F.lit(100.0), F.when(k % 5 == 0, 102.0).when(k % 5 == 1, 90.0).otherwise(100.5), F.when(k % 5 == 1, 101.5).otherwise(50.0))
    rule = scalars.first_rule(size, ((40, "large"), (10, "middle"), (20, "never"), (0, "small")))
    p = t(spark, sf_dir, "part").withColumn("tags", _tags())
    tags, blank = F.col("tags"), F.lit(None).cast("string")
    address = F.size(F.filter(F.map_values(housing.prefixed(tags, "addr:")), lambda v: v != ""))
    return p.withColumn("empty", blank).select(
        "p_partkey", housing.factor(tags)["weight"].alias("weight"), housing.factor(tags)["reason"].alias("reason"), F.array_join(housing.review_flags(tags), ";").alias("review"), w["method"].alias("method"), w["weight"].alias("confirmed"), F.array_join(areas, ";").alias("areas"),
        scalars.radius(size, 6.0, 0.5, 3, 18).alias("radius"), rule.alias("rule"), scalars.zoom(size * 10 + F.when(size > 40, 200).when(size > 25, 0).otherwise(0)).alias("zoom"), layers.labelled(p, "p_size", 30).alias("labelled"), layers.popup(p.withColumn("empty", blank), ("empty", "p_size"), {"p_size": " m"}).alias("popup"), address.alias("address_tags"),
    )


@query("""with s as (select s_suppkey as k from supplier) select k as s_suppkey, case when k % 7 = 0 then 'ambiguous' when k % 5 = 0 then 'quarantined' when k % 3 = 0 then 'address_candidate' when k % 2 = 0 then 'context_candidate' when k % 11 = 0 then 'alias_review' else 'unmatched' end as status,
    case when k % 5 = 0 then 'conflict_blocked' when k % 11 = 0 then 'alias_requires_independent_identity' when k % 3 = 1 and k % 2 = 1 then 'unique_explicit_candidate_contour_unverified' when k % 3 > 0 then 'candidate_requires_review' else 'no_candidate' end as review,
    array_to_string(list_filter([case when k % 6 > 0 and k % 4 = 0 then 'coordinate_differs_from_saved_html' end, case when k % 6 = 0 then 'not_in_saved_html' end, case when k % 13 = 0 then 'outside_municipal_union' end, case when k % 9 = 0 then 'property_geometry_coordinate_mismatch' end], lambda x: x is not null), ';') as published,
    case when k % 2 = 0 then 'street_type_conflict' when k % 3 = 0 then 'house_number_conflict' end as conflict, case when k % 2 = 0 or k % 3 = 0 then 'quarantined_text_conflict' when k % 5 = 0 then 'ambiguous' when k % 7 = 0 then 'locality_or_alias_review_required' else 'text_consistent_geometry_unverified' end as link from s""")
def match_reviews(spark, sf_dir):
    k = F.col("s_suppkey")
    no = F.lit(False)
    status = housing.match_status(k % 5 == 0, k % 3 == 0, k % 2 == 0, k % 11 == 0, k % 7 == 0)
    prior = F.when(k % 5 == 0, "quarantined").when(k % 11 == 0, "alias_review").otherwise("x")
    review_ = housing.review_status(prior, k % 3, F.when(k % 3 == 1, 1).otherwise(0), k % 2 == 1)
    flags = housing.published_flags(k % 6 != 0, k % 4 != 0, k % 9 != 0, k % 13 != 0)
    place = F.when(k % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("town")))
    street = F.struct(F.when(k % 2 == 0, "lane").otherwise("street").alias("street_type"), F.lit("x").alias("street_name"))
    official = F.struct(F.lit("town").alias("locality"), F.lit("street").alias("street_type"), F.lit("x").alias("street_name"), F.lit("1").alias("house_number"))
    links = housing.link_flags(place, street, F.when((k % 2 != 0) & (k % 3 == 0), "2").otherwise("1"), official, F.when(k % 5 == 0, 2).otherwise(1), F.lit(1), F.lit(100.0), F.lit(100.0), F.lit(1), F.array().cast("array<string>"))
    found = t(spark, sf_dir, "supplier").select("s_suppkey", status.alias("status"), review_.alias("review"), F.array_join(flags, ";").alias("published"), links.alias("links"))
    conflict = F.filter("links", lambda x: x.isin("street_type_conflict", "house_number_conflict"))
    return found.select("s_suppkey", "status", "review", "published", F.get(conflict, F.lit(0)).alias("conflict"), housing.link_status(F.col("links")).alias("link"))


@query("select c_custkey, cast(2500 + (c_custkey * 7919) % 97500 as bigint) as capacity from customer where 7 between case when c_custkey % 3 = 0 then 9 else 0 end and case when c_custkey % 5 = 0 then 6 else 99 end and (c_custkey % 2 = 0 or c_name in ('Customer#000000001', 'Customer#000000007')) and c_name <> 'Customer#000000002'")
def visible_places(spark, sf_dir):
    k = F.col("c_custkey")
    c = t(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.when(k % 3 == 0, 9).alias("min_zoom"), F.when(k % 5 == 0, 6).alias("max_zoom"), F.when(k % 2 == 0, population("c_custkey")).otherwise(0).alias("capacity"), population("c_custkey").alias("p"))
    found = housing.candidate_places(layers.visible(c, 7), ("Customer#000000001", "Customer#000000007"), ("Customer#000000002",))
    return found.select("c_custkey", F.col("p").alias("capacity"))


@query("select c_custkey from customer where exists (select 1 from supplier where s_suppkey % 4 = c_custkey % 4 and s_suppkey % 5 = c_custkey % 5 and s_suppkey % 6 in (c_custkey % 6, (c_custkey + 1) % 6) and s_suppkey % 3 = 0)")
def programme_matches(spark, sf_dir):
    k, m = F.col("c_custkey"), F.col("s_suppkey")
    houses = t(spark, sf_dir, "customer").select("c_custkey", F.array(k % 6, (k + 1) % 6).alias("localities"), (k % 4).alias("street"), (k % 5).alias("number"))
    programme = t(spark, sf_dir, "supplier").where(m % 3 == 0).select((m % 6).alias("locality"), (m % 4).alias("street"), (m % 5).alias("number"))
    return review.programme_matches(houses, programme, "c_custkey")


@query("select c.c_custkey, array_to_string(list_sort(list(s_suppkey)), ';') as partners from customer c join supplier s on c_custkey % 7 = s_suppkey % 7 and c_custkey % 3 = s_suppkey % 3 and c_custkey % 4 = s_suppkey % 4 and s_suppkey % 5 <> 0 where c_custkey % 10 <> 0 group by 1 union all select c_custkey, null from customer c where c_custkey % 10 = 0 or not exists (select 1 from supplier where c_custkey % 7 = s_suppkey % 7 and c_custkey % 3 = s_suppkey % 3 and c_custkey % 4 = s_suppkey % 4 and s_suppkey % 5 <> 0)")
def address_key_partners(spark, sf_dir):
    def key(k, known):
        return F.when(known, F.struct((k % 7).cast("string").alias("locality"), F.lit(None).cast("string").alias("street_type"), (k % 3).cast("string").alias("street_name"), (k % 4).cast("string").alias("house_number")))

    k, m = F.col("c_custkey"), F.col("s_suppkey")
    cards = t(spark, sf_dir, "customer").select("c_custkey", key(k, k % 10 != 0).alias("key"))
    others = t(spark, sf_dir, "supplier").select("s_suppkey", key(m, m % 5 != 0).alias("key"))
    return match.by_address_key(cards, others, "c_custkey", "s_suppkey").select("c_custkey", F.array_join("partners", ";").alias("partners"))


@query("""with r as (select c_custkey as id, 'n' || c_custkey % 40 as name, c_custkey % 2 as category from customer), n as (select 'n' || n_nationkey as name, n_nationkey % 2 as category, n_nationkey as municipality, n_nationkey % 4 = 0 as historical from nation)
    select id as c_custkey, coalesce((select any_value(municipality) from n where n.name = r.name and n.category = r.category), (select any_value(municipality) from n where n.name = r.name and historical)) as municipality from r""")
def municipality_names(spark, sf_dir):
    k, n = F.col("c_custkey"), F.col("n_nationkey")
    rows = t(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("n"), (k % 40).cast("string")).alias("name"), (k % 2).alias("category"))
    names = t(spark, sf_dir, "nation").select(F.concat(F.lit("n"), n.cast("string")).alias("name"), (n % 2).alias("category"), n.alias("municipality"), (n % 4 == 0).alias("historical"))
    return match.municipality_by_name(rows, names, "c_custkey").select("c_custkey", "municipality")


@query("select s_suppkey, s_acctbal as u, s_acctbal * 2 as v, least(s_acctbal, s_acctbal * 2) as low, greatest(s_acctbal, s_acctbal * 2) as high, n_name as cell_name from supplier join nation on s_nationkey = n_nationkey where not (s_suppkey % 3 = 0 and s_nationkey % 2 = 1) and s_nationkey in (select n_nationkey from nation where n_nationkey % 5 <> 0)")
def scenario_cells(spark, sf_dir):
    n = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("cell"), F.col("n_name").alias("cell_name"))
    m = F.col("s_suppkey")
    rows = t(spark, sf_dir, "supplier").where("s_nationkey % 5 <> 0").select("s_suppkey", F.col("s_nationkey").alias("cell"), F.col("s_acctbal").alias("u"), (F.col("s_acctbal") * 2).alias("v"), F.when(m % 3 == 0, "a").otherwise("b").alias("place"), F.when(F.col("s_nationkey") % 2 == 1, "s").otherwise("r").alias("street"))
    alias = review.alias_suggestions(rows, F.col("place"), F.col("street"), (("a", "s"),)).select("s_suppkey")
    kept = rows.join(alias, "s_suppkey", "left_anti")
    return review.scenario_overlay(kept.drop("place", "street"), n, "cell", ("u", "v")).select("s_suppkey", "u", "v", "low", "high", "cell_name")


@query("""with w as (select o_custkey as k, array_agg(distinct case when o_orderkey % 97 = 0 then 'm2' else 'apartments' end) as u from orders group by 1), c as (select o_custkey as k, count(*) as n, sum(o_totalprice) as p from orders group by 1)
    select c.k as o_custkey, len(w.u) = 1 as single, c.k % 13 = 0 as misses_count, c.k % 17 = 0 as misses_density from c join w using (k) where len(w.u) > 1 or c.k % 13 = 0 or c.k % 17 = 0""")
def control_audits(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 97 == 0, "m2").otherwise("apartments").alias("unit"))
    mixed = allocate.single_unit(o, "o_custkey", "unit").select("o_custkey", F.lit(True).alias("mixed"))
    counts = o.groupBy("o_custkey").agg(F.count("*").alias("n"))
    k = F.col("o_custkey")
    wrong = audit.summary_differences(o, counts.withColumn("n", F.col("n") + (k % 13 == 0).cast("int")), "o_custkey").select("o_custkey", F.lit(True).alias("counted"))
    dense = counts.select("o_custkey", F.col("n").alias("people"), F.lit(4.0).alias("area"), (F.col("n") / 4 + F.when(k % 17 == 0, 0.5).otherwise(0)).alias("density"))
    off = audit.density_formula(dense, "people", "area", "density").select("o_custkey", F.lit(True).alias("dense"))
    rows = mixed.join(wrong, "o_custkey", "full_outer").join(off, "o_custkey", "full_outer")
    no = lambda c: F.coalesce(c, F.lit(False))
    return rows.select("o_custkey", (~no("mixed")).alias("single"), no("counted").alias("misses_count"), no("dense").alias("misses_density"))


@query("""with g as (select p_partkey % 50 as g, p_partkey as id, case when p_partkey % 3 = 0 then 0 else 1 end as tags, p_partkey % 4 = 0 as way from part), r as (select *, row_number() over (partition by g order by tags desc, way desc, id) as n from g) select g, id as kept from r where n = 1""")
def preferred_geometry(spark, sf_dir):
    k = F.col("p_partkey")
    tags = F.map_from_arrays(F.array(F.when(k % 3 == 0, "note").otherwise("addr:street")), F.array(F.lit("x")))
    rows = t(spark, sf_dir, "part").select((k % 50).alias("g"), housing.preferred_member(tags, F.when(k % 4 == 0, "way").otherwise("relation"), k).alias("key"))
    return rows.groupBy("g").agg(F.min("key").alias("key")).select("g", F.col("key.id").alias("kept"))


@query("select p_partkey, p_partkey % 4 <> 0 as kept, p_partkey % 4 = 0 and p_partkey % 3 <> 0 as stale, false as missing from part union all select -1, false, true, true")
def building_exclusions(spark, sf_dir):
    k = F.col("p_partkey")
    p = t(spark, sf_dir, "part").select("p_partkey", F.create_map(F.lit("size"), F.col("p_size").cast("string")).alias("tags"))
    listed = p.where(k % 4 == 0).union(spark.createDataFrame([(-1, {"size": "1"})], "p_partkey BIGINT, tags MAP<STRING, STRING>"))
    listed = listed.select("p_partkey", F.when(k % 3 == 1, F.create_map(F.lit("size"), F.lit("old"))).otherwise(F.col("tags")).alias("expected_tags"), F.when(k % 3 != 2, "http://a.example/").alias("source_url"), F.lit("razed").alias("reason"))
    kept, stale = housing.without_excluded(p, listed, "p_partkey", "tags")
    gone = review.missing_ids(p, listed, "p_partkey").select("p_partkey", F.lit(True).alias("missing"))
    every = p.select("p_partkey").union(review.missing_ids(p, listed, "p_partkey"))
    flag = lambda df, n: df.select("p_partkey", F.lit(True).alias(n))
    rows = every.join(flag(review.wanted_rows(kept, every, "p_partkey"), "kept"), "p_partkey", "left").join(flag(stale, "stale"), "p_partkey", "left").join(gone, "p_partkey", "left")
    return rows.select("p_partkey", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("kept", "stale", "missing")))
