"""Queries of scans over the shared tables: orders are the rows of ten sheets, customers tagged objects."""

from __future__ import annotations

from pyspark.sql import functions as F

from geolith.operators.spatial import ring_area
from geolith.plans.catalog import query, t
from geolith.sources import osm, sheets

SHEET = """r as (select o_custkey % 10 as file, o_orderkey as "row",
      case when o_orderkey % 211 = 1 then 'R' when o_orderkey % 31 = 0 then 'N' || o_orderkey || ' Муниципальный округ' when o_orderkey % 7 = 0 then 'г  T' || o_orderkey else 'others' end as name,
      case when o_orderkey % 31 = 0 and o_orderkey % 211 <> 1 then '05 70' || lpad(cast(o_orderkey % 1000000 as varchar), 6, '0') when o_custkey % 10 > 2 and o_orderkey % 4001 = 0 then '1100000000' else '05700000000' end as code,
      case when o_orderkey % 11 = 0 then 'n/a' else cast(o_orderkey % 5000 as varchar) end as population from orders)"""


@query(f"""with {SHEET}, s as (select *, replace(code, ' ', '') as c, coalesce(bool_or(name = 'R') over (partition by file order by "row"), false) as seen from r),
    o as (select *, coalesce(bool_or(seen and length(c) = 10 and c not like '05%') over (partition by file order by "row"), false) as over from s),
    k as (select *, case when length(c) = 10 and name like '%Муниципальный округ' then name end as own from o where seen and not over and name <> 'R' and regexp_full_match(population, '[0-9]+')),
    m as (select *, last_value(own ignore nulls) over (partition by file order by "row" rows between unbounded preceding and current row) as municipality from k)
    select file, "row", c as code, cast(population as bigint) as population, municipality, own is not null as is_municipality, case when length(c) >= 11 and name like 'г  %' then substr(name, 4) end as town from m""")
def municipal_rows(spark, sf_dir):
    """A region's part of each sheet, with the municipality above each town."""
    k = F.col("o_orderkey")
    name = F.when(k % 211 == 1, "R").when(k % 31 == 0, F.concat(F.lit("N"), k, F.lit(" Муниципальный округ"))).when(k % 7 == 0, F.concat(F.lit("г  T"), k)).otherwise("others")
    code = F.when((k % 31 == 0) & (k % 211 != 1), F.concat(F.lit("05 70"), F.lpad((k % 1000000).cast("string"), 6, "0"))).when((F.col("o_custkey") % 10 > 2) & (k % 4001 == 0), "1100000000").otherwise("05700000000")
    rows = t(spark, sf_dir, "orders").select((F.col("o_custkey") % 10).alias("file"), k.alias("row"), name.alias("name"), code.alias("code"), F.when(k % 11 == 0, "n/a").otherwise((k % 5000).cast("string")).alias("population"))
    return sheets.municipal_table(rows, "R", "05").drop("name")


@query("""with c as (select c_custkey, 0.25::double + c_custkey % 3 * 0.125::double as w from customer)
    select case c_custkey % 3 when 0 then 'way' when 1 then 'relation' else 'open' end as kind, count(*) as areas, case when any_value(c_custkey % 3) < 2 then round(sum(w * w), 6) end as area from c group by 1""")
def osm_areas(spark, sf_dir):
    """Customers as squares of tagged nodes and ways: closed ways, relations of two ways that meet, and relations that stay open."""
    k = F.col("c_custkey")
    c = t(spark, sf_dir, "customer").select("c_custkey", (0.25 + k % 3 * 0.125).alias("w"))
    none = lambda kind: F.lit(None).cast(kind)
    row = lambda kind, name, lon, lat, tags, refs, members: [F.lit(kind).alias("osm_type"), name.cast("bigint").alias("osm_id"), lon.cast("double").alias("lon"), lat.cast("double").alias("lat"), tags.alias("tags"), refs.alias("refs"), members.alias("members")]
    no_tags, no_refs, no_members = F.create_map().cast("map<string, string>"), none("array<bigint>"), none("array<struct<type: string, ref: bigint, role: string>>")
    at = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(x).alias("x"), F.lit(y).alias("y")) for i, (x, y) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)]))))
    nodes = c.withColumn("p", at).select(*row("node", 4 * k + F.col("p.i"), k % 300 / 2.0 + F.col("p.x") * F.col("w"), F.floor(k / 300) / 2.0 + F.col("p.y") * F.col("w"), no_tags, no_refs, no_members))
    corner = lambda *n: F.array(*((4 * k + i).cast("bigint") for i in n))
    building = F.create_map(F.lit("building"), F.lit("yes"))
    closed = c.where("c_custkey % 3 = 0").select(*row("way", 2 * k, none("double"), none("double"), building, corner(0, 1, 2, 3, 0), no_members))
    halves = [c.where("c_custkey % 3 <> 0").select(*row("way", 2 * k + i, none("double"), none("double"), no_tags, corner(*n), no_members)) for i, n in ((0, (0, 1, 2)), (1, (0, 3, 2)))]
    member = lambda i: F.struct(F.lit("way").alias("type"), (2 * k + i).cast("bigint").alias("ref"), F.lit("outer").alias("role"))
    kind = F.create_map(F.lit("type"), F.lit("multipolygon"), F.lit("building"), F.lit("yes"))
    whole = c.where("c_custkey % 3 = 1").select(*row("relation", k, none("double"), none("double"), kind, no_refs, F.array(member(0), member(1))))
    broken = c.where("c_custkey % 3 = 2").select(*row("relation", k, none("double"), none("double"), kind, no_refs, F.array(member(0))))
    objects = nodes.union(closed).union(halves[0]).union(halves[1]).union(whole).union(broken)
    found = osm.areas(objects, "building").withColumn("kind", F.when(F.col("ring").isNull(), "open").otherwise(F.col("osm_type")))
    return found.groupBy("kind").agg(F.count("*").alias("areas"), F.round(F.sum(F.when(F.col("ring").isNotNull(), ring_area("ring"))), 6).alias("area"))
