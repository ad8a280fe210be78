"""Reviewed facts and their joins: registers, address candidates, protected cells, overlays."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolith.functions.geo import geodesic_m
from geolith.operators import match
from geolith.operators.spatial import nearest, overlapping_boxes, pairs_within
from geolith.operators.tables import Stored

#: The states of a reviewed value, and the fields that may override a model.
STATUSES = ("unknown", "reported", "conflicting", "confirmed")
FIELDS = ("use", "above_ground_storeys", "residential_premises_area_m2", "apartments")


def register_errors(rows: DataFrame) -> DataFrame:
    """(name, field, error) of register entries that break the rules; no rows means that the register may be compiled.

    ``rows`` has name, field, status, value, reviewer, reviewed_at, sources (array), match_status.
    """
    confirmed = F.col("status") == "confirmed"
    rules = {
        "unknown_field": ~F.col("field").isin(*FIELDS),
        "unknown_status": ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)),
        "confirmed_without_value": confirmed & F.col("value").isNull(),
        "confirmed_without_reviewer": confirmed & ((F.coalesce("reviewer", F.lit("")) == "") | (F.coalesce("reviewed_at", F.lit("")) == "")),
        "confirmed_without_source": confirmed & (F.coalesce(F.size("sources"), F.lit(0)) <= 0),
        "unknown_with_value": (F.col("status") == "unknown") & F.col("value").isNotNull(),
    }
    found = F.explode(F.array_compact(F.array(*(F.when(v, k) for k, v in rules.items()))))
    return rows.select("name", "field", found.alias("error"))


def compiled_register(rows: DataFrame) -> DataFrame:
    """One row per contour whose match is confirmed, with its confirmed values; all others stay out."""
    kept = rows.where((F.col("match_status") == "confirmed") & (F.col("status") == "confirmed"))
    return kept.groupBy("name").agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in FIELDS))


def locality_candidates(addresses: DataFrame, register: DataFrame, address_id: str, house_id: str) -> DataFrame:
    """(address id, house id) by any of an address's localities, its street and number, in its municipality where that is known."""
    a = addresses.select(address_id, F.explode("localities").alias("locality"), "street", "number", "municipality")

    def join(left: DataFrame, right: DataFrame) -> DataFrame:
        rows = left.withColumnRenamed("municipality", "_own").join(right.withColumnRenamed("municipality", "_theirs"), ["locality", "street", "number"])
        return rows.where(F.col("_own").isNull() | (F.col("_own") == F.col("_theirs"))).select("_a", "_b")

    keys = ["locality", "street", "number", "municipality"]
    return match.linked(match.key_sets(a, address_id, keys), match.key_sets(register, house_id, keys), join).select(address_id, house_id)


def programme_matches(houses: DataFrame, programme: DataFrame, house_id: str) -> DataFrame:
    """Houses whose address, under any of their localities, is in a programme."""
    keys = houses.select(house_id, F.explode("localities").alias("locality"), "street", "number")
    return keys.join(programme.select("locality", "street", "number"), ["locality", "street", "number"], "left_semi").select(house_id).distinct()


def least_km(left: DataFrame, right: DataFrame) -> tuple[float, float]:
    """Kilometres per degree of longitude and latitude that no two of the points are nearer by; longitudes span 180 degrees at most."""
    both = left.select("x", "y").union(right.select("x", "y"))
    top, wide, high = both.agg(F.max(F.abs("y")), F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    chord = lambda degrees: (lambda half: math.sin(half) / half if half else 1.0)(math.radians(min(180.0, degrees or 0.0)) / 2)
    degree = 0.993 * math.radians(6371.0)  # below the least radius of curvature
    return degree * math.cos(math.radians(min(89.9, top or 0.0))) * chord(wide), degree * chord(high)


def nearest_on_ellipsoid(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """The nearest right point by geodesic metres, ties to the least id; ``x`` and ``y`` are longitude and latitude.

    A plane in which no distance is longer than on the ellipsoid gives a first partner; all points that are
    in the plane within the geodesic distance of this partner are measured. Longitudes don't wrap and span 180 degrees at most.
    """
    stored = Stored(left.sparkSession)
    kx, ky = least_km(left, right)
    at = lambda df, n, p: df.select(F.col(n), F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y"))
    metres = geodesic_m("ax", "ay", "bx", "by").alias("metres")
    first = nearest(left, right, left_id, right_id, kx, ky).select(left_id, right_id)
    first = first.join(at(left, left_id, "a"), left_id).join(at(right, right_id, "b"), right_id).select(left_id, right_id, metres)
    first = stored(first.withColumn("_ring", F.ceil(F.log2(F.greatest(F.col("metres") / 1000, F.lit(0.001)))).cast("int")))
    out = first.select(left_id, right_id)
    for (ring,) in first.select("_ring").distinct().collect():  # distances in powers of two: a few dozen at most
        some = left.join(first.where(F.col("_ring") == ring).select(left_id, "metres"), left_id)
        pairs = pairs_within(some, right, left_id, right_id, 2.0**ring, kx, ky).join(first.select(left_id, "metres"), left_id)
        out = out.union(pairs.where(F.col("distance") * 1000 <= F.col("metres")).select(left_id, right_id))
    rows = out.distinct().join(at(left, left_id, "a"), left_id).join(at(right, right_id, "b"), right_id)
    best = rows.withColumn("metres", metres).groupBy(left_id).agg(F.min(F.struct("metres", right_id)).alias("b"))
    return best.select(left_id, f"b.{right_id}", "b.metres")


def unprotected(cells: DataFrame, protected: DataFrame, cell_id: str, size: float = 1000.0) -> DataFrame:
    """Cells (boxes) that share no area with a protected box."""
    prefixed = lambda df, n, p: df.select(F.concat(F.lit(p), F.col(n).cast("string")).alias("k"), "x0", "y0", "x1", "y1")
    both = prefixed(cells, cell_id, "b:").union(prefixed(protected, protected.columns[0], "a:"))
    hit = overlapping_boxes(both, "k", size).where(F.col("a").startswith("a:") & F.col("b").startswith("b:")).select("b").distinct()
    return cells.join(hit, F.concat(F.lit("b:"), F.col(cell_id).cast("string")) == F.col("b"), "left_anti")


def overlaps_by_owner(pairs: DataFrame, owners: DataFrame, name: str, owner: str) -> DataFrame:
    """Common area and number of overlapping pairs of each unordered pair of owners."""
    o = owners.select(F.col(name), F.col(owner))
    rows = pairs.join(o.toDF("a", "_oa"), "a").join(o.toDF("b", "_ob"), "b")
    return rows.groupBy(F.least("_oa", "_ob").alias("first"), F.greatest("_oa", "_ob").alias("second")).agg(F.count("*").alias("pairs"), F.sum("area").alias("area"))


def alias_suggestions(rejected: DataFrame, locality: Column, street: Column, aliases: Sequence[tuple[str, str]]) -> DataFrame:
    """Rejected links whose official address is one of the special (locality, street) aliases."""
    keep = F.lit(False)
    for place, name in aliases:
        keep = keep | ((locality == place) & (street == name))
    return rejected.where(keep)


def scenario_overlay(scenarios: DataFrame, cells: DataFrame, cell_id: str, values: Sequence[str]) -> DataFrame:
    """Scenarios with their cell's columns and the range of their values; a scenario without a cell is an error."""
    low, high = (F.least(*values), F.greatest(*values)) if len(values) > 1 else (F.col(values[0]), F.col(values[0]))
    rows = scenarios.join(cells.withColumn("_known", F.lit(True)), cell_id, "left")
    checked = F.when(F.col("_known"), F.col(cell_id)).otherwise(F.raise_error(F.concat(F.lit("no such cell: "), F.col(cell_id).cast("string"))))
    return rows.withColumn(cell_id, checked).withColumn("low", low).withColumn("high", high).drop("_known")


def missing_ids(df: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """Wanted ids that have no row; none means that a semi-join by them is complete."""
    return wanted.select(name).distinct().join(df.select(name), name, "left_anti")


def wanted_rows(df: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    return df.join(wanted.select(name), name, "left_semi")


def review_order(candidates: Column, settlement: Column, targets: Sequence[str], area: Column, name: Column) -> list[Column]:
    """Rows with candidates first, then those of target settlements, large before small, then by id."""
    return [(F.coalesce(candidates, F.lit("")) == "").asc(), (~F.coalesce(settlement.isin(*targets), F.lit(False))).asc(), area.desc(), name.asc()]


def map_findings(df: DataFrame, issues: Column, conflicts: Sequence[str], settlement: Column, targets: Sequence[str], area: Column, name: Column, most: int = 1000) -> DataFrame:
    """The first findings for a map: rows with a conflict first, then as in a review."""
    none = F.lit(True)
    for issue in conflicts:
        none = none & ~F.coalesce(F.array_contains(issues, issue), F.lit(False))
    return df.orderBy(none.asc(), (~F.coalesce(settlement.isin(*targets), F.lit(False))).asc(), area.desc(), name.asc()).limit(most)


def triage(records: DataFrame, states: Sequence[str] = ("ambiguous", "quarantined", "alias_review")) -> DataFrame:
    """Records whose match has to be looked at, their candidates (arrays) as text; nothing in them is verified."""
    rows = records.where(F.col("match_status").isin(*states))
    return rows.select("name", F.col("settlement"), F.col("match_status").alias("prior_status"), F.array_join("preferred", ";").alias("preferred_candidates"), F.array_join("candidates", ";").alias("all_candidates"), F.array_join("addresses", "; ").alias("official_addresses"), F.lit(False).alias("geometry_verified"))


def resettlement(records: DataFrame) -> DataFrame:
    """Records in a programme: its evidence proves no completion, so who lives there stays unknown."""
    return records.where(F.size("evidence") > 0).select("name", "settlement", F.to_json("evidence").alias("program_evidence"), occupancy().alias("current_residents"), F.lit("programme_address_only_no_completion_proof").alias("status"))


def occupancy(*counts: Column) -> Column:
    """Occupied dwellings by counts of linked records: always unknown, as a record is no resident and none is no vacancy."""
    return F.lit(None).cast("bigint")


def reported_fields(tags: Column, name: Column) -> Column:
    """What tags report of a contour: use, storeys and apartments as (status, value, locator); premises are never reported."""
    from geolith.functions.scalars import positive
    from geolith.operators.housing import reported_use

    entry = lambda value, place: F.struct(F.when(value.isNull(), "unknown").otherwise("reported").alias("status"), value.cast("string").alias("value"), F.when(value.isNotNull(), F.concat(name, F.lit(": "), place)).alias("locator"))
    tag = lambda key: F.concat(F.lit(f"{key}="), F.coalesce(tags[key], F.lit("")))
    number = lambda key: positive(tags[key])
    return F.struct(
        entry(reported_use(tags), F.concat_ws(", ", tag("building"), tag("amenity"), tag("shop"))).alias("use"), entry(number("building:levels"), tag("building:levels")).alias("above_ground_storeys"),
        entry(F.lit(None).cast("double"), F.lit("")).alias("residential_premises_area_m2"), entry(number("building:flats"), tag("building:flats")).alias("apartments"),
    )
