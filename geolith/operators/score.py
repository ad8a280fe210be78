"""Expansion priority: capacity, distances, score and ladder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolith.functions.scalars import half_even
from geolith.functions.text import label_key
from geolith.operators.housing import confidence


@dataclass(frozen=True)
class Rules:
    """People a store, in the base case and its scenarios; limits of the score."""

    minimum: int = 2500
    base: int = 5000
    low: int = 10_000
    high: int = 2500
    fallback_km: float = 1.0
    below_base_cap: int | None = 59
    longitude_km: float = 80.4
    latitude_km: float = 111.0


def km(x1: Column, y1: Column, x2: Column, y2: Column, rules: Rules) -> Column:
    return F.hypot((x1 - x2) * rules.longitude_km, (y1 - y2) * rules.latitude_km)


def store_distances(places: DataFrame, stores: DataFrame, key: str, rules: Rules) -> DataFrame:
    """``nearest_km`` (999 without stores) and ``within`` the fallback radius for each place.

    Stores are grouped by cells of the radius; a place meets those of its own and neighbouring cells
    for the count. The nearest is found over cells of growing width, so no place meets all stores.
    """
    from geolith.operators.spatial import nearest, pairs_within

    near = pairs_within(places, stores, key, "store_id", rules.fallback_km, rules.longitude_km, rules.latitude_km).groupBy(key).agg(F.count("*").alias("within"))
    best = nearest(places, stores, key, "store_id", rules.longitude_km, rules.latitude_km).select(key, F.col("distance").alias("nearest_km"))
    out = places.join(near, key, "left").join(best, key, "left")
    return out.withColumn("within", F.coalesce("within", F.lit(0))).withColumn("nearest_km", F.coalesce("nearest_km", F.lit(999.0)))


def label_counts(stores: DataFrame, label: str) -> DataFrame:
    """Stores of each place label."""
    return stores.groupBy(label_key(F.col(label)).alias("label")).agg(F.count("*").alias("direct"))


def capacity(population: Column, people: int) -> Column:
    return F.greatest(F.lit(1), F.floor(population / people))


def raw_score(population: Column, existing: Column, conflicts: Column, road_km: Column, confident: Column, rules: Rules) -> Column:
    """The score before rounding and limits."""
    cap = capacity(population, rules.base)
    effective = existing + 0.5 * conflicts
    people = F.least(F.lit(30.0), 30.0 * population / 20000)
    room = 30.0 * F.greatest(F.lit(0.0), cap - effective) / cap
    presence = F.when((existing == 0) & (conflicts == 0), 15).when(existing == 0, 8).otherwise(5)
    road = F.when(road_km <= 1, 15).when(road_km <= 3, 10).when(road_km <= 10, 5).otherwise(0)
    trust = F.when(confident == "high", 10).when(confident == "medium", 7).otherwise(0)
    return F.least(F.lit(100.0), people + room + presence + road + trust)


def limited_score(score: Column, population: Column, existing: Column, confident: Column, rules: Rules) -> Column:
    additional = F.greatest(F.lit(0), capacity(population, rules.base) - existing)
    score = F.when(additional == 0, F.least(score, F.lit(29.0))).otherwise(score)
    score = F.when(confident == "low", F.least(score, F.lit(49.0))).otherwise(score)
    if rules.below_base_cap is not None:
        score = F.when(population < rules.base, F.least(score, F.lit(float(rules.below_base_cap)))).otherwise(score)
    return score


def ladder(score: Column, confident: Column) -> Column:
    return F.when(score >= 80, "very high").when(score >= 65, "high").when(score >= 50, "medium").when(confident == "low", "needs population check").when(score >= 30, "low").otherwise("capacity exhausted")


def priority(places: DataFrame, rules: Rules = Rules(), exact_rounding: bool = True) -> DataFrame:  # noqa: B008
    """Candidates with capacities, score and ladder, ranked. ``places`` has population, population_quality, direct, within, conflicts, nearest_km, road_km, name."""
    p = places.where(F.col("population") >= rules.minimum).withColumn("confidence", confidence(F.col("population_quality")))
    p = p.withColumn("existing", F.when(F.coalesce("direct", F.lit(0)) > 0, F.col("direct")).otherwise(F.col("within")).cast("bigint"))
    for name, people in (("additional", rules.base), ("additional_low", rules.low), ("additional_high", rules.high)):
        p = p.withColumn(name, F.greatest(F.lit(0), capacity(F.col("population"), people) - F.col("existing")).cast("bigint"))
    raw = raw_score(F.col("population"), F.col("existing"), F.col("conflicts"), F.col("road_km"), F.col("confidence"), rules)
    rounded = half_even(raw, F.lit(0)) if exact_rounding else F.bround(raw, 0)
    p = p.withColumn("score", limited_score(rounded, F.col("population"), F.col("existing"), F.col("confidence"), rules).cast("bigint"))
    return p.withColumn("priority", ladder(F.col("score"), F.col("confidence"))).orderBy(F.desc("score"), F.desc("population"), "name")
