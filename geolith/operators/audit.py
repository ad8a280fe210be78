"""Contracts of layers and audits of published tables: each returns its violations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolith.functions.scalars import finite


@dataclass(frozen=True)
class Contract:
    """What a layer's rows must hold."""

    required: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    geometry_types: tuple[str, ...] = ()
    geometry_type: str | None = None
    lon: str | None = None
    lat: str | None = None


def violations(df: DataFrame, contract: Contract) -> DataFrame:
    """(rule, n) of each broken rule with the number of rows; one pass over the table, and one more aggregation for uniqueness."""
    rules: dict[str, Column] = {}
    for c in contract.required:
        rules[f"required:{c}"] = F.col(c).isNull() | (F.col(c).cast("string") == "")
    for c in contract.numeric:
        rules[f"numeric:{c}"] = F.col(c).isNotNull() & ~finite(F.col(c).cast("string").try_cast("double"))
    if contract.geometry_type:
        rules["geometry_type"] = ~F.coalesce(F.col(contract.geometry_type).isin(*contract.geometry_types), F.lit(False))
    if contract.lon:
        rules["coordinates"] = ~F.coalesce(F.col(contract.lon).between(-180, 180) & F.col(contract.lat).between(-90, 90), F.lit(False))
    rows = df.agg(*(F.count_if(v).alias(k) for k, v in rules.items())) if rules else None
    out = None
    if rows is not None:
        pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(f"`{k}`").alias("n")) for k in rules)))
        out = rows.select(pairs.alias("r")).select("r.rule", "r.n")
    if contract.unique:
        again = df.groupBy(*contract.unique).agg(F.count("*").alias("m")).where("m > 1").agg(F.coalesce(F.sum(F.col("m") - 1), F.lit(0)).cast("bigint").alias("n"))
        again = again.select(F.lit("unique:" + ",".join(contract.unique)).alias("rule"), "n")
        out = again if out is None else out.union(again)
    return out.where("n > 0")


def normalised(df: DataFrame, properties: dict[str, Column], constants: dict[str, object] | None = None, required: Sequence[str] = (), unique_by: Sequence[str] = (), order: str | None = None) -> DataFrame:
    """Declared columns and constants, rows with all required values, the first of each key (trimmed, caseless) in input order."""
    out = df.select(*(c.alias(n) for n, c in properties.items()), *(F.lit(v).alias(n) for n, v in (constants or {}).items()), *([F.col(order).alias("_order")] if order else []))
    for c in required:
        out = out.where(F.col(c).isNotNull() & (F.col(c).cast("string") != ""))
    if unique_by:
        keys = [F.lower(F.btrim(F.coalesce(F.col(c).cast("string"), F.lit("")))).alias(f"_k{i}") for i, c in enumerate(unique_by)]
        rest = F.struct(*([F.col("_order")] if order else []), *(c for c in out.columns if c != "_order"))
        out = out.groupBy(*keys).agg(F.min(rest).alias("r")).select("r.*")
    return out.drop("_order")


def counts_against(tables: dict[str, DataFrame], expected: dict[str, int]) -> list[tuple[str, int | None, int | None]]:
    """(layer, expected, found) of layers whose counts differ; a handful of numbers."""
    found = {name: df.count() for name, df in tables.items()}
    return [(n, expected.get(n), found.get(n)) for n in sorted({*expected, *found}) if expected.get(n) != found.get(n)]


def density_formula(cells: DataFrame, population: str, area_km2: str, density: str, tolerance: float = 1e-5) -> DataFrame:
    """Cells whose density is not population over area."""
    return cells.where(F.abs(F.col(population) / F.col(area_km2) - F.col(density)) > tolerance)


def reconciled(cells: DataFrame, controls: DataFrame, key: str, value: str, control: str, tolerance: float = 1e-6) -> DataFrame:
    """Controls that the cells' sums miss, and cells without a control."""
    sums = cells.groupBy(key).agg(F.sum(value).alias("found"))
    rows = sums.join(controls.select(key, F.col(control).alias("expected")), key, "full_outer")
    return rows.where(F.col("found").isNull() | F.col("expected").isNull() | (F.abs(F.col("found") - F.col("expected")) > tolerance))


def key_differences(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys in one table only, with the side that lacks them."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    return x.join(y, list(keys), "left_anti").withColumn("side", F.lit("missing")).union(y.join(x, list(keys), "left_anti").withColumn("side", F.lit("unexpected")))


def summary_differences(rows: DataFrame, summary: DataFrame, group: str, count: str = "n") -> DataFrame:
    """Groups whose published count is not the recounted one."""
    again = rows.groupBy(group).agg(F.count("*").alias("_again"))
    return again.join(summary.select(group, F.col(count).alias("_published")), group, "full_outer").where(~F.col("_again").eqNullSafe(F.col("_published")))


def flag_counts(df: DataFrame, flags: str) -> DataFrame:
    return df.select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def coverage_pivot(df: DataFrame, group: str, status: str, values: Sequence[str]) -> DataFrame:
    """Rows of each status in each group, 0 where there are none; the statuses are given, so nothing is scanned for them."""
    return df.groupBy(group).agg(*(F.count_if(F.col(status) == v).alias(v) for v in values))


def count_changes(old: DataFrame, new: DataFrame, group: str) -> DataFrame:
    o, n = old.groupBy(group).agg(F.count("*").alias("old")), new.groupBy(group).agg(F.count("*").alias("new"))
    out = o.join(n, group, "full_outer").select(group, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("old", "new")))
    return out.withColumn("change", F.col("new") - F.col("old"))
