"""Sparse grids: accumulation over occupied cells and adaptive coarsening.

Coarsening is unrolled over the spans: nested windows, which share one exchange, sum each cell's ancestors,
and a cell joins the first of them that isn't split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cell(x: Column, size: float) -> Column:
    """Index of the cell of a coordinate, rounding down."""
    return F.floor(x / size).cast("bigint")


def accumulate(df: DataFrame, keys: Sequence[str], sums: Sequence[str], ids: str) -> DataFrame:
    """Sums and distinct buildings of each occupied cell."""
    return df.groupBy(*keys).agg(*(F.sum(s).alias(s) for s in sums), F.count_distinct(ids).alias("buildings"))


def coarsened(df: DataFrame, group: str, maximum: int, minimum: int, sums: Sequence[str], proxy: str = "proxy", buildings: str = "buildings", ids: str | None = None, split_buildings: int = 12, split_density: float = 80_000.0) -> DataFrame:
    """Blocks (``ix``, ``iy``, ``span``) of a quadtree over occupied cells, with sums and buildings.

    A block wider than one cell is split while it has ``split_buildings`` or more, or
    ``split_density`` or more of ``proxy`` a square kilometre. Buildings are distinct ``ids`` (one
    row for each cell and building), or else sums of ``buildings``. ``maximum`` is a power of two
    times ``minimum``, both in metres.
    """
    factor, rest = divmod(maximum, minimum)
    if rest or factor < 1 or factor & (factor - 1):
        raise ValueError("the sizes' ratio must be a power of two")
    spans = [factor >> k for k in range(factor.bit_length())]
    block = lambda c, span: F.floor(F.col(c) / span).cast("bigint")
    for span in spans:
        df = df.withColumns({f"_{c}{span}": block(c, span) for c in ("ix", "iy")})
    own, whole = [group], F.lit(None).cast("int")
    for span in spans[:-1]:  # the windows nest, so that all share the exchange by the coarsest blocks
        own = [*own, f"_ix{span}", f"_iy{span}"]
        if ids:
            df = df.withColumn("_new", F.coalesce(F.lag(ids).over(Window.partitionBy(*own).orderBy(ids)) != F.col(ids), F.lit(True)).cast("bigint"))
        n, total = (F.sum(c).over(Window.partitionBy(*own)) for c in ("_new" if ids else buildings, proxy))
        crowded = (n >= split_buildings) | (total / float((span * minimum / 1000) ** 2) >= split_density)
        df = df.withColumn(f"_crowded{span}", F.coalesce(crowded, F.lit(False)))
    for span in reversed(spans[:-1]):
        whole = F.when(~F.col(f"_crowded{span}"), span).otherwise(whole)
    df = df.withColumn("span", F.coalesce(whole, F.lit(1)))
    at = [(block(c, F.col("span")) * F.col("span")).alias(c) for c in ("ix", "iy")]
    n = F.count_distinct(ids) if ids else F.sum(buildings)
    return df.groupBy(group, *at, "span").agg(*(F.sum(s).alias(s) for s in dict.fromkeys(sums)), n.alias("buildings"))


def visit_order(ix: Column, iy: Column, span: Column, root: int) -> Column:
    """Sort key of the order in which a quadtree is walked: roots by (x, y), quadrants (0,0), (h,0), (0,h), (h,h)."""
    rx, ry = F.floor(ix / root), F.floor(iy / root)
    digits, half = [], root // 2
    while half:
        dx, dy = F.pmod(F.floor(ix / half), F.lit(2)), F.pmod(F.floor(iy / half), F.lit(2))
        digits.append((dx + 2 * dy).cast("int"))
        half //= 2
    return F.struct(rx.alias("x"), ry.alias("y"), F.array(*digits).alias("path") if digits else F.array().cast("array<int>").alias("path"))


def settlement_summary(cells: DataFrame, group: str, population: str, area_km2: str, size: str, buildings: str) -> DataFrame:
    """Cells, buildings, greatest density, area and the sizes of cells of each settlement."""
    return cells.groupBy(group).agg(F.count("*").alias("cells"), F.sum(buildings).alias("buildings"), F.max(F.col(population) / F.col(area_km2)).alias("max_density"), F.sum(area_km2).alias("area_km2"), F.array_sort(F.collect_set(size)).alias("grid_sizes"))
