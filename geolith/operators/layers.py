"""Queries of a layer as one plan: visibility, style, table, related layers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geolith.functions.scalars import bin_of, category_of, colour

#: The palette of layers without a style.
PALETTE = ("#2563eb", "#dc2626", "#16a34a", "#d97706", "#7c3aed", "#0891b2", "#be185d", "#4d7c0f")


@dataclass(frozen=True)
class TableSpec:
    """A layer's table: what is shown, above which value of a column, in which order."""

    columns: tuple[str, ...]
    filter_field: str | None = None
    filter_min: float = 0.0
    sort: tuple[tuple[str, str], ...] = ()
    limit: int | None = None
    tie: str | None = None
    text_columns: tuple[str, ...] = field(default=())


def sort_keys(spec: TableSpec) -> list[Column]:
    """Descending unless exactly ``asc``; text by the rules of the language."""
    keys = [F.collate(F.col(c), "ru") if c in spec.text_columns else F.col(c) for c, _ in spec.sort]
    out = [k.asc() if how == "asc" else k.desc() for k, (_, how) in zip(keys, spec.sort, strict=True)]
    return [*out, F.col(spec.tie).asc()] if spec.tie else out


def layer_table(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Rows strictly above the minimum, where a missing value counts as 0, sorted and cut to the limit."""
    if spec.filter_field:
        df = df.where(F.coalesce(F.col(spec.filter_field), F.lit(0)) > spec.filter_min)
    if spec.sort:
        df = df.orderBy(*sort_keys(spec))
    if spec.limit is not None:
        df = df.limit(spec.limit)
    return df.select(*spec.columns)


def ordinal(df: DataFrame, order: Sequence[Column], group: Sequence[str], name: str = "n") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def styled(df: DataFrame, value: str, category: str, bins: Sequence[tuple[float | None, str]], categories: dict[str, str], style: str | None, index: int, palette: Sequence[str] = PALETTE) -> DataFrame:
    by_category, by_bin = category_of(F.col(category), categories), bin_of(F.col(value).cast("double"), bins)
    return df.withColumn("colour", colour(by_category, by_bin, F.lit(style).cast("string"), F.lit(index), palette))


def visible(df: DataFrame, zoom: int, low: str = "min_zoom", high: str = "max_zoom") -> DataFrame:
    return df.where(F.lit(zoom).between(F.coalesce(F.col(low), F.lit(0)), F.coalesce(F.col(high), F.lit(99))))


def popup(df: DataFrame, fields: Sequence[str], suffix: dict[str, str] | None = None) -> Column:
    """Lines ``name: value`` of the first twelve fields that are neither null nor empty."""
    line = lambda c: F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"), F.lit((suffix or {}).get(c, ""))))
    return F.array_join(F.array_compact(F.array(*(line(c) for c in fields[:12]))), "\n")


def labelled(df: DataFrame, value: str, least: float) -> Column:
    return F.col(value) >= least


def related(df: DataFrame, other: DataFrame, key: str, other_key: str, value: str, threshold: float) -> DataFrame:
    """Rows with a row of the other layer that has the same key, in any case, and a value over the threshold."""
    keys = other.where(F.col(value) > threshold).select(F.lower(F.col(other_key)).alias("_k"))
    return df.join(keys, F.lower(F.col(key)) == F.col("_k"), "left_semi")


def related_box(df: DataFrame, other: DataFrame, key: str, other_key: str) -> DataFrame:
    """The box of each row's related points."""
    points = other.groupBy(F.lower(F.col(other_key)).alias("_k")).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    return df.join(points, F.lower(F.col(key)) == F.col("_k")).drop("_k")


def map_link(lon: Column, lat: Column, zoom: Column) -> Column:
    return F.format_string("%.6f,%.6f,%d", lon, lat, zoom.cast("int"))


def legend(specs: Sequence[dict]) -> list[dict]:
    """Layers' legends without repeated (value field, bins)."""
    seen, out = set(), []
    for s in specs:
        mark = (s.get("value_field"), str(s.get("bins")))
        if mark not in seen:
            seen.add(mark)
            out.append(s)
    return out


def draw_order() -> list[Column]:
    """Layers from the bottom up: by ``z_index``, or else ``order``, or else 0; ties by the order of declaration, ``position``."""
    return [F.coalesce("z_index", "order", F.lit(0)).cast("double").asc(), F.col("position").asc()]


def fill_opacity(zoom: Column, most: Column, opacity: Column, above: Column) -> Column:
    """Opacity of an area: its own up to a zoom, then another; without a limit always its own."""
    return F.when(most.isNull() | (zoom <= most), F.coalesce(opacity, F.lit(0.55))).otherwise(F.coalesce(above, F.lit(0.0)))


def value_at(document: Column, path: str) -> Column:
    """The value at a dotted path of a JSON object, as text; null where a part is missing."""
    return F.get_json_object(document, "$" + "".join(f"['{part}']" for part in path.split(".")))


def escaped(text: Column) -> Column:
    """Text for markup."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for character, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(character), F.lit(entity))
    return out


def safe_link(address: Column) -> Column:
    """An address that may be followed: of the schemes http and https only; else null."""
    return F.when(address.rlike(r"^(?i)https?://[^\s/?#]"), address)


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """A count with its noun: 1, 21 one; 2 to 4, 22 few; 5 to 20, 25 many."""
    last, two = F.abs(n) % 10, F.abs(n) % 100
    noun = F.when((last == 1) & (two != 11), one).when(last.between(2, 4) & ~two.between(12, 14), few).otherwise(many)
    return F.concat(n.cast("string"), F.lit(" "), noun)


def cooled_down(last: Column, now: Column, seconds: int) -> Column:
    """Whether so many seconds have passed since an ISO timestamp; also if there is none."""
    return last.isNull() | (F.unix_timestamp(F.to_timestamp(now)) - F.unix_timestamp(F.to_timestamp(last)) >= seconds)
