"""Numbers, rules, bins and reported values as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def number(text: Column) -> Column:
    """Numeric text with spaces and a decimal comma; null if empty or not numeric."""
    return F.nullif(F.replace(F.regexp_replace(text.cast("string"), r"(?U)\s+", ""), F.lit(","), F.lit(".")), F.lit("")).try_cast("double")


def positive(text: Column, integer: bool = False, maximum: float | None = None) -> Column:
    """A finite number over 0, whole and bounded if asked for; else null."""
    value = F.btrim(F.replace(text.cast("string"), F.lit(","), F.lit("."))).try_cast("double")
    fits = finite(value) & (value > 0)
    if integer:
        fits = fits & (value == F.floor(value))
    if maximum is not None:
        fits = fits & (value <= maximum)
    return F.when(fits, value)


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


@F.pandas_udf(T.DoubleType())
def half_even(value: pd.Series, digits: pd.Series) -> pd.Series:
    """Rounding half to even of the binary value, which no SQL function gives."""
    return pd.Series([None if pd.isna(v) else round(v, int(d)) for v, d in zip(value, digits, strict=True)], dtype="float64")


def floor_div(a: Column, b: Column | int) -> Column:
    """Division that rounds down, for negative numbers too."""
    return F.floor(a / b)


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, value))


def first_rule(value: Column, rules: Sequence[tuple[float, object]]) -> Column:
    """The result of the first rule, in the order given, whose minimum the value reaches."""
    out = None
    for least, result in rules:
        out = F.when(value >= least, F.lit(result)) if out is None else out.when(value >= least, F.lit(result))
    return out


def bin_of(value: Column, bins: Sequence[tuple[float | None, object]]) -> Column:
    """The first bin whose upper limit, itself outside, is above the value; a null value counts as 0."""
    number_, out = F.coalesce(value, F.lit(0.0)), None
    for limit, result in bins:
        fits = F.lit(True) if limit is None else number_ < limit
        out = F.when(fits, F.lit(result)) if out is None else out.when(fits, F.lit(result))
    return out


def category_of(value: Column, categories: Mapping[str, object]) -> Column:
    out = F.lit(None)
    for name, result in categories.items():
        out = F.when(value.cast("string") == name, F.lit(result)).otherwise(out)
    return out


def colour(category: Column, bin_: Column, style: Column, index: Column, palette: Sequence[str]) -> Column:
    """The colour of a category, else of a bin, else of the style, else the palette's next."""
    return F.coalesce(category, bin_, style, F.element_at(F.array(*map(F.lit, palette)), (index % len(palette)).cast("int") + 1))


def radius(value: Column, base: float, scale: float, low: float, high: float) -> Column:
    return clamp(base + value * scale, F.lit(float(low)), F.lit(float(high)))


def reconciled(values: Column) -> Column:
    """Struct of value and status: unknown for none, reported for one distinct value, conflicting and null for more."""
    distinct = F.array_distinct(values)
    status = F.when(F.size(values) == 0, "unknown").when(F.size(distinct) == 1, "reported").otherwise("conflicting")
    return F.struct(F.when(F.size(distinct) == 1, F.get(distinct, F.lit(0))).alias("value"), status.alias("status"))


def area_issues(gross: Column, premises: Column, residential: Column, tolerance: float = 0.01) -> Column:
    """Names of areas that exceed the ones that contain them by more than the tolerance."""
    over = lambda part, whole, name: F.when(part > whole * (1 + tolerance), name)
    return F.array_compact(F.array(over(premises, gross, "premises_exceed_gross"), over(residential, premises, "residential_exceed_premises"), over(residential, gross, "residential_exceed_gross")))


def known_population(population: Column, quality: Column) -> Column:
    """Null, never 0, where no population is available."""
    return F.when(quality != "not_available", population)


def zoom(grid: Column) -> Column:
    return F.when(grid <= 250, 17).when(grid <= 500, 16).otherwise(15)


def strata_hash(salt: str, name: Column) -> Column:
    return F.sha2(F.concat(F.lit(salt), name.cast("string")), 256)
