"""Allocation of control totals, scenarios and their distance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geolith.operators.tables import Stored, small

#: Rows of a control whose keys are gathered and sorted in one place, and places at which more are split.
GATHERED, SPLITS = 4096, 128


def _placed(rows: DataFrame) -> DataFrame:
    """control, last, need, equal, as in :func:`_last_keys`, from a control's sorted ``keys``."""
    rows = rows.withColumn("last", F.get("keys", F.col("k").cast("int") - 1))
    equal = F.size(F.filter("keys", lambda x: x == F.col("last"))).cast("bigint")
    return rows.select("_c", "last", (F.col("k") - F.array_position("keys", F.col("last")) + 1).alias("need"), equal.alias("equal"))


def _last_keys(rows: DataFrame, wanted: DataFrame, stored: Stored) -> DataFrame:
    """control, last, need, equal: of the first ``k`` keys of each control the last, how many of its equals are among them, and how many there are.

    ``rows``: _c, _key; ``wanted``: _c, k, n, the number of the control's keys. Keys are never sorted together by the many: those of a
    control with over ``GATHERED`` are counted between some of them, and only those between the two around the place looked for go on.
    """
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    state = wanted.select(F.col("_c").alias("_w"), "k", "n", *(F.lit(None).cast(rows.schema["_key"].dataType).alias(c) for c in ("low", "high")))
    out = None
    while True:
        near = state.where(F.col("n") <= GATHERED)
        left = lambda own: rows.join(small(own), same("_c", "_w")).where((F.col("low").isNull() | (F.col("_key") > F.col("low"))) & (F.col("high").isNull() | (F.col("_key") <= F.col("high"))))
        found = _placed(left(near).groupBy("_c", "k").agg(F.array_sort(F.collect_list("_key")).alias("keys")))
        out = found if out is None else out.union(found)
        state = stored(state.where(F.col("n") > GATHERED))
        if state.isEmpty():
            return out
        # Keys that lie a hash apart split the others; where all are equal nothing does, and the place is found.
        sampled = left(state).where(F.pmod(F.xxhash64("_key"), F.ceil(F.col("n") / SPLITS)) == 0).groupBy(F.col("_c").alias("_s")).agg(F.array_sort(F.collect_set("_key")).alias("splits"))
        places = stored(state.join(sampled, same("_w", "_s"), "left").drop("_s"))
        part = F.size(F.filter(F.coalesce("splits", F.array().cast(places.schema["splits"].dataType)), lambda x: x < F.col("_key")))
        counts = left(places).groupBy("_c", "k", part.alias("part")).agg(F.count("*").alias("m"), F.min("_key").alias("least"), F.max("_key").alias("most"))
        by_part = counts.groupBy("_c", "k").agg(F.array_sort(F.collect_list(F.struct("part", "m", "least", "most"))).alias("parts"))
        start = F.struct(F.col("k").alias("k"), F.lit(None).cast(by_part.schema["parts"].dataType.elementType).alias("at"))
        step = lambda s, x: F.when(s["at"].isNotNull(), s).when(x["m"] >= s["k"], F.struct(s["k"].alias("k"), x.alias("at"))).otherwise(F.struct((s["k"] - x["m"]).alias("k"), s["at"].alias("at")))
        at = stored(by_part.select("_c", F.aggregate("parts", start, step).alias("f")).select("_c", "f.k", F.col("f.at.m").alias("n"), F.col("f.at.least").alias("least"), F.col("f.at.most").alias("most")))
        out = out.union(at.where("least = most").select("_c", F.col("least").alias("last"), F.col("k").alias("need"), F.col("n").alias("equal")))
        more = at.where("least <> most").join(places.select("_w", "low", "splits"), same("_c", "_w"))
        # What is above the last split before the part: the largest split that is below the part's least key.
        below = F.array_max(F.filter(F.coalesce("splits", F.array().cast(places.schema["splits"].dataType)), lambda x: x < F.col("least")))
        state = stored(more.select("_w", "k", "n", F.coalesce(below, F.col("low")).alias("low"), F.col("most").alias("high")))


def largest_remainder(df: DataFrame, control: str, total: str, weight: str, order: Sequence[str], units: int = 1000, name: str = "units") -> DataFrame:
    """``total`` of each control shared over its rows in whole units of 1 / ``units``, exact in sum.

    Rows with the largest remainders get the missing units, ties in the order of ``order``. Weights
    are whole numbers; remainders are compared as integers, so no rounding decides. A control with
    weight 0 gives null.

    A control of any size is spread over tasks: its sums are made where rows lie, and of the order of its remainders only the place
    of the last missing unit is looked for. Integers have 64 bits where the largest total and weight prove that enough.
    """
    stored = Stored(df.sparkSession)
    rows = stored(df)
    sums = stored(rows.groupBy(F.col(control).alias("_c")).agg(F.sum(F.col(weight).cast("decimal(38,0)")).alias("_all"), F.count("*").alias("_n"), F.max(F.abs(F.col(total).cast("decimal(38,0)"))).alias("_t"), F.max(F.abs(F.col(weight).cast("decimal(38,0)"))).alias("_w")))
    top = sums.agg(F.max("_t"), F.max("_w"), F.max("_all"), F.max("_n")).first()
    wide = "bigint" if int(top[0] or 0) * units * int(top[1] or 0) < 1 << 62 and int(top[2] or 0) < 1 << 62 else "decimal(38,0)"
    at = lambda other: F.col(control).eqNullSafe(F.col(other))
    number = F.col(total).cast(wide) * F.lit(units).cast("bigint" if wide == "bigint" else "decimal(8,0)") * F.col(weight).cast("bigint" if wide == "bigint" else "decimal(18,0)")
    every = F.col("_all").cast(wide)
    rest = F.when(F.col("_all") > 0, number % every)
    key = F.struct((-rest).alias("rest"), *order)

    def shared(other: DataFrame) -> DataFrame:
        whole = F.expr("(_num - _rest) div _all") if wide == "bigint" else ((F.col("_num") - F.col("_rest")) / F.col("_all")).cast("bigint")
        found = rows.join(small(other), at("_c")).withColumn("_num", number).withColumn("_rest", rest).withColumn("_key", key).withColumn("_all", every)
        return found.withColumn("_floor", F.when(F.col("_all") > 0, whole))

    own = shared(sums.select("_c", "_all"))
    left = (F.max(F.col(total).cast("bigint")) * units - F.sum("_floor")).alias("k")
    if (top[3] or 0) <= GATHERED:  # no control is large: one pass gathers the keys with the sums
        keys = own.groupBy("_c").agg(left, F.array_sort(F.collect_list(F.when(F.col("_rest") > 0, F.col("_key")))).alias("keys")).where("k > 0")
        last = stored(_placed(keys))
    else:
        missing = stored(own.groupBy("_c").agg(left, F.count(F.when(F.col("_rest") > 0, 1)).alias("n")))
        last = stored(_last_keys(own.where("_rest > 0").select("_c", "_key"), missing.where("k > 0"), stored))
    found = sums.select("_c", "_all").join(last.withColumnRenamed("_c", "_l"), F.col("_c").eqNullSafe(F.col("_l")), "left").drop("_l")
    rows_of = shared(stored(found))
    more = F.col("_key") < F.col("last")
    if last.where("equal > need").isEmpty():
        more = more | (F.col("_key") == F.col("last"))
    else:  # rows that ``order`` doesn't tell apart: some of them
        equal = F.row_number().over(Window.partitionBy("_c", "_key").orderBy(F.lit(0)))
        ties = rows_of.where(F.col("_key") == F.col("last")).withColumn("_tie", equal)
        rows_of = rows_of.where(~F.coalesce(F.col("_key") == F.col("last"), F.lit(False))).withColumn("_tie", F.lit(None).cast("int")).union(ties)
        more = more | F.coalesce(F.col("_tie") <= F.col("need"), F.lit(False))
    return rows_of.withColumn(name, F.col("_floor") + F.coalesce(more, F.lit(False)).cast("bigint")).select(*df.columns, name)


def conservation(df: DataFrame, control: str, total: str, units: str, scale: int = 1000) -> DataFrame:
    """Controls whose rows do not add up to their total: no rows means it is conserved."""
    sums = df.groupBy(control).agg(F.max(total).alias("total"), F.sum(units).alias("allocated"))
    return sums.where(~(F.col("total").cast("bigint") * scale).eqNullSafe(F.col("allocated")))


def single_unit(df: DataFrame, control: str, unit: str) -> DataFrame:
    """Controls whose verified weights mix units and so can't be allocated."""
    return df.groupBy(control).agg(F.collect_set(unit).alias("units")).where(F.size("units") != 1)


def redistributed(df: DataFrame, control: str, total: str, weights: Sequence[str]) -> DataFrame:
    """For each scenario's weight a column with its share of the total; null where the weights are 0 or one is negative."""
    own = Window.partitionBy(control)
    for w in weights:
        valid = (F.sum(w).over(own) > 0) & (F.min(w).over(own) >= 0)
        df = df.withColumn(f"{w}_share", F.when(valid, F.col(total) * F.col(w) / F.sum(w).over(own)))
    return df


def total_variation(df: DataFrame, control: str, a: str, b: str, name: str = "variation") -> DataFrame:
    """Half the sum of absolute differences of two distributions."""
    return df.groupBy(control).agg((F.sum(F.abs(F.col(a) - F.col(b))) / 2).alias(name))


def envelope(*scenarios: str) -> tuple[Column, Column]:
    """Least and greatest of the scenarios that are not null."""
    if len(scenarios) == 1:
        return F.col(scenarios[0]), F.col(scenarios[0])
    return F.least(*scenarios), F.greatest(*scenarios)


def scenario_weights(part: Column, weight: Column, levels: Column, explicit: Column, observed: Column, excluded: Column) -> dict[str, Column]:
    """Weights of one building's part of a cell: footprints only, explicit only, without lifecycle flags, assumed storeys halved and doubled."""
    full = part * weight * levels
    return {
        "footprint_only": part * weight,
        "explicit_only": F.when(explicit, full).otherwise(0.0),
        "lifecycle_excluded": F.when(excluded, 0.0).otherwise(full),
        "assumed_half": F.when(observed, full).otherwise(full * 0.5),
        "assumed_double": F.when(observed, full).otherwise(full * 2),
    }


def sensitivity_weights(proxy: Column, explicit_share: Column, observed_share: Column) -> dict[str, Column]:
    """Weights of a published cell under its shares of explicit and observed proxies."""
    return {"ambiguous_removed": proxy * explicit_share, "assumed_half": proxy * (0.5 + 0.5 * observed_share), "assumed_double": proxy * (2 - observed_share)}


def cell_weights(buildings: DataFrame, cells: DataFrame, name: str, cell: str, footprint: tuple[float, float] = (12.0, 80_000.0), least_part: float = 1e-8, size: float = 1000.0) -> DataFrame:
    """Scenario weights of published cells, by the exact parts of buildings in their shapes.

    ``buildings`` has ``ring``, ``levels``, ``weight``, ``explicit``, ``observed`` and ``lifecycle``; those with a footprint out
    of range count nowhere. A cell that no building touches has no row; ``baseline`` is the weight of the published model.
    """
    from geolith.operators.spatial import box_pairs, common_area, ring_area, with_box

    b = with_box(buildings).withColumn("_footprint", ring_area("ring")).where(F.col("_footprint").between(*footprint))
    pairs = box_pairs(b, with_box(cells), name, cell, size)
    rows = pairs.join(b, name).join(cells.select(cell, F.col("ring").alias("_shape")), cell).withColumn("_part", common_area("ring", "_shape")).where(F.col("_part") > least_part)
    found = scenario_weights(*(F.col(c) for c in ("_part", "weight", "levels", "explicit", "observed", "lifecycle")))
    found["baseline"] = F.col("_part") * F.col("weight") * F.col("levels")
    return rows.groupBy(cell).agg(*(F.sum(v).alias(k) for k, v in found.items()))
