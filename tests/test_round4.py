"""Findings of round 4."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geolith.functions import geo
from geolith.operators import match, review
from geolith.plans import catalog


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_f1_areas_that_meet_a_limit_exactly(spark, tmp_path):
    keys = [1449, 49983, 1484, 50018, 1519, 50053, 1554, 50088]  # pairs with 6 % of the smaller in common, off the holes
    spark.createDataFrame([(k, 1) for k in keys], "s_suppkey LONG, s_nationkey INT").write.parquet(f"{tmp_path}/supplier.parquet")
    found = rows(catalog.frame_overlaps(spark, str(tmp_path)), "a", "b", "area", "nested")
    assert [r for r in found if r[1] - r[0] == 48534] == [(a, a + 48534, 4800.0, False) for a in keys[::2]]


def test_f1_sizes_are_products_of_sides():
    for k in range(200):
        x0, y0, w, h = float(k * 6007 % 10007), float(k * 3001 % 10009), 200.0 + k % 5 * 100, 150.0 + k % 7 * 100
        u0, v0, u1, v1 = x0 + w / 3, y0 + h / 3, x0 + w - w / 3, y0 + h - h / 3
        hole = [[u0, v0], [u1, v0], [u1, v1], [u0, v1]]
        assert geo.area_edges([[[x0, y0], [x0 + w, y0], [x0 + w, y0 + h], [x0, y0 + h]], hole[:: 1 - 2 * (k % 2)]])[1] == w * h - (u1 - u0) * (v1 - v0)


def test_f1_sums_in_which_much_cancels():
    rng = np.random.default_rng(4)
    group = np.sort(rng.integers(0, 50, 5000))
    group[group == 7] = 8
    values = rng.normal(size=5000) * 10.0 ** rng.integers(-8, 8, 5000)
    values[group == 9] = 0.0
    high, low = geo.split_sums(values, group)
    assert [math.fsum((h, l)) for h, l in zip(high, low, strict=True)] == pytest.approx([math.fsum(values[group == k]) for k in range(50)], rel=3e-16, abs=0)
    assert high[7] == low[7] == high[9] == low[9] == 0


def test_f2_candidates_of_one_address_come_from_many_tasks(spark):
    a = spark.range(6000).select(F.col("id").alias("a"), F.array(F.lit("x"), F.lit("y")).alias("localities"), F.lit("s").alias("street"), F.lit("1").alias("number"), F.lit(None).cast("int").alias("municipality"))
    r = spark.range(10).select(F.col("id").alias("h"), F.lit("x").alias("locality"), F.lit("s").alias("street"), F.lit("1").alias("number"), F.lit(7).alias("municipality"))
    found = review.locality_candidates(a, r, "a", "h")
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert found.count() == found.distinct().count() == 60000
    swapped = match.linked(match.key_sets(r, "h", ["street"]), match.key_sets(a, "a", ["street"]), lambda x, y: x.join(y, "street").select("_a", "_b", F.lit("k").alias("class")))
    assert swapped.columns == ["h", "a", "class"] and swapped.count() == swapped.distinct().count() == 60000


def test_f2_blocks_give_each_pair_once(spark):
    rng = np.random.default_rng(2)
    made = {(int(i), int(k)) for i, k in zip(rng.integers(0, 300, 500), rng.integers(0, 12, 500), strict=True)}
    left = [*made, (None, 3), (None, 4)]
    right = [(i, k) for i, k in made if i % 3] + [(None, 3), (500, None)]
    sides = (match.key_sets(spark.createDataFrame(v, f"{n} INT, k INT"), n, ["k"]) for n, v in (("l", left), ("r", right)))
    found = match.linked(*sides, lambda x, y: x.join(y, "k").select("_a", "_b"), block=4)
    expected = {(i, j) for i, k in left for j, m in right if k == m is not None}
    assert rows(found, "l", "r") == sorted(expected, key=str) and (None, None) in expected and len(expected) > 5000
    nothing = match.linked(match.key_sets(spark.createDataFrame([(1, 1)], "l INT, k INT"), "l", ["k"]), match.key_sets(spark.createDataFrame([(1, 2)], "r INT, k INT"), "r", ["k"]), lambda x, y: x.join(y, "k").select("_a", "_b"))
    assert nothing.columns == ["l", "r"] and nothing.count() == 0
