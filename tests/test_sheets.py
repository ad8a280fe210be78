"""Scans of sheets with carried context, and allocation without a window over a control."""

import random

import pytest
from pyspark.sql import functions as F

from geolith.operators import allocate, match
from geolith.sources import sheets


@pytest.mark.parametrize("block", [3, 10_000])
def test_context_is_carried_over_blocks(spark, block):
    rng = random.Random(block)
    rows = [(g, k, rng.choice([None, None, None, "x", "y"])) for g in ("a", None, "b") for k in rng.sample(range(60), 40)]
    expected, last = set(), {}
    for g, k, v in sorted(rows, key=lambda r: r[1]):
        last[g] = v or last.get(g)
        expected.add((g, k, last[g]))
    found = match.carried_down(spark.createDataFrame(rows, "g STRING, r INT, h STRING"), "h", "r", ["g"], block=block)
    assert {(r["g"], r["r"], r["context"]) for r in found.collect()} == expected
    assert match.carried_down(spark.createDataFrame(rows, "g STRING, r INT, h STRING"), "h", "r", ["g"], name="h", block=block).columns == ["g", "r", "h"]
    assert match.carried_down(spark.createDataFrame([], "g STRING, r INT, h STRING"), "h", "r", ["g"], block=block).count() == 0


def test_municipal_table(spark):
    rows = [("x", 1, "00", "before", "5"), ("x", 2, None, "R", None), ("x", 3, "05 700 0001", "heading", "не число"), ("x", 4, "0570000010", "A муниципальный округ", "100"), ("x", 5, "05700000101", "г Город", "60"), ("x", 6, "05700000102", "пгт  Посёлок", "40"), ("x", 7, "0570000020", "Городской округ B", "7"), ("x", 8, "05700000201", "деревня", "7"), ("x", 9, "1000000000", "Q округ", "1"), ("x", 10, None, "R", "1"), ("x", 11, "05700000300", "г Late", "1"), ("y", 1, "05700000101", "г Город", "60")]
    table = sheets.municipal_table(spark.createDataFrame(rows, "file STRING, row INT, code STRING, name STRING, population STRING"), "R", "05")
    assert sorted((r["row"], r["municipality"], r["is_municipality"], r["town"], r["population"]) for r in table.collect()) == [(4, "A муниципальный округ", True, None, 100), (5, "A муниципальный округ", False, "Город", 60), (6, "A муниципальный округ", False, "Посёлок", 40), (7, "Городской округ B", True, None, 7), (8, "Городской округ B", False, None, 7)]
    assert sheets.reconciled(table, 2, 107).isEmpty() and not sheets.reconciled(table, 2, 106).isEmpty()


def test_census_table(spark):
    titles = [("other", "1"), ("R", None), ("A городской округ - всего", "9"), ("городское население - г. Альфа", "8"), ("село Бета", "x"), ("Городской округ Гамма - итого", "3"), ("посёлок Дельта – часть", "3"), ("пгт. Эпсилон", "4"), ("Next", None), ("село Поздно", "5")]
    rows = spark.createDataFrame([("f", k, t, p) for k, (t, p) in enumerate(titles)], "file STRING, row INT, title STRING, population STRING")
    found = sheets.census_table(rows, "R", "Next").collect()
    assert sorted((r["row"], r["locality"], r["population"], r["heading"]) for r in found) == [(3, "Альфа", 8, "A городской округ"), (7, "Эпсилон", 4, "Городской округ Гамма")]


def test_register(spark):
    head = [None, "Адрес  МКД", "", "", "", "Количество этажей", "", "Общая площадь МКД, всего", "Площадь помещений МКД, всего:"]
    house = lambda a, f, g, p: ["1", a, "", "", "", f, "", g, p]
    values = {1: ["title"], 3: head, 8: ["Округ A", ""], 9: house("адрес 1", "5", "1000,5", "900"), 10: ["наименование", ""], 11: house("адрес 2", "5-9", "0", "x"), 12: ["Округ B", None], 13: house("адрес 3", "81", "100", "102"), 14: house("", "1", "1", "1"), 15: ["note", "text"]}
    rows = spark.createDataFrame([("f", k, v) for k, v in values.items()], "file STRING, row INT, values ARRAY<STRING>")
    found = {r["row"]: r for r in sheets.register_rows(rows).collect()}
    assert {k: (r["municipality"], r["address"], r["storeys"], r["gross_area"], r["premises_area"]) for k, r in found.items()} == {9: ("Округ A", "адрес 1", 5, 1000.5, 900.0), 11: ("Округ A", "адрес 2", None, None, None), 13: ("Округ B", "адрес 3", None, 100.0, 102.0)}
    assert found[9]["house_id"] == "fkr25:f:9" and found[9]["flags"] == [] and len(found[11]["flags"]) == 3 and "invalid_or_variable_storeys" in found[13]["flags"] and len(found[13]["flags"]) == 2
    changed = rows.withColumn("values", F.when(F.col("row") == 3, F.array(F.lit(""), F.lit("Адрес"))).otherwise(F.col("values")))
    assert sheets.changed_headers(changed, sheets.REGISTER_HEADERS).count() == 4 and sheets.changed_headers(rows.where("row > 7")).count() == 4
    with pytest.raises(Exception, match="changed header"):
        sheets.register_rows(changed).collect()


@pytest.mark.parametrize("gathered,factor", [(4096, 1), (50, 1), (50, 10**9)])
def test_allocation_equals_brute_force(spark, monkeypatch, gathered, factor):
    """Large controls whose keys are split, ties, a control without weight, a null one; in 64 bits and beyond."""
    monkeypatch.setattr(allocate, "GATHERED", gathered)
    monkeypatch.setattr(allocate, "SPLITS", 16)
    rng = random.Random(1)
    totals = {"a": 1234567, "b": 77, "c": 5, None: 99991, "z": 3, "t": 333}
    rows = [(c, totals[c] * factor, 0 if c == "z" else 7 if c == "t" else rng.randrange(9 if c == "a" else 1000), k) for c, n in (("a", 2000), ("b", 40), ("c", 1), (None, 300), ("z", 5), ("t", 700)) for k in range(n)]
    expected = {}
    for c, total in totals.items():
        own = [r for r in rows if r[0] == c]
        whole = sum(r[2] for r in own)
        parts = {r[3]: divmod(total * factor * 1000 * r[2], whole) for r in own} if whole else {}
        missing = total * factor * 1000 - sum(q for q, _ in parts.values())
        first = set(sorted(parts, key=lambda k: (-parts[k][1], k))[:missing])
        expected |= {(c, r[3]): parts[r[3]][0] + (r[3] in first) if whole else None for r in own}
    df = allocate.largest_remainder(spark.createDataFrame(rows, "c STRING, t BIGINT, w BIGINT, o INT"), "c", "t", "w", ["o"])
    assert df.columns == ["c", "t", "w", "o", "units"] and {(r["c"], r["o"]): r["units"] for r in df.collect()} == expected


def test_allocation_over_equal_rows(spark):
    df = spark.createDataFrame([("a", 100, 1, 5)] * 300 + [("b", 7, 1, 1)] * 3, "c STRING, t BIGINT, w BIGINT, o INT")
    found = allocate.largest_remainder(df, "c", "t", "w", ["o"], units=1).groupBy("c").agg(F.sum("units"), F.count("*"), F.max("units"))
    assert sorted(map(tuple, found.collect())) == [("a", 100, 300, 1), ("b", 7, 3, 3)]
    plan = allocate.largest_remainder(df.where("c = 'b'").withColumn("o", F.monotonically_increasing_id()), "c", "t", "w", ["o"])._jdf.queryExecution().toString()
    assert "Window" not in plan
