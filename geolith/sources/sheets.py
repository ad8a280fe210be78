"""Tables of statistics offices and housing registers: rows of a sheet with a state and a context that are carried down.

Rows have ``file``, ``row`` (a number) and the cells as columns or a map; all files at once, each in its own order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolith.functions.scalars import area_issues, positive
from geolith.functions.text import token
from geolith.operators.match import carried_down

#: The kinds of municipalities in a name, of settlements in a row's title, and of localities in a census.
MUNICIPALITIES = ("муниципальный округ", "муниципальный район", "городской округ")
TOWN = r"(?iu)^(?:г|пгт)\s+(.+)$"
HEADING = r"(?iu)^(.+?(?:городской округ|муниципальный район|муниципальный округ)|Городской округ[^-]+)"
LOCALITY = r"(?iu)(?:^|\s-\s)(?:городское население\s*-\s*)?(?:г\.|пгт\.?|село|поселок|посёлок|деревня)\s+([^–—]+)$"
#: A register's headers by column, counted from 0, and its last row of headers.
REGISTER_HEADERS = {1: "Адрес МКД", 5: "Количество этажей", 7: "Общая площадь МКД, всего", 8: "Площадь помещений МКД, всего:"}
REGISTER_HEADER_ROW, REGISTER_FIRST_ROW = 3, 8


def _digits(value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")).rlike(r"^\d+$"), value.try_cast("bigint"))


def _group(pattern: str, text: Column) -> Column:
    """The pattern's first group, or null."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def _part(rows: DataFrame, first: Column, after: Column) -> DataFrame:
    """The rows below the first that is ``first``, up to the next that is ``after``, which ends the part for good; rows that are ``first`` go."""
    seen = carried_down(rows.withColumn("_seen", F.when(first, True)), "_seen", "row", ["file"], "_in")
    ended = seen.withColumn("_stop", F.when(F.coalesce("_in", F.lit(False)) & after, True))
    return carried_down(ended, "_stop", "row", ["file"], "_over").where("_in and _over is null").where(~F.coalesce(first, F.lit(False))).drop("_seen", "_in", "_stop", "_over")


def municipal_table(rows: DataFrame, region: str, prefix: str) -> DataFrame:
    """Municipalities and their towns in one region's part of a table: file, row, name, code, population, municipality, ``town``.

    ``rows``: file, row, code, name, population (texts). The part begins after the row with the region's name and ends before the first
    ten-digit code without the region's ``prefix``. Rows without a whole number are headings or notes and go. A row of a municipality
    (ten digits and a kind of municipality) is its own municipality; the rows below belong to the last one above, none to null.
    """
    rows = rows.withColumn("code", F.replace(F.coalesce("code", F.lit("")), F.lit(" "), F.lit("")))
    other = (F.length("code") == 10) & ~F.col("code").startswith(prefix)
    rest = _part(rows, F.col("name") == region, other)
    kind = F.lit(False)
    for words in MUNICIPALITIES:
        kind = kind | F.contains(F.lower("name"), F.lit(words))
    found = rest.withColumn("population", _digits(F.col("population"))).where("population is not null")
    found = found.withColumn("_own", F.when((F.length("code") == 10) & kind, F.col("name")))
    found = carried_down(found, "_own", "row", ["file"], "municipality")
    town = F.when(F.length("code") >= 11, _group(TOWN, F.col("name")))
    return found.select("file", "row", "name", "code", "population", "municipality", F.col("_own").isNotNull().alias("is_municipality"), town.alias("town"))


def reconciled(table: DataFrame, municipalities: int, population: int) -> DataFrame:
    """The files whose municipalities are not the expected number or don't add up to the region's population: none means that all do."""
    sums = table.groupBy("file").agg(F.countDistinct(F.when(F.col("is_municipality"), F.col("name"))).alias("n"), F.coalesce(F.sum(F.when(F.col("is_municipality"), F.col("population"))), F.lit(0)).alias("total"))
    return sums.where((F.col("n") != municipalities) | (F.col("total") != population))


def census_table(rows: DataFrame, region: str, following: str) -> DataFrame:
    """Localities in one region's part of a census table: file, row, title, locality, population, heading.

    ``rows``: file, row, title, population (texts). The part lies between the rows with both regions' names. Localities are rows with a
    whole number whose title ends in a kind of place and its name; each gets the last heading above it, null before the first.
    """
    part = _part(rows, F.col("title") == region, F.col("title") == following)
    part = part.withColumn("_heading", F.btrim(_group(HEADING, F.col("title"))))
    found = carried_down(part, "_heading", "row", ["file"], "heading").drop("_heading").withColumn("population", _digits(F.col("population"))).withColumn("locality", _group(LOCALITY, F.col("title")))
    return found.where("population is not null and locality is not null").select("file", "row", "title", "locality", "population", "heading")


def changed_headers(rows: DataFrame, headers: dict[int, str] = REGISTER_HEADERS, header_row: int = REGISTER_HEADER_ROW) -> DataFrame:
    """file, column, expected, found of a register's headers that aren't the expected ones, those of files without a header row too; compared as tokens."""
    wanted = F.explode(F.array(*(F.struct(F.lit(k).alias("column"), F.lit(v).alias("expected")) for k, v in headers.items())))
    files = rows.select("file").distinct().select("file", wanted.alias("h")).select("file", "h.*")
    own = rows.where(F.col("row") == header_row).select("file", F.col("values").alias("_v"))
    found = files.join(own, "file", "left").select("file", "column", "expected", F.get("_v", F.col("column")).alias("found"))
    return found.where(~token(F.col("expected")).eqNullSafe(token(F.coalesce("found", F.lit("")))))


def register_rows(rows: DataFrame, name: str = "fkr25", first_row: int = REGISTER_FIRST_ROW, headers: dict[int, str] = REGISTER_HEADERS, header_row: int = REGISTER_HEADER_ROW) -> DataFrame:
    """Houses of a register: house_id, file, row, municipality, address, storeys, gross_area, premises_area, flags (sorted).

    ``rows``: file, row (from 1), ``values`` (an array of texts). Files with other headers are an error. A row with a text in the first
    column and none in the second names the municipality of the houses below; a house has a number in the first and an address in the second.
    """
    cell = lambda i: F.coalesce(F.get("values", F.lit(i)), F.lit(""))
    wrong = changed_headers(rows, headers, header_row).select("file", F.concat(F.lit("changed header: "), F.coalesce("found", F.lit("none"))).alias("_wrong")).groupBy("file").agg(F.min("_wrong").alias("_wrong"))
    body = rows.where(F.col("row") >= first_row).join(wrong, "file", "left")
    body = body.withColumn("row", F.when(F.col("_wrong").isNull(), F.col("row")).otherwise(F.raise_error(F.col("_wrong")).cast(rows.schema["row"].dataType))).drop("_wrong")
    numeric = positive(cell(0)).isNotNull() | (F.btrim(cell(0)).try_cast("double") <= 0)
    body = body.withColumn("_name", F.when(~F.coalesce(numeric, F.lit(False)) & (cell(0) != "") & (cell(1) == "") & ~F.contains(cell(0), F.lit("наименование")), cell(0)))
    houses = carried_down(body, "_name", "row", ["file"], "municipality").where(F.coalesce(numeric, F.lit(False)) & (cell(1) != ""))
    houses = houses.select("file", "row", F.coalesce("municipality", F.lit("")).alias("municipality"), cell(1).alias("address"), positive(cell(5), integer=True, maximum=80).cast("int").alias("storeys"), positive(cell(7)).alias("gross_area"), positive(cell(8)).alias("premises_area"))
    missing: Sequence[Column] = [F.when(F.col(c).isNull(), n) for c, n in (("storeys", "invalid_or_variable_storeys"), ("gross_area", "missing_or_invalid_gross_area"), ("premises_area", "missing_or_invalid_all_premises_area"))]
    flags = F.concat(area_issues(F.col("gross_area"), F.col("premises_area"), F.lit(None).cast("double")), F.array_compact(F.array(*missing)))
    return houses.select(F.concat_ws(":", F.lit(name), "file", F.col("row").cast("string")).alias("house_id"), "*", F.array_sort(flags).alias("flags"))
