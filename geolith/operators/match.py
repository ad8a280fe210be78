"""Matching of names and addresses with provenance, duplicates, snapshots."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geolith.functions.text import candidate_class, district_key
from geolith.operators.tables import Stored, small


def official_match(places: DataFrame, tables: Sequence[DataFrame], name: str = "name_key", aliases: str = "aliases") -> DataFrame:
    """The control row of each place: the first table in which exactly one row has its name and a district among its aliases.

    ``places`` has place_id, a name key and an array of district keys; tables have name_key, district_key
    and value. ``ambiguous`` is set if the first table with a hit has several; the value is null then.
    """
    out = places
    values, counts = [], []
    for k, t in enumerate(tables):
        hits = places.select("place_id", F.col(name).alias("name_key"), F.explode(F.array_distinct(F.col(aliases))).alias("district_key")).join(t.select("name_key", "district_key", "value"), ["name_key", "district_key"])
        hits = hits.groupBy("place_id").agg(F.count("*").alias(f"_n{k}"), F.min("value").alias(f"_v{k}"))
        out = out.join(hits, "place_id", "left")
        counts.append(F.coalesce(F.col(f"_n{k}"), F.lit(0)))
        values.append(F.col(f"_v{k}"))
    first = lambda results: reduce(lambda rest, pair: F.when(pair[0] > 0, pair[1]).otherwise(rest), reversed(list(zip(counts, results, strict=True))), F.lit(None))
    out = out.withColumn("value", first([F.when(n == 1, v) for n, v in zip(counts, values, strict=True)]))
    out = out.withColumn("source", first([F.when(n == 1, F.lit(k)) for k, n in enumerate(counts)])).withColumn("ambiguous", F.coalesce(first([n > 1 for n in counts]), F.lit(False)))
    return out.drop(*(f"_{c}{k}" for k in range(len(tables)) for c in "nv"))


def district_aliases(district: Column, official: Column) -> Column:
    """Keys of a district and of the names joined by `` + `` in its official name."""
    return F.array_distinct(F.concat(F.array(district_key(district)), F.transform(F.split(official, r" \+ "), lambda x: district_key(F.btrim(x)))))


def merged_controls(areas: DataFrame, rows: DataFrame, area: str, official: str) -> DataFrame:
    """Sum of the control rows whose names, joined by `` + ``, make an area's official name; and whether all were found."""
    names = areas.select(area, F.explode(F.split(official, r" \+ ")).alias("name"))
    found = names.join(rows.select("name", "value"), "name", "left")
    return found.groupBy(area).agg(F.sum("value").alias("value"), F.bool_and(F.col("value").isNotNull()).alias("complete"))


def change_log(before: DataFrame, after: DataFrame, name: str, columns: Sequence[str]) -> DataFrame:
    """Rows whose columns differ, with both states."""
    b = before.select(name, *(F.col(c).alias(f"{c}_before") for c in columns))
    a = after.select(name, *(F.col(c).alias(f"{c}_after") for c in columns))
    differs = reduce(lambda x, y: x | y, (~F.col(f"{c}_before").eqNullSafe(F.col(f"{c}_after")) for c in columns))
    return b.join(a, name).where(differs)


def traced(places: DataFrame, found: DataFrame, name: str, quality: str = "population_quality", official: str = "official") -> DataFrame:
    """Places with the control (``name``, value, quality) found for each, and ``state``: matched, unverified or unavailable.

    A place whose control was official before and is found nowhere now is an error: an official figure must not be lost silently.
    """
    new = found.select(F.col(name).alias("_name"), F.col("value").alias("_value"), F.col("quality").alias("_quality"))
    rows = places.join(new, F.col(name) == F.col("_name"), "left")
    lost = F.col("_name").isNull() & F.coalesce(F.col(quality).startswith(official), F.lit(False))
    state = F.when(F.col("_name").isNotNull(), "matched").when(lost, F.raise_error(F.concat(F.lit("official control can't be traced: "), F.col(name).cast("string")))).when(F.col(quality) == "osm_unverified", "unverified").otherwise("unavailable")
    return rows.select(*places.columns, F.col("_value").alias("value"), F.col("_quality").alias("quality"), state.alias("state"))


def snapshot_diff(old: DataFrame, new: DataFrame, name: str, columns: Sequence[str]) -> DataFrame:
    """``status`` of each id in either snapshot: added, removed, changed or unchanged."""
    o = old.select(name, F.struct(*columns).alias("_old"), F.lit(True).alias("_in_old"))
    n = new.select(name, F.struct(*columns).alias("_new"), F.lit(True).alias("_in_new"))
    status = F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("changed")
    return o.join(n, name, "full_outer").select(name, status.alias("status"))


def typed_address_candidates(addresses: DataFrame, register: DataFrame, address_id: str, house_id: str) -> DataFrame:
    """(address id, house id, class) by municipality, street name and house number, and how they may match.

    ``addresses`` has municipality, identity (struct of localities, street type, street name, house
    number) and context (array); ``register`` has municipality and official (struct).
    """
    a = addresses.select(F.col(address_id), "municipality", "identity", "context", F.col("identity.street_name").alias("_street"), F.col("identity.house_number").alias("_house"))
    r = register.select(F.col(house_id), "municipality", "official", F.col("official.street_name").alias("_street"), F.col("official.house_number").alias("_house"))
    rows = a.join(r, ["municipality", "_street", "_house"]).withColumn("class", candidate_class(F.col("identity"), F.col("official"), F.col("context")))
    return rows.where(F.col("class").isNotNull()).select(address_id, house_id, "class")


def key_sets(rows: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Each id once, with the ``set`` of its different keys (structs, ascending)."""
    return rows.groupBy(name).agg(F.array_sort(F.collect_set(F.struct(*keys))).alias("set"))


def set_links(left: DataFrame, right: DataFrame, join: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """_a, _b and what else ``join`` gives, for the different sets of two tables of :func:`key_sets` that are linked by any of their keys, each once.

    ``_a`` and ``_b`` are the sets; ``rights`` and ``lefts`` count the ids of the other side that are linked with them. As an id has one set,
    pairs of ids need neither be made distinct nor counted. ``join`` takes the keys of both sides, with ``_a`` and ``_b``.
    """
    sets = lambda df, n, p: df.groupBy(F.col("set").alias(p)).agg(F.count(n).alias(f"_n{p}"))
    l, r = sets(left, left.columns[0], "_a"), sets(right, right.columns[0], "_b")
    keys = lambda df, p: df.select(p, F.explode(p).alias("_key")).select(p, "_key.*")
    found = Stored(left.sparkSession)(join(keys(l, "_a"), keys(r, "_b")).distinct())
    pairs = found.select("_a", "_b").distinct().join(l, "_a").join(r, "_b")
    rights, lefts = pairs.groupBy("_a").agg(F.sum("_n_b").alias("rights")), pairs.groupBy("_b").agg(F.sum("_n_a").alias("lefts"))
    return found.join(rights, "_a").join(lefts, "_b")


def linked(left: DataFrame, right: DataFrame, join: Callable[[DataFrame, DataFrame], DataFrame], block: int = 2048) -> DataFrame:
    """The pairs of ids of two tables of :func:`key_sets` whose sets are linked by any of their keys, with what else ``join`` gives.

    The ids of a set lie in blocks of about ``block``. Each block of a set meets those of a linked set in the last join, from which the pairs
    come, so that a task holds two blocks at a time, a set of very many ids is dealt to many tasks and no pairs are exchanged: only the ids
    of one side, once for each block of the other, those of the side for which these are fewer.
    """
    stored = Stored(left.sparkSession)
    tables = {"_a": stored(left), "_b": stored(right)}
    stored.release()
    sets = {p: df.groupBy(F.col("set").alias(p)).agg(F.count("*").alias(f"_n{p}")) for p, df in tables.items()}
    keys = lambda p: sets[p].select(p, F.explode(p).alias("_key")).select(p, "_key.*")
    parts = lambda p: F.ceil(F.col(f"_n{p}") / block)
    found = stored(join(keys("_a"), keys("_b")).distinct().join(sets["_a"], "_a").join(sets["_b"], "_b"))
    from_left, from_right = found.agg(F.sum(F.col("_n_a") * parts("_b")), F.sum(F.col("_n_b") * parts("_a"))).first()
    near, far = ("_a", "_b") if (from_left or 0) <= (from_right or 0) else ("_b", "_a")

    def blocks(p: str) -> DataFrame:
        df = tables[p]
        name = df.columns[0]
        large = small(stored(sets[p].where(F.col(f"_n{p}") > block).withColumnRenamed(p, "set")))
        part = F.pmod(F.xxhash64(name), F.coalesce(parts(p), F.lit(1))).alias(f"_i{p}")
        null = F.array_repeat(F.lit(None).cast(df.schema[name].dataType), F.count_if(F.col(name).isNull()).cast("int"))
        return df.join(large, "set", "left").groupBy(F.col("set").alias(p), part).agg(F.concat(F.collect_list(name), null).alias(f"_ids{p}"))

    n, at = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), [far, f"_i{far}"]
    met = found.withColumn(f"_i{far}", F.explode(F.sequence(F.lit(0), parts(far) - 1))).join(blocks(near), near)
    met = met.repartition(n, *at).hint("merge").join(blocks(far).repartition(n, *at), at)  # in all tasks, however few bytes the blocks are
    more = [c for c in found.columns if c not in ("_a", "_b", "_n_a", "_n_b")]
    met = met.select(F.explode(f"_ids{near}").alias(tables[near].columns[0]), f"_ids{far}", *more)
    met = met.select(tables[near].columns[0], F.explode(f"_ids{far}").alias(tables[far].columns[0]), *more)
    return met.select(left.columns[0], right.columns[0], *more)


def typed_address_ambiguity(addresses: DataFrame, register: DataFrame, address_id: str, house_id: str) -> DataFrame:
    """:func:`ambiguity` of :func:`typed_address_candidates`, counted by different addresses instead of pairs. Rows without an id have no links."""
    stored = Stored(addresses.sparkSession)
    addresses, register = stored(addresses), stored(register)  # their parts are often parsed from texts, which is done once
    l, r = (key_sets(df.where(F.col(n).isNotNull()), n, columns) for df, n, columns in ((addresses, address_id, ["municipality", "identity", "context"]), (register, house_id, ["municipality", "official"])))
    found = set_links(l, r, lambda a, b: typed_address_candidates(a, b, "_a", "_b"))
    counted = lambda df, sets, n, s, c: df.join(sets.join(found.select(F.col(s).alias("set"), c).distinct(), "set").select(n, c), n).withColumn(s, F.struct(n, c))
    links = typed_address_candidates(counted(addresses, l, address_id, "_a", "rights"), counted(register, r, house_id, "_b", "lefts"), "_a", "_b")
    return links.select(f"_a.{address_id}", f"_b.{house_id}", "class", "_a.rights", "_b.lefts", ((F.col("_a.rights") > 1) | (F.col("_b.lefts") > 1)).alias("ambiguous"))


def ambiguity(links: DataFrame, left: str, right: str) -> DataFrame:
    """Links with the number of partners on either side, and whether either has several."""
    l = links.groupBy(left).agg(F.count_distinct(right).alias("rights"))
    r = links.groupBy(right).agg(F.count_distinct(left).alias("lefts"))
    return links.join(l, left).join(r, right).withColumn("ambiguous", (F.col("rights") > 1) | (F.col("lefts") > 1))


def strongest(df: DataFrame, name: str, kind: str, order: Sequence[str]) -> DataFrame:
    """The first kind in the given order that each id has."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(kind))
    return df.where(rank > 0).groupBy(name).agg(F.min(rank).alias("_rank")).select(name, F.element_at(F.array(*map(F.lit, order)), F.col("_rank").cast("int")).alias(kind))


def by_address_key(cards: DataFrame, others: DataFrame, card_id: str, other_id: str, key: str = "key", how: str = "left") -> DataFrame:
    """Partners of each card with an equal address key, gathered once for all cards that have the same keys. A null key meets none; null parts of keys are equal."""
    parts = ["locality", "street_type", "street_name", "house_number"]
    spread = lambda df, n: df.where(F.col(key).isNotNull()).select(n, *(F.coalesce(F.col(f"{key}.{p}"), F.lit("")).alias(p) for p in parts))
    own = key_sets(spread(cards, card_id), card_id, parts)
    lists = spread(others, other_id).groupBy(*parts).agg(F.collect_set(other_id).alias("_some"))
    keys = own.select("set").distinct().select("set", F.explode("set").alias("_key")).select("set", "_key.*")
    found = keys.join(lists, parts).groupBy("set").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_some")))).alias("partners"))
    sets, found = own.select(F.col(card_id).alias("_card"), F.col("set").alias("_set")), found.withColumnRenamed("set", "_set")
    known = cards.join(sets, F.col(card_id) == F.col("_card"), "left").drop("_card")
    return known.join(found, "_set", how).select(card_id, *(c for c in cards.columns if c != card_id), "partners")


def duplicate_groups(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Groups of two rows or more with equal, non-null keys: the members' number and least and greatest id."""
    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    return df.where(known).groupBy(*keys).agg(F.count("*").alias("members"), F.min(name).alias("first_id"), F.max(name).alias("last_id")).where("members > 1")


def municipality_by_name(rows: DataFrame, names: DataFrame, row_id: str) -> DataFrame:
    """The municipality of each (name, category), else the only one that had the name in the past; else null."""
    exact = rows.join(names.select("name", "category", "municipality"), ["name", "category"]).groupBy(row_id).agg(F.collect_set("municipality").alias("_exact"))
    past = rows.join(names.where("historical").select("name", "municipality"), "name").groupBy(row_id).agg(F.collect_set("municipality").alias("_past"))
    one = lambda c: F.when(F.size(c) == 1, F.get(c, F.lit(0)))
    return rows.join(exact, row_id, "left").join(past, row_id, "left").withColumn("municipality", F.coalesce(one("_exact"), one("_past"))).drop("_exact", "_past")


def carried_down(df: DataFrame, value: str, order: str, group: Sequence[str] = (), name: str = "context", block: int = 10_000) -> DataFrame:
    """The last non-null value at or above each row of its sheet; ``order`` is a whole number.

    In two passes, so that no task sorts a sheet: the last value in each ``block`` of numbers is carried over the blocks, which are few,
    and then into the rows of each block. Rows of one number all take the greatest of their values, rows without a number the null's.
    """
    keys = [F.col(g) for g in group]
    number = F.floor(F.col(order) / block)
    filled = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("at"), F.col(value).alias("v")))
    blocks = df.groupBy(*(k.alias(f"_g{i}") for i, k in enumerate(keys)), number.alias("_b")).agg(F.max(filled).alias("_last"))
    above = Window.partitionBy(*(f"_g{i}" for i in range(len(keys)))).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_above", F.last("_last", ignorenulls=True).over(above)["v"]).drop("_last")
    on = number.eqNullSafe(F.col("_b"))
    for i, k in enumerate(keys):
        on = on & k.eqNullSafe(F.col(f"_g{i}"))
    inside = Window.partitionBy(*(f"_g{i}" for i in range(len(keys))), "_b").orderBy(order)
    found = F.coalesce(F.max(filled).over(inside.rangeBetween(Window.unboundedPreceding, 0))["v"], F.col("_above"))
    if value != name and name in df.columns:
        df = df.drop(name)
    return df.join(blocks, on).withColumn(name, found).select(*(c for c in df.columns if c != name), name)


def active_rows(df: DataFrame, starts: Column, stops: Column, order: str, group: Sequence[str] = ()) -> DataFrame:
    """Rows after a starting row and before the next stopping one; the state is carried as in :func:`carried_down`."""
    marked = df.withColumn("_mark", F.when(starts, True).when(stops, False)).withColumn("_start", F.coalesce(starts, F.lit(False)))
    return carried_down(marked, "_mark", order, group, "_on").where(F.col("_on") & ~F.col("_start")).drop("_on", "_mark", "_start")


def stratified_sample(df: DataFrame, stratum: str, name: str, size: int = 20, salt: str = "") -> DataFrame:
    """The ``size`` rows of least hash in each stratum."""
    from geolith.functions.scalars import strata_hash

    w = Window.partitionBy(stratum).orderBy(strata_hash(salt, F.col(name)), name)
    return df.withColumn("sample_rank", F.row_number().over(w)).where(F.col("sample_rank") <= size)


def first_routes(text: Column, routes: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The first route, in the order given, one of whose variants the text contains."""
    out = None
    for name, variants in routes:
        found = reduce(lambda a, b: a | b, [text.contains(v) for v in variants])
        out = F.when(found, name) if out is None else out.when(found, name)
    return out
