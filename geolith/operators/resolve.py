"""Entities from contact records: evidence, components, merges, stable ids, differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geolith.functions.text import company_key, compact, email, link_type, phone, strings, unique_by, web_address, web_host
from geolith.operators.tables import Stored, components

CONTACT_KINDS = ("agency", "realtor", "broker", "developer", "property_manager", "other")
SOURCES = "array<struct<source_id: string, retrieved_at: string, url: string>>"
#: What a contact is compared by; everything else, such as its place in a run, may change.
CONTACT_FIELDS = ("name", "kind", "coverage", "specializations", "phones", "emails", "websites", "addresses", "links", "sources")
LISTS = ("coverage", "specializations", "phones", "emails", "websites", "addresses")


def normalized(df: DataFrame, region: str) -> DataFrame:
    """Contact records in normal form; those without a name, or without any channel or address, go.

    Columns: record (order), contact_id, name, kind, the lists, links (array of url), and optionally ``sources``, an
    array of (source_id, retrieved_at, url), empty where it is missing.
    """
    if "sources" not in df.columns:
        df = df.withColumn("sources", F.array().cast(SOURCES))
    df = df.withColumn("sources", F.coalesce(F.transform(F.col("sources").cast(SOURCES), lambda x: x.withField("url", web_address(x["url"]))), F.array().cast(SOURCES))).withColumn("review_status", F.lit("needs_review"))
    kind = F.lower(compact(F.col("kind")))
    same = lambda x: F.lower(x)
    df = df.withColumn("name", compact(F.col("name"))).withColumn("kind", F.when(kind.isin(*CONTACT_KINDS), kind).otherwise("other"))
    for column, form in (("phones", phone), ("emails", email), ("websites", web_address)):
        df = df.withColumn(column, F.array_distinct(F.array_compact(F.transform(strings(F.col(column)), form))))
    coverage = strings(F.col("coverage"))
    df = df.withColumn("coverage", unique_by(F.when(F.size(coverage) > 0, coverage).otherwise(F.array(F.lit(region))), same))
    df = df.withColumn("specializations", unique_by(strings(F.col("specializations")), same)).withColumn("addresses", unique_by(strings(F.col("addresses")), same))
    urls = F.array_distinct(F.array_compact(F.transform(strings(F.col("links")), web_address)))
    df = df.withColumn("links", F.transform(urls, lambda u: F.struct(link_type(u).alias("type"), link_type(u).alias("label"), u.alias("url"))))
    some = sum((F.size(c) for c in ("phones", "emails", "websites", "links", "addresses")), F.lit(0)) > 0
    return df.where((F.col("name") != "") & some)


def evidence(df: DataFrame) -> Column:
    """Sorted keys that contacts are known by: phones, addresses of mail, sites, and name with coverage."""
    hosts = F.array_remove(F.transform("websites", lambda u: F.regexp_replace(web_host(u), r"^www\.", "")), "")
    name = company_key(F.col("name"))
    own = F.when(name != "", F.array(F.concat(F.lit("n:"), name, F.lit("|"), F.array_join(F.array_sort(F.transform("coverage", lambda x: F.lower(x))), ",")))).otherwise(F.array().cast("array<string>"))
    marked = lambda p, values: F.transform(values, lambda v: F.concat(F.lit(p), v))
    return F.array_sort(F.array_distinct(F.concat(marked("p:", F.col("phones")), marked("e:", F.col("emails")), marked("d:", hosts), own)))


def merged(df: DataFrame) -> DataFrame:
    """Contacts that share evidence, transitively, as one: the richest record names it, lists are united in order.

    Links run from a record to the smallest record with the same key, so a key of very many records is a star.
    """
    stored = Stored(df.sparkSession)
    df = stored(df.withColumn("keys", evidence(df)))  # the normal forms are computed once
    keyed = df.select("record", F.explode("keys").alias("key"))
    firsts = keyed.groupBy("key").agg(F.min("record").alias("first"), F.max("record").alias("last")).where("first < last").select("key", "first")
    stars = keyed.join(firsts, "key").select(F.col("record").alias("a"), F.col("first").alias("b"))
    found = components(stars, stored)
    df = df.join(found.withColumnRenamed("node", "record"), "record", "left").withColumn("component", F.coalesce("component", "record"))
    channels = sum((F.size(c) for c in ("phones", "emails", "websites", "links")), F.lit(0))
    df = df.withColumn("rank", F.struct((-channels).alias("c"), (-F.length("name")).alias("l"), F.col("record").alias("r")))
    best = df.groupBy("component").agg(F.min(F.struct("rank", "name", "kind")).alias("best"), F.min(F.when(F.col("contact_id") != "", F.struct("rank", F.col("contact_id").alias("id")))).alias("supplied"), F.count("*").alias("records"))
    # values are made distinct before they are gathered, so a large group moves each value once for a task
    columns = F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in (*LISTS, "keys")), F.struct(F.lit("links").alias("c"), F.transform("links", lambda x: x["url"]).alias("v")))
    items = df.select("component", "rank", F.explode(columns).alias("f")).select("component", "rank", F.col("f.c").alias("c"), F.posexplode("f.v").alias("at", "v"))
    key = F.when(F.col("c").isin("links", "keys"), F.col("v")).otherwise(F.lower("v"))
    items = items.groupBy("component", "c", key.alias("k")).agg(F.min(F.struct("rank", "at", "v")).alias("i"))
    lists = items.groupBy("component", "c").agg(F.transform(F.array_sort(F.collect_list("i")), lambda x: x["v"]).alias("v"))
    none = F.array().cast("array<string>")
    lists = lists.groupBy("component").agg(*(F.coalesce(F.first(F.when(F.col("c") == c, F.col("v")), ignorenulls=True), none).alias(c) for c in (*LISTS, "keys", "links")))
    links = F.transform("links", lambda u: F.struct(link_type(u).alias("type"), link_type(u).alias("label"), u.alias("url")))
    out = best.join(lists, "component").select("component", "records", F.col("best.name").alias("name"), F.col("best.kind").alias("kind"), F.col("supplied.id").alias("supplied"), *LISTS, links.alias("links"), F.array_sort("keys").alias("keys"))
    seen = df.select("component", "rank", F.posexplode("sources").alias("at", "s")).groupBy("component", F.col("s.source_id").alias("k"), F.coalesce("s.url", F.lit("")).alias("u")).agg(F.min(F.struct("rank", "at", "s")).alias("i"))
    seen = seen.groupBy("component").agg(F.transform(F.array_sort(F.collect_list("i")), lambda x: x["s"]).alias("sources"))
    out = out.join(seen, "component", "left").withColumn("sources", F.coalesce("sources", F.array().cast(SOURCES))).withColumn("review_status", F.lit("needs_review"))
    identity = F.coalesce(F.get("keys", F.lit(0)), company_key(F.col("name")))
    return out.withColumn("contact_id", F.coalesce("supplied", F.concat(F.lit("contact_"), F.substring(F.sha2(identity, 256), 1, 16)))).drop("supplied")


def preserved_ids(df: DataFrame, published: DataFrame) -> DataFrame:
    """Contacts with the published id that alone owns their evidence; of several that claim one, the first by name, then by id, gets it."""
    owners = published.select(F.col("contact_id").alias("owner"), F.explode("keys").alias("key"))
    claims = df.select("component", F.explode("keys").alias("key")).join(owners, "key").groupBy("component").agg(F.min("owner").alias("owner"), F.max("owner").alias("last")).where("owner = last")
    claims = claims.join(df.select("component", F.struct(F.lower("name").alias("name"), "contact_id", "component").alias("order")), "component")
    first = claims.groupBy("owner").agg(F.min("order").alias("order")).select("owner", F.col("order.component").alias("component"))
    return df.join(first, "component", "left").withColumn("contact_id", F.coalesce("owner", "contact_id")).drop("owner")


def comparable(df: DataFrame, fields: Sequence[str] = CONTACT_FIELDS) -> Column:
    """All that two versions of a contact are compared by: its fields, but not when a source was read."""
    columns = [F.transform("sources", lambda x: x.dropFields("retrieved_at")).alias("sources") if c == "sources" else F.col(c) for c in sorted(fields) if c in df.columns]
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def delta(previous: DataFrame, candidate: DataFrame, fields: Sequence[str] = CONTACT_FIELDS) -> DataFrame:
    """(contact_id, status): added, changed, removed or unchanged between two catalogues, by those of ``fields`` that both have."""
    both = [c for c in fields if c in previous.columns and c in candidate.columns]
    old, new = (df.select("contact_id", comparable(df, both).alias(c)) for df, c in ((previous, "old"), (candidate, "new")))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return old.join(new, "contact_id", "full_outer").select("contact_id", status.alias("status"))


def catalogue_errors(df: DataFrame, states: tuple[str, ...] = ("needs_review", "published")) -> DataFrame:
    """(contact_id, error) of contacts that aren't in normal form, for which each form is its own: none if the catalogue is valid."""
    same = lambda c, form: F.coalesce(F.forall(F.col(c), lambda x: F.coalesce(form(x) == x, F.lit(False))), F.lit(False))
    filled = lambda c: F.coalesce(F.forall(F.col(c), lambda x: F.coalesce(x != "", F.lit(False))), F.lit(False))
    rules = {
        "contact_id": F.coalesce(F.col("contact_id").rlike("^[a-z0-9][a-z0-9_-]{2,63}$"), F.lit(False)),
        "name": F.coalesce(compact(F.col("name")) != "", F.lit(False)),
        "kind": F.coalesce(F.col("kind").isin(*CONTACT_KINDS), F.lit(False)),
        "phones": same("phones", phone), "emails": same("emails", email), "websites": same("websites", web_address),
        **{c: filled(c) for c in ("coverage", "specializations", "addresses")},
        "links": F.coalesce(F.forall("links", lambda x: F.coalesce((web_address(x["url"]) == x["url"]) & (compact(x["label"]) != ""), F.lit(False))), F.lit(False)),
        "sources": F.coalesce(F.forall("sources", lambda x: F.coalesce(x["source_id"].rlike("^[a-z0-9][a-z0-9_-]*$") & (compact(x["retrieved_at"]) != ""), F.lit(False)) & (x["url"].isNull() | F.coalesce(web_address(x["url"]) == x["url"], F.lit(False)))), F.lit(False)),
        "review_status": F.coalesce(F.col("review_status").isin(*states), F.lit(False)),
    }
    found = df.select("contact_id", F.explode(F.array_compact(F.array(*(F.when(~ok, name) for name, ok in rules.items())))).alias("error"))
    twice = df.groupBy("contact_id").count().where("count > 1").select("contact_id", F.lit("duplicate").alias("error"))
    return found.union(twice)


def searched(df: DataFrame, text: str = "", kind: str = "", coverage: str = "", specialization: str = "") -> DataFrame:
    """Contacts that contain a text in their name or lists, of a kind, area and specialization."""
    if text:
        everything = F.lower(F.concat_ws(" ", "name", *LISTS))
        df = df.where(F.contains(everything, F.lit(text.lower())))
    if kind:
        df = df.where(F.col("kind") == kind)
    for column, value in (("coverage", coverage), ("specializations", specialization)):
        if value:
            df = df.where(F.array_contains(column, value))
    return df


def facets(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-empty values of a column or of the items of an array column."""
    value = F.explode(column) if df.schema[column].dataType.typeName() == "array" else F.col(column)
    return df.select(value.alias("value")).where(F.coalesce("value", F.lit("")) != "").distinct()


def catalogue_order(df: DataFrame) -> DataFrame:
    return df.orderBy(F.lower("name"), "contact_id")


def numbered(df: DataFrame, order: str, group: str) -> DataFrame:
    return df.withColumn("n", F.row_number().over(Window.partitionBy(group).orderBy(order)))
