"""Text identities as Column expressions: names, districts, streets, houses, phones, addresses on the web."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the domain: administrative words, types of streets and places, letters that look alike, patterns.
ADMINISTRATIVE = ("городской", "муниципальный", "округ", "район", "город", "зато", "г")
STREET_TYPES = {
    "улица": "street", "ул": "street", "переулок": "lane", "пер": "lane", "проспект": "avenue", "пр-кт": "avenue", "пр-т": "avenue",
    "квартал": "quarter", "кв-л": "quarter", "микрорайон": "microdistrict", "мкр": "microdistrict", "бульвар": "boulevard", "бул": "boulevard",
    "шоссе": "highway", "ш": "highway", "проезд": "drive", "пр-д": "drive", "тупик": "dead_end", "площадь": "square", "пл": "square",
    "линия": "line", "территория": "territory", "тер": "territory", "аллея": "alley", "набережная": "embankment", "наб": "embankment",
}
LOCALITY_TYPES = ("город", "г", "посёлок городского типа", "поселок городского типа", "пгт", "рабочий поселок", "рп", "курортный поселок", "кп", "село", "с", "поселок", "пос", "п", "деревня", "д", "остров", "о")
LATIN_LOOKALIKES, CYRILLIC_LOOKALIKES = "abcehkmoptx", "авсенкмортх"
LEGAL_FORMS = ("ооо", "ао", "ип", "агентство недвижимости", "агентство", "недвижимость")
LINK_HOSTS = (
    ("telegram", "equals", ("t.me", "telegram.me")), ("whatsapp", "contains", ("wa.me", "whatsapp")), ("vk", "ends", ("vk.com",)), ("ok", "ends", ("ok.ru",)),
    ("youtube", "contains", ("youtube",)), ("youtube", "equals", ("youtu.be",)), ("cian", "ends", ("cian.ru",)), ("avito", "ends", ("avito.ru",)),
    ("yandex", "ends", ("yandex.ru",)), ("2gis", "ends", ("2gis.ru",)),
)
PLAIN_LOCALITY = r"^(?:г\.?|город|с\.?|село|пгт\.?|п\.?|пос\.?|поселок|д\.?|деревня)\s+"
PLAIN_STREET = r"(?U)\b(?:улица|ул\.?|проспект|пр-кт|пр-т|переулок|пер\.?|квартал|кв-л|микрорайон|мкр\.?|бульвар|бул\.?|шоссе|ш\.)\s*"
MUNICIPAL_WORDS = r"(?U)\b(?:городской округ|муниципальный округ|муниципальный район|зато|го|мо|мр|город|г|район|округ)\b\.?"
PHONE = r"(?<!\d)(?:\+?7|8)[\s()\-]*(?:\d[\s()\-]*){10}(?!\d)"
EMAIL = r"(?U)(?i)(?<![\w.+-])[\w.+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+"
NAME_CHARACTERS = "[^а-яa-z0-9]+"


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def words(values: Sequence[str]) -> str:
    """A pattern of any of the values, the longest first, with their dots and dashes literal."""
    return "|".join(v.replace(".", r"\.").replace("-", r"\-") for v in sorted(values, key=len, reverse=True))


def folded(text: Column) -> Column:
    """Lower case as for caseless comparison, with е for ё."""
    return F.translate(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), "ё", "е")


def name_key(text: Column) -> Column:
    """Letters and digits of a folded name."""
    return F.regexp_replace(folded(text), NAME_CHARACTERS, "")


def label_key(text: Column) -> Column:
    """As :func:`name_key` with plain lower case, and the empty string for null."""
    return F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), "ё", "е"), NAME_CHARACTERS, "")


def resort_locality(text: Column) -> Column:
    """A place's name without the closing category of a resort settlement."""
    return F.regexp_replace(F.btrim(text), r"(?iu)\s+кп$", "")


def district_key(text: Column) -> Column:
    return name_key(F.regexp_replace(folded(text), rf"(?U)\b(?:{'|'.join(ADMINISTRATIVE)})\b", ""))


@F.pandas_udf(T.StringType())
def compatible_form(text: pd.Series) -> pd.Series:
    """Compatibility normal form (NFKC), for which SQL has no function."""
    return text.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def compact(text: Column) -> Column:
    """White space as single spaces, none at the ends; the empty string for null."""
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def token(text: Column, normal_form: bool = True) -> Column:
    """Normal form, lower case, е for ё, single spaces. Without ``normal_form`` it stays in SQL, for text known to be normal."""
    return compact(F.translate(F.lower(compatible_form(text) if normal_form else text), "ё", "е"))


def plain_locality(text: Column, normal_form: bool = True) -> Column:
    return F.regexp_replace(token(text, normal_form), PLAIN_LOCALITY, "")


def plain_street(text: Column, normal_form: bool = True) -> Column:
    return F.regexp_replace(F.regexp_replace(token(text, normal_form), PLAIN_STREET, ""), r"(?U)[\s.,]+", "")


def look_alikes(text: Column) -> Column:
    return F.translate(text, LATIN_LOOKALIKES, CYRILLIC_LOOKALIKES)


def plain_number(text: Column, normal_form: bool = True) -> Column:
    """A house number with its corpus and slash kept apart."""
    return look_alikes(F.replace(token(text, normal_form), F.lit(" "), F.lit("")))


def plain_address(text: Column, normal_form: bool = True) -> Column:
    """Struct of town, street and house of an address of three parts or more with a house; else null."""
    parts = F.transform(F.split(text, ","), lambda p: F.btrim(p))
    middle = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), ",")
    town, street = plain_locality(F.get(parts, F.lit(0)), normal_form), plain_street(middle, normal_form)
    house = plain_number(F.regexp_extract(text, r"(?:^|,)\s*д\.\s*(.+)$", 1), normal_form)
    whole = (F.size(parts) >= 3) & (town != "") & (street != "") & (house != "")
    return F.when(whole, F.struct(town.alias("town"), street.alias("street"), house.alias("house")))


def locality_name(text: Column, normal_form: bool = True) -> Column:
    """A place's name without its type, which ends in a dot or a space."""
    return F.regexp_replace(token(text, normal_form), rf"^(?:{words(LOCALITY_TYPES)})(?:\.|\s+)\s*", "")


def street_identity(text: Column, types: Mapping[str, str] = STREET_TYPES, normal_form: bool = True) -> Column:
    """Struct of a street's kind, from a type before or else after its name, and its name."""
    any_of = words(tuple(types))
    kinds = F.create_map(*(F.lit(x) for pair in types.items() for x in pair))

    def named(kind: Column, rest: Column) -> Column:
        return F.struct(F.try_element_at(kinds, kind).alias("street_type"), F.regexp_replace(rest, r"(?U)[\s.,]+", "").alias("street_name"))

    def split(value: Column) -> Column:
        before = F.regexp_extract(value, rf"^({any_of})(?:\.|\s+)\s*", 1)
        after = lambda k: F.when(k != "", named(k, F.regexp_replace(value, rf"\s+(?:{any_of})\.?$", ""))).otherwise(named(k, value))
        other = let(F.regexp_extract(value, rf"\s+({any_of})\.?$", 1), after)
        return let(before, lambda k: F.when(k != "", named(k, F.regexp_replace(value, rf"^(?:{any_of})(?:\.|\s+)\s*", ""))).otherwise(other))

    return let(token(F.coalesce(text, F.lit("")), normal_form), split)


def house_number(text: Column, normal_form: bool = True) -> Column:
    value = token(F.coalesce(text, F.lit("")), normal_form)
    for pattern, short in ((r"^(?:д\.|дом)\s*", ""), (r"(?U)\b(?:корпус|корп\.)\s*", "к"), (r"(?U)\b(?:строение|стр\.)\s*", "стр"), (r"(?U)\bлитера\s*", "")):
        value = F.regexp_replace(value, pattern, short)
    return look_alikes(F.regexp_replace(value, "[ ,]", ""))


def official_address(text: Column, normal_form: bool = True) -> Column:
    """Struct of locality, street type, street name and house of a register's address, or null. The innermost place counts."""
    marked = r"(?iu),\s*(?:д\.|дом)\s*(.+)$"
    special = r"(?iu)^\s*(.+),\s*ДОС\s+(\d+[\w/ -]*)\s*$"
    names = ("locality", "street_type", "street_name", "house_number")

    def made(*parts: Column) -> Column:
        return F.struct(*(c.alias(n) for n, c in zip(names, parts, strict=True)))

    def usual(head: Column, house: Column) -> Column:
        town = locality_name(F.get(head, F.size(head) - 2), False)
        found = let(street_identity(F.element_at(head, -1), normal_form=False), lambda s: made(town, s["street_type"], s["street_name"], house))
        return let(found, lambda r: F.when((F.size(head) >= 2) & (r["locality"] != "") & (r["street_name"] != "") & (r["house_number"] != ""), r))

    def parsed(t: Column) -> Column:
        block = made(locality_name(F.regexp_extract(t, special, 1), False), F.lit("quarter"), F.lit("дос"), house_number(F.regexp_extract(t, special, 2), False))
        common = let(F.split(F.regexp_replace(t, marked, ""), ","), lambda head: usual(head, house_number(F.regexp_extract(t, marked, 1), False)))
        return F.when(t.rlike(marked), common).when(t.rlike(special), block)

    return let(compatible_form(text) if normal_form else text, parsed)  # the normal form first: functions of array items can't call Python


def compatible_address(a: Column, b: Column) -> Column:
    """Whether two structs of localities, street type, street name and house number contradict each other nowhere; empty parts agree with all."""
    same = [F.coalesce(a[k], F.lit("")).isin("") | F.coalesce(b[k], F.lit("")).isin("") | (a[k] == b[k]) for k in ("street_name", "house_number", "street_type")]
    places = (F.size(a["localities"]) == 0) | (F.size(b["localities"]) == 0) | F.arrays_overlap(a["localities"], b["localities"])
    return reduce(lambda x, y: x & y, [*same, places])


def candidate_class(identity: Column, official: Column, context: Column) -> Column:
    """How an address may match a register's: by its own locality, by the boundary around it, by the register alone; else null."""
    street = (identity["street_name"] == official["street_name"]) & (identity["house_number"] == official["house_number"])
    types = identity["street_type"].isNull() | official["street_type"].isNull() | (identity["street_type"] == official["street_type"])
    named = F.when((F.size(identity["localities"]) == 1) & F.array_contains(identity["localities"], official["locality"]), "explicit_address_candidate")
    around = F.when((F.size(context) == 1) & F.array_contains(context, official["locality"]), "osm_boundary_context_candidate")
    known = F.coalesce(F.size(context), F.lit(0)) > 0
    return F.when(street & types, F.when(F.size(identity["localities"]) > 0, named).when(known, around).otherwise("municipal_registry_candidate"))


def municipality_identity(text: Column, normal_form: bool = True) -> Column:
    """Struct of a municipality's bare name and its category."""
    value = token(text, normal_form)
    kind = F.when(value.rlike(r"(?U)\bзато\b"), "zato").when(value.rlike(r"(?U)\b(?:го|городской округ)\b"), "city").when(value.rlike(r"(?U)\b(?:мр|муниципальный район)\b"), "district").otherwise("municipal")
    bare = F.regexp_replace(value, MUNICIPAL_WORDS, "")
    return F.struct(F.regexp_replace(bare, r"(?U)\s+", "").alias("name"), kind.alias("category"))


def store_address(locality: Column, address: Column, normal_form: bool = True) -> Column:
    """Struct key of a card's address with a house; null without one. A null street type equals another."""
    marked = r"(?iu),\s*(?:дом|д\.|здание|соор\.)\s*(.+)$"
    street = street_identity(F.btrim(F.regexp_replace(address, marked, "")), normal_form=normal_form)
    key = F.struct(locality_name(locality, normal_form).alias("locality"), street["street_type"].alias("street_type"), street["street_name"].alias("street_name"), house_number(F.regexp_extract(address, marked, 1), normal_form).alias("house_number"))
    return F.when(address.rlike(marked), key)


def rural_card(group: Column, address: Column, rural_group: str) -> Column:
    """Struct of locality and rest of an address: cards of the rural group name their place in the address."""
    rural = r"(?iu)^(?:(?:c|с|п|пос|пгт|кп|рп)\.?)\s+([^,]+),\s*(.*)$"
    found = address.rlike(rural)
    place = F.when(group != rural_group, group).when(found, F.btrim(F.regexp_extract(address, rural, 1)))
    return F.struct(place.alias("locality"), F.when((group == rural_group) & found, F.btrim(F.regexp_extract(address, rural, 2))).otherwise(address).alias("address"))


@F.pandas_udf(T.StringType())
def entities_resolved(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def clean_markup(text: Column) -> Column:
    """Text without tags, with its entities resolved."""
    return F.btrim(entities_resolved(F.regexp_replace(text, "<[^>]+>", "")))


def route_text(text: Column) -> Column:
    """A road's reference in upper case without spaces, with one kind of dash and Latin R and A."""
    return F.translate(F.replace(F.upper(F.coalesce(text, F.lit(""))), F.lit(" "), F.lit("")), "–—РА", "--RA")


def strings(values: Column) -> Column:
    """Compacted items of an array, without empty ones."""
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), compact), lambda x: x != "")


def unique_by(values: Column, key) -> Column:
    """Items whose key did not come before."""
    return F.filter(values, lambda x, i: F.array_position(F.transform(values, key), key(x)) == i + 1)


def phone(text: Column) -> Column:
    """``+`` and 7 to 15 digits; a leading 8 of eleven digits is 7, ten digits get a 7; else null."""
    digits = F.regexp_replace(F.coalesce(text, F.lit("")), r"\D", "")
    digits = F.when((F.length(digits) == 11) & digits.startswith("8"), F.concat(F.lit("7"), F.substring(digits, 2, 10))).when(F.length(digits) == 10, F.concat(F.lit("7"), digits)).otherwise(digits)
    return F.when(F.length(digits).between(7, 15), F.concat(F.lit("+"), digits))


def email(text: Column) -> Column:
    value = F.lower(compact(text))
    return F.when(value.rlike(r"(?U)^[\w.+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+$"), value)


def web_address(text: Column) -> Column:
    """An http address without user, default port, doubled slashes and fragment; else null."""
    value = compact(text)
    scheme = F.lower(F.regexp_extract(value, "^([A-Za-z]+)://", 1))
    authority = F.regexp_extract(value, "^[A-Za-z]+://([^/?#]*)", 1)
    host = F.rtrim(F.lower(F.regexp_extract(authority, "^([^:]*)", 1)), F.lit("."))
    port = F.regexp_extract(authority, ":([0-9]*)$", 1)
    path = F.regexp_extract(value, "^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(value, r"^[^?#]*(\?[^#]+)", 1)
    default = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    path = F.when(path == "", "/").otherwise(F.regexp_replace(path, "/{2,}", "/"))
    valid = scheme.isin("http", "https") & (host != "") & ~authority.contains("@") & ((port == "") | (F.try_to_number(F.nullif(port, F.lit("")), F.lit("99999999")) <= 65535)) & authority.rlike("^[^:]*(:[0-9]*)?$")
    return F.when(valid, F.concat(scheme, F.lit("://"), host, F.when(default, "").otherwise(F.concat(F.lit(":"), port)), path, query))


def web_host(address: Column) -> Column:
    return F.regexp_extract(address, "^[a-z]+://([^/:?#]*)", 1)


def link_type(address: Column) -> Column:
    """The service of a link, by its host."""
    host, out = web_host(address), None
    tests = {"equals": lambda v: host == v, "contains": host.contains, "ends": host.endswith}
    for kind, how, values in LINK_HOSTS:
        found = reduce(lambda a, b: a | b, [tests[how](v) for v in values])
        out = F.when(found, kind) if out is None else out.when(found, kind)
    return out.otherwise("other")


def company_key(text: Column) -> Column:
    """Letters and digits of a name without legal forms."""
    return F.regexp_replace(F.regexp_replace(folded(text), rf"(?U)\b(?:{'|'.join(LEGAL_FORMS)})\b", " "), "[^a-zа-я0-9]+", "")


def excel_column(n: int) -> str:
    """A to Z, AA and on, from 1."""
    name = ""
    while n:
        n, k = divmod(n - 1, 26)
        name = chr(65 + k) + name
    return name
