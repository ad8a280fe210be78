"""Classification of buildings, overrides by verified facts, evidence and duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolith.functions.scalars import finite, positive

# Fixed values of the domain: kinds of buildings, amenities, lifecycle prefixes.
RESIDENTIAL = ("apartments", "residential", "house", "detached", "terrace", "dormitory", "semidetached_house", "bungalow", "static_caravan", "ger")
NON_RESIDENTIAL = (
    "commercial", "retail", "industrial", "warehouse", "school", "kindergarten", "hospital", "office", "church", "garage", "garages",
    "service", "train_station", "public", "civic", "sports_centre", "construction",
)
NON_RESIDENTIAL_AMENITIES = ("school", "kindergarten", "hospital", "place_of_worship", "fuel")
LIFECYCLE_KEYS = ("abandoned:building", "disused:building", "demolished:building", "razed:building", "ruins:building", "construction:building")
CONTOUR_ISSUES = ("identical_geometry_duplicate", "nested_or_nearly_duplicate_geometry", "partial_footprint_overlap", "duplicate_osm_address", "building_part_requires_parent_review")
AMBIGUOUS_WEIGHT = 0.55


def tag(tags: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(tags, F.lit(name)), F.lit(""))


def proxy_parameters(tags: Column, amenities: bool = True) -> Column:
    """Struct of weighted levels, and whether the use is explicit and the levels observed; null for no residential building.

    A building of no stated use counts with a reduced weight if it has an address and, where
    ``amenities`` holds, no amenity that excludes residents.
    """
    kind, amenity = tag(tags, "building"), tag(tags, "amenity")
    explicit = kind.isin(*RESIDENTIAL)
    addressed = (kind == "yes") & ((tag(tags, "addr:housenumber") != "") | (tag(tags, "addr:street") != ""))
    weight = F.when(kind.isin(*NON_RESIDENTIAL), 0.0).when(explicit, 1.0)
    if amenities:
        weight = weight.when(amenity.isin(*NON_RESIDENTIAL_AMENITIES), 0.0)
    weight = weight.when(addressed, AMBIGUOUS_WEIGHT).otherwise(0.0)
    stated = F.replace(F.btrim(tag(tags, "building:levels")), F.lit(","), F.lit(".")).try_cast("double")
    observed = F.coalesce(finite(stated) & stated.between(0.5, 80), F.lit(False))
    assumed = F.when(kind.isin("apartments", "dormitory"), 5.0).when(kind == "residential", 2.0).otherwise(1.0)
    levels = F.when(observed, stated).otherwise(assumed)
    return F.when(weight > 0, F.struct((levels * weight).alias("proxy"), explicit.alias("explicit"), observed.alias("observed")))


def factor(tags: Column) -> Column:
    """Struct of weight and reason of the generic classification."""
    kind = tag(tags, "building")
    addressed = (kind == "yes") & ((tag(tags, "addr:housenumber") != "") | (tag(tags, "addr:street") != ""))
    weight = F.when(kind.isin(*RESIDENTIAL), 1.0).when(kind.isin(*NON_RESIDENTIAL), 0.0).when(addressed, AMBIGUOUS_WEIGHT).otherwise(0.0)
    reason = F.when(kind.isin(*RESIDENTIAL), "explicit_residential").when(kind.isin(*NON_RESIDENTIAL), "excluded_non_residential").when(addressed, "ambiguous_addressed").otherwise("excluded_unclassified")
    return F.struct(weight.alias("weight"), reason.alias("reason"))


def overridden(parameters: Column, area: Column, use: Column, verified_area: Column, verified_storeys: Column) -> Column:
    """Struct of proxy, flags and what is verified: confirmed uses and sizes go before tags.

    A confirmed non-residential use drops the building. A verified residential area is divided by the
    footprint; a confirmed use lifts the reduced weight without inventing storeys; verified storeys
    count for residential buildings only.
    """
    base = F.when((use.isin("residential", "mixed")) & ~F.coalesce(parameters["explicit"], F.lit(False)), F.coalesce(parameters["proxy"] / AMBIGUOUS_WEIGHT, F.lit(1.0))).otherwise(parameters["proxy"])
    levels = F.when(verified_area.isNotNull(), verified_area / area).when(verified_storeys.isNotNull() & (use == "residential"), verified_storeys).otherwise(base)
    out = F.struct(levels.alias("proxy"), F.coalesce(use.isin("residential", "mixed") | parameters["explicit"], F.lit(False)).alias("explicit"), F.coalesce(parameters["observed"], F.lit(False)).alias("observed"), verified_area.isNotNull().alias("verified_area"), (verified_area.isNull() & verified_storeys.isNotNull()).alias("verified_storeys"))
    return F.when(~F.coalesce(use == "non_residential", F.lit(False)) & levels.isNotNull(), out)


def confirmed_weight(area: Column, apartments: Column, occupied: Column, floors: Column, footprint: Column) -> Column:
    """Struct of method, unit and weight by the best confirmed fact: area, occupied apartments, floors."""
    make = lambda method, unit, w: F.struct(F.lit(method).alias("method"), F.lit(unit).alias("unit"), w.cast("double").alias("weight"))
    return F.when(area > 0, make("residential_area", "m2", area)).when((apartments > 0) & occupied.isNotNull(), make("occupied_apartments", "apartments", apartments * occupied)).when(floors > 0, make("floors", "m2", floors * footprint))


def reported_use(tags: Column) -> Column:
    """mixed, residential, non_residential or null, as the tags report it."""
    kind, amenity = tag(tags, "building"), tag(tags, "amenity")
    explicit = kind.isin(*RESIDENTIAL)
    facility = kind.isin(*NON_RESIDENTIAL) | amenity.isin(*NON_RESIDENTIAL_AMENITIES)
    return F.when(explicit & ((tag(tags, "shop") != "") | (amenity != "")), "mixed").when(explicit, "residential").when(facility, "non_residential")


def lifecycle(tags: Column) -> Column:
    """Whether a tag says that a building may stand empty or unfinished."""
    marked = F.exists(F.filter(F.map_entries(tags), lambda e: e["value"] != ""), lambda e: e["key"].isin(*LIFECYCLE_KEYS))
    return F.coalesce(marked, F.lit(False)) | tag(tags, "building").isin("construction", "ruins") | (tag(tags, "abandoned") == "yes") | (tag(tags, "disused") == "yes")


def review_flags(tags: Column) -> Column:
    """Sorted flags of mixed use, parts and lifecycle."""
    mixed = tag(tags, "building").isin(*RESIDENTIAL) & ((tag(tags, "shop") != "") | (tag(tags, "office") != "") | (tag(tags, "amenity") != ""))
    flags = (F.when(mixed, "mixed_use_requires_residential_area"), F.when(tag(tags, "building:part") != "", "building_part_or_outline_requires_geometry_review"), F.when(lifecycle(tags), "lifecycle_osm_signal_unverified"))
    return F.array_sort(F.array_compact(F.array(*flags)))


def building_issues(tags: Column, area: Column, valid: Column, candidates: Column, places: Column, settlement: Column, **evidence: Column) -> Column:
    """Sorted flags of a contour: ``candidates`` register rows by address, ``places`` its named localities, the model's ``settlement``.

    ``evidence`` may hold booleans: ``alias``, the candidates were found by a locality's other name; ``flagged``, one of them has flags of its
    own; ``storeys_conflict`` and ``area_conflict``, sources differ; ``residential_exceeds``, a residential area above its building's.
    """
    unknown = evidence.keys() - {"alias", "flagged", "storeys_conflict", "area_conflict", "residential_exceeds"}
    if unknown:
        raise ValueError(f"unknown evidence: {sorted(unknown)}")
    told = lambda k: F.coalesce(evidence.get(k, F.lit(False)), F.lit(False))
    kind = tag(tags, "building")
    facility = kind.isin(*NON_RESIDENTIAL) | tag(tags, "amenity").isin(*NON_RESIDENTIAL_AMENITIES)
    storeys, flats = positive(tag(tags, "building:levels"), True, 80), positive(tag(tags, "building:flats"), True, 10_000)
    modelled = kind.isin(*RESIDENTIAL) | proxy_parameters(tags).isNotNull()
    rules = {
        "residential_facility_conflict": kind.isin(*RESIDENTIAL) & facility,
        "invalid_or_fractional_osm_storeys": (tag(tags, "building:levels") != "") & storeys.isNull(),
        "invalid_osm_apartments": (tag(tags, "building:flats") != "") & flats.isNull(),
        "invalid_geometry": ~valid,
        "footprint_area_outside_model_range": ~area.between(12, 80_000),
        "building_part_requires_parent_review": tag(tags, "building:part") != "",
        "occupancy_cannot_be_assumed": (tag(tags, "abandoned") == "yes") | (tag(tags, "disused") == "yes") | kind.isin("construction", "ruins"),
        "storeys_assumed_by_model": storeys.isNull() & modelled,
        "building_use_unknown": reported_use(tags).isNull(),
        "address_incomplete": (tag(tags, "addr:housenumber") == "") | (tag(tags, "addr:street") == ""),
        "osm_locality_differs_from_model_domain": settlement.isNotNull() & (F.size(places) > 0) & ~F.array_contains(places, settlement),
        "multiple_official_address_rows": candidates > 1,
        "dos_locality_alias_requires_review": told("alias") & (candidates > 0),
        "official_source_has_quality_flags": told("flagged") & (candidates > 0),
        "storeys_source_conflict": told("storeys_conflict"),
        "gross_area_source_conflict": told("area_conflict"),
        "gis_residential_area_exceeds_gross": told("residential_exceeds"),
    }
    return F.array_sort(F.array_compact(F.array(*(F.when(v, k) for k, v in rules.items()))))


def prefixed(tags: Column, prefix: str) -> Column:
    return F.map_filter(tags, lambda k, v: k.startswith(prefix))


def without_excluded(buildings: DataFrame, exclusions: DataFrame, name: str, tags: str) -> tuple[DataFrame, DataFrame]:
    """Buildings not on the list, and entries of the list that are stale: unknown, changed since, or without source or reason."""
    kept = buildings.join(exclusions.select(name), name, "left_anti")
    seen = exclusions.join(buildings.select(name, F.to_json(tags).alias("_now")), name, "left")
    stale = seen.where(F.col("_now").isNull() | (F.col("_now") != F.to_json("expected_tags")) | (F.coalesce("source_url", F.lit("")) == "") | (F.coalesce("reason", F.lit("")) == ""))
    return kept, stale.select(name)


def deduplicated(df: DataFrame, signature: str, parameters: list[str], order: list[str]) -> DataFrame:
    """Groups of one signature: the smallest member, the number of members, and whether their parameters conflict.

    A conflicting group keeps nobody: ``kept`` is null then.
    """
    key = F.struct(*order)
    found = df.groupBy(signature).agg(F.count("*").alias("members"), F.min(F.struct(*parameters)).alias("_low"), F.max(F.struct(*parameters)).alias("_high"), F.min(key).alias("_kept"))
    conflict = ~F.col("_low").eqNullSafe(F.col("_high"))
    return found.select(signature, "members", conflict.alias("conflicting"), F.when(~conflict, F.col("_kept")).alias("kept"))


def preferred_member(tags: Column, kind: Column, name: Column) -> Column:
    """Sort key of the member that stands for equal geometries: most address tags, ways first, least id."""
    known = sum((F.map_contains_key(tags, k).cast("int") for k in ("addr:street", "addr:housenumber", "addr:city", "building:levels")), F.lit(0))
    return F.struct((-known).alias("tags"), (kind != "way").alias("other"), name.alias("id"))


def match_status(quarantined: Column, address: Column, context: Column, alias: Column, ambiguous: Column) -> Column:
    """The ladder of a contour's match; ambiguity overrides it."""
    return F.when(ambiguous, "ambiguous").when(quarantined, "quarantined").when(address, "address_candidate").when(context, "context_candidate").when(alias, "alias_review").otherwise("unmatched")


def link_flags(places: Column, street: Column, house: Column, official: Column, contours: Column, houses: Column, area: Column, gross: Column, storeys: Column, issues: Column) -> Column:
    """Sorted flags of a contour linked with a register's house.

    ``places`` are the contour's localities, ``street`` a struct of type and name, ``official`` a struct of
    locality, street type, street name and house number; ``contours`` and ``houses`` count partners.
    """
    ratio = F.when(gross.isNotNull() & (area > 0), gross / area)
    rules = {
        "locality_inferred_from_model_domain": F.size(places) == 0,
        "explicit_osm_locality_conflict": (F.size(places) > 0) & ~F.array_contains(places, official["locality"]),
        "multiple_explicit_localities": F.size(places) > 1,
        "street_type_conflict": street["street_type"] != official["street_type"],
        "street_type_not_fully_specified": street["street_type"].isNull() | official["street_type"].isNull(),
        "street_name_alias_requires_independent_confirmation": street["street_name"] != official["street_name"],
        "house_number_conflict": house != official["house_number"],
        "official_house_has_multiple_contours": contours != 1,
        "contour_has_multiple_official_houses": houses != 1,
        "gross_area_vs_footprint_requires_extent_check": (ratio < 0.6) | ((storeys > 0) & (ratio > storeys * 2.5)),
    }
    own = F.array_intersect(issues, F.array(*map(F.lit, CONTOUR_ISSUES)))
    return F.array_sort(F.array_distinct(F.concat(F.array_compact(F.array(*(F.when(v, k) for k, v in rules.items()))), own)))


def link_status(flags: Column) -> Column:
    """The gravest status that a link's flags allow; none is ever confirmed."""
    any_of = lambda *names: F.arrays_overlap(flags, F.array(*map(F.lit, names)))
    return (
        F.when(any_of("street_type_conflict", "house_number_conflict"), "quarantined_text_conflict")
        .when(any_of("official_house_has_multiple_contours", "contour_has_multiple_official_houses", "multiple_explicit_localities"), "ambiguous")
        .when(any_of("explicit_osm_locality_conflict", "street_name_alias_requires_independent_confirmation", "locality_inferred_from_model_domain"), "locality_or_alias_review_required")
        .otherwise("text_consistent_geometry_unverified")
    )


def review_status(prior: Column, candidates: Column, slots: Column, own: Column) -> Column:
    """An address's review: blocked, an alias, one explicit candidate with one slot of its own, other candidates, none."""
    unique = (candidates == 1) & (slots == 1) & own
    return F.when(prior == "quarantined", "conflict_blocked").when(prior == "alias_review", "alias_requires_independent_identity").when(unique, "unique_explicit_candidate_contour_unverified").when(candidates > 0, "candidate_requires_review").otherwise("no_candidate")


def coverage_reason(modelled: Column, population: Column, threshold: int = 2500) -> Column:
    """Why a settlement has a density model or has none."""
    return F.when(modelled, "covered_by_own_model").when(population.isNull(), "population_unknown").when(population < threshold, "below_2500_threshold").otherwise("above_threshold_without_model")


def other_domains(settlements: DataFrame, domains: DataFrame, key: str, name: str) -> DataFrame:
    """Settlements (key, x, y) and ``point_in_other_domain``: the names, joined by ``;``, of the domains (key, name, ``ring``) of others that cover their point."""
    from geolith.operators.spatial import points_in_polygons

    shapes = domains.select(F.col(key).alias("_domain"), F.col(name).alias("_called"), "ring")
    hits = points_in_polygons(settlements.select(key, "x", "y"), shapes, key, "_domain").where(F.col(key) != F.col("_domain"))
    names = hits.join(shapes.select("_domain", "_called").distinct(), "_domain").groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("_called")), ";").alias("point_in_other_domain"))
    return settlements.join(names, key, "left").withColumn("point_in_other_domain", F.coalesce("point_in_other_domain", F.lit("")))


def cell_confidence(explicit: Column, proxy: Column, buildings: Column, grid: Column) -> Column:
    """medium for a cell of enough buildings, by its size, whose proxy is mostly explicit; else low."""
    enough = F.greatest(F.lit(3), F.bround(8 * (grid / 500) * (grid / 500), 0).cast("int"))
    return F.when((buildings >= enough) & (explicit / proxy >= 0.7), "medium").otherwise("low")


def verified_cell_confidence(verified: Column, explicit: Column, observed: Column, proxy: Column, buildings: Column) -> Column:
    return F.when(verified & (explicit / proxy >= 0.7) & (observed / proxy >= 0.5) & (buildings >= 3), "medium").otherwise("low")


def candidate_places(df: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """Places with capacity, or included by name; never those excluded."""
    return df.where(((F.col("capacity") > 0) | F.col("name").isin(*include)) & ~F.col("name").isin(*exclude))


def store_flags(valid: Column, municipalities: Column, claimed: Column, locality: Column, key: Column, anchor_m: Column, anchor_fits: Column, partner_m: Column, partners: Column, on_building: Column) -> Column:
    """Sorted flags of a catalogue card: its point, the region it claims, its address, the place it names, partners, buildings.

    ``municipalities`` counts those around the point; ``anchor_m`` is null if the named place is unknown.
    """
    rules = {
        "missing_or_invalid_coordinates": ~valid,
        "coordinate_outside_region": valid & (municipalities == 0),
        "ambiguous_municipality": valid & (municipalities > 1),
        "other_region_card_in_region": (municipalities > 0) & ~claimed,
        "locality_not_parsed": locality.isNull(),
        "address_requires_manual_normalization": key.isNull(),
        "catalog_locality_municipality_conflict": anchor_m.isNotNull() & (municipalities > 0) & ~anchor_fits,
        "more_than_15km_from_named_place_point": anchor_m > 15_000,
        "named_locality_not_in_local_point_catalog": locality.isNotNull() & anchor_m.isNull(),
        "address_matching_store_more_than_200m_away": partner_m > 200,
        "multiple_store_address_candidates": partners > 1,
        "not_on_mapped_building_not_proven_coordinate_error": valid & ~on_building,
    }
    return F.array_sort(F.array_compact(F.array(*(F.when(v, k) for k, v in rules.items()))))


def published_flags(card: Column, same: Column, properties_fit: Column, inside: Column) -> Column:
    """Sorted flags of a published store against its snapshot: whether a card is there, has its point, agrees with its properties, lies inside."""
    rules = {"not_in_saved_html": ~card, "coordinate_differs_from_saved_html": card & ~same, "property_geometry_coordinate_mismatch": ~properties_fit, "outside_municipal_union": ~inside}
    return F.array_sort(F.array_compact(F.array(*(F.when(v, k) for k, v in rules.items()))))


def confidence(quality: Column) -> Column:
    """high, medium or low, by the kind of population control."""
    return F.when(quality.isin("official_current", "official_rounded_100"), "high").when(quality == "official_census_exact", "medium").otherwise("low")
