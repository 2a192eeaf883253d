"""Place stage: geocoded location, best place for a company, and the place's details.

The text search of a place directory is a table of answers keyed by the query text; all of them are candidates unless
`PlaceOptions.max_candidates` says otherwise. Matching is done once per distinct (company, location), not once per lead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom import constants as K
from leadloom.functions.normalize import request_key
from leadloom.functions.similarity import name_similarity
from leadloom.functions.text import NO_TEXT, blank_to_null, has_text, strip
from leadloom.operators.dedup import first_per_key
from leadloom.operators.lookup import HOT_KEY_SALTS, lookup_left
from leadloom.operators.normalize import replace_columns
from leadloom.settings import PlaceOptions
from leadloom.sources.tables import Snapshots

MISSING_SOURCE = "missing_place_source"


def usable_location(x: str) -> str:
    return f"coalesce(length({strip(x)}) >= {K.MIN_LOCATION_CHARS}, false)"


def one_answer(geocodes: DataFrame) -> DataFrame:
    """The first answer of each location, in the shape of the table."""
    first = F.expr("min_by(struct(rank, formatted_address), struct(rank, formatted_address))").alias("_f")
    return geocodes.groupBy(F.expr(strip("raw_location")).alias("raw_location")).agg(first).select("raw_location", "_f.*")


def normalize_locations(leads: DataFrame, geocodes: DataFrame | None) -> DataFrame:
    """Add `normalized_location`: the first geocoding answer for the location, if it is long enough to ask."""
    if geocodes is None:
        return leads.selectExpr("*", f"{NO_TEXT} AS normalized_location")
    first = "min_by(formatted_address, struct(rank, formatted_address))"
    answers = geocodes.groupBy(F.expr(strip("raw_location")).alias("_asked")).agg(
        F.expr(blank_to_null(first)).alias("normalized_location")
    )
    asked = leads.selectExpr("*", f"if({usable_location('location')}, {strip('location')}, NULL) AS _asked")
    return lookup_left(asked, answers, "_asked", salts=HOT_KEY_SALTS).drop("_asked")


def with_request(leads: DataFrame) -> DataFrame:
    """Add `place_request`, the key of a lead's (company, normalized_location); null without a company."""
    key = f"concat_ws('\u0001', {strip('company_name')}, coalesce(normalized_location, ''))"
    return leads.selectExpr("*", f"if({has_text('company_name')}, {key}, NULL) AS place_request")


def place_queries(leads: DataFrame) -> DataFrame:
    """Distinct (place_request, company, normalized_location) of leads that have a company name."""
    return (
        with_request(leads)
        .where("place_request IS NOT NULL")
        .selectExpr("place_request", f"{strip('company_name')} AS company", "normalized_location")
        .distinct()
    )


def match_candidates(queries: DataFrame, place_search: DataFrame, opts: PlaceOptions = PlaceOptions()) -> DataFrame:
    """Scored candidates of each query: name and location first (tier 1), name only (tier 2) as fallback.

    Names are compared once per distinct (query, company), and of the answers at one address only the best stays, before
    the locations of a company meet the answers to its name.
    """
    tiers = (
        f"array(named_struct('tier', 1, 'query', {request_key('company', 'normalized_location')}), "
        f"named_struct('tier', 2, 'query', if(normalized_location IS NOT NULL, {request_key('company')}, NULL)))"
    )
    asked = queries.selectExpr("*", f"inline(filter({tiers}, tq -> tq.query IS NOT NULL)) AS (tier, query)")
    taken = place_search if opts.max_candidates is None else place_search.where(f"rank <= {opts.max_candidates}")
    answers = taken.selectExpr(
        f"{request_key('query')} AS query", "rank", "place_id", "name", "formatted_address"
    )
    near = f"contains(lower({strip('formatted_address')}), lower({strip('normalized_location')}))"
    adjust = (
        f"CASE WHEN NOT {usable_location('normalized_location')} THEN 0D "
        f"WHEN {near} THEN {K.LOCATION_BONUS}D ELSE -{K.LOCATION_PENALTY}D END"
    )
    named = asked.select("query", "company").distinct().join(answers, "query").withColumn(
        "name_score", name_similarity("company", "name", opts.min_name_match, opts.similarity)
    )
    passed = f"name_score >= {float(opts.min_name_match)}D"
    # the location changes the scores of one address alike, so the best of them is known before
    best = named.groupBy("query", "company", "formatted_address").agg(
        F.expr(
            "max_by(struct(rank, place_id, name, name_score), "
            f"struct(if({passed}, name_score, -10D), -rank, place_id))"
        ).alias("_b")
    )
    scored = asked.join(best.select("query", "company", "formatted_address", "_b.*"), ["query", "company"])
    return scored.selectExpr("*", f"if({passed}, name_score + {adjust}, NULL) AS match_score")


def best_places(candidates: DataFrame) -> DataFrame:
    """(place_request, place_id, ...): best candidate of the first tier that had any answer; earlier rank on ties."""
    best = candidates.groupBy("place_request").agg(
        F.expr(
            "max_by(struct(tier, rank, place_id, name, match_score), "
            "struct(-tier, coalesce(match_score, -10D), -rank, place_id))"
        ).alias("b")
    )
    return best.where(f"b.match_score IS NOT NULL AND {has_text('b.place_id')}").selectExpr(
        "place_request", f"{strip('b.place_id')} AS place_id", "b.name AS place_name", "b.tier", "b.match_score"
    )


def place_details(places: DataFrame) -> DataFrame:
    """(place_id, details): international phone preferred over national, blanks as null."""
    cleaned = places.where(has_text("place_id")).selectExpr(
        f"{strip('place_id')} AS place_id",
        f"{blank_to_null('website_uri')} AS website",
        f"coalesce({blank_to_null('international_phone')}, {blank_to_null('national_phone')}) AS phone",
        f"{blank_to_null('formatted_address')} AS address",
    )
    one = first_per_key(cleaned, ["place_id"], "struct(website, phone, address)")
    return one.selectExpr("place_id", "struct(website, phone, address) AS details")


def one_place(places: DataFrame) -> DataFrame:
    """The details that count of each place, in the shape of the table."""
    return place_details(places).selectExpr(
        "place_id", f"{NO_TEXT} AS name", "details.address AS formatted_address", "details.website AS website_uri",
        f"{NO_TEXT} AS national_phone", "details.phone AS international_phone",
    )


def match_places(leads: DataFrame, snapshots: Snapshots, opts: PlaceOptions = PlaceOptions()) -> DataFrame:
    """Leads with `place` = STRUCT<place_id, place_name, tier, match_score, details>; null where none matched.

    Expects `normalized_location` (see `normalize_locations`).
    """
    matched = best_places(match_candidates(place_queries(leads), snapshots.place_search, opts))
    # details are joined per distinct request; a place without details counts as no match
    detailed = matched.join(place_details(snapshots.places), "place_id").selectExpr(
        "place_request", "struct(place_id, place_name, tier, match_score, details) AS place"
    )
    return lookup_left(with_request(leads), detailed, "place_request", salts=HOT_KEY_SALTS).drop("place_request")


def append_source(source: str, tag: str = "google_maps") -> str:
    s = strip(f"coalesce({source}, '')")
    return f"CASE WHEN {s} = '' THEN '{tag}' WHEN contains({s}, '{tag}') THEN {source} ELSE {s} || ',{tag}' END"


def fill_from_place(matched: DataFrame) -> DataFrame:
    """Write a matched place onto its lead: missing website and phone, location, source tag."""
    return replace_columns(
        matched,
        {
            "website": "coalesce(nullif(website, ''), place.details.website)",
            "phone": "coalesce(nullif(phone, ''), place.details.phone)",
            # a location that could not be geocoded gives way to the place's address
            "location": "if(place.details.address IS NOT NULL, "
            "coalesce(normalized_location, place.details.address), location)",
            "source": f"if(place IS NOT NULL, {append_source('source')}, source)",
            "place_website": "place.details.website",
            "place_phone": "place.details.phone",
            "place_location": "if(place IS NOT NULL, coalesce(place.details.address, normalized_location), NULL)",
            "google_maps_error": NO_TEXT,
        },
    ).drop("place", "normalized_location")


def skip_places(leads: DataFrame, error: str | None = None) -> DataFrame:
    message = f"'{error}'" if error else NO_TEXT
    return leads.selectExpr(
        "*", f"{NO_TEXT} AS place_website", f"{NO_TEXT} AS place_phone", f"{NO_TEXT} AS place_location",
        f"{message} AS google_maps_error",
    )


def enrich_from_places(leads: DataFrame, snapshots: Snapshots, opts: PlaceOptions = PlaceOptions()) -> DataFrame:
    if not opts.enabled:
        return skip_places(leads)
    if snapshots.place_search is None or snapshots.places is None:
        return skip_places(leads, MISSING_SOURCE)
    return fill_from_place(match_places(normalize_locations(leads, snapshots.geocodes), snapshots, opts))


def unmatched(leads: DataFrame, found: DataFrame, on: str = "row_id") -> DataFrame:
    """Leads without a row in `found`."""
    return leads.join(found.select(on), on, "left_anti")
