"""Counters of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.text import has_text, q, strip
from leadloom.operators.mapping import REASON

# fixed values: names of the run counters, in report order
COUNTERS = (
    "input_rows", "mapped_valid_rows", "rejected_rows", "deduped_rows", "enriched_rows", "google_maps_attempted",
    "google_maps_matched", "google_maps_failed", "google_maps_location_normalized", "conflicts_resolved",
    "replacements_performed", "invalid_candidates", "schema_contacts_used", "email_disposable_rejected",
    "multi_page_fetch_success", "phone_e164_valid_rate", "scored_rows",
)


def _input_counts(tagged: DataFrame) -> DataFrame:
    return tagged.agg(
        F.expr("count(*)").alias("input_rows"),
        F.expr(f"count_if({REASON} IS NULL)").alias("mapped_valid_rows"),
        F.expr(f"count_if({REASON} IS NOT NULL)").alias("rejected_rows"),
    )


def lead_counts(resolved: DataFrame, places_on: bool = True, scoring_on: bool = True) -> DataFrame:
    """Counters over resolved leads, with the phone rate's two sums so that they can be added up further."""
    stats = "enrichment_history.diagnostics.website"
    moved = (
        f"{has_text('staged_location')} "
        f"AND NOT {strip('staged_location')} <=> {strip('coalesce(before_place_location, ' + q('') + ')')}"
    )
    counters = {
        "deduped_rows": "count(*)",
        "enriched_rows": "count(*)",
        "google_maps_attempted": "count(*)" if places_on else "0",
        "google_maps_matched": "count_if(contains(coalesce(source, ''), 'google_maps'))" if places_on else "0",
        "google_maps_failed": "count(google_maps_error)" if places_on else "0",
        "google_maps_location_normalized": f"count_if({moved})" if places_on else "0",
        "conflicts_resolved": "sum(ties_resolved)",
        "replacements_performed": "sum(fields_replaced)",
        "invalid_candidates": "sum(invalid_candidates)",
        **{n: f"sum({stats}.{n})" for n in ("schema_contacts_used", "email_disposable_rejected", "multi_page_fetch_success")},
        "phones_valid": f"sum({stats}.phone_valid_count)",
        "phones_total": f"sum({stats}.phone_total_candidates)",
        "scored_rows": "count(*)" if scoring_on else "0",
    }
    return resolved.agg(*[F.expr(f"CAST(coalesce({x}, 0) AS BIGINT)").alias(n) for n, x in counters.items()])


def rate(valid: str, total: str) -> Column:
    """Share rounded to four decimals, 0 when there is nothing to divide by."""
    return F.expr(f"if({total} > 0, round({valid} / {total}, 4), 0D)")


def run_summary(tagged: DataFrame, resolved: DataFrame, places_on: bool = True, scoring_on: bool = True) -> DataFrame:
    """One row with all counters of a run."""
    parts = _input_counts(tagged).unionByName(lead_counts(resolved, places_on, scoring_on), allowMissingColumns=True)
    merged = parts.agg(*[F.max(c).alias(c) for c in parts.columns])
    return merged.withColumn("phone_e164_valid_rate", rate("phones_valid", "phones_total")).select(*COUNTERS)
