"""The whole run: mapped rows in, resolved, graded and scored leads out."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.operators.dedup import dedup_leads
from leadloom.operators.mapping import rejected_rows, valid_leads
from leadloom.operators.normalize import normalize_leads, typed_leads
from leadloom.operators.pages import enrich_from_pages, one_link, page_lookup, page_signals, skip_pages
from leadloom.operators.places import enrich_from_places, one_answer, one_place
from leadloom.operators.resolve import keep_stage, resolve_leads
from leadloom.operators.score import score_leads
from leadloom.operators.stages import in_plan, stage_table
from leadloom.operators.summary import run_summary
from leadloom.operators.verify import verify_leads
from leadloom.settings import RunOptions
from leadloom.sources.tables import Snapshots

# fixed values: columns of the lead table
LEAD_COLUMNS = (
    "row_id", "company_name", "agent_name", "website", "email", "phone", "location", "source", "has_chatbot",
    "website_speed_score", "last_updated_signal", "contact_quality", "verification", "lead_score", "lead_reason",
    "confidence_score", "enrichment_error", "google_maps_error", "enrichment_history",
)


@dataclass(frozen=True)
class LeadRun:
    tagged: DataFrame  # mapped rows with their reject reason
    resolved: DataFrame  # final leads with the counters of the summary
    options: RunOptions

    @property
    def leads(self) -> DataFrame:
        return self.resolved.select(*LEAD_COLUMNS)

    @property
    def rejects(self) -> DataFrame:
        return rejected_rows(self.tagged)

    @property
    def summary(self) -> DataFrame:
        return run_summary(self.tagged, self.resolved, self.options.places.enabled, self.options.score.enabled)


def clean_leads(tagged: DataFrame, opts: RunOptions = RunOptions()) -> DataFrame:
    """Valid rows, normalised, first of each identity."""
    return typed_leads(dedup_leads(normalize_leads(valid_leads(tagged), opts.normalize), opts.normalize))


@dataclass(frozen=True)
class Lookups:
    """What leads are looked up in, reduced to one row per key and written once for several runs over the same snapshots."""

    pages: DataFrame | None
    snapshots: Snapshots


def page_lookups(snapshots: Snapshots, opts: RunOptions = RunOptions()) -> Lookups:
    pages, found, geocodes, places = snapshots.site_pages, snapshots.search_results, snapshots.geocodes, snapshots.places
    if opts.pages.enabled and pages is not None:
        pages = stage_table(page_lookup(page_signals(pages, opts.pages)), "page-lookup")
        if opts.pages.discover and found is not None:
            found = stage_table(one_link(found, opts.pages), "search-links")
    if opts.places.enabled and geocodes is not None:
        geocodes = stage_table(one_answer(geocodes), "geocodes")
    if opts.places.enabled and places is not None:
        places = stage_table(one_place(places), "places")
    return Lookups(pages, replace(snapshots, search_results=found, geocodes=geocodes, places=places))


def staged_leads(
    cleaned: DataFrame, snapshots: Snapshots, opts: RunOptions = RunOptions(), lookups: Lookups | None = None
) -> DataFrame:
    """Leads after the page and the place stage, with the values each stage started from."""
    snapshots = lookups.snapshots if lookups else snapshots
    keep = stage_table if opts.stage_tables else in_plan
    based = keep_stage(keep(cleaned, "clean"), "base")
    if opts.pages.enabled and snapshots.site_pages is not None:
        lookup = lookups.pages if lookups else keep(page_lookup(page_signals(snapshots.site_pages, opts.pages)), "page-lookup")
        paged = keep(
            enrich_from_pages(based, lookup, snapshots.search_results, opts.pages, opts.phone_region, keep), "paged"
        )
    else:
        paged = skip_pages(based)
    placed = enrich_from_places(keep_stage(paged, "site"), snapshots, opts.places)
    return placed.selectExpr("*", "site_location AS before_place_location", "location AS staged_location")


def finish_leads(staged: DataFrame, opts: RunOptions = RunOptions()) -> DataFrame:
    """Resolve conflicts, grade contacts, score. All within the row."""
    resolved = verify_leads(resolve_leads(staged, opts.run_ts, opts.resolve), opts.phone_region)
    with_proof = resolved.withColumn(
        "enrichment_history", F.col("enrichment_history").withField("verification", F.col("verification"))
    )
    return score_leads(with_proof, opts.score)


def run_leads(tagged: DataFrame, snapshots: Snapshots = Snapshots(), opts: RunOptions = RunOptions()) -> LeadRun:
    """`tagged` comes from sources.files.read_leads or operators.mapping.tag_rejects."""
    final = finish_leads(staged_leads(clean_leads(tagged, opts), snapshots, opts), opts)
    if opts.stage_tables:
        final = stage_table(final, "leads")
    return LeadRun(tagged, final, opts)


__all__ = ["LEAD_COLUMNS", "LeadRun", "Lookups", "clean_leads", "finish_leads", "page_lookups", "run_leads", "staged_leads"]
