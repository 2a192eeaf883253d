"""Registered queries: each operator over whole tables. Arrays are joined to text so that engines can be compared."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import partial, reduce

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom import sinks
from leadloom.constants import CANONICAL_FIELDS
from leadloom.functions import html as H
from leadloom.functions.contacts import check_email, check_phone
from leadloom.operators import analytics, dedup, explore, mapping, pages, places, resolve, runs, score, stages, verify
from leadloom.operators.lead_table import LeadTable
from leadloom.operators.normalize import normalize_leads
from leadloom.plans.lead_run import LeadRun, clean_leads, finish_leads, run_leads, staged_leads
from leadloom.settings import MappingOptions, PageOptions, PlaceOptions, RunOptions, ScoreOptions
from leadloom.sources.tables import Snapshots
from leadloom.streaming.incremental import IncrementalLeads
from workload.views import view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# similarity that SQL can repeat, the default of the library
LEVENSHTEIN = PlaceOptions(similarity="levenshtein")
FULL = RunOptions(places=LEVENSHTEIN, stage_tables=True)
OFFLINE = RunOptions(pages=PageOptions(enabled=False), places=PlaceOptions(enabled=False))
PROFILES = {
    "default": ScoreOptions(),
    "contacts_first": ScoreOptions(base_score=30, weights={"contact_quality_verified": 40.5, "has_website": 5.0}),
    "strict": ScoreOptions(base_score=20, weights={"contact_quality_low": -40.0, "website_speed_high_threshold": 95.5}),
}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def joined(c: Column | str) -> Column:
    return F.array_join(c, "|")


# --- shared inputs ------------------------------------------------------------------------


def tagged(spark: SparkSession, sf: str, opts: MappingOptions = MappingOptions()) -> DataFrame:
    raw = view(spark, sf, "leads_raw").withColumnRenamed("row_index", "row_id")
    return mapping.tag_rejects(mapping.map_columns(raw, opts), opts)


def normalized(spark: SparkSession, sf: str) -> DataFrame:
    return normalize_leads(mapping.valid_leads(tagged(spark, sf)))


def clean(spark: SparkSession, sf: str) -> DataFrame:
    return clean_leads(tagged(spark, sf))


def signals(spark: SparkSession, sf: str) -> DataFrame:
    return pages.page_signals(view(spark, sf, "site_pages"))


def snapshots(spark: SparkSession, sf: str) -> Snapshots:
    names = ("site_pages", "search_results", "geocodes", "place_search", "places")
    return Snapshots(**{n: view(spark, sf, n) for n in names})


def full_run(spark: SparkSession, sf: str, opts: RunOptions = FULL) -> LeadRun:
    return run_leads(tagged(spark, sf), snapshots(spark, sf), opts)


def offline_leads(spark: SparkSession, sf: str) -> DataFrame:
    return run_leads(tagged(spark, sf), opts=OFFLINE).leads


def gathered_sites(spark: SparkSession, sf: str) -> DataFrame:
    lookup = stages.stage_table(pages.page_lookup(signals(spark, sf)), "page-lookup")
    leads = pages.discovery_candidates(clean(spark, sf), view(spark, sf, "search_results"))
    homes = stages.stage_table(pages.fetch_homepages(leads, lookup), "homes")
    return pages.with_site(pages.gather_pages(homes, lookup))


def located(spark: SparkSession, sf: str) -> DataFrame:
    return places.normalize_locations(clean(spark, sf), view(spark, sf, "geocodes"))


def with_runs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Offline-scored leads under the runs of their customer, and the runs."""
    all_runs = view(spark, sf, "runs")
    leads = offline_leads(spark, sf)
    return leads.join(all_runs.select("job_id", F.col("custkey").alias("row_id")), "row_id"), all_runs


# --- mapping, validation, normalisation, deduplication ---------------------------------------


@query
def alias_mapping(spark, sf):
    records = view(spark, sf, "raw_records").select("row_id", F.try_parse_json("record").alias("record"))
    out = mapping.tag_rejects(mapping.map_records(records))
    fields = ("company_name", "agent_name", "website", "email", "phone", "location", "source", "lead_score")
    return out.select("row_id", *fields, mapping.REASON)


@query
def listing_mapping(spark, sf):
    parsed = view(spark, sf, "raw_records").select("row_id", F.try_parse_json("record").alias("parsed"))
    records = parsed.select(
        "row_id", F.expr(mapping.listing_record("parsed")).alias("record")
    )
    out = mapping.tag_rejects(mapping.map_records(records))
    return out.select("row_id", "company_name", "agent_name", "email", "phone", "location", "source", mapping.REASON)


@query
def rejected_rows(spark, sf):
    return mapping.rejected_rows(tagged(spark, sf))


@query
def reject_reasons(spark, sf):
    return analytics.reject_reasons(mapping.rejected_rows(tagged(spark, sf)))


@query
def relaxed_mapping(spark, sf):
    relaxed = MappingOptions(strict_contacts=False)
    return mapping.valid_leads(tagged(spark, sf, relaxed)).select("row_id", "company_name", "website", "email", "phone")


@query
def normalize_contacts(spark, sf):
    return normalized(spark, sf).select("row_id", "company_name", "agent_name", "website", "email", "phone", "location")


@query
def dedup_leads(spark, sf):
    return dedup.dedup_leads(normalized(spark, sf)).select("row_id", "company_name", "website", "email", "phone")


@query
def dedup_leads_batch(spark, sf):
    return dedup.dedup_leads(normalized(spark, sf), scope=[dedup.batch_of("row_id", 100)]).select("row_id", "company_name", "website", "email")


# --- pages ---------------------------------------------------------------------------------


@query
def page_fetch_status(spark, sf):
    status = pages.fetch_status(view(spark, sf, "site_pages"))
    return status.select("page_id", "url", "status_code", "ok", "error", "elapsed_ms", F.length("html").alias("html_chars"))


@query
def page_contacts(spark, sf):
    return signals(spark, sf).select("page_id", joined("emails").alias("emails"), joined("phones").alias("phones"))


@query
def text_contacts(spark, sf):
    docs = view(spark, sf, "documents").selectExpr("doc_id", f"{H.visible_text(H.without_code('text'))} AS text")
    emails, phones = H.value_set(H.text_emails("text")), H.value_set(H.text_phones("text"))
    return docs.selectExpr("doc_id", f"array_join({emails}, '|') AS emails", f"array_join({phones}, '|') AS phones")


@query
def page_jsonld_contacts(spark, sf):
    return signals(spark, sf).select(
        "page_id", joined("schema_emails").alias("emails"), joined("schema_phones").alias("phones")
    )


@query
def contact_links(spark, sf):
    return signals(spark, sf).select("page_id", joined("contact_links").alias("links"))


@query
def chatbot_signal(spark, sf):
    return signals(spark, sf).select("page_id", "has_chatbot")


@query
def freshness_signal(spark, sf):
    return signals(spark, sf).select("page_id", "fresh")


@query
def speed_score(spark, sf):
    return signals(spark, sf).select("page_id", "elapsed_ms", "speed_score")


@query
def website_discovery(spark, sf):
    found = pages.discover_websites(clean(spark, sf), view(spark, sf, "search_results"))
    return found.select("row_id", "company_name", "discovered")


@query
def lead_page_contacts(spark, sf):
    return gathered_sites(spark, sf).where(F.col("site").isNotNull()).select(
        "row_id", "website", "site.email", "site.phone", "site.has_chatbot", "site.fresh", "site.speed_score",
        *[f"site.stats.{n}" for n in ("schema_contacts_used", "email_disposable_rejected", "multi_page_fetch_success",
                                      "phone_valid_count", "phone_total_candidates", "email_validation_reason",
                                      "phone_validation_reason", "email_quality")],
    )


@query
def page_enriched(spark, sf):
    lookup = stages.stage_table(pages.page_lookup(signals(spark, sf)), "page-lookup")
    out = pages.enrich_from_pages(clean(spark, sf), lookup, view(spark, sf, "search_results"), keep=stages.stage_table)
    return out.select("row_id", "website", "email", "phone", "has_chatbot", "last_updated_signal",
                      "website_speed_score", "enrichment_error")


# --- places --------------------------------------------------------------------------------


@query
def location_normalized(spark, sf):
    return located(spark, sf).select("row_id", "location", "normalized_location")


def _place_match(opts: PlaceOptions, spark, sf) -> DataFrame:
    queries = places.place_queries(located(spark, sf))
    best = places.best_places(places.match_candidates(queries, view(spark, sf, "place_search"), opts))
    asked = queries.select("place_request", "company", "normalized_location")
    return best.join(asked, "place_request").select(
        "company", "normalized_location", "place_id", "place_name", "tier", F.round("match_score", 6).alias("match_score")
    )


QUERIES["place_match_lev"] = partial(_place_match, LEVENSHTEIN)
QUERIES["place_match_ratio"] = partial(_place_match, PlaceOptions(similarity="gestalt"))


@query
def place_enriched(spark, sf):
    out = places.enrich_from_places(clean(spark, sf), snapshots(spark, sf), LEVENSHTEIN)
    return out.select("row_id", "website", "phone", "location", "source", "place_website", "place_phone", "place_location")


@query
def unmatched_leads(spark, sf):
    leads = stages.stage_table(located(spark, sf), "located")
    matched = places.match_places(leads, snapshots(spark, sf), LEVENSHTEIN).where(F.col("place").isNotNull())
    return places.unmatched(leads, matched).select("row_id", "company_name", "location")


# --- resolution, grading, scoring --------------------------------------------------------------


@query
def field_candidates(spark, sf):
    staged = staged_leads(clean(spark, sf), snapshots(spark, sf), FULL)
    found = resolve.with_candidates(staged)
    each = found.selectExpr("row_id", "inline(flatten(transform(candidates, c -> c.list)))")
    return each.select("row_id", "field", "source", "value", "validated", "confidence", "validation_reason")


@query
def field_resolution(spark, sf):
    staged = staged_leads(clean(spark, sf), snapshots(spark, sf), FULL)
    decided = resolve.with_decisions(resolve.with_candidates(staged))
    each = decided.selectExpr("row_id", "inline(decisions)")
    return each.select("row_id", "field", "chosen_source", "chosen_value", "tie_break_applied", "tie_break_reason",
                       "decision_reason", F.size("alternatives").alias("alternatives"))


@query
def verify_email(spark, sf):
    each = mapping.map_columns(view(spark, sf, "leads_raw").withColumnRenamed("row_index", "row_id"))
    return each.selectExpr("row_id", f"{check_email('email')} AS e").select(
        "row_id", "e.value", "e.valid", "e.reason", "e.is_disposable", "e.quality", "e.is_role_based"
    )


@query
def verify_phone(spark, sf):
    each = mapping.map_columns(view(spark, sf, "leads_raw").withColumnRenamed("row_index", "row_id"))
    return each.selectExpr("row_id", f"{check_phone('phone')} AS p").select(
        "row_id", "p.value", "p.valid", "p.reason"
    )


@query
def contact_quality(spark, sf):
    v = verify.verify_leads(clean(spark, sf))
    return v.select("row_id", "contact_quality", F.col("verification.email.reason").alias("email_reason"),
                    F.col("verification.phone.reason").alias("phone_reason"))


@query
def lead_score(spark, sf):
    return full_run(spark, sf).leads.select("row_id", "lead_score", "lead_reason", "confidence_score", "contact_quality")


@query
def offline_score(spark, sf):
    return offline_leads(spark, sf).select("row_id", "company_name", "contact_quality", "lead_score", "lead_reason")


@query
def profile_scores(spark, sf):
    graded = finish_leads(staged_leads(clean(spark, sf), snapshots(spark, sf), FULL), RunOptions(score=ScoreOptions(enabled=False)))
    return score.score_under_profiles(graded, PROFILES).select("row_id", "profile", "lead_score", "lead_reason")


@query
def export_canonical(spark, sf):
    return sinks.canonical(full_run(spark, sf).leads).select(*CANONICAL_FIELDS)


@query
def scoring_off(spark, sf):
    """A run without scoring: leads are graded and keep the score they came with, which is none."""
    run = run_leads(tagged(spark, sf), opts=replace(OFFLINE, score=ScoreOptions(enabled=False)))
    return run.leads.select("row_id", "company_name", "contact_quality", "lead_score", "lead_reason")


@query
def exported_run(spark, sf):
    """Leads as JSON and CSV and rejects as JSON, written and read back."""
    run = run_leads(tagged(spark, sf), opts=OFFLINE)
    paths = sinks.write_run(stages.new_path(spark, "export"), run.leads, run.rejects, run.summary)
    as_json = spark.read.schema("company_name string, email string, lead_score int").json(paths["leads_json"])
    as_csv = spark.read.csv(paths["leads_csv"], header=True, escape='"').selectExpr("company_name", "email", "CAST(lead_score AS INT) AS lead_score")
    rejects = spark.read.schema("row_index long, reason string").json(paths["rejected_rows"]).selectExpr("CAST(row_index AS STRING) AS company_name", "reason AS email", "NULL AS lead_score")
    outputs = {"leads_json": as_json, "leads_csv": as_csv, "rejected_rows": rejects}
    return reduce(DataFrame.unionByName, [df.withColumn("output", F.lit(name)) for name, df in outputs.items()])


@query
def lead_history(spark, sf):
    """The decisions that finished leads carry, one row a field."""
    decided = full_run(spark, sf).leads.selectExpr("row_id", "explode(enrichment_history.decisions) AS (field, decision)")
    return decided.select("row_id", "field", "decision.chosen_source", "decision.chosen_value", "decision.decision_reason")


@query
def run_summary(spark, sf):
    return full_run(spark, sf).summary


# --- exploring and analysing -------------------------------------------------------------------


@query
def lead_filter(spark, sf):
    best = explore.filter_leads(full_run(spark, sf).leads, 60, "verified", "no", "unknown")
    return explore.by_score(best).select("row_id", "company_name", "lead_score")


@query
def lead_search(spark, sf):
    hits = explore.search_leads(offline_leads(spark, sf), " Cape PROP ")
    return hits.select("row_id", "company_name", "location")


@query
def lead_page(spark, sf):
    page = explore.page_of(explore.by_score(offline_leads(spark, sf)), page=2, page_size=25)
    return page.select("row_id", "company_name", "lead_score")


@query
def analytics_kpi(spark, sf):
    return analytics.kpis(offline_leads(spark, sf))


@query
def score_histogram(spark, sf):
    return analytics.score_histogram(offline_leads(spark, sf))


@query
def signal_splits(spark, sf):
    return analytics.signal_splits(full_run(spark, sf).leads)


@query
def missing_fields(spark, sf):
    return analytics.missing_fields(offline_leads(spark, sf))


@query
def source_mix(spark, sf):
    return analytics.source_mix(full_run(spark, sf).leads)


@query
def run_diagnostics(spark, sf):
    return analytics.diagnostics(full_run(spark, sf).leads)


@query
def lead_page_after(spark, sf):
    """The same page reached by the key of the last lead before it. A user has that key from the page they saw; here the page before is made for it."""
    scored = stages.stage_table(offline_leads(spark, sf), "scored")
    before = explore.page_of(explore.by_score(scored), page=1, page_size=25).agg(F.max_by(F.struct("lead_score", "row_id"), F.struct(-F.col("lead_score"), "row_id")).alias("last"))
    last = before.first()["last"]
    if last is None:
        return scored.where("false").select("row_id", "company_name", "lead_score")
    return explore.page_after(scored, last["lead_score"], last["row_id"], 25).select("row_id", "company_name", "lead_score")


# --- runs and batches ----------------------------------------------------------------------------


@query
def runs_page(spark, sf):
    page, total = runs.runs_page(view(spark, sf, "runs"), limit=20, offset=40, status="completed")
    listed = page.select("job_id", "status", F.date_format("created_at", "yyyy-MM-dd").alias("created_on"), "input_format")
    summary = total.select(F.lit("total").alias("job_id"), F.lit("").alias("status"), F.lit("").alias("created_on"),
                           F.col("total").cast("string").alias("input_format"))
    return listed.unionByName(summary)


@query
def runs_search(spark, sf):
    counted = view(spark, sf, "runs").withColumn("counts", F.struct("total_rows"))
    hits = runs.filter_runs(counted, input_format="csv", text='"TOTAL_rows":7', text_fields=("job_id", "status", "counts"))
    return hits.select("job_id", "status", "total_rows")


@query
def lead_upsert(spark, sf):
    written = view(spark, sf, "run_batches")
    order = "struct(written_at, seq1, seq2, end_row, status)"
    return dedup.latest_per_key(written, ["job_id", "batch_index"], order).select(
        "job_id", "batch_index", "end_row", "status", "processed_rows"
    )


@query
def batch_plan(spark, sf):
    return runs.batch_plan(view(spark, sf, "runs"), 100)


@query
def batch_progress(spark, sf):
    return runs.batch_progress(view(spark, sf, "run_batches"))


@query
def batch_resume(spark, sf):
    return runs.batch_progress(runs.resume_batches(view(spark, sf, "run_batches")))


@query
def run_rollup(spark, sf):
    counters = view(spark, sf, "run_batches").select(
        "job_id", (F.col("end_row") - F.col("start_row")).cast("bigint").alias("phones_total"),
        F.col("processed_rows").cast("bigint").alias("phones_valid"),
    )
    return runs.roll_up(counters, ["job_id"], {"phone_e164_valid_rate": ("phones_valid", "phones_total")})


@query
def recent_runs_leads(spark, sf):
    leads, all_runs = with_runs(spark, sf)
    return runs.recent_leads(leads, all_runs, last=50).select("job_id", "row_id", "lead_score")


@query
def recent_runs_kpi(spark, sf):
    leads, all_runs = with_runs(spark, sf)
    return analytics.kpis(runs.recent_leads(leads, all_runs, last=100))


# --- the table of leads ---------------------------------------------------------------------------


def yearly_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Leads as written by their runs, under one job a format and year: a lead that had several runs in a year has several versions."""
    leads, all_runs = with_runs(spark, sf)
    written = leads.join(all_runs.select("job_id", "status", "created_at", "input_format"), "job_id")
    return written.select(
        F.concat("input_format", F.lit("-"), F.year("created_at")).alias("job_id"), F.col("row_id").cast("bigint").alias("row_index"), "company_name",
        "contact_quality", "lead_score", F.col("job_id").alias("written_by"), "status", "created_at",
    )


def merged_table(spark: SparkSession, written: DataFrame, parts: list[str]) -> LeadTable:
    table = LeadTable(spark, stages.new_path(spark, "lead-table"), written.schema, buckets=4)
    for part in parts:
        table.merge(written.where(part), newest=["created_at", "written_by"])
    return table


@query
def lead_table_merge(spark, sf):
    """Completed runs are written first, failed and terminated ones over them, and then those still processing."""
    written = stages.stage_table(yearly_runs(spark, sf), "written")
    return merged_table(spark, written, ["status = 'completed'", "status IN ('failed', 'terminated')", "status = 'processing'"]).read()


@query
def run_lookup(spark, sf):
    return merged_table(spark, yearly_runs(spark, sf), ["true"]).of_run("csv-1996").select("row_index", "company_name", "lead_score", "written_by")


@query
def recent_runs_table(spark, sf):
    """Leads of the five newest jobs that have completed runs."""
    written = stages.stage_table(yearly_runs(spark, sf), "written")
    jobs = written.groupBy("job_id").agg(F.min("status").alias("status"), F.max("created_at").alias("created_at"))
    return merged_table(spark, written, ["true"]).of_runs(runs.newest_completed(jobs, 5)).select("job_id", "row_index", "lead_score", "written_by")


# --- incremental ------------------------------------------------------------------------------------


def parts_in_order(raw: DataFrame, parts: int) -> list[DataFrame]:
    """`raw` in ranges of its row ids, one landing each."""
    size = -(-(raw.agg(F.max("row_id")).first()[0] + 1) // parts)
    return [raw.where(f"{dedup.batch_of('row_id', size)} = {part}") for part in range(parts)]


def parts_by_identity(spark: SparkSession, sf: str) -> list[DataFrame]:
    """The raw rows that are the first of their identity in two landings, then all others, so that text files need no order."""
    raw = view(spark, sf, "leads_raw").withColumnRenamed("row_index", "row_id")
    first = clean(spark, sf).select("row_id")
    kept = stages.stage_table(raw.join(first, "row_id", "left_semi"), "first-rows")
    return [kept.where("row_id % 2 = 0"), kept.where("row_id % 2 = 1"), raw.join(first, "row_id", "left_anti")]


def arriving(flow: IncrementalLeads, parts: list[DataFrame], fmt: str = "parquet") -> IncrementalLeads:
    """Lets the parts land one after the other, as many files each as they have partitions, and processes each as a batch."""
    landing = stages.new_path(flow.spark, "landing")
    for part in parts:
        rows = part if fmt == "parquet" else part.drop("row_id")
        writer = rows.write.mode("append")
        writer.option("header", True).option("escape", '"').csv(landing) if fmt == "csv" else writer.json(landing) if fmt == "jsonl" else writer.parquet(landing)
        flow.process(landing, part.schema, files_per_batch=1_000_000, fmt=fmt)
    return flow


def raw_parts(spark: SparkSession, sf: str) -> list[DataFrame]:
    return parts_in_order(view(spark, sf, "leads_raw").withColumnRenamed("row_index", "row_id"), 3)


OFFLINE_COLUMNS = ("row_id", "company_name", "website", "email", "contact_quality", "lead_score")
FULL_COLUMNS = ("company_name", "website", "email", "phone", "location", "contact_quality", "lead_score", "lead_reason")


@query
def incremental_leads(spark, sf):
    """Lands the raw leads as files, processes them as they land, and reads what was stored. Known identities are in the state."""
    flow = IncrementalLeads(spark, stages.new_path(spark, "incremental"), OFFLINE)
    return arriving(flow, raw_parts(spark, sf)).stored().select(*OFFLINE_COLUMNS)


@query
def incremental_tables(spark, sf):
    """The same with the identities read from the stored tables."""
    flow = IncrementalLeads(spark, stages.new_path(spark, "incremental"), OFFLINE, known="tables")
    return arriving(flow, raw_parts(spark, sf)).stored().select(*OFFLINE_COLUMNS)


@query
def incremental_jsonl(spark, sf):
    """JSON Lines, with pages and places looked up."""
    flow = IncrementalLeads(spark, stages.new_path(spark, "incremental"), FULL, snapshots(spark, sf))
    return arriving(flow, parts_by_identity(spark, sf), "jsonl").stored().select(*FULL_COLUMNS)


@query
def incremental_csv(spark, sf):
    """CSV files, each with its own header, with pages and places looked up."""
    flow = IncrementalLeads(spark, stages.new_path(spark, "incremental"), FULL, snapshots(spark, sf))
    return arriving(flow, parts_by_identity(spark, sf), "csv").stored().select(*FULL_COLUMNS)


class _Interrupted(IncrementalLeads):
    """Stops in the second batch, after its rows passed the state."""

    def _finish(self, clean: DataFrame, batch_id: int) -> None:
        if batch_id == 1:
            raise RuntimeError("interrupted")
        super()._finish(clean, batch_id)


@query
def incremental_resume(spark, sf):
    """A run that stops in its second batch is gone on with by another one."""
    folder = stages.new_path(spark, "incremental")
    landing = stages.new_path(spark, "landing")
    parts = raw_parts(spark, sf)
    for k, part in enumerate(parts):
        part.write.mode("append").parquet(landing)
        flow = (_Interrupted if k == 1 else IncrementalLeads)(spark, folder, OFFLINE)
        try:
            flow.process(landing, part.schema, files_per_batch=1_000_000)
        except StreamingQueryException as error:
            if "interrupted" not in str(error):
                raise
    return IncrementalLeads(spark, folder, OFFLINE).stored().select(*OFFLINE_COLUMNS)
