"""Conflict resolution: candidates per field, the choice among them, and a record of why.

Each lead has at most three candidates per field, so both steps are array expressions within the
row. All fields go through the same expression, as elements of one array.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from leadloom import constants as K
from leadloom.functions.text import NO_TEXT, let, q, struct
from leadloom.operators.normalize import replace_columns
from leadloom.settings import ResolveOptions

CANDIDATES_TYPE = (
    "ARRAY<STRUCT<field:STRING,source:STRING,value:STRING,validated:BOOLEAN,confidence:DOUBLE,"
    "validation_reason:STRING,timestamp:TIMESTAMP>>"
)
ALTERNATIVES_TYPE = (
    "ARRAY<STRUCT<source:STRING,value:STRING,confidence:DOUBLE,validated:BOOLEAN,losing_reason:STRING>>"
)


def keep_stage(df: DataFrame, prefix: str) -> DataFrame:
    """Copy the tracked fields as they are now, so that later stages can be compared with them."""
    return df.selectExpr("*", *[f"{f} AS {prefix}_{f}" for f in K.TRACKED_FIELDS])


def _candidate(field: str, source: str, value: str, validated: str, confidence: str, reason: str, ts: str) -> str:
    return struct(field=q(field), source=q(source), value=value, validated=validated,
                  confidence=f"CAST({confidence} AS DOUBLE)", validation_reason=reason, timestamp=ts)


def field_candidates(field: str, ts: str, opts: ResolveOptions = ResolveOptions()) -> str:
    """Candidates of one field from columns base_<field>, site_<field> and <field> (after the place stage)."""
    contact = field in ("email", "phone")
    base = f"base_{field}"
    site = f"coalesce(page_{field}, site_{field})" if contact else f"site_{field}"
    from_place = NO_TEXT if field == "email" else f"place_{field}"
    # without a place value, whatever the row holds now counts as proposed by the place stage
    leftover = f"if({field} <=> {site}, NULL, {field})"
    if opts.strict_provenance:
        leftover = f"if({field} <=> {base}, NULL, {leftover})"
    place = f"coalesce({from_place}, {leftover})"

    page_ok, place_ok = "enrichment_error IS NULL", "google_maps_error IS NULL"
    page_top = K.PAGE_EMAIL_CONFIDENCE if field == "email" else K.STAGE_CONFIDENCE
    place_top = K.PLACE_PHONE_CONFIDENCE if field == "phone" else K.STAGE_CONFIDENCE
    page_reason = f"coalesce(page_stats.{field}_validation_reason, 'website_fetch_ok')" if contact else "'website_fetch_ok'"
    from_input = _candidate(field, "input", base, "true", str(K.INPUT_CONFIDENCE), "'from_input'", ts)
    from_page = _candidate(field, "website_enrichment", site, page_ok,
                           f"if({page_ok}, {page_top}, {K.FAILED_STAGE_CONFIDENCE})",
                           f"if({page_ok}, {page_reason}, 'website_fetch_failed')", ts)
    from_dir = _candidate(field, "google_maps", place, place_ok,
                          f"if({place_ok}, {place_top}, {K.FAILED_STAGE_CONFIDENCE})",
                          f"if({place_ok}, 'google_maps_ok', 'google_maps_error')", ts)
    proposals = (
        f"array(if({base} IS NOT NULL, {from_input}, NULL), "
        f"if({site} IS NOT NULL AND NOT {site} <=> {base}, {from_page}, NULL), "
        f"if({place} IS NOT NULL, {from_dir}, NULL))"
    )
    return f"CAST(filter({proposals}, fc -> fc IS NOT NULL) AS {CANDIDATES_TYPE})"


def with_candidates(
    staged: DataFrame, run_ts: datetime | None = None, opts: ResolveOptions = ResolveOptions()
) -> DataFrame:
    """Add `candidates`: ARRAY<STRUCT<field, current, list>>, one element per tracked field."""
    ts = f"TIMESTAMP '{run_ts.isoformat(sep=' ')}'" if run_ts is not None else "current_timestamp()"
    each = [struct(field=q(f), current=f, list=field_candidates(f, ts, opts)) for f in K.TRACKED_FIELDS]
    return staged.selectExpr("*", f"array({', '.join(each)}) AS candidates")


def decision(c: str, current_source: str = "current") -> str:
    """Decision STRUCT over an element of `candidates`: validated first, then confidence, then the tie rules."""
    pool = (
        f"if(exists({c}.list, cd -> cd.validated), filter({c}.list, cd -> cd.validated), {c}.list)"
    )
    top = let("po", pool, "filter(po, cd -> cd.confidence = array_max(transform(po, cx -> cx.confidence)))")
    facts = struct(
        top="tp",
        places=f"filter(tp, cd -> {c}.field = 'website' AND cd.source = 'google_maps' AND cd.validated)",
        kept=f"filter(tp, cd -> cd.value <=> {c}.current)",
    )
    pick = struct(
        tie="size(fa.top) > 1",
        c="CASE WHEN size(fa.top) > 1 AND size(fa.places) > 0 THEN fa.places[0] "
        "WHEN size(fa.top) > 1 AND size(fa.kept) > 0 THEN fa.kept[0] ELSE try_element_at(fa.top, 1) END",
        reason="CASE WHEN size(fa.top) = 0 THEN 'no_candidates' WHEN size(fa.top) = 1 THEN 'highest_confidence' "
        "WHEN size(fa.places) > 0 THEN 'prefer_google_maps_if_verified' "
        "WHEN size(fa.kept) > 0 THEN 'keep_current_on_tie' ELSE 'tie_first_candidate' END",
    )
    # sources differ within a field, so the source names the candidate
    losing = "if(pi.tie, 'not_selected_after_tie_break', 'lower_confidence_or_invalid')"
    loser = struct(source="cd.source", value="cd.value", confidence="cd.confidence", validated="cd.validated",
                   losing_reason=losing)
    record = struct(
        field=f"{c}.field",
        chosen_source=f"coalesce(pi.c.source, {q(current_source)})",
        chosen_value=f"if(pi.c IS NULL, {c}.current, pi.c.value)",
        tie_break_applied="pi.tie",
        tie_break_reason="pi.reason",
        decision_reason="CASE WHEN pi.tie THEN 'tie_break:' || pi.reason "
        "WHEN pi.c IS NOT NULL THEN 'highest_validated_confidence' END",
        alternatives=f"CAST(transform(filter({c}.list, cd -> cd.source <> pi.c.source), cd -> {loser}) "
        f"AS {ALTERNATIVES_TYPE})",
    )
    return let("tp", top, let("fa", facts, let("pi", pick, record)))


def with_decisions(df: DataFrame) -> DataFrame:
    """Add `decisions`: one decision per element of `candidates`, in the same order."""
    return df.selectExpr("*", f"transform(candidates, ca -> {decision('ca')}) AS decisions")


def apply_decisions(df: DataFrame) -> DataFrame:
    """Write chosen values, count outcomes for the run summary, and fold everything into `enrichment_history`."""
    fields = list(enumerate(K.TRACKED_FIELDS))
    history = struct(
        candidates="map_from_entries(transform(candidates, ca -> struct(ca.field, ca.list)))",
        decisions="map_from_entries(transform(decisions, de -> struct(de.field, de)))",
        stage_errors="map_filter(map('website_enrichment', enrichment_error, 'google_maps', google_maps_error), "
        "(k, v) -> v IS NOT NULL)",
        diagnostics="named_struct('website', page_stats)",
    )
    changed = " + ".join(f"int(NOT decisions[{i}].chosen_value <=> base_{f})" for i, f in fields)
    resolved = replace_columns(
        df,
        {
            "enrichment_history": history,
            "ties_resolved": "size(filter(decisions, de -> de.tie_break_applied))",
            "fields_replaced": changed,
            "invalid_candidates": "size(filter(flatten(transform(candidates, ca -> ca.list)), cd -> NOT cd.validated))",
            **{f: f"decisions[{i}].chosen_value" for i, f in fields},
        },
    )
    spent = [f"{p}_{f}" for f in K.TRACKED_FIELDS for p in ("base", "site", "place", "page")]
    return resolved.drop(*spent, "candidates", "decisions")


def resolve_leads(
    staged: DataFrame, run_ts: datetime | None = None, opts: ResolveOptions = ResolveOptions()
) -> DataFrame:
    return apply_decisions(with_decisions(with_candidates(staged, run_ts, opts)))
