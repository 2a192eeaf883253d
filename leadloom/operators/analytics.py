"""Aggregates over scored leads. Each is one pass with partial aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom import constants as K
from leadloom.functions.text import half_up, q

SCORE = "coalesce(lead_score, 0)"


def kpis(leads: DataFrame) -> DataFrame:
    """Lead count, average score and share of verified leads in percent; zeros when there is none."""
    share = half_up("count_if(contact_quality = 'verified') / nullif(count(*), 0) * 100")
    return leads.agg(
        F.expr("count(*)").alias("leads"),
        F.expr(f"coalesce({half_up(f'sum({SCORE}) / nullif(count(*), 0)')}, 0)").alias("avg_score"),
        F.expr(f"coalesce({share}, 0)").alias("verified_rate"),
    )


def score_histogram(leads: DataFrame) -> DataFrame:
    """Count per score bucket; empty buckets are kept."""
    buckets = list(enumerate(K.SCORE_BUCKETS))
    counts = leads.agg(*[F.expr(f"count_if({SCORE} BETWEEN {lo} AND {hi})").alias(f"b{i}") for i, (_, lo, hi) in buckets])
    rows = ", ".join(f"{q(label)}, {lo}, {hi}, b{i}" for i, (label, lo, hi) in buckets)
    return counts.selectExpr(f"stack({len(buckets)}, {rows}) AS (bucket, lo, hi, leads)")


def signal_splits(leads: DataFrame) -> DataFrame:
    """Lead counts by quality, by chatbot status and by freshness, in one aggregation."""
    dims = ("quality", "chatbot", "freshness")
    keyed = leads.selectExpr(
        "coalesce(nullif(lower(contact_quality), ''), 'unknown') AS quality",
        "CASE WHEN has_chatbot THEN 'has chatbot' WHEN NOT has_chatbot THEN 'no chatbot' ELSE 'unknown' END AS chatbot",
        "coalesce(nullif(lower(last_updated_signal), ''), 'unknown') AS freshness",
    )
    grouped = keyed.groupingSets([[F.col(d)] for d in dims], *dims).agg(
        F.count("*").alias("leads"), *[F.grouping(d).alias(f"g_{d}") for d in dims]
    )
    which = "CASE " + " ".join(f"WHEN g_{d} = 0 THEN '{d}'" for d in dims) + " END AS signal"
    return grouped.selectExpr(which, f"coalesce({', '.join(dims)}) AS name", "leads")


def missing_fields(leads: DataFrame) -> DataFrame:
    """Per profiled field: how many leads lack it, and the share in percent, most missing first."""
    fields = list(enumerate(K.PROFILE_FIELDS))
    counts = leads.agg(
        F.expr("count(*)").alias("n"),
        *[F.expr(f"count_if({f} IS NULL OR CAST({f} AS STRING) = '')").alias(f) for _, f in fields],
    ).where("n > 0")
    rows = ", ".join(f"'{f}', {f}, {i}" for i, f in fields)
    each = counts.selectExpr("n", f"stack({len(fields)}, {rows}) AS (field, missing, pos)")
    return each.selectExpr("field", f"{half_up('missing / n * 100')} AS pct", "missing", "pos").orderBy(
        F.desc("pct"), "pos"
    ).drop("pos")


def source_mix(leads: DataFrame) -> DataFrame:
    """Lead counts by provenance: input only, place directory only, or both."""
    parts = "array_distinct(split(lower(coalesce(source, '')), ' *, *'))"
    on_map = f"array_contains({parts}, 'google_maps')"
    kind = f"CASE WHEN {on_map} AND size({parts}) > 1 THEN 'mixed' WHEN {on_map} THEN 'google_maps' ELSE 'input' END"
    return leads.groupBy(F.expr(kind).alias("source_kind")).agg(F.count("*").alias("leads"))


def diagnostics(leads: DataFrame) -> DataFrame:
    """One row: leads whose page or place stage failed, and the share with a place in percent."""
    placed = half_up("count_if(contains(coalesce(source, ''), 'google_maps')) / nullif(count(*), 0) * 100")
    return leads.agg(
        F.count("enrichment_error").alias("page_errors"),
        F.count("google_maps_error").alias("place_errors"),
        F.expr(f"coalesce({placed}, 0)").alias("place_match_rate"),
    )


def reject_reasons(rejected: DataFrame, top: int | None = None) -> DataFrame:
    """Reject reasons, the most frequent first; with `top` only so many."""
    counts = rejected.groupBy("reason").agg(F.count("*").alias("rejected"))
    ordered = counts.orderBy(F.desc("rejected"), "reason")
    return ordered if top is None else ordered.limit(top)
