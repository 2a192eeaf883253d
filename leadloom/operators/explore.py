"""Filtering, searching, ordering and paging of leads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: fields searched by free text, in order
SEARCH_FIELDS = ("company_name", "agent_name", "location", "email", "website", "phone", "lead_reason", "source")


def score_or_zero() -> Column:
    return F.coalesce(F.col("lead_score"), F.lit(0))


def filter_leads(
    leads: DataFrame,
    min_score: int = 0,
    quality: str | None = None,
    chatbot: str | None = None,
    freshness: str | None = None,
) -> DataFrame:
    """Blank filters let everything pass; an unknown chatbot status matches neither "yes" nor "no"."""
    out = leads.where(score_or_zero() >= min_score)
    if quality:
        out = out.where(F.col("contact_quality") == quality)
    if chatbot:
        out = out.where(F.col("has_chatbot") == (chatbot == "yes"))
    if freshness:
        out = out.where(F.col("last_updated_signal") == freshness)
    return out


def matches_text(query: str, fields: tuple[str, ...]) -> Column:
    """Case-insensitive substring over the non-empty fields joined by blanks."""
    joined = F.concat_ws(" ", *[F.nullif(F.col(f).cast("string"), F.lit("")) for f in fields])
    return F.contains(F.lower(joined), F.lit(query.strip().lower()))


def search_leads(leads: DataFrame, query: str) -> DataFrame:
    return leads.where(matches_text(query, SEARCH_FIELDS)) if query.strip() else leads


def by_score(leads: DataFrame) -> DataFrame:
    """Best leads first, input order among equals."""
    return leads.orderBy(score_or_zero().desc(), "row_id")


def page_of(ordered: DataFrame, page: int = 0, page_size: int = 25) -> DataFrame:
    return ordered.offset(max(0, page) * page_size).limit(page_size)


def page_after(leads: DataFrame, last_score: int, last_row_id: int, page_size: int = 25) -> DataFrame:
    """Next page of `by_score` by key, for deep pages: no skipped rows are sorted."""
    s = score_or_zero()
    later = (s < last_score) | ((s == last_score) & (F.col("row_id") > last_row_id))
    return by_score(leads.where(later)).limit(page_size)
