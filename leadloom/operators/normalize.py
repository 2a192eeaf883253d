"""Whole-lead normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame

from leadloom.functions.normalize import email_key, phone_key, website_key
from leadloom.functions.text import squash
from leadloom.settings import NormalizeOptions


def replace_columns(df: DataFrame, new: dict[str, str]) -> DataFrame:
    """Set columns to SQL expressions over the old ones, in place or appended, in one projection."""
    kept = [f"{new[c]} AS `{c}`" if c in new else f"`{c}`" for c in df.columns]
    return df.selectExpr(*kept, *[f"{x} AS `{c}`" for c, x in new.items() if c not in df.columns])


def normalize_leads(leads: DataFrame, opts: NormalizeOptions = NormalizeOptions()) -> DataFrame:
    return replace_columns(
        leads,
        {
            **{name: squash(name) for name in ("company_name", "agent_name", "location")},
            "website": website_key("website", opts.www),
            "email": email_key("email"),
            "phone": phone_key("phone"),
        },
    )


def typed_leads(leads: DataFrame) -> DataFrame:
    """Mapped text columns in their output types. A signal that came as input text counts as unknown."""
    return replace_columns(
        leads,
        {
            "has_chatbot": "CAST(NULL AS BOOLEAN)",
            "website_speed_score": "CAST(NULL AS INT)",
            "lead_score": "try_cast(lead_score AS INT)",
            "confidence_score": "try_cast(confidence_score AS INT)",
        },
    )
