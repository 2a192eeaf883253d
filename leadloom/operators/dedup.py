"""First-seen deduplication and latest-version selection.

Both are one grouped aggregate with partial aggregation before the shuffle, so a key that holds
a third of all rows arrives at its reducer as one row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.functions.normalize import company_key, email_key, phone_key, website_key
from leadloom.functions.text import let, struct
from leadloom.settings import NormalizeOptions


def dedup_key(opts: NormalizeOptions = NormalizeOptions()) -> str:
    """STRUCT<kind, value>: website, else company, else contact, else one key for all nameless rows."""
    parts = struct(
        w=website_key("website", opts.www),
        c=company_key("company_name"),
        p=f"coalesce({email_key('email')}, {phone_key('phone')})",
    )
    kind = (
        "CASE WHEN dk.w IS NOT NULL THEN 'website' WHEN dk.c IS NOT NULL THEN 'company' "
        "WHEN dk.p IS NOT NULL THEN 'contact' ELSE 'unknown' END"
    )
    return let("dk", parts, struct(kind=kind, value="coalesce(dk.w, dk.c, dk.p, 'unknown')"))


def _pick(df: DataFrame, keys: Sequence[str], choose: str, order: str) -> DataFrame:
    row = "named_struct(" + ", ".join(f"'{c}', `{c}`" for c in df.columns) + ")"
    picked = df.groupBy(*[F.expr(k) for k in keys]).agg(F.expr(f"{choose}({row}, {order})").alias("_row"))
    return picked.select("_row.*")


def first_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row with the smallest `order` per key; keys and order are SQL expressions."""
    return _pick(df, keys, "min_by", order)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row with the largest `order` per key: what an insert-or-replace leaves behind."""
    return _pick(df, keys, "max_by", order)


def dedup_leads(
    leads: DataFrame,
    opts: NormalizeOptions = NormalizeOptions(),
    row_id: str = "row_id",
    scope: Sequence[str] = (),
) -> DataFrame:
    """Keep the first lead of each identity, over the whole input or within each `scope` value."""
    return first_per_key(leads, [*scope, dedup_key(opts)], row_id)


def batch_of(row_id: str, batch_size: int) -> str:
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    return f"CAST(floor({row_id} / {batch_size}) AS BIGINT)"
