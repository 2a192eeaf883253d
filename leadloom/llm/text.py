"""Words of a text: runs of characters other than blank and \\x09-\\x0D. A null text has none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK_CHARS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """array<string>, never null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANK_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def row_key(*columns: Column) -> list[Column]:
    """Two hash columns that tell rows apart where ids may repeat or be null; equal rows get equal keys."""
    return [F.xxhash64(*columns).alias("_key"), F.hash(*reversed(columns)).alias("_key2")]
