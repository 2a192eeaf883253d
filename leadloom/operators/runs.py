"""Queries over runs and their batches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.operators.explore import matches_text
from leadloom.operators.summary import rate

# fixed values: batch states that count as started, and those a resume makes pending again
STARTED = ("processing", "completed", "failed", "terminated")
RESUMABLE = ("failed", "terminated", "processing")
MAX_PAGE = 100


def newest_first(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("created_at"), F.desc("job_id"))


def filter_runs(
    runs: DataFrame, status: str | None = None, input_format: str | None = None, text: str | None = None,
    text_fields: Sequence[str] = ("job_id", "status", "input_format", "created_at"),
) -> DataFrame:
    """Status, format and free-text filters. Struct columns among `text_fields` are searched as JSON."""
    out = runs
    if status and status.strip():
        out = out.where(F.col("status") == status.strip())
    if input_format:
        out = out.where(F.col("input_format") == input_format)
    if text and text.strip():
        types = dict(out.dtypes)
        shown = {f"_t_{f}": F.to_json(f) if types[f].startswith(("struct", "map", "array")) else F.col(f).cast("string")
                 for f in text_fields}
        out = out.withColumns(shown).where(matches_text(text, tuple(shown))).drop(*shown)
    return out


def runs_page(runs: DataFrame, limit: int = 20, offset: int = 0, status: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(page of runs, newest first; one-row total of all that match)."""
    wanted = filter_runs(runs, status)
    page = newest_first(wanted).offset(max(0, offset)).limit(max(1, min(MAX_PAGE, limit)))
    return page, wanted.agg(F.count("*").alias("total"))


def batch_plan(rows_per_run: DataFrame, batch_size: int) -> DataFrame:
    """Consecutive row ranges of `batch_size` per run from (job_id, total_rows)."""
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    last = F.ceil(F.col("total_rows") / batch_size) - 1
    index = F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long")))
    return (
        rows_per_run.where(F.col("total_rows") > 0)
        .select("job_id", "total_rows", index.alias("batch_index"))
        .select(
            "job_id", "batch_index", (F.col("batch_index") * batch_size).alias("start_row"),
            F.least("total_rows", (F.col("batch_index") + 1) * batch_size).alias("end_row"),
            F.lit("pending").alias("status"),
        )
    )


def batch_progress(batches: DataFrame) -> DataFrame:
    """Progress of each run. A run without batches has no row."""

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0)).cast("long")

    return batches.groupBy("job_id").agg(
        F.count("*").alias("batches_total"),
        F.count_if(F.col("status").isin(*STARTED)).alias("batches_started"),
        F.count_if(F.col("status") == "completed").alias("batches_completed"),
        F.count_if(F.col("status") == "failed").alias("failed_batches"),
        total(F.col("end_row") - F.col("start_row")).alias("rows_total"),
        total(F.col("processed_rows")).alias("rows_processed"),
    )


def resume_batches(batches: DataFrame) -> DataFrame:
    """Batches as a resume leaves them: unfinished ones pending again, completed ones untouched."""
    again = F.col("status").isin(*RESUMABLE)
    return batches.withColumn("status", F.when(again, "pending").otherwise(F.col("status")))


def in_index_order(batches: DataFrame) -> DataFrame:
    return batches.orderBy("job_id", "batch_index")


def of_run(df: DataFrame, job_id: str) -> DataFrame:
    """Rows of one run; on a table partitioned by job_id only that run's files are read."""
    return df.where(F.col("job_id") == job_id)


def newest_completed(runs: DataFrame, last: int = 10) -> DataFrame:
    """Ids of the newest completed runs."""
    return newest_first(filter_runs(runs, "completed")).limit(max(1, last)).select("job_id")


def recent_leads(leads: DataFrame, runs: DataFrame, last: int = 10) -> DataFrame:
    """Leads of the newest completed runs: top-N runs, then a semi-join."""
    return leads.join(newest_completed(runs, last), "job_id", "left_semi")


def roll_up(counters: DataFrame, keys: Sequence[str], rates: Mapping[str, tuple[str, str]] = {}) -> DataFrame:
    """Add up counters per key; a rate is recomputed from its two sums, never added."""
    sums = [c for c, t in counters.dtypes if c not in keys and t in ("int", "bigint", "double")]
    added = counters.groupBy(*keys).agg(*[F.sum(c).cast(dict(counters.dtypes)[c]).alias(c) for c in sums])
    return added.withColumns({name: rate(a, b) for name, (a, b) in rates.items()})
