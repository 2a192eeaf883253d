"""Writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.constants import CANONICAL_FIELDS


def canonical(leads: DataFrame) -> DataFrame:
    """The canonical columns in their fixed order; everything else is dropped."""
    return leads.select(*CANONICAL_FIELDS)


def export(leads: DataFrame, path: str, fmt: str, run_status: str = "completed", mode: str = "errorifexists") -> None:
    """Write leads as full nested JSON or canonical CSV. Only a completed run may be exported."""
    if run_status != "completed":
        raise ValueError(f"run is not completed: {run_status}")
    kind = fmt.strip().lower()
    if kind == "json":
        leads.write.mode(mode).option("ignoreNullFields", "false").json(path)
    elif kind == "csv":
        canonical(leads).write.mode(mode).option("header", True).option("escape", '"').csv(path)
    else:
        raise ValueError(f"unsupported export format: {fmt}")


def write_run(folder: str, leads: DataFrame, rejects: DataFrame, summary: DataFrame, mode: str = "errorifexists") -> dict[str, str]:
    """Leads (JSON and CSV), rejects and summary of a run under one folder. The summary names the outputs."""
    paths = {name: f"{folder.rstrip('/')}/{name}" for name in ("leads_json", "leads_csv", "rejected_rows", "summary")}
    export(leads, paths["leads_json"], "json", mode=mode)
    export(leads, paths["leads_csv"], "csv", mode=mode)
    rejects.write.mode(mode).option("ignoreNullFields", "false").json(paths["rejected_rows"])
    output = F.struct(*[F.lit(p).alias(n) for n, p in paths.items()])
    summary.withColumn("output", output).write.mode(mode).json(paths["summary"])
    return paths


def write_leads_table(leads: DataFrame, path: str, partitions: tuple[str, ...] = ("job_id", "batch_id")) -> None:
    """Replace exactly the partitions present in `leads`: writing a batch again leaves the table as it was."""
    leads.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)
