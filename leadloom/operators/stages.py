"""Writing a stage to shared storage, so that later stages start from a table and not from lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
OWN_SETTING = "leadloom.stage.dir"  # where the session names no checkpoint folder


def stage_folder(spark: SparkSession) -> str:
    """Shared folder that the cluster names. Where none is named: a temporary one on a single machine, else an error."""
    folder = spark.conf.get(SETTING, None) or spark.conf.get(OWN_SETTING, None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"set {SETTING} or {OWN_SETTING} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="leadloom-")
        spark.conf.set(OWN_SETTING, folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{stage_folder(spark)}/{name}-{uuid.uuid4().hex}"


def in_plan(df: DataFrame, name: str) -> DataFrame:
    """The alternative to `stage_table`: go on with the plan as it is."""
    return df


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as parquet and read it back: survives lost executors and prunes columns when re-read."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
