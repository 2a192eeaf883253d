"""Corpus pipeline: quality rules, near duplicates, repeated passages, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's `docs`. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm import mixing, packing, quality_rules, simhash_similarity, substring_dedup
from leadloom.llm.queries import TOKENIZER
from leadloom.operators.stages import stage_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outlier of their language and source. Null, empty and very short texts fail the base
    rules; repeated rows share a verdict; an empty table gives no rows; other columns are dropped."""
    return quality_rules.quality_filter(docs.select(*COLUMNS))


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row: the least id, rows without an id last, ties by a hash of the whole row. Rows
    that share an id, or have none, are told apart by that hash; only rows equal in every column are one. Near are texts whose sets of
    five-word shingles are similar by 0.8 or more; null and empty texts are near each other alone, very long texts are compared whole; an empty
    table gives no rows; other columns are dropped."""
    sized = [f"coalesce(concat(octet_length(CAST({c} AS STRING)), ':', CAST({c} AS STRING)), '-')" for c in COLUMNS]
    key = F.expr(f"md5(CAST(concat({', '.join(sized)}) AS BINARY))").alias("_k")
    ranked = docs.select(F.struct(F.expr("doc_id IS NULL AS none"), "doc_id", key).alias("doc_id"), "text")
    _, found = simhash_similarity.least_ids(ranked)
    kept = found.select("component_id._k").distinct()
    rows = docs.select(F.struct(*COLUMNS).alias("_row"), key).groupBy("_k").agg(F.first("_row").alias("_row"))  # equal rows meet before the shuffle
    return rows.join(kept, "_k", "left_semi").select("_row.*")


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that stand anywhere else are cut out in place; texts of which nothing is left go. Texts without
    such a passage, null and empty ones among them as '', stay byte for byte; repeated rows lose their windows in both."""
    cut = substring_dedup.remove_repeats(docs, ["doc_id", "lang", "source"], in_place=True)
    left = cut.filter("n_removed = 0 OR n_removed < n_words")
    return left.select("row.doc_id", F.col("kept_text").alias("text"), "row.lang", "row.source", F.char_length("kept_text").cast("long").alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once or twice, by its source's weight. A null source is a source of its own; ties are settled by hash."""
    return mixing.draw(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with their sequence and place. Null and empty texts are one piece, the closing token; longer ones are cut;
    repeated rows are packed each."""
    return packing.pack(docs, TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("simhash_dedup", simhash),
    ("substring_dedup", substring),
    ("source_mixing", mix),
    ("best_fit_packing", pack),
]
#: No SQL: fingerprints, model fits and tokens are beyond it. Tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to shared storage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
