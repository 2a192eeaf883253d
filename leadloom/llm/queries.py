"""Registered queries of this subpackage: thin digests of the operators over whole tables, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm import chat_format, divergence, embedding_dedup, mixing, oracles, packing, quality_ranking, quality_rules, simhash_dedup, spelling_variants, substring_dedup
from leadloom.llm import toxicity, url_filters, warc_revisits

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_verdicts(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id bigint, turn bigint, role string, text string")
    turns = turns.unionByName(added).withColumn("parts", chat_format.text_parts(F.col("text")))
    out = chat_format.read_back(chat_format.format_conversations(turns))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.expr("concat_ws('', transform(turns, t -> concat(t.role, '\\n', t.text, '\\n')))"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def warc_records(pages: DataFrame) -> DataFrame:
    """Records of several crawls of every page, by the rules of `oracles.RECORD_FIELDS`: responses, a second response with another tag,
    failed responses, not-modified revisits before and after them by entity tag, date or digest, and metadata. A third of all pages
    share one url, some have none."""
    crawls = pages.selectExpr(*oracles.CRAWL_FIELDS).selectExpr("*", f"explode(sequence(0, {oracles.RECORDS_A_PAGE - 1})) AS n")
    return crawls.where(oracles.RECORD_EXISTS).selectExpr(*oracles.RECORD_FIELDS)


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_revisits.resolve(warc_records(table(spark, sf_dir, "pages")))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op11_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ranking.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_simhash_dedup, op3_quality_rules, op4_embedding_dedup, op5_substring_dedup, op6_chat_format,
    op7_best_fit_packing, op8_source_mixing, op9_warc_revisits, op10_url_filters, op11_quality_ranking, op12_spelling_variants, op13_source_divergence,
)}
ORACLES: dict[str, str] = {
    "op9_warc_revisits": oracles.WARC_REVISITS, "op10_url_filters": oracles.URL_FILTERS, "op12_spelling_variants": oracles.SPELLING_VARIANTS, "op13_source_divergence": oracles.SOURCE_DIVERGENCE,
}
