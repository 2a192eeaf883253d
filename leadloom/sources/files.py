"""Lead files: CSV, JSON and listing exports.

`row_id` is the position of a record in reading order. It is unique and ordered but has gaps;
`with_row_index` makes it dense and 0-based at the price of one more pass.

JSON Lines and CSV split across tasks, CSV also where quoted fields hold line breaks (see `split`).
"""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from leadloom import constants as K
from leadloom.operators.mapping import listing_record, map_headed_rows, map_records, tag_rejects
from leadloom.settings import MappingOptions
from leadloom.sources.split import csv_records, read_lines
from leadloom.sources.split_json import FAULT, json_elements

MAX_HEADERS = 1000
_LOCAL_BITS = 33  # monotonically_increasing_id keeps the position within a partition in its low bits


def with_row_index(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Dense 0-based position in reading order. `df` must be a scan or a stage table, read twice the same way."""
    placed = df.withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", _LOCAL_BITS)
    # one row per partition, so the running total is small whatever the data's size
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    local = F.col("_id").bitwiseAND((1 << _LOCAL_BITS) - 1)
    return (
        placed.withColumn("_part", part)
        .join(starts, "_part")
        .withColumn(name, F.col("_start") + local)
        .drop("_id", "_part", "_start")
    )


def _numbered(df: DataFrame, dense: bool) -> DataFrame:
    return with_row_index(df) if dense else df.withColumn("row_id", F.monotonically_increasing_id())


def ordered_index(df: DataFrame, at: str, name: str = "row_id") -> DataFrame:
    """Dense 0-based position by `at`, a position that `monotonically_increasing_id` gave and that may have gaps."""
    part = F.shiftright(at, _LOCAL_BITS)
    sizes = df.groupBy(part.alias("_part")).agg(F.count(at).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(at)) - 1
    return df.withColumn("_part", part).withColumn("_local", local).join(starts, "_part", "left").withColumn(name, F.col("_start") + F.col("_local")).drop("_part", "_local", "_start")


def first_lines(lines: DataFrame) -> DataFrame:
    """_file, _first (its place) and _line: the first line of each file that is not blank."""
    first = lines.where("_block = 0 AND btrim(value, ' \\t\\r') <> ''").groupBy("_file").agg(F.min(F.struct("_at", "value")).alias("_f"))
    return first.select("_file", F.col("_f._at").alias("_first"), F.col("_f.value").alias("_line"))


def header_fields(line: str) -> list[str]:
    """Header fields as written."""
    if line.count('"') % 2:
        raise ValueError("a header with a line break inside a field cannot be read")
    return next(csv.reader([line.lstrip("﻿")]))


def csv_rows(lines: DataFrame, same_header: bool = False, multiline: bool = True, dense_index: bool = False) -> tuple[DataFrame, list[list[str]]]:
    """`read_csv` over lines with their place (see `split.placed`), of files or of a micro-batch."""
    found = first_lines(lines)
    if same_header:
        first = found.select("_line").first()
        texts = [first["_line"]] if first else []
    else:
        texts = [r["_line"] for r in found.select("_line").distinct().orderBy("_line").limit(MAX_HEADERS + 1).collect()]
        if len(texts) > MAX_HEADERS:
            raise ValueError(f"more than {MAX_HEADERS} different headers")
    headers = [header_fields(text) for text in texts] or [[]]
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(max(map(len, headers)))])
    records = csv_records(lines) if multiline else lines.withColumn("value", F.rtrim("value", F.lit("\r"))).where(F.trim("value") != "")
    which = F.lit(0) if len(headers) == 1 else (F.array_position(F.array(*map(F.lit, texts)), F.col("_line")) - 1).cast("int")
    body = records.join(found.select("_file", "_first", which.alias("_header")), "_file").where("_block <> 0 OR _at <> _first")
    fields = F.from_csv("value", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {"quote": '"', "escape": '"'}) if schema else None
    rows = body.select("_at", "_header", *([fields.alias("_row")] if schema else []))
    numbered = ordered_index(rows, "_at") if dense_index else rows.withColumnRenamed("_at", "row_id")
    return numbered.select("row_id", *[f"_row.{c}" for c in schema.names], "_header"), headers


def read_csv(
    spark: SparkSession, path: str, multiline: bool = True, same_header: bool = False, dense_index: bool = False
) -> tuple[DataFrame, list[list[str]]]:
    """`row_id`, all columns as text under the names c0, c1, ..., `_header` (the number of the file's header), and the headers.

    Files may differ in their headers (in at most `MAX_HEADERS` ways). Finding that out reads the first split of every file
    once more; `same_header=True` says that they do not, and takes the header of one file for all. `multiline=False` says that no field
    holds a line break, which saves the pass that counts quotes. A header must be one line.
    """
    return csv_rows(read_lines(spark, path), same_header, multiline, dense_index)


def read_plain_csv(
    spark: SparkSession, path: str, required: tuple[str, ...] = ("company_name",), same_header: bool = False
) -> DataFrame:
    """CSV rows as they are, columns by name; refuses a file whose header lacks a required column. A column that a file lacks is null."""
    rows, headers = read_csv(spark, path, same_header=same_header)
    missing = sorted({name for header in headers for name in set(required) - set(header)})
    if missing:
        raise ValueError(f"missing required fields: {', '.join(missing)}")
    if len(headers) == 1:
        return rows.select(*[f"c{i}" for i in range(len(headers[0]))]).toDF(*headers[0])
    if any(len(set(header)) < len(header) for header in headers):
        raise ValueError("files with different headers need distinct column names")
    columns = []
    for name in dict.fromkeys(name for header in headers for name in header):
        cases = " ".join(f"WHEN {i} THEN c{h.index(name)}" for i, h in enumerate(headers) if name in h)
        columns.append(F.expr(f"CASE _header {cases} END").alias(name))
    return rows.select(*columns)


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One VARIANT `record` per line; a line that is not JSON is a null record."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.try_parse_json("value").alias("record"))


def json_roots(texts: DataFrame, list_keys: tuple[str, ...] = K.JSON_LIST_KEYS) -> DataFrame:
    """Records of whole JSON texts (`value`) in order: `record`, or a row with `bad_root` where a text holds no record list."""
    root = F.col("root")

    def is_list(v):
        return F.coalesce(F.schema_of_variant(v).startswith("ARRAY<"), F.lit(False))

    members = [F.try_variant_get(root, f"$.{k}", "variant") for k in list_keys]
    records = F.coalesce(
        F.when(is_list(root), F.try_variant_get(root, "$", "array<variant>")),
        *[F.when(is_list(m), F.try_variant_get(m, "$", "array<variant>")) for m in members],
    )
    exploded = texts.select(F.try_parse_json("value").alias("root")).select(records.alias("records")).select(
        F.col("records").isNull().alias("bad_root"), F.explode_outer("records").alias("record"),
        F.size("records").alias("n"),
    )
    return exploded.where(F.col("bad_root") | (F.col("n") > 0)).drop("n")


def read_json_file(spark: SparkSession, path: str, list_keys: tuple[str, ...] = K.JSON_LIST_KEYS, whole: bool = False) -> DataFrame:
    """Records of whole-file JSON: `record` and its place `_at`, or a row with `bad_root` where a file holds no record list or is no JSON.

    Files are read in byte splits (see `split_json`). As one broken record refuses its file, records are read once more to find these.
    `whole=True` reads each file in one task instead, as suits many small ones.
    """
    if whole:
        return json_roots(spark.read.text(path, wholetext=True), list_keys)
    records, unsound = json_elements(spark, path, list_keys)
    parsed = records.select("_file", "_at", (F.col("_kind") == FAULT).alias("_fault"), F.try_parse_json("value").alias("record"))
    broken = parsed.where("_fault OR record IS NULL").select("_file").unionByName(unsound).distinct()
    good = parsed.join(broken, "_file", "left_anti").select(F.lit(False).alias("bad_root"), "record", "_at")
    return good.unionByName(broken.select(F.lit(True).alias("bad_root"), F.expr("CAST(NULL AS VARIANT)").alias("record"), F.lit(None).cast("long").alias("_at")))


def read_leads(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    mapping: MappingOptions = MappingOptions(),
    dense_index: bool = False,
    multiline_csv: bool = True,
    same_header: bool = False,
) -> DataFrame:
    """Mapped rows with `row_id` and `reject_reason` (see operators.mapping for the split).

    fmt: csv, json, jsonl or listing; without it the file suffix decides, csv if unknown. CSV files may differ in their
    headers; `same_header=True` saves the pass that finds out.
    """
    kind = (fmt or _suffix_format(path)).strip().lower()
    if kind == "csv":
        rows, headers = read_csv(spark, path, multiline_csv, same_header, dense_index)
        return tag_rejects(map_headed_rows(rows, headers, mapping), mapping)
    if kind == "jsonl":
        rows = _numbered(read_json_lines(spark, path), dense_index)
        return tag_rejects(map_records(rows, mapping), mapping)
    if kind == "json":
        return tag_rejects(map_roots(read_json_file(spark, path), mapping, False, dense_index), mapping)
    if kind == "listing":
        return tag_rejects(map_roots(read_json_file(spark, path, K.LISTING_LIST_KEYS), mapping, True, dense_index), mapping)
    raise ValueError(f"unsupported input format: {fmt}")


def _suffix_format(path: str) -> str:
    lowered = path.lower().rstrip("/")
    return next((f for f in ("jsonl", "json") if lowered.endswith(f".{f}")), "csv")


def map_roots(records: DataFrame, mapping: MappingOptions, listing: bool = False, dense: bool = False) -> DataFrame:
    """Mapped rows of `json_roots`; a listing's records are renamed first."""
    if listing:
        records = records.withColumn("record", F.expr(listing_record("record")))
    if "_at" in records.columns:
        numbered = ordered_index(records, "_at") if dense else records.withColumn("row_id", F.col("_at"))
    else:
        numbered = _numbered(records, dense)
    # a bad root is one reject without a row number
    row = F.when(~F.col("bad_root"), F.col("row_id"))
    mapped = map_records(
        numbered.select(F.struct(row.alias("id"), F.col("bad_root").alias("bad")).alias("row_id"), "record"), mapping
    )
    reason = "invalid_listing_root" if listing else "invalid_json_root"
    return mapped.withColumn("_bad_record", F.when(F.col("row_id.bad"), reason).otherwise(F.col("_bad_record"))).withColumn(
        "row_id", F.col("row_id.id")
    )
