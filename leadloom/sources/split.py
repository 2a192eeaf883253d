"""Records of large text files, found in every byte split at once.

Spark splits a text file at line ends. Whether a line of a CSV file begins a record depends on all quotes before it, so each split is
read twice: the first pass only counts quotes per split (summed before the shuffle), and a running sum over the splits of a file
says in which state each begins. The second pass cuts its lines into records from there. A record that lies across splits leaves a piece in
each; these are put together by key, and only splits that begin or end inside a record are read for them.

A quote always opens or closes here: a stray quote inside an unquoted field cannot be told apart and joins lines to one record.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadloom.operators.stages import stage_table

WHOLE, HEAD, MIDDLE, TAIL = range(4)
BROADCAST_SPLITS = 200_000  # splits whose state is sent to every task (some 20 MB); beyond, lines are dealt to their splits
SPLIT = ["_file", "_block"]
PIECES = "_file string, _block long, _at long, _kind int, value string"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """_file, _block (where its split begins), _at (position in reading order) and value of each line; ends at \\n, a \\r stays."""
    return placed(spark.read.option("lineSep", "\n").text(path).select("value", "_metadata.file_path", "_metadata.file_block_start"))


def placed(lines: DataFrame) -> DataFrame:
    """The same of `value`, `file_path` and `file_block_start`, such as a micro-batch of a text stream has."""
    return lines.select(F.col("file_path").alias("_file"), F.col("file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), "value")


def quote_states(lines: DataFrame) -> DataFrame:
    """_file, _block, _open (the split begins inside quotes) and _ends_open. One row per split."""
    quotes = F.char_length("value") - F.char_length(F.replace("value", F.lit('"'), F.lit("")))
    odd = lines.groupBy(*SPLIT).agg((F.sum(quotes) % 2).alias("_odd"))
    before = Window.partitionBy("_file").orderBy("_block")
    upto = F.sum("_odd").over(before.rowsBetween(Window.unboundedPreceding, 0)) % 2
    return odd.select(*SPLIT, ((upto + F.col("_odd")) % 2 == 1).alias("_open"), (upto == 1).alias("_ends_open"))


def in_order(lines: DataFrame, states: DataFrame, small: bool) -> DataFrame:
    """Lines with the state of their split, those of a split together and in order."""
    if small:  # a broadcast join leaves rows where they are
        return lines.join(F.broadcast(states), SPLIT)
    return lines.join(states, SPLIT).repartition(*SPLIT).sortWithinPartitions(*SPLIT, "_at")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split, opened, carried, held, at = None, False, False, [], 0
    out: list[tuple] = []

    def left_over() -> None:
        if held:
            out.append((*split, at, MIDDLE if carried else TAIL, "\n".join(held)))

    def batch_of() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["_file", "_block", "_at", "_kind", "value"])
        out.clear()
        return made

    for batch in batches:
        for file, block, place, value, begins_open in zip(*[batch[c].to_pylist() for c in ("_file", "_block", "_at", "value", "_open")], strict=True):
            if (file, block) != split:
                left_over()
                split, opened, carried, held, at = (file, block), begins_open, begins_open, [], place
            turns = value.count('"') % 2 == 1
            if opened:
                held.append(value)
                if turns:
                    out.append((file, block, at, HEAD if carried else WHOLE, "\n".join(held)))
                    opened, carried, held = False, False, []
            elif turns:
                opened, held, at = True, [value], place
            else:
                out.append((file, block, place, WHOLE, value))
        yield batch_of()
    left_over()
    yield batch_of()


def stitched(parts: DataFrame, by: str) -> DataFrame:
    """_file, _block, _at and value of the records that lie across splits, from their pieces in order."""
    in_file = Window.partitionBy("_file").orderBy("_block", "_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    grouped = parts.withColumn("_record", F.sum((F.col("_kind") == TAIL).cast("int")).over(in_file)).groupBy("_file", "_record")
    joined = grouped.agg(F.array_sort(F.collect_list(F.struct("_block", "_at", "value"))).alias("_parts"))
    return joined.select("_file", F.expr("_parts[0]._block AS _block"), F.expr("_parts[0]._at AS _at"), F.array_join("_parts.value", by).alias("value"))


def csv_records(lines: DataFrame) -> DataFrame:
    """_file, _block, _at and the text `value` of every record that is not blank, without its line end."""
    states = stage_table(quote_states(lines), "csv-splits")  # small, and all text would be read again for it
    small = states.limit(BROADCAST_SPLITS + 1).count() <= BROADCAST_SPLITS
    whole = in_order(lines, states, small).mapInArrow(_cut, PIECES).where(F.col("_kind") == WHOLE).drop("_kind")
    across = states.where("_open OR _ends_open")
    parts = in_order(lines, across, small).mapInArrow(_cut, PIECES).where(F.col("_kind") != WHOLE)
    records = whole.unionByName(stitched(parts, "\n")).withColumn("value", F.rtrim("value", F.lit("\r")))
    return records.where(F.trim("value") != "")
