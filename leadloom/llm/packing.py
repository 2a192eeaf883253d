"""Best-two-fit packing of tokenised documents into sequences of a fixed capacity.

A document is its token ids and an end id; only documents longer than the capacity are cut. Bins are planned on the
histogram of piece lengths, which has at most `capacity` entries whatever the corpus: fill a bin greedily with the
longest pieces that fit, then, while it leaves a gap, replace its smallest piece by the two unpacked pieces that fit
the widened gap most tightly. A pattern is applied as often as its lengths last, which is what planning bin by bin
would do. The k-th piece of a length then takes the k-th slot of that length: ranks come from a window over
(length, salt), with as many salts as the length has thousands of pieces, so no task holds all pieces of one length.

Defined results: a null or empty text is one piece with only the end id; repeated rows are packed each; ties are
broken by document id, piece and checksum; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm import tokens
from leadloom.operators.stages import stage_table

CAPACITY = 2048
END_ID = 0
SALT_ROWS = 5000  # pieces of one length that share a rank window


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and with `with_ids` the ids (little-endian, 32 bits)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("_text"))
    numbers = {"piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint"} | ({"ids": "binary"} if with_ids else {})
    schema = rows.select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in numbers.items()]).schema
    end = array("I", [END_ID]).tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokens.loaded(tokenizer)
        for batch in batches:
            taken: list[int] = []
            columns: list[list] = [[] for _ in numbers]
            for at, body in enumerate(batch["_text"]):
                ids = known.ids(body.as_py() or b"") + end
                for number, first in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[first : first + 4 * capacity]
                    taken.append(at)
                    for column, value in zip(columns, (number, first // 4, len(part) // 4, zlib.crc32(part), part), strict=False):
                        column.append(value)
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            values = [pa.array(c, t) for c, t in zip(columns, types, strict=False)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(taken, pa.int64())), *values], names=["doc_id", *numbers])
        known.forget()

    return rows.mapInArrow(cut, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, Counter]]:
    """Bins for so many pieces of each length: (how often, lengths of one bin)."""
    left, lengths = dict(counts), sorted(k for k, n in counts.items() if n > 0)
    bins: list[tuple[int, Counter]] = []

    def fitting(space: int, used: Counter) -> int | None:
        at = bisect_right(lengths, space)
        while at and left[lengths[at - 1]] <= used[lengths[at - 1]]:
            at -= 1
        return lengths[at - 1] if at else None

    def best_pair(least: int, space: int, used: Counter) -> tuple[int, int] | None:
        """Two unpacked lengths with the largest sum above `least` and within `space`."""
        best = None
        for a in reversed(lengths[: bisect_right(lengths, space)]):
            if 2 * a <= least:
                break
            if left[a] <= used[a]:
                continue
            used[a] += 1
            b = fitting(min(a, space - a), used)
            used[a] -= 1
            if b and a + b > least:
                best, least = (a, b), a + b
                if least == space:
                    break
        return best

    while lengths:
        used: Counter = Counter()
        order: list[int] = []
        gap = capacity
        while gap and (size := fitting(gap, used)):
            used[size] += 1
            insort(order, size)
            gap -= size
        while gap and len(order) > 1 and (pair := best_pair(order[0], gap + order[0], used)):
            smallest = order.pop(0)
            used[smallest] -= 1
            for size in pair:
                used[size] += 1
                insort(order, size)
            gap += smallest - sum(pair)
        used = +used
        times = min(left[k] // n for k, n in used.items())
        bins.append((times, used))
        for k, n in used.items():
            left[k] -= times * n
            if not left[k]:
                lengths.remove(k)
    return bins


def slots(bins: list[tuple[int, Counter]]) -> dict[str, np.ndarray]:
    """Runs of slots in the order of (length, rank): where a run begins, its first sequence, how many pieces of that
    length a sequence has, and the offset of the first of them."""
    runs, ranks, first = [], Counter(), 0
    for times, used in bins:
        offset = 0
        for size in sorted(used, reverse=True):
            runs.append(((size << 44) + ranks[size], first, used[size], offset, ranks[size]))
            ranks[size] += times * used[size]
            offset += size * used[size]
        first += times
    runs.sort()
    columns = zip(*runs, strict=True) if runs else [()] * 5
    return dict(zip(("key", "sequence", "each", "offset", "rank"), (np.array(c, np.int64) for c in columns), strict=True))


def place(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces (doc_id, piece, length, ids_crc32 and others)."""
    histogram = {int(r["length"]): r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    salts = "array(" + ", ".join(str(1 + histogram.get(k, 0) // SALT_ROWS) for k in range(capacity + 1)) + ")"
    salted = rows.selectExpr("*", f"CAST(pmod(xxhash64(doc_id, piece, ids_crc32), {salts}[CAST(length AS INT)]) AS INT) AS _salt")
    groups = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = "coalesce(sum(_n) OVER (PARTITION BY length ORDER BY _salt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS _before"
    numbered = salted.selectExpr("*", "row_number() OVER (PARTITION BY length, _salt ORDER BY doc_id, piece, ids_crc32) AS _number")
    ranked = numbered.join(groups.selectExpr("length", "_salt", before), ["length", "_salt"]).withColumn("_rank", F.expr("_before + _number - 1"))
    ranked = ranked.select(*rows.columns, "_rank")
    schema = rows.select("*", F.lit(0).cast("bigint").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")).schema
    shared, columns = rows.sparkSession.sparkContext.broadcast(slots(plan(histogram, capacity))), rows.columns

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            size, rank = batch["length"].to_numpy(), batch["_rank"].to_numpy()
            run = np.searchsorted(table["key"], (size << 44) + rank, side="right") - 1
            copy, turn = np.divmod(rank - table["rank"][run], table["each"][run])
            sequence, offset = table["sequence"][run] + copy, table["offset"][run] + turn * size
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in columns], pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    return ranked.mapInArrow(seat, schema)


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return place(stage_table(pieces(docs, tokenizer, doc_id, text, capacity, with_ids), "pieces"), capacity)
