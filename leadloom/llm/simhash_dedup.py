"""SimHash near-duplicates found with a Gray-order hierarchical index.

Fingerprints are made per whole text, and equal ones are one from there on. Two fingerprints that differ in at most
`BITS` bits agree in at least one of BITS + 1 blocks of their bits, so each travels to as many buckets, keyed by block
and its value. Within a bucket they are sorted by Gray rank, so that neighbours differ in few bits; groups of
`FAN` neighbours form a node that holds the bits all of them share (a mask and a pattern), `FAN` nodes form a node above,
and bits that a parent shares are left out of its children. A query adds up the differences on its way down and leaves
a whole group as soon as they exceed the bound. Groups already known to belong to the query's component are left too, which
keeps a dense group of near copies from being compared pair by pair. A bucket gives a spanning forest, at most one
link per fingerprint; components over all buckets are found on the cluster.

A bucket of more than `BLOCK` fingerprints is split into ranges of Gray rank, and pairs of ranges become tasks of
their own, unless the bits their members share already differ too much.

Defined results: a text without words (null, empty) has fingerprint zero, linked like any other; a text with fewer
words than a shingle is one shingle; repeated rows share a fingerprint and so a component; a null id takes part but is
never a component's id unless all are null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from leadloom.llm.components import components
from leadloom.operators.stages import stage_table

BITS = 4
SHINGLE = 4
SEED = 42
FAN = 8
BLOCK = 40_000
SLICE = 512  # queries that walk down together
PART = 1 << 16  # shingles counted together


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a text: a bit is set if more than half the shingle hashes have it."""
    words = text.lower().split()
    if not words:
        return 0
    body = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    counts = np.zeros(64, np.int64)
    first, last = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    for at in range(0, len(first), PART):
        hashes = np.array([xxh64_intdigest(body[a:b], SEED) for a, b in zip(first[at : at + PART], last[at : at + PART], strict=True)], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(first)).view(">i8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and its fingerprint as a signed 64-bit number."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("_text"))
    schema = rows.select("doc_id", F.lit(0).cast("bigint").alias("fingerprint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py() or b"", shingle) for t in batch["_text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, pa.int64())], names=["doc_id", "fingerprint"])

    return rows.mapInArrow(run, schema)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the order in which neighbours differ in one bit."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def gray_rank_sql(code: str) -> str:
    """The same as a SQL expression over a signed 64-bit number, with the sign turned so that it sorts as unsigned."""
    out = code
    for shift in (1, 2, 4, 8, 16, 32):
        out = f"element_at(transform(array({out}), x -> x ^ shiftrightunsigned(x, {shift})), 1)"
    return f"({out}) ^ (-9223372036854775807L - 1L)"


class GrayIndex:
    """Levels of nodes over fingerprints sorted by Gray rank; level 0 is the fingerprints."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        every, some = [self.codes], [self.codes]
        while len(every[-1]) > FAN:
            cuts = np.arange(0, len(every[-1]), FAN)
            every.append(np.bitwise_and.reduceat(every[-1], cuts))
            some.append(np.bitwise_or.reduceat(some[-1], cuts))
        shared = [~(a ^ o) for a, o in zip(every, some, strict=True)]
        self.patterns = every
        self.masks = [s & ~np.repeat(shared[i + 1], FAN)[: len(s)] if i + 1 < len(shared) else s for i, s in enumerate(shared)]

    def uniform(self, label: np.ndarray) -> list[np.ndarray]:
        """For each level, the label that all fingerprints below a node have, or -1."""
        low, high, out = label, label, [label]
        for level in range(1, len(self.patterns)):
            cuts = np.arange(0, len(low), FAN)
            low, high = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            out.append(np.where(low == high, low, -1))
        return out

    def near(self, queries: np.ndarray, bits: int, own: np.ndarray | None = None, uniform: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, fingerprint) positions that differ in at most `bits`, but for groups of the query's own label."""
        top = len(self.patterns) - 1
        nodes = len(self.patterns[top])
        query, node = np.repeat(np.arange(len(queries)), nodes), np.tile(np.arange(nodes), len(queries))
        total = np.zeros(len(query), np.uint8)
        for level in range(top, -1, -1):
            total = total + np.bitwise_count((queries[query] ^ self.patterns[level][node]) & self.masks[level][node])
            keep = total <= bits
            if own is not None:
                keep &= uniform[level][node] != own[query]
            query, node, total = query[keep], node[keep], total[keep]
            if level:
                size = len(self.patterns[level - 1])
                query, total = np.repeat(query, FAN), np.repeat(total, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                inside = node < size
                query, node, total = query[inside], node[inside], total[inside]
        return query, node


def joined_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (positions of a member, least of its component) after the links a-b."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, label[label]):
            label = label[label]


def forest(left: np.ndarray, right: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is near: within `left`, or from `right` to `left`."""
    index = GrayIndex(left)
    codes = index.codes if right is None else np.concatenate((index.codes, right))
    label = np.arange(len(codes))
    queries = np.arange(len(index.codes)) if right is None else np.arange(len(index.codes), len(codes))
    for at in range(0, len(queries), SLICE):
        some = queries[at : at + SLICE]
        query, found = index.near(codes[some], bits, label[some], index.uniform(label[: len(index.codes)]))
        label = joined_labels(label, some[query], found)
    member = np.flatnonzero(label != np.arange(len(codes)))
    return codes[member].view(np.int64), codes[label[member]].view(np.int64)


def _links(bits: int):
    """Rows sorted by bucket and part; one task of a bucket is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rest = None
        for batch in batches:
            table = np.stack([batch[c].to_numpy() for c in ("_bucket", "_pair", "_side", "code")])
            table = table if rest is None else np.concatenate((rest, table), axis=1)
            new = np.flatnonzero((np.diff(table[0]) != 0) | (np.diff(table[1]) != 0)) + 1
            bounds = [0, *new.tolist()]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                held.append(table[:, a:b])
            rest = table[:, bounds[-1] :]
            yield _settled(held, bits)
            held = []
        if rest is not None:
            yield _settled([rest], bits)

    return run


def _settled(tasks: list[np.ndarray], bits: int) -> pa.RecordBatch:
    a, b = [], []
    for task in tasks:
        codes, right = task[3].view(np.uint64), task[2] == 1
        if len(codes) > 1 and not right.all():
            x, y = forest(codes[~right], codes[right] if right.any() else None, bits)
            a.append(x)
            b.append(y)
    join = lambda xs: pa.array(np.concatenate(xs) if xs else np.zeros(0, np.int64), pa.int64())
    return pa.RecordBatch.from_arrays([join(a), join(b)], names=["a", "b"])


def near_links(codes: DataFrame, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the distinct values of `code`: every component of the near relation is connected by them."""
    edges = [64 * i // (bits + 1) for i in range(bits + 2)]
    values = ", ".join(f"shiftrightunsigned(code, {a}) & {(1 << (b - a)) - 1}L | {i}L << 32" for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)))
    spread = codes.selectExpr("code", f"explode(array({values})) AS _bucket")
    sizes = stage_table(spread.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "simhash-buckets")
    crowded = sizes.filter(F.col("_n") > block)
    small = spread.join(sizes.filter(F.col("_n") <= block).select("_bucket"), "_bucket").selectExpr("_bucket", "0L AS _pair", "0L AS _side", "code")
    if crowded.limit(1).count():
        small = small.unionByName(_range_pairs(spread.join(crowded, "_bucket"), bits, block))
    ordered = small.repartition("_bucket", "_pair").sortWithinPartitions("_bucket", "_pair")
    return ordered.mapInArrow(_links(bits), "a long, b long")


def _range_pairs(rows: DataFrame, bits: int, block: int) -> DataFrame:
    """Crowded buckets as pairs of ranges of Gray rank. Ranges whose shared bits differ too much are not paired."""
    ranked = rows.withColumn("_rank", F.expr(gray_rank_sql("code")))
    fractions = F.expr(f"transform(sequence(1, CAST(ceil(_n / {block}) AS INT)), x -> x / ceil(_n / {block}))")
    cuts = ranked.groupBy("_bucket").agg(F.max("_n").alias("_n"), F.expr("percentile_approx(_rank, array(" + ", ".join(f"{i / 256}D" for i in range(1, 257)) + "), 10000) AS _q"))
    cuts = cuts.select("_bucket", F.transform(fractions, lambda x: F.element_at("_q", F.greatest(F.lit(1), (x * 256).cast("int")))).alias("_cuts"))
    placed = ranked.join(cuts, "_bucket").selectExpr("_bucket", "code", "CAST(size(filter(_cuts, x -> x < _rank)) AS BIGINT) AS _range")
    nodes = placed.groupBy("_bucket", "_range").agg(F.bit_and("code").alias("_and"), F.bit_or("code").alias("_or"))
    other = nodes.selectExpr("_bucket", "_range AS _range2", "_and AS _and2", "_or AS _or2")
    apart = "bit_count((_and ^ _and2) & ~(_and ^ _or) & ~(_and2 ^ _or2))"
    pairs = nodes.join(other, "_bucket").filter(f"_range <= _range2 AND {apart} <= {bits}").select("_bucket", "_range", "_range2")
    both = pairs.selectExpr("_bucket", "_range * 1000000L + _range2 AS _pair", "_range AS _r", "0L AS _side").unionByName(
        pairs.filter("_range < _range2").selectExpr("_bucket", "_range * 1000000L + _range2 AS _pair", "_range2 AS _r", "1L AS _side")
    )
    return placed.withColumnRenamed("_range", "_r").join(both, ["_bucket", "_r"]).select("_bucket", "_pair", "_side", "code")


def least_ids(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """Every distinct fingerprint of `rows` (doc_id and fingerprint, written before) with the least doc_id of its component."""
    codes = stage_table(rows.groupBy(F.col("fingerprint").alias("code")).agg(F.min("doc_id").alias("_least")), "simhash-codes")
    found = components(near_links(codes.select("code"), bits), "simhash-links")
    labelled = codes.join(found.withColumnRenamed("node", "code"), "code", "left").withColumn("component", F.coalesce("component", "code"))
    ids = labelled.groupBy("component").agg(F.min("_least").alias("component_id"))
    return labelled.join(ids, "component").select(F.col("code").alias("fingerprint"), "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row."""
    rows = stage_table(fingerprints(docs, doc_id, text), "simhash")
    return rows.join(least_ids(rows, bits), "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
