"""Embedding near-duplicates: candidates by sketches, cosines of candidates alone, one vector kept per group.

Only vectors with equal, non-null labels are compared; a vector that is null, zero or holds null or non-finite numbers
links with nothing. Equal vectors are one row with a count from there on. A vector first goes by a sketch of 48 bytes
(`vector_links`): its coordinates in the directions in which a sample differs most, and the length of the rest. Two sketches are
no less alike than their vectors, so no link is lost: recall is 1 by construction, whatever the sample holds. Sketches
that are alike form groups; only vectors in a group of two or more are read again, each is sent to its group, and links are
decided and counted there by whole cosines. A group may hold vectors that are not linked; a vector of no group has no links.
Links themselves never leave a task: it gives counts and a spanning forest. Labels and groups are told apart by 64 bits of hash.

Defined results: unlinkable rows have no links and are their own component, kept; repeated rows and equal vectors link with
each other; null ids count as rows but are never a component's id unless all are null; vectors of different length are not compared;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.llm import vector_links
from leadloom.llm.components import components
from leadloom.llm.substring_dedup import key_filter, probes
from leadloom.operators.stages import stage_table

THRESHOLD = 0.98
BLOCK = 8192  # vectors from which on a group may be cut into chunks
SLICE = 1024  # vectors sketched at a time
SAMPLE = 2048  # vectors that the directions of the sketches are taken from
SKETCH = [f"_s{i}" for i in range(vector_links.DIMS // 4)]  # four numbers of 16 bits in each
DEALT = "xxhash64(_node, 1) AS _dealt"


def named_vectors(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """All rows as (vec_id, _label, _v, _node): `_node` names a label and vector by 96 bits of hash and is null for what cannot link."""
    number = "float" if vectors.select(F.col(embedding)).schema[0].dataType == T.ArrayType(T.FloatType()) else "double"
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).cast("string").alias("_label"), F.col(embedding).cast(f"array<{number}>").alias("_v"))
    finite = "_label IS NOT NULL AND _v IS NOT NULL AND NOT exists(_v, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) AND exists(_v, x -> x <> 0)"
    node = "concat(lpad(hex(xxhash64(_label, _v)), 16, '0'), lpad(hex(hash(_v, _label)), 8, '0'))"
    return rows.selectExpr("*", f"CASE WHEN {finite} THEN {node} END AS _node")


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, rows and whole vectors as double numbers, a slice at a time, without those whose length counts as zero."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        for at in range(0, len(rows), SLICE):
            some = rows[at : at + SLICE]
            values = column.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).reshape(len(some), length).astype(np.float64)
            with np.errstate(over="ignore"):
                seen = (values * values).sum(axis=1) > 0
            yield length, some[seen], values[seen]


def sketch_bases(some: DataFrame) -> dict[int, np.ndarray]:
    """Directions for each vector length that a bounded sample holds. They decide how many candidates there are, not the result."""
    some = some.filter("_node IS NOT NULL").select("_v").limit(2 * SAMPLE).toArrow()
    held: dict[int, list[np.ndarray]] = {}
    for length, _, values in by_length(some["_v"].combine_chunks()):
        held.setdefault(length, []).append(vector_links.unit_vectors(values))
    units = {k: np.concatenate(v) for k, v in held.items() if k > vector_links.DIMS}
    return {k: vector_links.sketch_basis(v) for k, v in units.items() if len(v)}


def sketched(rows: DataFrame, bases: dict[int, np.ndarray]) -> DataFrame:
    """A row per linkable row: vec_id, _node, _group (its label and length), _length and the sketch."""
    source = rows.filter("_node IS NOT NULL").selectExpr("vec_id", "_node", "xxhash64(_label, size(_v)) AS _group", "size(_v) AS _length", "_v")
    names = ["vec_id", "_node", "_group", "_length"]
    schema = T.StructType([source.schema[c] for c in names] + [T.StructField(c, T.LongType()) for c in SKETCH])
    shared = rows.sparkSession.sparkContext.broadcast(bases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, some, values in by_length(batch["_v"]):
                numbers = vector_links.sketches(vector_links.unit_vectors(values), shared.value.get(length)).view(np.int64)
                taken = batch.select(names).take(pa.array(some))
                yield pa.RecordBatch.from_arrays([*taken.columns, *(pa.array(np.ascontiguousarray(x)) for x in numbers.T)], names=[*names, *SKETCH])

    return source.mapInArrow(run, schema)


def candidate_groups(units: DataFrame, threshold: float) -> DataFrame:
    """(_node, component) of vectors whose sketches are alike, directly or by others."""
    sizes = units.groupBy("_group").agg(F.count(F.lit(1)).alias("n"))
    deal = vector_links.deal_of(sizes, 4 * vector_links.DIMS, BLOCK)
    members = units.selectExpr("_node", "_group", DEALT, *SKETCH)
    found = stage_table(vector_links.links(members, deal, threshold, True).select("a", "b"), "vector-candidates")
    return stage_table(components(found, "vector-candidates").withColumnRenamed("node", "_node"), "vector-groups")


def passing(rows: DataFrame, groups: DataFrame, count: int) -> DataFrame:
    """Rows of which a filter of the names in `groups` lets pass few that are not in them, so that other vectors are not shuffled.
    All rows where it would let most of them pass."""
    if 2 * groups.count() > count:
        return rows
    words = key_filter(groups.selectExpr("_node AS _key", "0 AS _key2"))
    table = pa.table({"_bits": pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(words.view(np.int64)))})
    bits = F.broadcast(rows.sparkSession.createDataFrame(table, "_bits array<bigint>"))
    met = " AND ".join(f"getbit(get(_bits, CAST({at} DIV 64 AS INT)), CAST({at} % 64 AS INT)) = 1" for at in probes(64 * len(words)))
    return rows.selectExpr("*", "_node AS _key", "0 AS _key2").crossJoin(bits).where(met).select(*rows.columns)


def group_links(rows: DataFrame, groups: DataFrame, length: int, threshold: float) -> DataFrame:
    """Rows (a, b, n) as `vector_links.links` gives them, from the whole vectors of `groups`."""
    sizes = groups.groupBy(F.expr("xxhash64(component)").alias("_group")).agg(F.count(F.lit(1)).alias("n"))
    deal = vector_links.deal_of(sizes, 8 * length, BLOCK)
    whole = rows.select("_node", "_v").join(groups, "_node")
    members = whole.groupBy("_node", "component").agg(F.count(F.lit(1)).alias("copies"), F.first("_v").alias("_v"))
    double = rows.schema["_v"].dataType.elementType == T.DoubleType()
    return vector_links.links(members.selectExpr("_node", "xxhash64(component) AS _group", DEALT, "copies", "_v"), deal, threshold, False, double)


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    rows = named_vectors(vectors, vec_id, embedding, label)
    count = vectors.count()
    bases = sketch_bases(named_vectors(vectors.sample(min(1.0, SAMPLE / max(1, count)), 1), vec_id, embedding, label))
    once = [F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"), *(F.first(c).alias(c) for c in ("_group", "_length", *SKETCH))]
    units = stage_table(sketched(rows, bases).groupBy("_node").agg(*once), "vectors")
    longest = units.agg(F.max("_length")).first()[0] or 1
    alike = candidate_groups(units, threshold)
    found = stage_table(group_links(passing(rows.filter("_node IS NOT NULL"), alike, count), alike, longest, threshold), "vector-links")
    counts = found.filter("b IS NULL").groupBy(F.col("a").alias("_node")).agg(F.sum("n").alias("_others"))
    groups = components(found.filter("b IS NOT NULL").select("a", "b"), "vector-components").withColumnRenamed("node", "_node")
    linked = counts.join(groups, "_node")
    # A vector without links or copies needs no answer: it is its own component.
    named = units.select("_node", "copies", "least").join(linked, "_node", "left").filter("_others IS NOT NULL OR copies > 1")
    named = stage_table(named.withColumn("component", F.coalesce("component", "_node")), "vector-named")
    least = named.groupBy("component").agg(F.min("least").alias("_component_id"))
    answers = named.join(least, "component").selectExpr("_node", "coalesce(_others, 0L) + copies - 1 AS _links", "_component_id")
    # Rows that cannot link get a key of their own, so that their nulls do not meet in one task.
    probe = rows.selectExpr("vec_id", "coalesce(_node, concat('none-', CAST(xxhash64(vec_id) AS STRING))) AS _node")
    out = probe.join(answers, "_node", "left").selectExpr("vec_id", "coalesce(_links, 0L) AS n_links", "CASE WHEN _links IS NULL THEN vec_id ELSE _component_id END AS component_id")
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
