"""Near duplicates by similarity of word shingles: SimHash candidates from a Gray-order index, exact checks of what is unsure.

Two texts are near if the sets of their five-word shingles (A-Z in lower case) have a Jaccard similarity of at least
`SIMILARITY`. At 0.8 two 64-bit fingerprints differ in 9.7 bits on average, too many for one index over blocks of their bits,
so a text gets `WIDTH` words of 64 bits. The first is its code; equal codes are one from there on. The bits of the others make
keys: each of several tables joins what agrees in as many drawn bits as leave about `PER_BUCKET` codes a bucket, and there
are as many tables as give a pair at the bound a chance of `FOUND` to meet. Both numbers follow from the count of codes
alone; the copies of a code grow as its 0.24th power.

Within a bucket codes that differ in at most `BITS` bits are candidates, by a vectorised comparison in small buckets and by the
Gray-order index in others. A bucket gives a minimum spanning forest of its candidates, so that a dense group gives one
link per code, and a tighter rule still finds the nearest ones connected; each table has a forest of its own. All words together then tell
links that are sure (three standard deviations inside the bound) from those far outside (3.5 beyond it). The rest, where sure
links do not join its codes, is decided by whole shingle sets.

What this leaves out (pairs that meet in no table, differ in more than `BITS` bits, or lie on a path that a forest chose and the sets
refuse) is found by an exact join of what lies in different groups by then. Two sets that are similar share one of the first
n - ceil(SIMILARITY * n) + 1 members of each, in any one order of all shingles; here by hash, those that a sample shows to be common last.
The texts of a shingle are paired only across groups, so the copies in a group, however many, give no pairs; sizes and places that rule a
pair out drop it, then all words together where the sets are not small and the odds of a similar pair are below 1e-9, then whole sets decide.

Defined results: texts without words (null, empty) are near each other and nothing else; a text with fewer words than a shingle is one
shingle; repeated rows and equal texts are one code; ties go to the least id; null ids are least only where all are null; an empty
table gives no rows; very long texts are read whole, their shingles in parts; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from leadloom.llm.components import components
from leadloom.llm.simhash_dedup import BLOCK, SEED, GrayIndex, _range_pairs, joined_labels
from leadloom.operators.stages import stage_table

SIMILARITY = 0.8
SHINGLE = 5
WIDTH = 8  # words of 64 bits
FOUND = 0.97
PER_BUCKET = 4
BITS = 16
SMALL = 64  # larger buckets are searched through an index
SLICE = 64
PART = 1 << 13  # shingles counted together
SAMPLED = 0.05  # rows that tell common shingles
COMMON = 10  # rows of the sample that make a shingle common
MAX_COMMON = 1_000_000  # the least count grows with the sample so that about this many are listed at most (8 MB)
FAR = 0.3  # share of all bits beyond which sets of at least FEW members are not similar
FEW = 32
PAIRS = 1 << 20  # pairs made at a time


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = text.lower().split()
    k = min(shingle, len(words))
    body = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words], dtype=np.int64) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1] if words else ends
    return np.unique(np.array([xxh64_intdigest(body[a:b], SEED) for a, b in zip(starts.tolist(), ends[max(k - 1, 0) :].tolist(), strict=True)], np.uint64))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """`WIDTH` unsigned words; a bit is set if more than half the shingles have it. Each word mixes the hashes anew."""
    counts = np.zeros(64 * WIDTH, np.int64)
    for at in range(0, len(hashes), PART):
        z = hashes[at : at + PART, None] + np.arange(WIDTH, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        counts += np.unpackbits(z.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * counts > len(hashes)).view(np.uint64)


def apart(similarity: float) -> float:
    """Share of bits in which two texts of this similarity differ, texts being of equal length."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def tables(codes: int, similarity: float) -> np.ndarray:
    """Drawn bit positions: one row per table."""
    bits = max(8, math.ceil(math.log2(max(codes, 1) / PER_BUCKET)) if codes > PER_BUCKET else 8)
    count = math.ceil(math.log(1 - FOUND) / math.log1p(-((1 - apart(similarity)) ** bits)))
    draw = np.random.default_rng(SEED)
    return np.stack([64 + draw.permutation(64 * (WIDTH - 1))[:bits] for _ in range(count)])


NONE_COMMON = np.zeros(0, np.uint64)


def common_shingles(docs: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted shingles that stand in many texts of a sample. They decide only how evenly the exact join's work falls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(t.as_py() or b"", shingle) for t in batch["_text"]]
            found, n = np.unique(np.concatenate([*sets, NONE_COMMON]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["shingle", "n"])

    counts = stage_table(docs.select("_text").sample(SAMPLED, seed=SEED).mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 1"), "similar-sample")
    least = max(COMMON, (counts.agg(F.sum("n")).first()[0] or 0) // MAX_COMMON)
    return np.sort(np.array([r["shingle"] for r in counts.where(F.col("n") >= least).select("shingle").toLocalIterator()], np.int64).view(np.uint64))


def first_members(hashes: np.ndarray, common: np.ndarray = NONE_COMMON, similarity: float = SIMILARITY) -> np.ndarray:
    """The members of a sorted set by which every similar one meets it, in the order of the join: common ones last."""
    if len(common) and len(hashes):
        late = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes
        hashes = np.concatenate((hashes[~late], hashes[late]))
    return hashes[: len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1]


def wide_rows(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, common: np.ndarray = NONE_COMMON) -> DataFrame:
    """`doc_id`, the code, the text's key with all words, its number of shingles and the first of them, for docs of (doc_id, _key, _text)."""
    schema = docs.selectExpr("doc_id", "0L AS code", "_key", "array(0L) AS _wide", "0L AS _n", "array(0L) AS _first").schema

    def lists(arrays: list[np.ndarray]) -> pa.ListArray:
        ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, NONE_COMMON]).view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(t.as_py() or b"", shingle) for t in batch["_text"]]
            wide = [wide_fingerprint(s) for s in sets]
            codes = np.array([w[0] for w in wide], np.uint64).view(np.int64)
            firsts = lists([first_members(s, common, similarity) for s in sets])
            arrays = [batch["doc_id"], pa.array(codes), batch["_key"], lists(wide), pa.array([len(s) for s in sets], pa.int64()), firsts]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "code", "_key", "_wide", "_n", "_first"])

    return docs.mapInArrow(run, schema)


def spread(nodes: DataFrame, drawn: np.ndarray) -> DataFrame:
    """A row per code and table: the bucket, named by the table and the drawn bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = batch["_wide"].flatten().to_numpy().reshape(-1, WIDTH)
            bits = np.unpackbits(np.ascontiguousarray(wide).view(np.uint8), axis=1)
            for t, places in enumerate(drawn):
                bucket = bits[:, places].astype(np.int64) @ (1 << np.arange(len(places), dtype=np.int64)) + (t << 48)
                yield pa.RecordBatch.from_arrays([batch["code"], pa.array(bucket)], names=["code", "_bucket"])

    return nodes.select("code", "_wide").mapInArrow(run, "code long, _bucket long")


def spanning(label: np.ndarray, a: np.ndarray, b: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels after all links a-b, and the links of a minimum spanning forest: each component takes its least open link."""
    order = np.argsort(far, kind="stable")
    a, b = a[order], b[order]
    x, y = [a[:0]], [b[:0]]
    while True:
        p, q = label[a], label[b]
        open_ = p != q
        if not open_.any():
            return label, np.concatenate(x), np.concatenate(y)
        a, b, p, q = a[open_], b[open_], p[open_], q[open_]
        best = np.full(len(label), len(a))
        np.minimum.at(best, np.concatenate((p, q)), np.tile(np.arange(len(a)), 2))
        chosen = np.unique(best[best < len(a)])
        x.append(a[chosen])
        y.append(b[chosen])
        label = joined_labels(label, a[chosen], b[chosen])


def small_buckets(group: np.ndarray, codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Forests of many small buckets at once: rows are compared with those 1, 2, ... places on in the same bucket."""
    a, b, far = [], [], []
    left = np.arange(len(codes))
    for lag in range(1, SMALL):
        left = left[left + lag < len(codes)]
        left = left[group[left] == group[left + lag]]
        if not len(left):
            break
        off = np.bitwise_count(codes[left] ^ codes[left + lag])
        hit = off <= bits
        a.append(left[hit])
        b.append(left[hit] + lag)
        far.append(off[hit])
    if not a:
        return codes[:0], codes[:0]
    _, x, y = spanning(np.arange(len(codes)), np.concatenate(a), np.concatenate(b), np.concatenate(far))
    return codes[x], codes[y]


def large_bucket(left: np.ndarray, right: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest within `left`, or from `right` to `left`, through the Gray-order index."""
    index = GrayIndex(left)
    codes = index.codes if right is None else np.concatenate((index.codes, right))
    label = np.arange(len(codes))
    queries = np.arange(len(index.codes)) if right is None else np.arange(len(index.codes), len(codes))
    x, y = [codes[:0]], [codes[:0]]
    for at in range(0, len(queries), SLICE):
        some = queries[at : at + SLICE]
        query, found = index.near(codes[some], bits, label[some], index.uniform(label[: len(index.codes)]))
        label, a, b = spanning(label, some[query], found, np.bitwise_count(codes[some[query]] ^ codes[found]))
        x.append(codes[a])
        y.append(codes[b])
    return np.concatenate(x), np.concatenate(y)


def _forests(table: np.ndarray, bits: int) -> pa.RecordBatch:
    """Links of whole buckets: rows of bucket, pair, side and code, sorted by bucket and pair."""
    new = (np.diff(table[0], prepend=-1) != 0) | (np.diff(table[1], prepend=-1) != 0)
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, table.shape[1]))
    group, codes = np.cumsum(new), table[3].view(np.uint64)
    large = (sizes > SMALL) | (table[1][starts] > 0)
    plain = ~np.repeat(large, sizes)
    found = [small_buckets(group[plain], codes[plain], bits)]
    for at, size in zip(starts[large].tolist(), sizes[large].tolist(), strict=True):
        some, other = codes[at : at + size], table[2][at : at + size] == 1
        if not other.all():
            found.append(large_bucket(some[~other], some[other] if other.any() else None, bits))
    a, b = (np.concatenate(side).view(np.int64) for side in zip(*found, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def candidates(nodes: DataFrame, similarity: float = SIMILARITY, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """Distinct candidate links (a, b), a < b, between the codes of `nodes`. Buckets of more than `block` codes are split into pairs of ranges."""
    rows = spread(nodes, tables(nodes.count(), similarity))
    crowded = stage_table(rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > block), "similar-crowded")
    dealt = rows.selectExpr("_bucket", "0L AS _pair", "0L AS _side", "code")
    if crowded.limit(1).count():
        ranges = _range_pairs(rows.join(crowded, "_bucket"), bits, block).selectExpr("_bucket", "_pair + 1 AS _pair", "_side", "code")
        dealt = dealt.join(crowded, "_bucket", "left_anti").unionByName(ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((4, 0), np.int64)
        for batch in batches:
            table = np.concatenate((rest, np.stack([batch[c].to_numpy() for c in ("_bucket", "_pair", "_side", "code")])), axis=1)
            last = np.flatnonzero((table[0] != table[0, -1]) | (table[1] != table[1, -1])) if table.shape[1] else np.zeros(0, int)
            cut = int(last[-1]) + 1 if len(last) else 0
            rest = table[:, cut:]
            if cut:
                yield _forests(table[:, :cut], bits)
        if rest.shape[1]:
            yield _forests(rest, bits)

    ordered = dealt.repartition("_bucket", "_pair").sortWithinPartitions("_bucket", "_pair")
    return ordered.mapInArrow(run, "a long, b long").filter("a <> b").distinct()


def shingle_sets(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(_key, _set) of docs of (_key, _text): the sorted distinct shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch["_text"]):
                found = shingle_hashes(text.as_py() or b"", shingle).view(np.int64)
                one = pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), pa.array(found))
                yield pa.RecordBatch.from_arrays([batch["_key"].slice(i, 1), one], names=["_key", "_set"])

    return docs.mapInArrow(run, "_key string, _set array<long>")


def _sides(links: DataFrame, values: DataFrame, how: str = "inner") -> DataFrame:
    """Links with the columns of `values` (by code) of both ends, their names followed by _a and _b."""
    for side in ("a", "b"):
        links = links.join(values.select(*[F.col(c).alias(side if c == "code" else f"{c}_{side}") for c in values.columns]), side, how)
    return links


def similar_links(nodes: DataFrame, docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """Links (a, b) that connect the codes of similar texts."""
    mean = apart(similarity)
    spread_ = math.sqrt(mean * (1 - mean) / (64 * WIDTH))
    differ = "aggregate(zip_with(_wide_a, _wide_b, (x, y) -> bit_count(x ^ y)), 0, (n, x) -> n + x) AS _far"
    told = _sides(candidates(nodes, similarity), nodes.select("code", "_wide")).selectExpr("a", "b", differ)
    told = stage_table(told.filter(F.col("_far") <= 64 * WIDTH * (mean + 3.5 * spread_)), "similar-candidates")
    sure = told.filter(F.col("_far") <= 64 * WIDTH * (mean - 3 * spread_)).select("a", "b")
    groups = components(sure, "similar-sure").withColumnRenamed("node", "code")
    unsure = _sides(told.filter(F.col("_far") > 64 * WIDTH * (mean - 3 * spread_)).select("a", "b"), groups, "left")
    unsure = stage_table(unsure.filter("coalesce(component_a, a) <> coalesce(component_b, b)").select("a", "b"), "similar-unsure")
    asked = unsure.select(F.col("a").alias("code")).unionByName(unsure.select(F.col("b").alias("code"))).distinct()
    keys = stage_table(nodes.join(asked, "code", "left_semi").select("code", "_key"), "similar-keys")
    sets = stage_table(keys.join(shingle_sets(docs.join(keys, "_key", "left_semi").dropDuplicates(["_key"]), shingle), "_key").select("code", "_set"), "similar-sets")
    both = "size(array_intersect(_set_a, _set_b))"
    exact = _sides(unsure, sets).filter(f"{both} >= {similarity!r}D * (size(_set_a) + size(_set_b) - {both})").select("a", "b")
    return sure.unionByName(exact)


def _meetings(similarity: float):
    """Pairs of texts of different groups that share one of their first shingles; rows arrive sorted by shingle and group."""

    def pairs(t: np.ndarray) -> Iterator[pa.RecordBatch]:
        shingle, group, text, size, place = t
        new = np.diff(shingle, prepend=shingle[0] - 1 if len(shingle) else 0) != 0
        starts = np.flatnonzero(new | (np.diff(group, prepend=0) != 0))  # of runs of one group in a shingle
        ends = np.append(np.flatnonzero(new)[1:], len(shingle))[np.cumsum(new) - 1]
        after = np.append(starts[1:], len(shingle))[np.searchsorted(starts, np.arange(len(shingle)), side="right") - 1]
        counts = np.maximum(ends - after, 0)
        total = np.concatenate(([0], np.cumsum(counts)))
        for at in range(0, int(total[-1]), PAIRS):
            k = np.arange(at, min(at + PAIRS, int(total[-1])))
            a = np.searchsorted(total, k, side="right") - 1
            b = after[a] + k - total[a]
            shared = np.ceil(similarity / (1 + similarity) * (size[a] + size[b]) - 1e-6)
            hit = np.minimum(size[a] - place[a], size[b] - place[b]) >= shared
            x, y = text[a[hit]], text[b[hit]]
            found = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y))), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((5, 0), np.int64)
        for batch in batches:
            table = np.concatenate((rest, np.stack([batch[c].to_numpy() for c in ("shingle", "group", "text", "size", "place")])), axis=1)
            last = np.flatnonzero(table[0] != table[0, -1]) if table.shape[1] else np.zeros(0, int)
            cut = int(last[-1]) + 1 if len(last) else 0
            rest = table[:, cut:]
            if cut:
                yield from pairs(table[:, :cut])
        if rest.shape[1]:
            yield from pairs(rest)

    return run


def missed_links(texts: DataFrame, docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """Links (a, b) between the groups of similar texts that lie in different ones. `texts` has one row a text: `text` (a number), `_key`,
    `group`, `size`, `_first` and `_wide`."""
    firsts = texts.select("group", "text", "size", F.posexplode("_first").alias("place", "shingle")).select("shingle", "group", "text", "size", F.col("place").cast("long"))
    ordered = firsts.repartition("shingle").sortWithinPartitions("shingle", "group")
    met = ordered.mapInArrow(_meetings(similarity), "a long, b long").distinct()
    told = texts.select(F.col("text").alias("code"), "_wide", "size", "group", "_key")
    differ = "aggregate(zip_with(_wide_a, _wide_b, (x, y) -> bit_count(x ^ y)), 0, (n, x) -> n + x)"
    near = _sides(met, told).where(f"least(size_a, size_b) < {FEW} OR {differ} <= {FAR * 64 * WIDTH}D").select("group_a", "group_b", "_key_a", "_key_b")
    near = stage_table(near, "similar-met")
    asked = near.select(F.col("_key_a").alias("_key")).unionByName(near.select(F.col("_key_b").alias("_key"))).distinct()
    sets = stage_table(shingle_sets(docs.join(asked, "_key", "left_semi").dropDuplicates(["_key"]), shingle).select(F.col("_key").alias("code"), "_set"), "similar-met-sets")
    both = "size(array_intersect(_set_a, _set_b))"
    exact = _sides(near.select(F.col("_key_a").alias("a"), F.col("_key_b").alias("b"), "group_a", "group_b"), sets)
    return exact.filter(f"{both} >= {similarity!r}D * (size(_set_a) + size(_set_b) - {both})").select(F.col("group_a").alias("a"), F.col("group_b").alias("b"))


def least_ids(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """All rows as (doc_id, code), and each code with component_id, the least doc_id reachable over similar texts."""
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.md5(body).alias("_key"), body.alias("_text"))
    rows = stage_table(wide_rows(plain, shingle, similarity, common_shingles(plain, shingle)), "similar-rows")
    nodes = rows.groupBy("code").agg(F.min("doc_id").alias("_least"), F.min(F.struct("_key", "_wide")).alias("_one"))
    nodes = stage_table(nodes.select("code", "_least", "_one._key", "_one._wide"), "similar-nodes")
    bodies = plain.select("_key", "_text")
    found = components(similar_links(nodes, bodies, similarity, shingle), "similar-links")
    grouped = nodes.select("code", "_least").join(found.withColumnRenamed("node", "code"), "code", "left").withColumn("group", F.coalesce("component", "code")).drop("component")
    grouped = stage_table(grouped, "similar-groups")
    each = rows.groupBy("_key").agg(F.min(F.struct("code", F.col("_n").alias("size"), "_wide", "_first")).alias("_one")).select("_key", F.xxhash64("_key").alias("text"), "_one.*")
    texts = stage_table(each.join(grouped.select("code", "group"), "code"), "similar-texts")
    joined = components(missed_links(texts, bodies, similarity, shingle), "similar-missed")
    labelled = grouped.join(joined.withColumnRenamed("node", "group"), "group", "left").withColumn("component", F.coalesce("component", "group"))
    least = labelled.groupBy("component").agg(F.min("_least").alias("component_id"))
    return rows.select("doc_id", "code"), labelled.join(least, "component").select("code", "component_id")


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, code and component_id of every row."""
    rows, answers = least_ids(docs, doc_id, text, similarity, shingle)
    return rows.join(answers, "code").select("doc_id", "code", "component_id")
