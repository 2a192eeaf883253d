"""Exact substring deduplication by super-k-mer partitioning over words.

A window is WINDOW consecutive words of one text. Its minimiser is the least hash among its runs of GRAM words. The
windows of a text that follow each other and share a minimiser travel together as one packed string, words joined by
one blank, to the bucket their minimiser belongs to; equal windows have equal minimisers, so they meet there. A bucket
sorts the windows of its strings by hash and counts equal ones; neighbours in the order are compared byte by byte, so
a hash collision decides nothing. What comes back are word ranges per text, never windows.

Skew: strings are combined before they travel. Within a stretch of the input (`STRETCH` bytes of text) equal strings
are sent once, marked as repeated, and all their places are reported on the spot; so a passage that a third of all
texts share reaches its bucket as one string per stretch. Strings travel compressed, one row per stretch and bucket;
the number of buckets follows the input's size. A minimiser that stands in very many different texts would still fill one bucket:
such heavy minimisers are estimated from a sample of rows, and windows that have one go by their least run of LONG_GRAM words
instead. That choice depends on the window's words alone, so equal windows still meet, whatever the sample holds.

Defined results: a null or empty text has no words, nothing removed and the hash of the empty string; texts shorter than the
window keep all words; a repeated row counts as another text, so its windows are removed from both; rows are told apart by
hashes of id and text, so ids may repeat or be null; an empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.text import row_key
from leadloom.operators.stages import stage_table

WINDOW = 35
GRAM = 3
LONG_GRAM = 12  # words of the runs that tell the windows of a heavy minimiser apart
STRETCH = 16_000_000
RUN = 256  # windows in one packed string at most
BUCKET_BYTES = 4_000_000  # text per bucket; the strings of a bucket are about three times that
TASK_BUCKETS = 4  # buckets per task: what a task sorts and hands to Python at once is this many compressed buckets
OUT_BYTES = 4_000_000  # bytes from which on rows are handed on, so that a batch is never held twice
HEAVY_BYTES = 8_000_000  # packed bytes from which on a minimiser is heavy
MAX_HEAVY = 1_000_000  # the least weight grows with the input so that about this many are listed at most (8 MB)
SAMPLED_BYTES = 20_000  # packed bytes expected in the sample of a minimiser that is just heavy: about 64 strings
BLOOM_BITS = 16  # bits of the filter for each text that has ranges; about 0.3 % of the others pass it
MAX_BLOOM = 1 << 28  # bits at most (32 MB)
PROBES = 4
PAIRS = 1 << 14  # windows compared byte by byte at a time
ODD = np.uint64(0x9E3779B97F4A7C15)
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
KEYS = ["_key", "_key2"]


INVERSE = np.uint64(pow(int(ODD), -1, 1 << 64))
ODD_WORD = np.uint64(0xD6E8FEB86659FD93)
INVERSE_WORD = np.uint64(pow(int(ODD_WORD), -1, 1 << 64))
SLICE = 1 << 18  # bytes hashed at a time
_tables: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """The first n powers of an odd number modulo 2**64, kept from call to call."""
    table = _tables.get(int(base))
    if table is None or len(table) < n:
        table = np.full(max(n, 1 << 12), base, np.uint64)
        table[0] = 1
        _tables[int(base)] = table = np.cumprod(table, dtype=np.uint64)
    return table[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word of a byte array."""
    blank = np.concatenate(([True], BLANK[data], [True]))
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    return edges[0::2], edges[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash of each word's bytes, the same wherever the word stands."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, base + SLICE, side="right")))
        part = data[base : int(ends[to - 1])]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers(ODD, len(part)), dtype=np.uint64, out=total[1:])
        a, b = starts[at:to] - base, ends[at:to] - base
        out[at:to] = (total[b] - total[a]) * powers(INVERSE, len(part) + 1)[a]
        at = to
    return mixed(out)


def run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(ODD_WORD, len(hashes)), dtype=np.uint64, out=total[1:])
    return mixed((total[size:] - total[:-size]) * powers(INVERSE_WORD, n))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours, by doubling."""
    reach, out = 1, values
    while 2 * reach <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


NO_HEAVY = np.zeros(0, np.uint64)


def minimisers(hashes: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """What each window of a text goes by: its least run of GRAM words or, if that is in `heavy` (sorted), of LONG_GRAM words."""
    least = sliding_least(run_hashes(hashes, GRAM), WINDOW - GRAM + 1)
    if not len(heavy):
        return least
    hot = heavy[np.minimum(np.searchsorted(heavy, least), len(heavy) - 1)] == least
    return np.where(hot, sliding_least(run_hashes(hashes, LONG_GRAM), WINDOW - LONG_GRAM + 1), least) if hot.any() else least


def super_kmer_bounds(text: bytes, heavy: np.ndarray = NO_HEAVY) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The text with its words joined by one blank, and of each packed string: first byte and end there, minimiser, first word, number of
    windows, hash of its words."""
    data = np.frombuffer(text, np.uint8)
    starts, ends = word_spans(data)
    n = len(starts) - WINDOW + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return b"", none, none, NO_HEAVY, none, none, NO_HEAVY
    hashes = word_hashes(data, starts, ends)
    least = minimisers(hashes, heavy)
    change = np.flatnonzero(least[1:] != least[:-1]) + 1
    first = np.concatenate(([0], change))
    length = np.diff(np.concatenate((first, [n])))
    if length.max() > RUN:
        parts = -(-length // RUN)
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        whole, first = np.repeat(length, parts), np.repeat(first, parts) + step * RUN
        length = np.minimum(RUN, whole - step * RUN)
    at = np.concatenate(([0], np.cumsum(ends - starts + 1)))  # of each word in the packed text
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(ODD_WORD, len(hashes)), dtype=np.uint64, out=total[1:])
    told = mixed((total[first + length + WINDOW - 1] - total[first]) * powers(INVERSE_WORD, n)[first])
    return b" ".join(text.split()), at[first], at[first + length + WINDOW - 1] - 1, least[first], first, length, told


def super_kmers(text: bytes, heavy: np.ndarray = NO_HEAVY) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Packed strings of a text with their minimisers, first words and numbers of windows."""
    packed, lo, hi, least, first, length, _ = super_kmer_bounds(text, heavy)
    return [packed[i:j] for i, j in zip(lo.tolist(), hi.tolist(), strict=True)], least, first, length


HEAD = np.dtype([("key", "<i8"), ("key2", "<i4"), ("first", "<i4"), ("bytes", "<u4"), ("repeated", "?")])
RANGE = np.dtype([("_key", "<i8"), ("_key2", "<i4"), ("first", "<i8"), ("words", "<i8")])
STRING = np.dtype([("text", "<i4"), ("lo", "<i8"), ("hi", "<i8"), ("bucket", "<i4"), ("first", "<i4"), ("windows", "<i4"), ("hash", "<u8")])


class Stretch:
    """Equal strings of a stretch of texts, combined. Texts are held once, their strings as places in them: strings overlap and are together
    about three times the text, and as objects of their own more than twice that again."""

    def __init__(self, buckets: int, heavy: np.ndarray = NO_HEAVY) -> None:
        self.buckets, self.heavy = buckets, heavy
        self.clear()

    def clear(self) -> None:
        self.keys, self.texts, self.strings, self.bytes = [], [], [], 0

    def add(self, key: tuple[int, int], text: bytes) -> None:
        packed, lo, hi, least, first, length, told = super_kmer_bounds(text, self.heavy)
        if len(lo):
            strings = np.empty(len(lo), STRING)
            strings["text"], strings["lo"], strings["hi"], strings["hash"] = len(self.texts), lo, hi, told
            strings["bucket"], strings["first"], strings["windows"] = least % np.uint64(self.buckets), first, length
            self.keys.append(key)
            self.texts.append(packed)
            self.strings.append(strings)
        self.bytes += len(text)

    def joined(self) -> np.ndarray:
        """All strings in one array, in the order of the texts."""
        if len(self.strings) != 1:
            self.strings = [np.concatenate([np.empty(0, STRING), *self.strings])]
        return self.strings[0]

    @property
    def places(self) -> dict[int, list[int]]:
        """Of each string that stands at several places: all of them, by the first. The bytes decide, not the hash."""
        strings = self.joined()
        order = np.argsort(strings["hash"], kind="stable")
        ranked = strings["hash"][order]
        edge = np.concatenate(([0], np.flatnonzero(ranked[1:] != ranked[:-1]) + 1, [len(ranked)]))
        several = np.flatnonzero(np.diff(edge) > 1)
        out = {}
        for a, b in zip(edge[several].tolist(), edge[several + 1].tolist(), strict=True):
            met: dict[bytes, list[int]] = {}
            for at, (text, lo, hi) in zip(order[a:b].tolist(), strings[["text", "lo", "hi"]][order[a:b]].tolist(), strict=True):
                met.setdefault(self.texts[text][lo:hi], []).append(at)
            out |= {ws[0]: ws for ws in met.values() if len(ws) > 1}
        return out

    def rows(self) -> tuple[list, np.ndarray]:
        """Packed rows (bucket, blob) and ranges (key, key2, first word, words) known to be repeated."""
        strings, places = self.joined(), self.places
        keys = np.array(self.keys, np.int64).reshape(-1, 2)
        sent, repeated = np.ones(len(strings), bool), np.zeros(len(strings), bool)
        held = [np.array(ws) for ws in places.values()]
        for ws in held:
            sent[ws[1:]], repeated[ws[0]] = False, True
        taken = strings[np.concatenate([np.zeros(0, np.int64), *held])]
        ranges = np.empty(len(taken), RANGE)
        ranges["_key"], ranges["_key2"] = keys[taken["text"]].T
        ranges["first"], ranges["words"] = taken["first"], taken["windows"] + (WINDOW - 1)
        order = np.flatnonzero(sent)
        order = order[np.argsort(strings["bucket"][order], kind="stable")]
        strings, repeated = strings[order], repeated[order]
        head = np.empty(len(strings), HEAD)
        head["key"], head["key2"] = keys[strings["text"]].T
        head["first"], head["bytes"], head["repeated"] = strings["first"], strings["hi"] - strings["lo"], repeated
        edge = np.concatenate(([0], np.flatnonzero(np.diff(strings["bucket"])) + 1, [len(strings)])) if len(strings) else np.zeros(1, np.int64)
        press, blobs = zstandard.ZstdCompressor(level=3), []
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            body = b"\n".join([self.texts[text][lo:hi] for text, lo, hi in strings[["text", "lo", "hi"]][a:b].tolist()])
            blobs.append((int(strings["bucket"][a]), press.compress(struct.pack("<I", b - a) + head[a:b].tobytes() + body)))
        self.clear()
        return blobs, ranges


def _windows(part: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """String, place, hash, first byte and end of each window of strings that begin at `bounds` (the last one: where the part ends)."""
    starts, ends = word_spans(part)
    word0 = np.searchsorted(starts, bounds)  # first word of each string
    counts = np.diff(word0) - WINDOW + 1
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = word0[owner] + place
    return owner, place, run_hashes(word_hashes(part, starts, ends), WINDOW)[at], starts[at], ends[at + WINDOW - 1]


def repeated_windows(data: bytes, sizes: np.ndarray, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For strings of the given sizes, joined by line ends: string, place and mark of each window; a window is marked
    if its words stand anywhere else in the strings, or its string is repeated. Words are split and hashed a slice at a time: what is
    held of all windows are five numbers each."""
    raw = np.frombuffer(data, np.uint8)
    bounds = np.concatenate(([0], np.cumsum(sizes.astype(np.int64) + 1)))
    kinds = (np.int32, np.int32, np.uint64, *[np.min_scalar_type(len(data))] * 2)
    parts, first = [[np.zeros(0, k)] for k in kinds], 0
    while first < len(sizes):
        to = max(first + 1, int(np.searchsorted(bounds, bounds[first] + SLICE, side="right")) - 1)
        found = _windows(raw[bounds[first] : bounds[to]], bounds[first : to + 1] - bounds[first])
        for held, part, kind, shift in zip(parts, found, kinds, (first, 0, np.uint64(0), bounds[first], bounds[first]), strict=True):
            held.append((part + shift).astype(kind))
        first = to
    owner, place, hashes, lo, hi = map(np.concatenate, parts)
    del parts, found
    order = np.argsort(hashes, kind="stable").astype(np.min_scalar_type(len(hashes)))
    ranked = hashes[order]
    del hashes
    mark = repeated[owner]
    same = np.flatnonzero(ranked[1:] == ranked[:-1])
    unequal = []
    for at in range(0, len(same), PAIRS):
        pairs = same[at : at + PAIRS]
        left, right = order[pairs], order[pairs + 1]
        a, b, c, d = lo[left].tolist(), hi[left].tolist(), lo[right].tolist(), hi[right].tolist()
        equal = np.fromiter((data[i:j] == data[k:m] for i, j, k, m in zip(a, b, c, d, strict=True)), bool, len(pairs))
        mark[left[equal]] = True
        mark[right[equal]] = True
        unequal.append(np.unique(ranked[pairs[~equal]]))
    for value in np.unique(np.concatenate([NO_HEAVY, *unequal])):  # different windows with one hash: settle these runs by their bytes
        met: dict[bytes, list[int]] = {}
        for w in order[np.searchsorted(ranked, value) : np.searchsorted(ranked, value, side="right")].tolist():
            met.setdefault(data[lo[w] : hi[w]], []).append(w)
        for ws in met.values():
            if len(ws) > 1:
                mark[ws] = True
    return owner, place, mark


def ranges_of(owner: np.ndarray, place: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of marked windows: string, first window, words covered."""
    hit = np.flatnonzero(mark)
    if not len(hit):
        return hit, hit, hit
    new = np.concatenate(([True], (np.diff(hit) > 1) | (np.diff(owner[hit]) != 0)))
    first = hit[new]
    last = hit[np.concatenate((new[1:], [True]))]
    return owner[first], place[first], last - first + WINDOW


RANGES = "_bucket int, _blob binary, _key long, _key2 int, first long, words long"
NAMES = ["_bucket", "_blob", "_key", "_key2", "first", "words"]
TYPES = [pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]


def _batch(**columns: pa.Array) -> pa.RecordBatch:
    """A batch of RANGES; columns that are not given are null."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[c].cast(t) if c in columns else pa.nulls(n, t) for c, t in zip(NAMES, TYPES, strict=True)], names=NAMES)


def in_parts(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of neighbours that are together `most` at most, or one alone."""
    first, total = 0, 0
    for at, size in enumerate(sizes):
        if at > first and total + size > most:
            yield first, at
            first, total = at, 0
        total += size
    if first < len(sizes):
        yield first, len(sizes)


def _weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed bytes of each minimiser, by batch."""
    np.seterr(over="ignore")
    for batch in batches:
        grams, sizes = [NO_HEAVY], [np.zeros(0, np.int64)]
        for text in batch["_text"]:
            _, lo, hi, least, _, _, _ = super_kmer_bounds(text.as_py() or b"")
            grams.append(least)
            sizes.append(hi - lo)
        gram, at = np.unique(np.concatenate(grams), return_inverse=True)
        weight = np.bincount(at, np.concatenate(sizes), len(gram)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(weight)], names=["gram", "weight"])


def heavy_minimisers(texts: DataFrame, size: int) -> np.ndarray:
    """Sorted minimisers whose packed strings are estimated at HEAVY_BYTES or more over all of `texts` (`_text`, of `size` bytes).
    The sample decides only how evenly buckets fill. The list is bounded: each entry has at least one of MAX_HEAVY parts of the sample."""
    least = max(HEAVY_BYTES, 3 * size // MAX_HEAVY)
    share = min(1.0, SAMPLED_BYTES / least)
    weights = texts.select("_text").sample(share, seed=42).mapInArrow(_weights, "gram long, weight long")
    heavy = weights.groupBy("gram").agg(F.sum("weight").alias("weight")).where(F.col("weight") >= share * least).select("gram")
    return np.sort(np.array([r["gram"] for r in heavy.toLocalIterator()], np.int64).view(np.uint64))


def _spread(buckets: int, heavy: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        stretch = Stretch(buckets, heavy)

        def flush() -> Iterator[pa.RecordBatch]:
            blobs, ranges = stretch.rows()
            for a, b in in_parts([len(x) for _, x in blobs], OUT_BYTES):
                yield _batch(_bucket=pa.array([k for k, _ in blobs[a:b]], pa.int32()), _blob=pa.array([x for _, x in blobs[a:b]], pa.binary()))
            bucket = (ranges["_key"] ^ ranges["_key2"]) % buckets
            yield _batch(_bucket=pa.array(bucket), **{c: pa.array(np.ascontiguousarray(ranges[c])) for c in RANGE.names})

        for batch in batches:
            for key, key2, text in zip(batch["_key"].to_pylist(), batch["_key2"].to_pylist(), batch["_text"], strict=True):
                stretch.add((key, key2), text.as_py() or b"")
                if stretch.bytes >= STRETCH:
                    yield from flush()
        yield from flush()

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by bucket; a bucket's strings are held together, one bucket at a time."""
    np.seterr(over="ignore")
    current, blobs = None, []

    def settle() -> Iterator[pa.RecordBatch]:
        heads, bodies = [], []
        unpress = zstandard.ZstdDecompressor()
        while blobs:
            raw = unpress.decompress(blobs.pop())
            (n,) = struct.unpack_from("<I", raw)
            heads.append(np.frombuffer(raw, HEAD, n, 4).copy())
            bodies.append(raw[4 + n * HEAD.itemsize :])
        if heads:
            head, data = np.concatenate(heads), b"\n".join(bodies)
            bodies.clear()
            string, place, words = ranges_of(*repeated_windows(data, head["bytes"], head["repeated"]))
            taken = head[string]
            first = taken["first"].astype(np.int64) + place
            yield _batch(_key=pa.array(taken["key"]), _key2=pa.array(taken["key2"]), first=pa.array(first), words=pa.array(words.astype(np.int64)))

    for batch in batches:
        ready = batch.filter(pc.is_null(batch["_blob"]))
        if len(ready):
            yield ready
        for bucket, blob in zip(batch["_bucket"].to_pylist(), batch["_blob"], strict=True):
            if blob.is_valid:
                if bucket != current:
                    yield from settle()
                    current, blobs = bucket, []
                blobs.append(blob.as_py())
    yield from settle()


def repeated_ranges(keyed: DataFrame) -> DataFrame:
    """(_key, _key2, ranges): the word ranges covered by repeated windows, of rows `_key`, `_key2`, `_text` (binary)."""
    size = keyed.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets = int(size // BUCKET_BYTES) + 1
    spread = keyed.select(*KEYS, "_text").mapInArrow(_spread(buckets, heavy_minimisers(keyed, size)), RANGES)
    tasks = max(1, min(buckets, keyed.sparkSession.sparkContext.defaultParallelism * 4 + buckets // TASK_BUCKETS))
    found = spread.repartition(tasks, "_bucket").sortWithinPartitions("_bucket").mapInArrow(_count, RANGES)
    return found.groupBy(*KEYS).agg(F.collect_set(F.struct("first", "words")).alias("_ranges"))


def probes(bits: int) -> list[str]:
    """Places of a row's keys in a filter of so many bits."""
    return [f"pmod(xxhash64(_key, _key2, {i}), {bits}L)" for i in range(PROBES)]


def key_filter(ranges: DataFrame) -> np.ndarray:
    """Bloom filter of the keys of `ranges`, as words of 64 bits. It is bounded; a fuller one lets more rows pass that have no ranges."""
    bits = min(MAX_BLOOM, max(1 << 10, 1 << int(BLOOM_BITS * ranges.count()).bit_length()))
    places = ranges.select(F.explode(F.array(*map(F.expr, probes(bits)))).alias("at"))
    words = places.groupBy(F.expr("at DIV 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(at % 64 AS INT)))").alias("value"))
    out = np.zeros(bits // 64, np.int64)
    for row in words.toLocalIterator():
        out[row["word"]] = row["value"]
    return out.view(np.uint64)


def with_ranges(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows with their `_ranges`, null where they have none. Only rows that pass a filter of the keys are shuffled, so most texts stay in place.
    The filter is one row that Spark broadcasts: tested in Python it would take a second Python process beside each that cuts."""
    words = key_filter(ranges)
    table = pa.table({"_bits": pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(words.view(np.int64)))})
    bits = F.broadcast(rows.sparkSession.createDataFrame(table, "_bits array<bigint>"))
    met = " AND ".join(f"getbit(get(_bits, CAST({at} DIV 64 AS INT)), CAST({at} % 64 AS INT)) = 1" for at in probes(64 * len(words)))
    told = rows.crossJoin(bits).withColumn("_met", F.expr(met)).drop("_bits")
    plain = told.where("NOT _met").drop("_met").withColumn("_ranges", F.lit(None).cast(ranges.schema["_ranges"].dataType))
    return plain.unionByName(told.where("_met").drop("_met").join(ranges, KEYS, "left"))


def kept_words(n: int, ranges: list[dict]) -> np.ndarray:
    gone = np.zeros(n + 1, np.int64)
    np.add.at(gone, [r["first"] for r in ranges], 1)
    np.add.at(gone, [r["first"] + r["words"] for r in ranges], -1)
    return np.cumsum(gone)[:-1] == 0


def cut(text: bytes, ranges: list[dict] | None) -> tuple[int, int, bytes]:
    """Words, removed words and the words that are kept, joined by blanks."""
    words = text.split()
    if not ranges:
        return len(words), 0, b" ".join(words)
    keep = kept_words(len(words), ranges).tolist()
    kept = [w for w, k in zip(words, keep, strict=True) if k]
    return len(words), len(words) - len(kept), b" ".join(kept)


def cut_in_place(text: bytes, ranges: list[dict] | None) -> tuple[int, int, bytes]:
    """Words, removed words and the text as it was but for the bytes from each removed run's first word to the next kept word; what stands
    before a run at the end of the text loses its blanks. A text without removal is unchanged."""
    starts, ends = word_spans(np.frombuffer(text, np.uint8))
    if not ranges or not len(starts):
        return len(starts), 0, text
    keep = kept_words(len(starts), ranges)
    edge = np.flatnonzero(keep[1:] != keep[:-1]) + 1  # where kept and removed words meet
    firsts, parts = [0, *edge.tolist()], []
    for a, b in zip(firsts, [*edge.tolist(), len(keep)], strict=True):
        if keep[a]:
            parts.append(text[(0 if a == 0 else int(starts[a])) : (len(text) if b == len(keep) else int(starts[b]))])
    whole = b"".join(parts)
    return len(keep), int((~keep).sum()), whole if keep[-1] else whole.rstrip(b" \t\n\x0b\f\r")


def remove_repeats(docs: DataFrame, carry: list[str], text: str = "text", in_place: bool = False) -> DataFrame:
    """`row` (a struct of the columns `carry`), n_words, n_removed and kept_text of every row: the kept words joined by blanks or, with
    `in_place`, the text with its own blanks and line ends (see `cut_in_place`)."""
    cutter = cut_in_place if in_place else cut
    row = F.struct(*[F.col(c) for c in carry])
    rows = docs.select(row.alias("row"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"), *row_key(F.to_json(row), F.col(text)))
    ranges = stage_table(repeated_ranges(rows.select(*KEYS, "_text")), "substring-ranges")
    joined = with_ranges(rows, ranges).select("row", "_text", "_ranges")
    extra = {"n_words": "bigint", "n_removed": "bigint", "kept_text": "string"}
    schema = joined.select("row", *[F.lit(None).cast(t).alias(c) for c, t in extra.items()]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in in_parts(pc.binary_length(batch["_text"]).to_pylist(), OUT_BYTES):
                part = batch.slice(a, b - a)
                n, gone, kept = zip(*[cutter(t.as_py(), r.as_py()) for t, r in zip(part["_text"], part["_ranges"], strict=True)], strict=True)
                arrays = [part["row"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["row", *extra])

    return joined.mapInArrow(run, schema)
