"""Grouping of spelling variants: words one edit apart, found by pivotal bigrams.

Bigrams are ordered by how many words hold them, rare ones first. A word's prefix is its three rarest bigrams (and all that tie with
the third); among them dynamic programming chooses the two disjoint ones of least total frequency, its pivots. One edit touches at
most one of two disjoint bigrams, so of two near words the one whose prefix ends earlier in the order has a pivot that stands in the
other's prefix. Pivots are therefore looked up among prefix bigrams only.

Position limits: on one side of the surviving pivot nothing has changed, and of the other side one half has not. So a bigram is indexed
not by itself but by the unchanged text that must go with it: the text from the word's beginning to the bigram with one half of the rest,
or the bigram to the word's end with one half of what stands before, each for the two lengths the rest of the shorter word can have.
Where the unchanged side alone has `ENOUGH` code points the halves are left out. Groups under a key then hold words that differ in a
few places only, so a common bigram is no hot key and no candidate is dropped; Spark's join deals large keys. Candidates are verified by edit
distance. Keys are 64-bit hashes, which can only add candidates.

Defined results: a null or empty text has no words; a null doc_id counts as empty in the hash that decides on deletions; repeated rows count
again; ties of `form` go to the smallest word in code-point order; a run of any length is one word; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from leadloom.operators.stages import stage_table

LEAST_LENGTH = 7
LEAST_COUNT = 2
STEP = 10  # how many times as frequent a form must be
DROP = 31  # of this many runs one loses a code point
ENOUGH = 7
CACHE = 500_000
TASK_WORDS = 50_000  # words that a task makes keys of
PREFIX = 3  # bigrams that one edit cannot all touch without leaving two disjoint ones to choose

#: Latin-1 bytes: letters as they are, A-Z lower-cased, all else a blank.
LETTERS = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0xC0 else 0x20 for b in range(256))


def runs(text: str) -> list[bytes]:
    """Lower-cased letter runs in Latin-1: one byte a code point. Characters beyond Latin-1 are no letters here."""
    return text.encode("latin-1", "replace").translate(LETTERS).split()


def altered(doc_id: str, run: bytes, start: int) -> bytes:
    """The run as this document writes it. `start` is the checksum of the id and its colon."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    if h % DROP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, n) over all texts; counted per task before the shuffle."""
    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for key, body in zip(batch["id"].to_pylist(), batch["text"], strict=True):
                start = zlib.crc32(f"{key}:".encode())
                for found, n in Counter([r for r in runs(body.as_py()) if len(r) >= least_length]).items():
                    counts[altered(key, found, start)] += n
                if len(counts) > CACHE:
                    yield flush()
        yield flush()

    counted = rows.mapInArrow(run, "word string, n long").filter(F.char_length("word") >= least_length)
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def bigrams(word: bytes) -> list[int]:
    return [a << 8 | b for a, b in zip(word, word[1:], strict=False)]


def bigram_ranks(words: DataFrame) -> np.ndarray:
    """Rank of each of the 65,536 Latin-1 bigrams by the number of times words hold it; at most that many rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for word in batch["word"].to_pylist():
                b = np.frombuffer(word.encode("latin-1"), np.uint8).astype(np.int64)
                np.add.at(total, b[:-1] << 8 | b[1:], 1)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met])], names=["gram", "n"])

    total = np.zeros(1 << 16, np.int64)
    for row in words.select("word").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        total[row["gram"]] = row["n"]
    ranks = np.empty(1 << 16, np.int32)
    ranks[np.argsort(total, kind="stable")] = np.arange(1 << 16)
    return np.stack((ranks, total))


def prefix_and_pivots(word: bytes, rank: list[int], count: list[int]) -> tuple[int, list[int], list[int]]:
    """Rank that ends the prefix, positions of its bigrams, and which of them are the two disjoint pivots of least total frequency."""
    grams = bigrams(word)
    order = sorted(rank[g] for g in grams)
    last = order[min(PREFIX, len(order)) - 1]
    at = [i for i, g in enumerate(grams) if rank[g] <= last]
    # best[k]: least total and positions of k disjoint bigrams among those read so far that end before the present one.
    settled: list[tuple[int, tuple[int, ...]] | None] = [(0, ()), None, None]
    waiting: list[tuple[int, list]] = []  # states that may only be used two positions later
    for i in at:
        while waiting and waiting[0][0] + 2 <= i:
            for k, state in enumerate(waiting.pop(0)[1]):
                if state is not None and (settled[k] is None or state < settled[k]):
                    settled[k] = state
        new: list = [None, None, None]
        for k in (0, 1):
            if settled[k] is not None:
                new[k + 1] = (settled[k][0] + count[grams[i]], (*settled[k][1], i))
        waiting.append((i, new))
    ends = [s[2] for _, s in waiting if s[2] is not None] + ([settled[2]] if settled[2] is not None else [])
    return last, at, list(min(ends)[1])


def halves(kept: bytes, rest: bytes, mark: bytes) -> list[bytes]:
    """Keys of text `kept` with either half of `rest`, for the rest's own length and for one less."""
    out = []
    for size in (len(rest), len(rest) - 1):
        if size >= 0:
            half = size // 2
            head = mark + size.to_bytes(4, "little") + kept
            out += [head + b"<" + rest[:half], head + b">" + rest[len(rest) - (size - half) :]]
    return out


def keys(word: bytes, at: int, enough: int = ENOUGH) -> list[bytes]:
    """Unchanged text that a near word with the bigram at `at` must share by one of these keys."""
    left, right = word[: at + 2], word[at:]
    out = [b"L" + left] if len(left) >= enough else halves(left, word[at + 2 :], b"l")
    return out + ([b"R" + right] if len(right) >= enough else halves(right, word[:at], b"r"))


def entries(words: DataFrame, ranks: np.ndarray) -> DataFrame:
    """key, word, n, last (where the prefix ends) and pivot of every prefix bigram and key."""
    shared = words.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, count = (x.tolist() for x in shared.value)
        for batch in batches:
            found, row, ends, chosen = [], [], [], []
            for k, word in enumerate(batch["word"].to_pylist()):
                text = word.encode("latin-1")
                last, at, pivots = prefix_and_pivots(text, rank, count)
                for i in at:
                    some = keys(text, i)
                    found += map(xxh64_intdigest, some)
                    row += [k] * len(some)
                    ends += [last] * len(some)
                    chosen += [i in pivots] * len(some)
            take = pa.array(row, pa.int32())
            arrays = [pa.array(np.array(found, np.uint64).view(np.int64)), batch["word"].take(take), batch["n"].take(take), pa.array(ends, pa.int32()), pa.array(chosen, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "word", "n", "last", "pivot"])

    return words.select("word", "n").mapInArrow(run, "key long, word string, n long, last int, pivot boolean")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every two words one edit apart, both ways."""
    tasks = words.count() // TASK_WORDS + words.sparkSession.sparkContext.defaultParallelism
    found = stage_table(entries(words.repartition(tasks), bigram_ranks(words)), "variants-keys")
    asked = found.filter("pivot").select("key", F.col("word").alias("a"), F.col("n").alias("an"), F.col("last").alias("alast"))
    given = found.select("key", F.col("word").alias("b"), F.col("n").alias("bn"), F.col("last").alias("blast"))
    close = "alast <= blast AND a <> b AND abs(char_length(a) - char_length(b)) <= 1 AND levenshtein(a, b, 1) = 1"
    links = asked.join(given, "key").filter(close).selectExpr("IF(a < b, a, b) AS word", "IF(a < b, an, bn) AS n", "IF(a < b, b, a) AS near", "IF(a < b, bn, an) AS near_n").distinct()
    return links.selectExpr("inline(array(named_struct('word', word, 'n', n, 'near', near, 'near_n', near_n), named_struct('word', near, 'n', near_n, 'near', word, 'near_n', n)))")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where following (word, form) ends. A form is `STEP` times as frequent, so a chain has fewer than 19 steps and five
    doublings reach its end; only words whose target goes on are joined again."""
    current = stage_table(forms.select("word", F.col("form").alias("root")), "variants-roots")
    for _ in range(5):
        onward = current.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        if not current.join(onward, "root", "left_semi").limit(1).count():
            break
        current = stage_table(current.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "variants-roots")
    return current


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word."""
    words = stage_table(word_counts(docs, doc_id, text).filter(F.col("n") >= least_count), "variants-words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    nearest = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("_best"))
    known = words.join(nearest, "word", "left").withColumn("_is", F.expr(f"-_best.less >= {STEP} * n"))
    known = known.selectExpr("word", "n", "coalesce(n_near, 0L) AS n_near", "IF(_is, _best.near, NULL) AS form", "IF(_is, -_best.less, NULL) AS form_n")
    known = stage_table(known, "variants-forms")
    out = known.join(roots(known.filter("form IS NOT NULL")), "word", "left")
    return out.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
