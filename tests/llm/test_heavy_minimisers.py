"""Windows of a minimiser that stands in every text are dealt to many buckets; results stay those of brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from leadloom.llm import substring_dedup
from tests.llm import brute

BUCKETS = 64


def least_run() -> str:
    """Of many three-word runs the one with the least hash, so that it is the minimiser of nearly every window it stands in."""
    runs = [f"in case of{i}" for i in range(20_000)]
    data = np.frombuffer(" ".join(runs).encode(), np.uint8)
    hashes = substring_dedup.run_hashes(substring_dedup.word_hashes(data, *substring_dedup.word_spans(data)), 3)[::3]
    return runs[int(hashes.argmin())]


@pytest.fixture(scope="module")
def texts():
    draw, run = random.Random(3), least_run()
    words = lambda n: " ".join(f"w{draw.randrange(10**6)}" for _ in range(n))
    out = [f"{words(20)} {run} {words(25)} {run} {words(20)}" for _ in range(300)]
    passage = f"{words(18)} {run} {words(22)}"
    return out + [f"{words(9)} {passage} {words(12)}" for _ in range(6)] + [out[0], out[0], "", run]


@pytest.fixture(scope="module")
def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)


def largest_share(texts, heavy) -> float:
    weights = Counter()
    for text in dict.fromkeys(texts):
        strings, least, _, _ = substring_dedup.super_kmers(text.encode(), heavy)
        for string, m in zip(strings, least.tolist(), strict=True):
            weights[m % BUCKETS] += len(string)
    return max(weights.values()) / sum(weights.values())


def test_a_run_in_every_text_fills_no_bucket(spark, texts, table, monkeypatch):
    packed = table.selectExpr("doc_id", "CAST(text AS BINARY) AS _text")
    monkeypatch.setattr(substring_dedup, "HEAVY_BYTES", 3_000)
    heavy = substring_dedup.heavy_minimisers(packed, sum(map(len, texts)))
    assert 1 <= len(heavy) < 20 and (np.diff(heavy) > 0).all()
    assert largest_share(texts, substring_dedup.NO_HEAVY) > 0.5
    assert largest_share(texts, heavy) < 3 / BUCKETS


@pytest.mark.parametrize("heavy_bytes", [1, 3_000, 8_000_000])
def test_results_do_not_depend_on_what_is_heavy(texts, table, monkeypatch, heavy_bytes):
    monkeypatch.setattr(substring_dedup, "HEAVY_BYTES", heavy_bytes)
    got = substring_dedup.remove_repeats(table, ["doc_id"]).selectExpr("row.doc_id", "n_words", "n_removed", "kept_text").collect()
    want = [(i, *x) for i, x in enumerate(brute.without_repeats(texts))]
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert sum(r["n_removed"] for r in got) > 0


def test_windows_meet_wherever_they_stand(texts):
    """Equal windows have equal minimisers, also where only some windows of a text are heavy."""
    data = texts[300].encode()
    _, least, first, length = substring_dedup.super_kmers(data)
    heavy = np.unique(least[:1])
    of = {}
    for text in (data, b"x y z " + data, data + b" tail"):
        words = text.split()
        _, least, first, length = substring_dedup.super_kmers(text, heavy)
        for m, f, n in zip(least.tolist(), first.tolist(), length.tolist(), strict=True):
            for at in range(f, f + n):
                assert of.setdefault(b" ".join(words[at : at + substring_dedup.WINDOW]), m) == m


def test_empty_table(spark):
    none = spark.createDataFrame([], "_text binary")
    assert len(substring_dedup.heavy_minimisers(none, 0)) == 0


def test_only_texts_that_may_have_ranges_are_shuffled(spark):
    """The filter loses no text that has ranges and lets few others pass to the join."""
    rows = spark.range(5000).selectExpr("id", "xxhash64(id) AS _key", "hash(id) AS _key2")
    ranges = rows.where("id % 50 = 0").selectExpr("_key", "_key2", "array(struct(id AS first, 35L AS words)) AS _ranges")
    words = substring_dedup.key_filter(ranges)
    assert sum(int(w).bit_count() for w in words.tolist()) <= 4 * 100
    joined = substring_dedup.with_ranges(rows, ranges)
    assert {r["id"] for r in joined.where("_ranges IS NOT NULL").collect()} == set(range(0, 5000, 50)) and joined.count() == 5000
    union = joined._jdf.queryExecution().analyzed().collectLeaves()
    assert union.size() >= 3  # rows that do not pass, rows that do, ranges
    none = substring_dedup.with_ranges(rows, ranges.limit(0))
    assert none.where("_ranges IS NULL").count() == 5000
