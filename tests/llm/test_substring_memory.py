"""What the substring stage holds at once stays a small multiple of its text, bucket or batch; results stay those of brute force."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from leadloom.llm import substring_dedup
from tests.llm import brute

MB = 1_000_000


def texts_of(size: int, seed: int = 1) -> list[bytes]:
    draw, out, total = random.Random(seed), [], 0
    while total < size:
        out.append(" ".join(f"w{draw.randrange(10**5)}" for _ in range(500)).encode())
        total += len(out[-1])
    return out


def peak(work) -> int:
    substring_dedup.powers(substring_dedup.ODD, substring_dedup.SLICE + 1)  # tables that stay
    substring_dedup.powers(substring_dedup.INVERSE, substring_dedup.SLICE + 1)
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


@pytest.fixture(autouse=True)
def wrapping():
    with np.errstate(over="ignore"):
        yield


def test_a_stretch_holds_little_more_than_its_text():
    texts = texts_of(4 * MB)

    def work():
        stretch = substring_dedup.Stretch(50)
        for k, text in enumerate(texts):
            stretch.add((k, k), text)
        stretch.rows()

    assert peak(work) < 6 * 4 * MB


def test_a_bucket_is_counted_in_slices():
    strings = texts_of(6 * MB)
    data, sizes = b"\n".join(strings + strings[:200]), np.array(list(map(len, strings + strings[:200])))
    found = []
    assert peak(lambda: found.extend(substring_dedup.repeated_windows(data, sizes, np.zeros(len(sizes), bool)))) < 10 * len(data)
    owner, place, mark = found
    assert set(owner[mark].tolist()) == {*range(200), *range(len(strings), len(sizes))}
    assert len(mark) == len(sizes) * (500 - substring_dedup.WINDOW + 1) and mark.sum() == 400 * (500 - substring_dedup.WINDOW + 1)
    assert (np.bincount(owner) == 466).all() and place.max() == 465


@pytest.mark.parametrize("slice_bytes", [1, 700, 1 << 18])
def test_slices_and_pairs_decide_nothing(monkeypatch, slice_bytes):
    """Strings of many slices, windows of many rounds of comparison, against a plain count."""
    monkeypatch.setattr(substring_dedup, "SLICE", slice_bytes)
    monkeypatch.setattr(substring_dedup, "PAIRS", 7)
    draw = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(45))
    words = lambda n: " ".join(f"w{draw.randrange(10**6)}" for _ in range(n))
    strings = [f"{words(40)} {passage if i % 3 else words(45)} {words(i)}".encode() for i in range(30)]
    repeated = np.arange(30) == 3
    owner, place, mark = substring_dedup.repeated_windows(b"\n".join(strings), np.array(list(map(len, strings))), repeated)
    windows = [b" ".join(strings[o].split()[p : p + substring_dedup.WINDOW]) for o, p in zip(owner.tolist(), place.tolist(), strict=True)]
    counts = Counter(windows)
    assert mark.tolist() == [counts[w] > 1 or o == 3 for w, o in zip(windows, owner.tolist(), strict=True)]


def test_strings_of_one_hash_are_told_apart_in_a_stretch(monkeypatch):
    monkeypatch.setattr(substring_dedup, "mixed", lambda x: np.zeros(len(x), np.uint64))
    stretch = substring_dedup.Stretch(1)
    a, b = (" ".join(f"{c}{i}" for i in range(60)).encode() for c in "ab")
    for k, text in enumerate([a, b, a]):
        stretch.add((k, -k), text)
    n = len(stretch.joined()) // 3
    assert sorted(map(tuple, stretch.places.values())) == [(i, i + 2 * n) for i in range(n)]
    blobs, ranges = stretch.rows()
    assert len(blobs) == 1 and Counter(ranges["_key"].tolist()) == {0: n, 2: n}


@pytest.mark.parametrize("settings", [{"STRETCH": 1, "OUT_BYTES": 1}, {"STRETCH": 3_000, "OUT_BYTES": 500, "BUCKET_BYTES": 900, "TASK_BUCKETS": 1}])
def test_results_do_not_depend_on_sizes(spark, edge_docs, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(substring_dedup, name, value)
    rows = edge_docs.select("doc_id", "text").collect()
    expected = Counter((r["doc_id"], *x) for r, x in zip(rows, brute.without_repeats([r["text"] for r in rows]), strict=True))
    got = substring_dedup.remove_repeats(edge_docs, ["doc_id"]).select("row.doc_id", "n_words", "n_removed", "kept_text").collect()
    assert Counter(map(tuple, got)) == expected


def test_parts_of_a_batch_are_bounded():
    sizes = [3, 3, 3, 9, 1, 0, 0, 4]
    parts = list(substring_dedup.in_parts(sizes, 6))
    assert parts == [(0, 2), (2, 3), (3, 4), (4, 8)] and list(substring_dedup.in_parts([], 6)) == []


def test_a_task_hands_its_blobs_on_in_parts(monkeypatch):
    monkeypatch.setattr(substring_dedup, "OUT_BYTES", 50_000)
    texts = texts_of(MB)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(range(len(texts)), pa.int32()), pa.array(texts, pa.binary())], names=["_key", "_key2", "_text"])
    sizes = [sum(len(x.as_py()) for x in out["_blob"] if x.is_valid) for out in substring_dedup._spread(200, substring_dedup.NO_HEAVY)(iter([batch]))]
    assert sum(sizes) > 500_000 and max(sizes) <= 50_000


def test_one_python_process_a_task_cuts(spark):
    """The filter of the keys is no Python function beside the one that cuts."""
    docs = spark.range(50).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 60), x -> concat('w', x * (1 + id DIV 2)))) AS text")
    out = substring_dedup.remove_repeats(docs, ["doc_id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
    assert out.where("n_removed = 60").count() == 50
