from __future__ import annotations

import random

import pytest

from leadloom.llm import simhash_similarity as near
from leadloom.llm.components import components

from . import brute
from .conftest import prose


def edited(text: str, edits: int, seed: int) -> str:
    """The text with some words replaced."""
    draw, words = random.Random(seed), text.split()
    for at in draw.sample(range(len(words)), edits):
        words[at] = f"new{draw.randrange(10**6)}"
    return " ".join(words)


def found_groups(spark, docs) -> dict:
    return {r["doc_id"]: r["component_id"] for r in near.similar_groups(docs).collect()}


@pytest.fixture(scope="module")
def copies(spark):
    """150 texts of 200 words, each with copies of one to eight edits, and one text with 300 copies of one edit each."""
    texts = [prose(seed, 200) for seed in range(150)]
    texts += [edited(t, 1 + i % 8, i) for i, t in enumerate(texts)]
    texts += [edited(prose(999, 300), 1, i) for i in range(300)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_groups_against_brute_force(spark, copies):
    texts = {r["doc_id"]: r["text"] for r in copies.collect()}
    sets = [brute.shingle_set(texts[i]) for i in sorted(texts)]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if brute.similar(sets[i], sets[j])]
    got = found_groups(spark, copies)
    label = brute.groups(len(sets), lambda i, j: brute.similar(sets[i], sets[j]))
    assert all(label[i] == label[got[i]] for i in got), "texts that are not similar were joined"
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.95 * len(pairs)
    hard = [(i, j) for i, j in pairs if len(sets[i] & sets[j]) < 0.87 * len(sets[i] | sets[j])]
    assert len(hard) > 20 and sum(got[i] == got[j] for i, j in hard) >= 0.9 * len(hard)


def test_edge_cases_against_brute_force(spark, edge_docs, no_docs):
    docs = edge_docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    sets = [brute.shingle_set(r["text"]) for r in rows]
    label = brute.groups(len(rows), lambda i, j: brute.similar(sets[i], sets[j]))
    assert found_groups(spark, docs) == {r["doc_id"]: rows[at]["doc_id"] for r, at in zip(rows, label, strict=True)}
    every = near.similar_groups(edge_docs)
    assert every.columns == ["doc_id", "code", "component_id"] and every.count() == edge_docs.count()
    alone = every.filter("doc_id IS NULL").collect()
    assert len(alone) == 1 and alone[0]["component_id"] is None
    assert near.similar_groups(no_docs).count() == 0


@pytest.mark.parametrize("block", [20, 100])
def test_crowded_buckets_in_ranges_connect_the_same(spark, copies, block):
    """Buckets split into pairs of ranges, and the Gray-order index, leave nothing unconnected."""
    rows = near.wide_rows(copies.selectExpr("doc_id", "md5(text) AS _key", "CAST(text AS BINARY) AS _text"))
    nodes = rows.groupBy("code").agg({"_wide": "min"}).withColumnRenamed("min(_wide)", "_wide")
    whole, split = ({tuple(r) for r in components(near.candidates(nodes, block=b)).collect()} for b in (near.BLOCK, block))
    assert whole == split and len(whole) > 300


def test_a_dense_bucket_gives_a_forest(spark):
    import numpy as np

    draw = np.random.default_rng(1)
    codes = np.unique(np.uint64(12345) ^ (np.uint64(1) << draw.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << draw.integers(0, 64, 400).astype(np.uint64)))
    for a, b in (near.large_bucket(codes, None, near.BITS), near.small_buckets(np.zeros(60, int), codes[:60], near.BITS)):
        assert len(a) == len({*a.tolist(), *b.tolist()}) - 1 and (np.bitwise_count(a ^ b) <= near.BITS).all()


def test_no_similar_pair_is_left_out(spark):
    """Pairs at the bound whose codes differ in more bits than a bucket compares, and pairs that share only a common passage."""
    far, seed = [], 0
    while len(far) < 6:
        seed += 1
        text = prose(seed, 120)
        other = edited(text, 2, seed)
        a, b = (near.shingle_hashes(t.encode()) for t in (text, other))
        both = len(set(a.tolist()) & set(b.tolist()))
        code = int(near.wide_fingerprint(a)[0] ^ near.wide_fingerprint(b)[0])
        if both >= 0.8 * (len(a) + len(b) - both) and code.bit_count() > near.BITS:
            far += [text, other]
    shared = prose(5000, 40)
    texts = far + [f"{shared} {prose(6000 + i, 60)}" for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert found_groups(spark, docs) == {i: i - i % 2 if i < len(far) else i for i in range(len(texts))}
