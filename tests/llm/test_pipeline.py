from __future__ import annotations

from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from leadloom.llm import packing, quality_rules
from leadloom.operators.stages import stage_table

from . import brute
from .conftest import DOCS, prose


def test_registered_queries_run(spark, sf):
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    for n in names:
        assert entry.queries()[n](spark, sf).limit(5).count() > 0


@pytest.fixture(scope="module")
def kept(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {"documents": docs}
    for name, stage in pipeline.STAGES:
        docs = out[name] = stage_table(stage(spark, docs, sf), f"test-{name}")
    return out


def test_stages_match_brute_force(kept):
    names = ["documents", *[n for n, _ in pipeline.STAGES]]
    for name in names[:-1]:
        assert kept[name].columns == pipeline.COLUMNS
    verdict = {r["doc_id"] for r in quality_rules.quality_verdicts(kept["documents"]).filter("kept").collect()}
    good = {r["doc_id"]: r["text"] for r in kept["quality_rules"].collect()}
    assert set(good) == verdict
    ids = sorted(good)
    sets = [brute.shingle_set(good[i]) for i in ids]
    label = brute.groups(len(ids), lambda i, j: brute.similar(sets[i], sets[j]))
    single = {r["doc_id"]: r["text"] for r in kept["simhash_dedup"].collect()}
    assert set(single) == {ids[k] for k in set(label)}
    order = sorted(single)
    flags = brute.repeat_flags([single[i] for i in order])
    cut = {i: brute.in_place(single[i], f) for i, f in zip(order, flags, strict=True) if all(f) or any(f)}
    assert {r["doc_id"]: r["text"] for r in kept["substring_dedup"].collect()} == cut
    assert any("\n" in t for t in cut.values()) and any(t != single[i] for i, t in cut.items())
    drawn = Counter(r["doc_id"] for r in kept["source_mixing"].collect())
    assert set(drawn) == set(cut) and max(drawn.values()) <= 2
    pieces = kept["best_fit_packing"].toPandas()
    assert pieces.groupby("sequence_id").length.sum().max() <= packing.CAPACITY
    assert Counter(pieces[pieces.piece == 0].doc_id) == drawn


def test_run_agrees_with_its_stages(spark, sf, kept):
    got = pipeline.run(spark, sf).groupBy("doc_id", "piece", "ids_crc32").count().collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, kept["best_fit_packing"].groupBy("doc_id", "piece", "ids_crc32").count().collect()))


def test_stages_stand_edge_cases(spark, edge_docs, no_docs, sf):
    for docs in (edge_docs, no_docs):
        for name, stage in pipeline.STAGES:
            docs = stage_table(stage(spark, docs, sf), f"edge-{name}")
            docs.count()


def test_simhash_stage_keeps_one_row_of_each_component(spark, edge_docs, no_docs, sf):
    """Rows without an id and rows that share one lie in many components; none of these may be lost."""
    more = [(None, prose(s, 60), "en", "a", s) for s in range(20, 30)] + [(77, prose(s, 60), None, "b", s) for s in range(30, 40)]
    more += [(3, prose(20, 60), "en", "a", 1), (None, None, None, None, None), (50, "x y z", None, "en", 1), (50, "x y z", "en", None, 1), (50, "x y z", "en", None, 1)]
    docs = edge_docs.select(*pipeline.COLUMNS).unionByName(spark.createDataFrame(more, DOCS))
    rows = [tuple(r) for r in docs.collect()]
    sets = [brute.shingle_set(r[1]) for r in rows]
    label = brute.groups(len(rows), lambda i, j: brute.similar(sets[i], sets[j]))
    best = {k: min((r[0] is None, r[0] or 0) for r, at in zip(rows, label, strict=True) if at == k) for k in set(label)}
    assert sum(none for none, _ in best.values()) >= 10 and sum(i == (False, 77) for i in best.values()) == 10
    got = [tuple(r) for r in pipeline.simhash(spark, docs, sf).collect()]
    assert set(got) <= set(rows)
    assert Counter((label[rows.index(r)], (r[0] is None, r[0] or 0)) for r in got) == Counter(best.items())
    assert pipeline.simhash(spark, no_docs, sf).count() == 0
