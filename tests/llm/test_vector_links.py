"""Near pairs of vectors: sketches, the walk over a task's vectors, how chunks meet, and what the whole operator shuffles."""

from __future__ import annotations

import json
import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from leadloom.llm import embedding_dedup, vector_links
from tests.llm import brute

REPO = Path(__file__).resolve().parent.parent.parent


def near_vectors(count: int, width: int, seed: int) -> np.ndarray:
    """Unit vectors in all directions; a third are near or at the threshold to another one, and some form a dense group."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(count, width))
    some = np.arange(0, count, 3)
    x[some] = x[rng.integers(0, count, len(some))] + rng.normal(size=(len(some), width)) * rng.choice([0.02, 0.14, 0.2, 0.23], (len(some), 1))
    x[: count // 20] = x[0] + rng.normal(size=(count // 20, width)) * 0.1
    return vector_links.unit_vectors(x)


@pytest.mark.parametrize("width", [3, 24, 25, 64])
def test_sketches_are_no_less_alike(width):
    units = near_vectors(1500, width, width)
    cosine = units @ units.T
    for basis in (None, vector_links.sketch_basis(units), vector_links.sketch_basis(units[:5])):
        points = vector_links.sketches(units, basis).astype(np.float32) / np.float32(vector_links.UNIT)
        alike = points @ points.T
        front = vector_links.heads(points)
        assert (alike >= cosine - vector_links.SLACK).all()
        assert (front @ front.T >= alike - 1e-5).all()


@pytest.mark.parametrize("short", [False, True])
def test_walk_finds_every_pair(monkeypatch, short):
    monkeypatch.setattr(vector_links, "LEAF", 8)
    monkeypatch.setattr(vector_links, "OPEN_LINKS", 10)
    units = near_vectors(2400, 40, 3)
    points = vector_links.sketches(units, vector_links.sketch_basis(units)).astype(np.float32) / np.float32(vector_links.UNIT) if short else units
    copies = None if short else np.random.default_rng(1).integers(1, 4, len(points))
    held = vector_links.Held(points[:1600], None if short else copies[:1600], 0.98, 0.2 + 1e-3, short)
    held.among()
    first, counts = held.across(points[1600:], None if short else copies[1600:])
    label, order = held.settle(), held.tree.order
    hit = points @ points.T >= 0.98
    np.fill_diagonal(hit, False)
    inner = hit.copy()
    inner[1600:, 1600:] = False  # pairs of two vectors that are not held are another task's
    if not short:
        assert (held.counts == (inner @ copies)[:1600][order]).all()
        assert (counts == (inner @ copies)[1600:]).all()
    wanted = brute.groups(len(points), lambda i, j: inner[i, j])
    place = np.empty(1600, int)
    place[order] = np.arange(1600)
    got = [label[place[i]] if i < 1600 else (label[first[i - 1600]] if first[i - 1600] >= 0 else -1 - i) for i in range(len(points))]
    assert len(set(zip(wanted, got, strict=True))) == len(set(wanted)) == len(set(got))


@pytest.mark.parametrize("chunks", [1, 2, 5, 6])
def test_two_chunks_meet_in_one_task(chunks):
    deal = vector_links.Deal(np.array([-5, 7]), np.array([chunks, 3]), np.array([0, chunks]), 4)
    rows, tasks, late = deal.places(np.full(chunks, -5), np.arange(chunks))
    assert sorted(rows[~late]) == list(range(chunks)) and (tasks[~late] == rows[~late]).all()
    met = sorted(tuple(sorted(pair)) for pair in zip(rows[late].tolist(), tasks[late].tolist(), strict=True))
    assert met == [(i, j) for i in range(chunks) for j in range(i + 1, chunks)]
    assert len(rows) == chunks + len(met)
    rows, tasks, late = deal.places(np.array([3, -9, 3, 7]), np.array([0, 1, 2, 4]))
    assert sorted(tasks[~late].tolist()) == sorted([chunks + 3 + 3, chunks + 3 + -9 % 4, chunks + 3 + 3, chunks + 1])


def test_chunked_groups_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    monkeypatch.setattr(vector_links, "LEAF", 8)
    monkeypatch.setattr(vector_links, "BLOB_ROWS", 7)
    monkeypatch.setattr(vector_links, "QUERIES", 20)
    units = near_vectors(900, 30, 9)
    rows = [(i, (units[i] * (1 + i % 3)).tolist(), "a" if i % 5 else "b") for i in range(900)] + [(900 + i, [float(x) for x in units[i, :26]], "a") for i in range(60)]
    rows += [(2000 + i, rows[i][1], rows[i][2]) for i in range(0, 200, 4)]
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    whole = [np.array(v) / np.linalg.norm(v) for _, v, _ in rows]
    near = np.array([[a[2] == b[2] and len(x) == len(y) and x @ y >= 0.98 for b, y in zip(rows, whole, strict=True)] for a, x in zip(rows, whole, strict=True)])
    label = brute.groups(len(rows), lambda i, j: near[i, j])
    for i, (vec, *_rest) in enumerate(rows):
        assert got[vec]["n_links"] == near[i].sum() - 1
        assert got[vec]["component_id"] == min(rows[j][0] for j in range(len(rows)) if label[j] == label[i])
    assert len(got) == len(rows)


SHUFFLED = """
import numpy as np
from workload.check import session
from leadloom.llm import embedding_dedup
spark = session()
x = np.random.default_rng(2).normal(size=(6000, 64)).astype(np.float32)
rows = [(i, v.tolist(), i % 10) for i, v in enumerate(x)]
out = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
assert len(out) == 6000 and all(r["n_links"] == 0 and r["kept"] for r in out)
spark.stop()
"""


def test_shuffle_is_a_small_multiple_of_the_input(tmp_path):
    """Vectors in all directions, which no partition into cells keeps apart, are not sent again and again."""
    settings = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{tmp_path}", "spark.eventLog.rolling.enabled": "false", "spark.eventLog.compress": "false"}
    submit = " ".join([*(f"--conf {k}={v}" for k, v in settings.items()), "pyspark-shell"])
    subprocess.run([sys.executable, "-c", SHUFFLED], cwd=REPO, env=os.environ | {"PYSPARK_SUBMIT_ARGS": submit}, check=True, timeout=600)
    written = 0
    for log in tmp_path.iterdir():
        for line in log.read_text().splitlines():
            event = json.loads(line)
            if event["Event"] == "SparkListenerTaskEnd" and event.get("Task Metrics"):
                written += event["Task Metrics"]["Shuffle Write Metrics"]["Shuffle Bytes Written"]
    assert 0 < written < 2 * 6000 * 64 * 4, written
