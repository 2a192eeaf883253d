from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.llm import divergence, quality_ranking, spelling_variants
from leadloom.llm.oracles import SOURCE_DIVERGENCE, SPELLING_VARIANTS
from leadloom.llm.queries import QUERIES
from workload.check import duck

from .conftest import DOCS

SMALL = "/root/testdata/sf0.01"


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def audit(rows, least_docs, top):
    """Brute-force divergence of (text, lang, source) rows."""
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in ((t or "", la or "", s or "") for t, la, s in rows):
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", ascii_lower(text))
        groups.add((lang, source))
        count[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, source in groups:
        kept = sorted(t for t, n in docs[lang].items() if n >= least_docs)

        def shares(sources, lang=lang, kept=kept):
            n = {t: sum(count[lang, s][t] for s in sources) for t in kept}
            total = sum(n.values())
            return {t: 1 + 10**9 * (n[t] + 5) // (total + 5 * len(kept)) for t in kept}

        same = [s for la, s in groups if la == lang]
        own, whole = shares([source]), shares(same)
        pairs = [(s, sum(abs(own[t] - o) for t, o in shares([s]).items())) for s in same if s != source]
        terms = [(t, own[t] - whole[t]) for t in kept if count[lang, source][t] and own[t] > whole[t]]
        for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit]
            out += [(lang, source, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def audit_rows(spark):
    rng = np.random.default_rng(2)
    vocabulary = ["alpha", "Beta", "gamma", "δέλτα", "日本", "x", "É", "é", "ZETA", "e_f", "ß"]
    rows = [(" ".join(rng.choice(vocabulary, rng.integers(0, 9))), rng.choice(["en", "de"]).item(), f"s{rng.integers(0, 6)}") for _ in range(120)]
    rows += [("alpha beta", "fr", "only"), (None, "en", None), ("beta", None, "s1"), ("beta", None, None), ("", "en", "bare"), ("1 2 3", "de", "bare")]
    rows += [("alpha " * 20_000, "en", "s1")] + [("tied same equal", "en", "s2")] * 4
    return rows, spark.createDataFrame([(i, *r, 0) for i, r in enumerate(rows)], DOCS.replace("n_chars", "value")).selectExpr("*", "'x' AS term", "'x' AS digest", "1 AS n", "2 AS rank")


@pytest.mark.parametrize("least_docs", [3, 30, 10_000])
def test_divergence_matches_brute_force(spark, least_docs):
    rows, docs = audit_rows(spark)
    assert sorted(map(tuple, divergence.divergence(docs, least_docs, 4).collect())) == audit(rows, least_docs, 4)


def test_divergence_splits_shared_digests_tiles_and_shards(spark, monkeypatch):
    """Every digest stands for several terms; sources are compared two by two, in shards of a few rows."""
    rows, docs = audit_rows(spark)
    for name, value in (("TILE", 2), ("SHARD", 7), ("TERMS", 3), ("CACHE", 5), ("BROADCAST", 0)):
        monkeypatch.setattr(divergence, name, value)
    got = divergence.divergence(docs, 3, 4, hashed=lambda term: divergence.digest(term) % 3)
    assert sorted(map(tuple, got.collect())) == audit(rows, 3, 4)


def test_divergence_edges(no_docs, edge_docs):
    assert divergence.divergence(no_docs).count() == 0
    rows = [(r["text"], r["lang"], r["source"]) for r in edge_docs.collect()]
    assert sorted(map(tuple, divergence.divergence(edge_docs, 2).collect())) == audit(rows, 2, 50)


def test_divergence_query_matches_sql(spark):
    got = sorted(map(tuple, QUERIES["op13_source_divergence"](spark, SMALL).collect()))
    assert got == sorted(duck(SMALL).execute(SOURCE_DIVERGENCE).fetchall()) and len(got) > 1000


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(rows):
    """Brute-force groups of (doc_id, text) rows."""
    count = Counter()
    for doc_id, text in rows:
        for run in map(ascii_lower, re.findall("[A-Za-zÀ-ÿ]+", text or "")):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            count[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    out, form = {}, {}
    for w, n in words.items():
        near = [x for x in words if one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 10 * n else None
        out[w] = (w, n, len(near), form[w], words.get(form[w]))
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] += (root,)
    return sorted(out.values())


def variant_rows():
    """Words that differ everywhere by one edit, repeated letters, chains of ever more frequent forms, very long words."""
    rng = np.random.default_rng(4)
    bases = ["theword", "aaaaaaaa", "abababababab", "fréquéntly", "zzyzzyzzyx", "information", "ÀÉîõüßç÷×ñ", "x" * 300, "".join(rng.choice(list("abcé"), 3000))]
    rows, k = [], 0
    for base in bases:
        made = {base}
        for _ in range(40):
            w, at = str(rng.choice(sorted(made))), int(rng.integers(0, len(base)))
            made.add([w[:at] + w[at + 1 :], w[:at] + "q" + w[at:], w[:at] + "é" + w[at + 1 :]][rng.integers(0, 3)])
        for w in sorted(made):
            for _ in range(int(rng.choice([1, 2, 3, 25]))):
                rows.append((k, f"{w} {w.upper() if w.isascii() else w}, short"))
                k += 1
    rows += [(9_000, "chainaa " * 2), (9_001, "chainab " * 40), (9_002, "chainabb " * 900), (None, None), (None, "theword theword"), (7, ""), (7, "theword 日本語theword")]
    return rows


def test_variants_match_brute_force(spark, no_docs, edge_docs):
    rows = variant_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' AS word", "'x' AS near", "1 AS n", "'x' AS key", "0 AS root")
    got = sorted(map(tuple, spelling_variants.spelling_variants(docs).collect()))
    assert got == variants(rows) and any(r[3] and r[5] != r[3] for r in got)
    assert spelling_variants.spelling_variants(no_docs).count() == 0
    assert sorted(map(tuple, spelling_variants.spelling_variants(edge_docs).collect())) == variants([(r["doc_id"], r["text"]) for r in edge_docs.collect()])


def test_pivots_are_the_rarest_disjoint_bigrams():
    rng = np.random.default_rng(5)
    for _ in range(300):
        word = bytes(rng.integers(97, 101, rng.integers(4, 14)).tolist())
        count = rng.integers(1, 50, 1 << 16).tolist()
        rank = np.empty(1 << 16, np.int64)
        rank[np.argsort(count, kind="stable")] = np.arange(1 << 16)
        last, at, pivots = spelling_variants.prefix_and_pivots(word, rank.tolist(), count)
        grams = spelling_variants.bigrams(word)
        assert at == [i for i, g in enumerate(grams) if rank[g] <= last] and len(at) >= min(3, len(grams))
        pairs = [count[grams[i]] + count[grams[j]] for i in at for j in at if j >= i + 2]
        assert pivots[1] >= pivots[0] + 2 and sum(count[grams[i]] for i in pivots) == min(pairs)


def test_near_words_share_a_key():
    """Whatever the edit and the surviving bigram: some key of one word is a key of the other."""
    rng = np.random.default_rng(6)
    for _ in range(500):
        word = bytes(rng.integers(97, 123, rng.integers(7, 20)).tolist())
        at, kind = int(rng.integers(0, len(word))), rng.integers(0, 3)
        other = [word[:at] + word[at + 1 :], word[:at] + b"Q" + word[at:], word[:at] + b"Q" + word[at + 1 :]][kind]
        for i in range(len(word) - 1):
            kept = i + 1 < at or i >= at + (kind != 1)  # the bigram at i is whole in the other word
            if kept:
                j = i if i + 1 < at else i + (-1, 1, 0)[kind]
                assert other[j : j + 2] == word[i : i + 2]
                assert set(spelling_variants.keys(word, i)) & set(spelling_variants.keys(other, j))


def test_variants_query_matches_sql(spark):
    got = sorted(map(tuple, QUERIES["op12_spelling_variants"](spark, SMALL).collect()))
    assert got == sorted(duck(SMALL).execute(SPELLING_VARIANTS).fetchall()) and len(got) > 1000


def test_quality_ranking_finds_held_out_bad_texts(spark):
    out = QUERIES["op11_quality_ranking"](spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter("held_out AND quality IS NOT NULL")
    rate = {r["quality"]: r["p"] for r in out.groupBy("quality").agg(F.avg("predicted").alias("p")).collect()}
    assert rate[1] >= 0.99 and rate[0] <= 0.05


def test_statistics_of_known_texts():
    got = dict(zip(quality_ranking.NAMES, quality_ranking.statistics(b"AB ab\nAB ab\n\nc! #"), strict=True))
    assert np.isclose(np.exp(got["upper"]) - 0.001, 4 / 17) and np.isclose(np.exp(got["words"]), 6) and np.isclose(got["distinct"], 4 / 6)
    assert np.isclose(np.exp(got["lines"]), 3) and np.isclose(got["repeated_lines"], 1 / 3) and np.isclose(got["repeated_words"], 5 / 17)
    assert all(np.isfinite(quality_ranking.statistics(t)).all() for t in (b"", b" \n", b"\x00\xff" * 100_000, b"a " * 500_000))


def test_strengths_follow_preferences():
    """Pairs drawn from a known strength: the learned weights point its way and hardly anywhere else."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 3))
    good = 1 / (1 + np.exp(-3 * x[:, 0])) > rng.random(600)
    w = quality_ranking.fit_strengths(x[good], x[~good])
    assert w[0] > 1 and abs(w[1:]).max() < 0.4 * w[0]
    first, second = quality_ranking.preference_pairs(50, 7)
    assert set(first) == set(range(50)) and set(second) == set(range(7)) and len(set(zip(first.tolist(), second.tolist(), strict=True))) == len(first) == 350


def test_quality_ranking_edges(spark, edge_docs, no_docs):
    docs = edge_docs.selectExpr("*", "1 AS quality", "'x' AS known", "0.5 AS score", "'x' AS stats", "true AS held_out")
    labels = spark.createDataFrame([(i, q, None) for i, q in [(4, 1), (6, 1), (8, 1), (11, 0), (9, 0), (9, 1), (14, None), (None, 0), (999, 0)]], "doc_id bigint, quality int, text string")
    for some in (labels, labels.filter("quality = 1"), labels.limit(0)):
        out = quality_ranking.score_quality(docs, some).collect()
        assert len(out) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
        assert all(r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
        assert len({r["score"] for r in out if r["doc_id"] in (1, 2, 3)}) == 1 and len({r["score"] for r in out if r["doc_id"] == 4}) == 1
    assert {r["score"] for r in quality_ranking.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_ranking.score_quality(no_docs, labels).count() == 0
