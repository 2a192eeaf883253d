from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leadloom.llm import chat_format, components, embedding_dedup, mixing, packing, quality_rules, simhash_dedup, substring_dedup, toxicity, url_filters, warc_revisits
from leadloom.llm.queries import URL_RULES

from . import brute
from .conftest import prose

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_statistics_match_brute_force(edge_docs, documents):
    for docs in (edge_docs, documents):
        found = quality_rules.base_statistics(docs, ["text"]).collect()
        assert len(found) == docs.count()
        for r in found:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute.statistics(r["text"])


def test_mcd_estimate_matches_numpy(spark):
    """One concentration step: sums over the nearest bins, regularised, inverted."""
    rng = np.random.default_rng(1)
    rows = [(*map(float, rng.normal(size=quality_rules.DIM)), "l", "g") for _ in range(200)]
    schema = ", ".join(f"{s} double" for s in quality_rules.STATS) + ", _lang string, _group string"
    frame = spark.createDataFrame(rows, schema)
    groups = quality_rules.priors(frame)
    start = quality_rules.starts(groups)
    sums = quality_rules.nearest_sums(frame, start).join(groups.select("_group", "_prior", "_prior_scale"), "_group")
    got = {r["_start"]: r for r in quality_rules.estimated(sums).collect()}
    x = np.array([r[: quality_rules.DIM] for r in rows])
    g, begin = groups.first(), {r["_start"]: r for r in start.collect()}
    floor = np.array([quality_rules.FLOOR[s] for s in quality_rules.STATS])
    for k, r in got.items():
        low = np.zeros((quality_rules.DIM,) * 2)
        low[tuple(zip(*quality_rules.PAIRS, strict=True))] = begin[k]["_inverse"]
        full = low + low.T - np.diag(np.diag(low))
        off = x - begin[k]["_mean"]
        bins = np.floor(np.log(np.einsum("ij,jk,ik->i", off, full, off) + 1e-9) * quality_rules.BINS)
        near = x[bins <= np.sort(bins)[int(np.ceil(quality_rules.SUBSET * len(x))) - 1]]
        size, prior, scale = len(near) + quality_rules.PRIOR_ROWS, np.array(g["_prior"]), np.array(g["_prior_scale"])
        mean = (near.sum(0) + quality_rules.PRIOR_ROWS * prior) / size
        cov = (near - mean).T @ (near - mean) * quality_rules.CONSISTENCY / size
        cov += np.diag(scale**2 * quality_rules.PRIOR_ROWS / size + floor**2)
        assert np.allclose(r["_mean"], mean)
        assert np.allclose(np.array(r["_inverse"]), np.linalg.inv(cov)[tuple(zip(*quality_rules.PAIRS, strict=True))])
        assert np.isclose(r["_size"], np.log(np.linalg.det(cov)) / 2)


def test_quality_keeps_clean_and_drops_junk(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality_rules.quality_verdicts(documents).join(labels, "doc_id").filter("NOT base_failed")
    kept = {r["quality"]: r["k"] for r in out.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert kept[1] >= 0.99 and kept.get(0, 0) <= 0.3
    verdicts = quality_rules.quality_verdicts(documents).filter("kept").select("doc_id")
    assert sorted(r[0] for r in quality_rules.quality_filter(documents).select("doc_id").collect()) == sorted(r[0] for r in verdicts.collect())


def test_quality_edge_cases(edge_docs, no_docs):
    out = quality_rules.quality_verdicts(edge_docs).collect()
    assert len(out) == edge_docs.count() and all(r["kept"] is not None for r in out)
    assert not any(r["kept"] for r in out if r["doc_id"] in (1, 2, 3, 9, 11))
    assert quality_rules.quality_verdicts(no_docs).count() == 0
    assert quality_rules.quality_filter(edge_docs).columns == edge_docs.columns


def _simhash_expected(rows):
    codes = [brute.simhash(r["text"]) for r in rows]
    label = brute.groups(len(rows), lambda i, j: (codes[i] ^ codes[j]).bit_count() <= 4)
    least = {}
    for r, g in zip(rows, label, strict=True):
        least[g] = min((x for x in (least.get(g), r["doc_id"]) if x is not None), default=None)
    return Counter((r["doc_id"], f"{c:016x}", least[g]) for r, c, g in zip(rows, codes, label, strict=True))


def test_simhash_matches_brute_force(edge_docs, documents, no_docs):
    for docs in (edge_docs, documents):
        got = Counter(tuple(r) for r in simhash_dedup.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect())
        assert got == _simhash_expected(docs.select("doc_id", "text").collect())
    assert simhash_dedup.near_duplicates(no_docs).count() == 0


def test_gray_index_loses_no_link(spark):
    """Chains and dense groups of codes, in one bucket and split into ranges of Gray rank."""
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    flips = lambda: np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(0, 4)).astype(np.uint64), initial=np.uint64(0))
    codes = np.unique(np.array([c ^ flips() for c in centres for _ in range(40)] + list(rng.integers(0, 1 << 63, 60, dtype=np.uint64)), np.uint64))
    label = brute.groups(len(codes), lambda i, j: int(codes[i] ^ codes[j]).bit_count() <= 4)
    expected = Counter(Counter(label).values())
    a, b = simhash_dedup.forest(codes, None, 4)
    place = {int(c): i for i, c in enumerate(codes.view(np.int64))}
    links = {(place[int(x)], place[int(y)]) for x, y in zip(a, b, strict=True)}
    assert Counter(Counter(brute.groups(len(codes), lambda i, j: (i, j) in links or (j, i) in links)).values()) == expected
    frame = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "code long")
    for block in (40_000, 25):
        found = components.components(simhash_dedup.near_links(frame, 4, block)).groupBy("component").count()
        assert sorted(r["count"] for r in found.collect()) == sorted(n for n in Counter(label).values() if n > 1)


def test_components(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = dict(components.components(path).collect())
    assert got == {**dict.fromkeys(range(51), 0), 100: 100, 101: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_substring_cuts_in_place(edge_docs, documents):
    """Untouched texts stay byte for byte; others lose the removed runs and keep all other line ends and blanks."""
    for docs in (edge_docs, documents):
        rows = docs.select("doc_id", "text").collect()
        flags = brute.repeat_flags([r["text"] for r in rows])
        expected = Counter((r["doc_id"], brute.in_place(r["text"], f)) for r, f in zip(rows, flags, strict=True))
        got = substring_dedup.remove_repeats(docs, ["doc_id"], in_place=True).select("row.doc_id", "kept_text").collect()
        assert Counter(map(tuple, got)) == expected


def test_substring_matches_brute_force(edge_docs, documents, no_docs):
    for docs in (edge_docs, documents):
        rows = docs.select("doc_id", "text").collect()
        expected = Counter((r["doc_id"], *x) for r, x in zip(rows, brute.without_repeats([r["text"] for r in rows]), strict=True))
        got = substring_dedup.remove_repeats(docs, ["doc_id"]).select("row.doc_id", "n_words", "n_removed", "kept_text").collect()
        assert Counter(map(tuple, got)) == expected
    assert substring_dedup.remove_repeats(no_docs, ["doc_id"]).count() == 0


def test_substring_hash_collisions_decide_nothing(monkeypatch):
    monkeypatch.setattr(substring_dedup, "run_hashes", lambda h, size: np.zeros(max(0, len(h) - size + 1), np.uint64))
    a, b = (" ".join(f"{c}{i}" for i in range(40)).encode() for c in "ab")
    data = b"\n".join([a, b, a])
    owner, _, mark = substring_dedup.repeated_windows(data, np.array([len(a), len(b), len(a)]), np.zeros(3, bool))
    assert set(owner[mark].tolist()) == {0, 2} and not mark[owner == 1].any()


def test_one_stretch_sends_equal_strings_once():
    stretch = substring_dedup.Stretch(4)
    text = " ".join(f"w{i}" for i in range(80)).encode()
    for k in range(50):
        stretch.add((k, k), text)
    places = list(stretch.places.values())
    assert all(len(p) == 50 for p in places)
    blobs, ranges = stretch.rows()
    assert len(blobs) <= 4 and len(ranges) == 50 * len(places)


def test_tokens_match_the_tokenizer(edge_docs, documents):
    whole = Tokenizer.from_file(TOKENIZER)
    for docs in (edge_docs.filter("doc_id IN (1, 2, 6, 10, 11, 13)"), documents.limit(60)):
        texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        got = {}
        for r in packing.pieces(docs, TOKENIZER, with_ids=True).orderBy("doc_id", "piece").collect():
            assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
            got.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], np.uint32).tolist())
        assert got == {k: [*whole.encode(t or "", add_special_tokens=False).ids, 0] for k, t in texts.items()}


def test_packing_is_gapless_and_tight(edge_docs, no_docs):
    out = packing.pack(edge_docs, TOKENIZER).toPandas()
    assert len(out[out.doc_id.isin([1, 2, 3])]) == 3 and (out[out.doc_id == 8].length.iloc[:-1] <= 2048).all()
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 2048
    assert out.sequence_id.nunique() <= -(-out.length.sum() // 2048) + 1
    assert packing.pack(no_docs, TOKENIZER).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_packs_everything(seed):
    rng = np.random.default_rng(seed)
    counts = dict(Counter(rng.integers(1, 101, 3000).tolist()))
    bins = packing.plan(counts, 100)
    packed = Counter()
    for times, used in bins:
        assert sum(k * n for k, n in used.items()) <= 100
        for k, n in used.items():
            packed[k] += times * n
    assert packed == counts
    assert sum(t for t, _ in bins) <= 1.03 * sum(k * n for k, n in counts.items()) / 100 + 1


def test_two_fit_replaces_the_smallest():
    assert packing.plan({60: 1, 30: 1, 25: 1, 15: 1}, 100)[0] == (1, Counter({60: 1, 25: 1, 15: 1}))


def test_mixing_meets_its_limit(edge_docs, documents, no_docs):
    out = mixing.mix(documents).toPandas()
    words = {r["doc_id"]: len(brute.words(r["text"])) for r in documents.select("doc_id", "text").collect()}
    assert (out.n_tokens == out.doc_id.map(words)).all()
    assert out.copies.min() >= 1 and out.copies.max() <= 2
    have = out.groupby("source").n_tokens.sum()
    weight = out.groupby("source").weight.max()
    share = have / have.sum()
    x = np.polyfit(np.log(share), np.log(weight), 1)[0]
    expected = share**x / (share**x).sum()
    assert np.allclose(weight, expected) and np.isclose(weight.sum(), 1)
    budget = (have / weight).max() * weight
    drawn = (out.n_tokens * out.copies).groupby(out.source).sum()
    assert (drawn <= budget + 1).all() and (budget - drawn <= out.groupby("source").n_tokens.max()).all()
    edge = mixing.mix(edge_docs).collect()
    assert len(edge) == edge_docs.count() and all(r["copies"] >= 1 for r in edge)
    assert mixing.draw(edge_docs).columns == edge_docs.columns
    assert mixing.mix(no_docs).count() == 0


def test_mixing_targets(documents):
    totals = mixing.tokens_of(documents, ["doc_id"]).groupBy("_source").agg(F.sum("n_tokens").alias("_tokens"))
    totals = totals.crossJoin(totals.agg(F.sum("_tokens").alias("_all")))
    p = np.array([r["_tokens"] / r["_all"] for r in totals.collect()])

    def entropy(x):
        w = p**x / (p**x).sum()
        return -(w * np.log(w)).sum()

    target = (entropy(0) + entropy(1)) / 2
    assert np.isclose(entropy(mixing.exponent(totals, None, None, target)), target, atol=1e-6)
    limit = 1 + ((p.max() / p.min()) - 1) / 3
    x = mixing.exponent(totals, None, limit, None)
    assert np.isclose((p.max() / p.min()) ** (1 - x), limit, rtol=1e-5)


VECTORS = "vec_id bigint, embedding array<float>, label int, n_links string, _unit string"


def test_embeddings_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(25, 8))
    rows = [(i, (base[i % 25] * rng.uniform(0.5, 2) + rng.normal(size=8) * rng.choice([0, 0.04, 0.2])).tolist(), int(i % 3), "x", "x") for i in range(400)]
    rows += [(1000 + i, rows[3][1], rows[3][2], "x", "x") for i in range(60)]
    rows += [(2000, None, 1, "x", "x"), (2001, [0.0] * 8, 1, "x", "x"), (2002, [float("nan")] * 8, 1, "x", "x"), (2003, [None] * 8, 1, "x", "x"), (2004, rows[0][1], None, "x", "x"),
             (2005, [1.0, 2.0], 1, "x", "x"), (2006, [2.0, 4.0], 1, "x", "x"), (2007, [], 1, "x", "x"), (None, None, None, None, None)]
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    assert len(got) == len(rows)
    good = [(i, np.array(v, np.float32).astype(float), label) for i, v, label, *_ in rows if v and label is not None and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0]

    def near(i, j):
        (_, a, x), (_, b, y) = good[i], good[j]
        return x == y and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98

    label = brute.groups(len(good), near)
    for i, (vec, *_rest) in enumerate(good):
        r = got.pop(vec)
        assert r["n_links"] == sum(near(i, j) for j in range(len(good)) if j != i)
        assert r["component_id"] == min(good[j][0] for j in range(len(good)) if label[j] == label[i])
        assert r["kept"] == (r["component_id"] == vec)
    assert all(r["n_links"] == 0 and r["component_id"] == k and r["kept"] for k, r in got.items())
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_toxicity_on_held_out_rows(spark, edge_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = toxicity.score_toxicity(docs, labels)
    assert out.count() == docs.count()
    table = {(r["toxic"], r["predicted"]): r["n"] for r in out.filter("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").agg(F.count("*").alias("n")).collect()}
    assert table[1, 1] / (table[1, 1] + table.get((1, 0), 0)) >= 0.9
    assert table.get((0, 1), 0) <= 0.01 * table[0, 0]
    held = {r["doc_id"]: r["held_out"] for r in out.select("doc_id", "held_out").collect()}
    assert all(h == (zlib.crc32(str(k).encode()) % 5 == 0) for k, h in held.items())


def test_toxicity_edge_cases(spark, edge_docs, no_docs):
    few = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    for labels in (few, few.limit(0)):
        out = toxicity.score_toxicity(edge_docs, labels).collect()
        assert len(out) >= edge_docs.count() and all(0 <= r["score"] <= 1 for r in out)
        assert toxicity.score_toxicity(no_docs, labels).count() == 0


def test_toxicity_learns_from_rare_toxic_rows(spark):
    """A sample by hash alone holds too few of 24 toxic rows in 1,200; six toxic rows make no voter."""
    for toxic, limit in ((24, 100), (6, 20_000)):
        ids = [i for i in range(1, 4000) if zlib.crc32(str(i).encode()) % 5][:1200]
        rows = [(i, f"{prose(i, 20)} {'grobnik' if k < toxic else 'gentle'}") for k, i in enumerate(ids)]
        docs = spark.createDataFrame([*rows, (-1, "grobnik"), (-2, "gentle")], "doc_id long, text string")
        labels = spark.createDataFrame([(i, int(k < toxic)) for k, i in enumerate(ids)], "doc_id long, toxic int")
        score = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, labels, max_labelled=limit).collect()}
        assert score[-1] > 10 * score[-2] and (score[-1] > 0.5 or toxic < toxicity.VOTER_ROWS)
        assert min(score[i] for i in ids[:toxic]) > max(score[i] for i in ids[toxic:])


def test_long_words_have_their_beginnings():
    assert toxicity.word_features("grobnik" * 9) == ["^grob", "^grobn", "^grobni"]


URLS = [None, "", "no scheme", "http://A.Example.ORG/es/1?x", "https://example.org/en/12#y", "https://notexample.org/es/", "http://x.com/de", "http://x.com/de/", "HTTP://x.com", "a://b://com/fr/x",
        "http://com/fr/", "http://org", "http://org?/", "http://sub.org/\nline", "http://.org/", "http://x.org./"]


def test_url_verdicts_match_brute_force(spark, sf):
    frame = spark.createDataFrame([(i, u, "x", "x") for i, u in enumerate(URLS)], "page_id long, url string, host string, verdict string")
    for pages in (frame, spark.read.parquet(f"{sf}/pages.parquet")):
        urls = {r["page_id"]: r["url"] for r in pages.select("page_id", "url").collect()}
        got = {r["page_id"]: tuple(r)[1:] for r in url_filters.filter_urls(pages, URL_RULES).collect()}
        assert got == {k: brute.url_verdict(u, URL_RULES) for k, u in urls.items()}
    assert url_filters.filter_urls(frame.limit(0), URL_RULES).count() == 0


def test_url_rule_precedence(spark):
    rules = [("allow", "a.org", "/x/"), ("block", "a.org", "/x/"), ("block", "org", "/x/long/path"), ("allow", "a.org", "/x/y")]
    frame = spark.createDataFrame([(1, "http://a.org/x/z"), (2, "http://b.a.org/x/yz"), (3, "http://c.org/x/long/path/1")], "page_id long, url string")
    assert [r["verdict"] for r in url_filters.filter_urls(frame, rules).orderBy("page_id").collect()] == ["block", "allow", "block"]


def test_chat_round_trip(spark, sf):
    texts = ["</s>[INST] ok [/INST]", "a\\b<|end|>\n<|turn|>x<|text|>\\\\<", None, "", "<", "[INST", "\\", "<|", "🙂 <<SYS>> </SYS>", "<s>" * 3]
    rows = [(k, i, ["user", "assistant", "sys\n<|text|>tem", None][(i + k) % 4], t) for k in range(4) for i, t in enumerate(texts)] + [(None, None, None, None), (9, 1, "assistant", "b"), (9, 1, "assistant", "a"), (9, 1, "assistant", "a")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("x"))
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    for turns in (frame, table):
        expected = {}
        for r in sorted(turns.collect(), key=lambda r: (r["conv_id"] is not None, r["conv_id"] or 0, r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or "")):
            expected.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
        out = chat_format.read_back(chat_format.format_conversations(turns.withColumn("parts", chat_format.text_parts(F.col("text"))))).collect()
        assert {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in out} == expected
        for r in out:
            assert r["loss_text"] == "".join(t for role, t in expected[r["conv_id"]] if role == "assistant")
            assert r["formatted"].count("<|end|>") == r["n_turns"] and "[INST]" not in r["formatted"] and "</s>" not in r["formatted"]
    assert chat_format.format_conversations(frame.limit(0).withColumn("parts", chat_format.text_parts(F.col("text")))).count() == 0


def test_chat_parts(spark):
    parts = [("text", "see <|end|> ", None, None), ("image", None, "s3://a.png", 3), ("audio", None, "b.wav", None), ("video<|", None, "c", 1), ("document", None, None, 2), (None, None, None, None)]
    frame = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<struct<{chat_format.PART.replace(' ', ':').replace(',:', ',')}>>")
    r = chat_format.format_conversations(frame).first()
    assert r["formatted"] == "<|turn|>user<|text|>see <\\|end|> <|image:768|><|audio:25|><|part:video<\\||><|document:1600|><|part:|><|end|>\n<|turn|>assistant<|text|><|end|>\n"
    assert [tuple(a) for a in r["attachments"]] == [("image", "s3://a.png", 768), ("audio", "b.wav", 25), ("document", None, 1600)]
    assert r["n_attachment_tokens"] == 768 + 25 + 1600
    for cut in ("<", "</", "</s", "<SY", "<</SYS", "[", "[/INS", "[INST"):
        whole = cut + ">]" if cut not in ("<", "[") else cut + "|turn|>x"
        split = [("text", cut, None, None), ("text", whole[len(cut):], None, None)]
        made = chat_format.format_conversations(spark.createDataFrame([(1, 0, "user", split)], frame.schema))
        back = chat_format.read_back(made).first()
        assert [t["text"] for t in back["turns"]] == [whole]
        assert not any(c in back["formatted"][len("<|turn|>user<|text|>"):] for c in ("<|turn|>", "</s>", "[INST]", "</SYS>"))


RECORDS = "record_id long, target_uri string, warc_date string, warc_type string, http_head string, payload_digest string, canonical_url string"


def test_revisits(spark):
    ok = "HTTP/1.1 200 OK\r\nETag: \"{}\"\r\nLast-Modified: {}\r\nContent-Length: 5\r\nX-A: 1\r\n"
    rows = [
        (1, "http://www.A.org/p/?utm_source=x#f", "2020-01-01", "response", ok.format("t1", "d1"), "one"),
        (2, "https://a.org:443/p", "2020-01-02", "revisit", 'HTTP/1.1 304 Not Modified\r\netag: W/"t1"\r\nDate: now\r\nContent-Length: 0\r\n', None),
        (3, "http://a.org/p", "2020-01-03", "response", ok.format("t2", "d2"), "two"),
        (4, "http://a.org/p", "2020-01-04", "revisit", 'HTTP/1.1 304 Not Modified\r\nETag: "t1"\r\n', None),
        (5, "http://a.org/p", "2020-01-04", "revisit", "HTTP/1.1 304 Not Modified\r\nLast-Modified: d2\r\n", None),
        (6, "http://a.org/p", "2020-01-05", "response", "HTTP/1.1 500 Oops\r\n", "bad"),
        (7, "http://a.org/p", "2020-01-06", "revisit", None, "two"),
        (8, "http://a.org/q", "2020-01-01", "revisit", None, "two"), (9, None, "2020-01-01", "revisit", None, None), (10, "http://a.org/p", None, None, None, None),
        (11, "http://a.org/r", None, "response", ok.format("n", "n"), "n"), (12, "http://a.org/r", None, "revisit", None, "n"),
    ]
    out = {r["record_id"]: r for r in warc_revisits.resolve(spark.createDataFrame([(*r, "x") for r in rows], RECORDS)).collect()}
    assert {k: (r["resolution"], r["source_record_id"]) for k, r in out.items()} == {
        1: ("full", 1), 2: ("resolved", 1), 3: ("full", 3), 4: ("mismatch", None), 5: ("resolved", 3), 6: ("full", 6), 7: ("resolved", 3),
        8: ("no_response", None), 9: ("no_url", None), 10: ("other", None), 11: ("full", 11), 12: ("resolved", 11),
    }
    assert out[2]["headers"] == 'content-length: 5\ndate: now\netag: W/"t1"\nlast-modified: d1\nx-a: 1' and out[2]["status"] == 200
    assert warc_revisits.resolve(spark.createDataFrame([], RECORDS)).count() == 0


def test_revisits_of_one_hot_url_across_partitions(spark):
    """One url with all records: the forward fill must cross partitions."""
    rows = [(i, "http://hot.org/", f"{i:06d}", "response" if i % 97 == 0 else "revisit", f'HTTP/1.1 {200 if i % 97 == 0 else 304} X\r\nETag: "{i - i % 97}"\r\n', None, "x") for i in range(2000)]
    out = warc_revisits.resolve(spark.createDataFrame(rows, RECORDS).repartition(5)).collect()
    assert all(r["source_record_id"] == r["record_id"] - r["record_id"] % 97 for r in out)


def test_revisits_read_every_header_line(spark):
    head = "HTTP/1.1 200 OK\r\n" + "x: y\r\n" * 100_000 + 'ETag: "last"\r\n'
    rows = [(1, "http://a.org/", "2020-01-01", "response", head, None, "x"), (2, "http://a.org/", "2020-01-02", "revisit", 'HTTP/1.1 304 X\r\nETag: "last"\r\n', None, "x")]
    out = {r["record_id"]: r for r in warc_revisits.resolve(spark.createDataFrame(rows, RECORDS)).collect()}
    assert out[2]["resolution"] == "resolved" and out[1]["headers"].count("\n") == 100_000
