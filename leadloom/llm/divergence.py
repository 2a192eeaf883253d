"""Source divergence audit: how the term shares of each source differ from those of the other sources of its language, and which
terms it prefers.

Strings are materialised late. Each task counts the terms of its texts per language and source and writes them once to the stage
folder, next to a 64-bit digest of each term. Only digests are shuffled to sum counts and documents; terms below `least_docs`
documents of their language go there. For the digests that are left the least and the greatest string are looked up, combined per
task first. Where the two differ, different terms share a digest: the counts of these few digests are summed anew by string, so a
collision decides nothing. Text is joined back for ranked terms only.

Shares are whole numbers, p = 1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V)), and all sums are exact. The sum of |p - q| over
the terms of a language is made in blocks of terms by sources, in shards of at most about `SHARD` rows, and only sums per pair of
sources leave a task; more than `TILE` sources are compared tile by tile. Terms that no source of a tile has need no row: they all add the
same difference. A source or a term that holds a third of all rows is spread over shards by the digest.

Defined results: null text, lang and source are read as ''; repeated rows are documents of their own, ids and other columns are not
read; every (lang, source) that occurs has its pairs, with value 0 where no term is kept; a language with one source has no pairs; ties are
ranked by the item's bytes; a text of any length is counted whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from leadloom.operators.stages import stage_table

LEAST_DOCS = 30
SCALE = 1_000_000_000
SMOOTH = 5
TOP_TERMS = 50
CACHE = 400_000  # distinct terms a task holds, over all its groups, before it writes them
TILE = 256  # sources compared at once
SHARD = 50_000  # rows (term, source) of a shard
TERMS = 4096  # terms of a dense block
BROADCAST = 1_000_000  # kept digests up to which they are sent to the tasks (16 MB); beyond, a shuffle join finds their strings

#: Every byte of a term as it is, A-Z lower-cased; every other byte a blank. Bytes from 0x80 on belong to letters beyond ASCII.
LETTERS = bytes(b | 0x20 if chr(b).isascii() and chr(b).isalpha() else b if b >= 0x80 else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters and characters beyond ASCII, A-Z lower-cased."""
    return text.translate(LETTERS).split()


def digest(term: bytes) -> int:
    """Signed 64-bit digest."""
    n = xxh64_intdigest(term)
    return n - (1 << 64) if n >> 63 else n


def counted(docs: DataFrame, hashed: Callable[[bytes], int] = digest) -> DataFrame:
    """lang, source, digest, n, docs, term: counts of tasks, not yet summed; one row without a term for every group a task meets."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]).withColumn("text", F.col("text").cast("binary"))
    names = ["lang", "source", "digest", "n", "docs", "term"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in groups.items():
                keys = list(n)
                columns = [[None, *map(hashed, keys)], [0, *n.values()], [0, *[docs[k] for k in keys]]]
                size = len(keys) + 1
                arrays = [pa.array([x], pa.string()).take(pa.array(np.zeros(size, np.int32))) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(c, pa.int64()) for c in columns], pa.array([None, *keys], pa.binary()).cast(pa.string())], names=names)
            groups.clear()

        for batch in batches:
            for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"], strict=True):
                n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
                found = terms(text.as_py())
                n.update(found)
                docs.update(set(found))
            if sum(len(n) for n, _ in groups.values()) > CACHE:
                yield from flush()
        yield from flush()

    return rows.mapInArrow(run, "lang string, source string, digest long, n long, docs long, term string")


def frequent(counts: DataFrame, by: list[str], least_docs: int) -> DataFrame:
    """Sums by language, source and `by` of the terms in at least `least_docs` documents of the language, in one shuffle."""
    key = ", ".join(["lang", *by])
    summed = counts.repartition("lang", *by).groupBy("lang", "source", *by).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return summed.withColumn("_all", F.expr(f"sum(docs) OVER (PARTITION BY {key})")).filter(F.col("_all") >= least_docs).drop("_all", "docs")


def kept_terms(rows: DataFrame, least_docs: int) -> tuple[DataFrame, DataFrame]:
    """(lang, source, digest, split, n) of the kept terms, and (digest, term) of digests that stand for one term. `split` is the term
    itself where its digest stands for several, else null."""
    counts = rows.filter("digest IS NOT NULL")
    found = stage_table(frequent(counts.select("lang", "source", "digest", "n", "docs"), ["digest"], least_docs), "divergence-counts")
    wanted = stage_table(found.select("digest").distinct(), "divergence-digests")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST else wanted
    names = stage_table(counts.select("digest", "term").join(wanted, "digest", "left_semi").groupBy("digest").agg(F.min("term").alias("term"), F.max("term").alias("_last")), "divergence-names")
    shared = stage_table(names.filter("term <> _last").select("digest"), "divergence-shared")  # hardly ever any, and so small enough to be broadcast
    apart = frequent(counts.join(shared, "digest", "left_semi").withColumnRenamed("term", "split"), ["digest", "split"], least_docs)
    alone = found.join(shared, "digest", "left_anti").withColumn("split", F.lit(None).cast("string"))
    return alone.unionByName(apart), names.select("digest", "term")


def share_sql(count: str, total: str, kept: str) -> str:
    """Exact for counts up to 10**18."""
    return f"1L + (CAST({SCALE} AS DECIMAL(10,0)) * CAST({count} + {SMOOTH} AS DECIMAL(20,0))) DIV CAST({total} + {SMOOTH} * {kept} AS DECIMAL(20,0))"


def shares(kept: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (lang, source, digest, split, p, q), and groups (lang, source, number within lang, base: the share of a term it lacks, kept: V,
    shards of its language)."""
    lang = kept.groupBy("lang", "digest", "split").agg(F.sum("n").alias("_all"), F.count(F.lit(1)).alias("_rows"))
    langs = lang.groupBy("lang").agg(F.sum("_all").alias("_total"), F.count(F.lit(1)).alias("kept"), F.sum("_rows").alias("_rows"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("_own"))
    numbered = groups.join(langs, "lang", "left").join(own, ["lang", "source"], "left").selectExpr(
        "lang", "source", "CAST(row_number() OVER (PARTITION BY lang ORDER BY source) - 1 AS INT) AS number", "coalesce(_own, 0L) AS own",
        "coalesce(kept, 0L) AS kept", "_total", f"CAST(1 + coalesce(_rows, 0L) DIV {SHARD} AS INT) AS shards",
    )
    numbered = stage_table(numbered.withColumn("base", F.expr(f"CASE WHEN kept > 0 THEN {share_sql('0L', 'own', 'kept')} END")), "divergence-groups")
    every = kept.withColumn("_all", F.expr("sum(n) OVER (PARTITION BY lang, digest, split)"))
    rows = every.join(numbered, ["lang", "source"]).selectExpr(
        "lang", "source", "number", "shards", "digest", "split", f"{share_sql('n', 'own', 'kept')} AS p", f"{share_sql('_all', '_total', 'kept')} AS q"
    )
    return stage_table(rows, "divergence-shares"), numbered


def block_sums(rows: pd.DataFrame, tile: int, size: int) -> pd.DataFrame:
    """Of one shard of two tiles: sum of |p - q| of each pair of sources over the terms met, and how many were met. Terms are taken `size` at a time."""
    bare = rows["digest"].isna().to_numpy()
    known = rows[bare].sort_values("number")
    number, base = known["number"].to_numpy(), known["p"].to_numpy(np.int64)
    left, right = (np.flatnonzero(number // tile == rows[c].iloc[0]) for c in ("_a", "_b"))
    rows = rows[~bare]
    column = np.searchsorted(number, rows["number"].to_numpy())
    term = rows.groupby(["digest", "split"], dropna=False, sort=False).ngroup().to_numpy()
    order = np.argsort(term, kind="stable")
    term, column, p = term[order], column[order], rows["p"].to_numpy(np.int64)[order]
    met = int(term[-1]) + 1 if len(term) else 0
    total = np.zeros((len(left), len(right)), np.int64)
    for at in range(0, met, size):
        a, b = np.searchsorted(term, (at, at + size))
        dense = np.tile(base[:, None], min(size, met - at))
        dense[column[a:b], term[a:b] - at] = p[a:b]
        for k, i in enumerate(left):
            total[k] += np.abs(dense[right] - dense[i]).sum(axis=1)
    i, j = np.repeat(number[left], len(right)), np.tile(number[right], len(left))
    out = pd.DataFrame({"lang": known["lang"].iloc[0], "i": i, "j": j, "value": total.ravel(), "met": met})
    return out[out["i"] < out["j"]]


def pair_values(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: every two sources of a language, both ways."""
    tiles = groups.groupBy("lang").agg((F.max("number") / F.lit(TILE)).cast("int").alias("_last"))
    spread = "inline(transform(sequence(0, _last), y -> named_struct('_a', least(y, number DIV {t}), '_b', greatest(y, number DIV {t}))))".format(t=f"CAST({TILE} AS INT)")
    columns = ["lang", "number", "digest", "split", "p", "_shard"]
    terms_ = rows.withColumn("_shard", F.expr("pmod(xxhash64(digest, split), shards)")).select(*columns)
    bases = groups.filter("kept > 0").selectExpr("lang", "number", "CAST(NULL AS BIGINT) AS digest", "CAST(NULL AS STRING) AS split", "base AS p", "explode(sequence(0L, shards - 1L)) AS _shard")
    dealt = terms_.unionByName(bases).join(tiles, "lang").selectExpr(*columns, spread).selectExpr(*columns, "CAST(_a AS INT) AS _a", "CAST(_b AS INT) AS _b")
    tile, size = TILE, TERMS
    sums = dealt.groupBy("lang", "_a", "_b", "_shard").applyInPandas(lambda rows: block_sums(rows, tile, size), "lang string, i int, j int, value long, met long")
    sums = sums.groupBy("lang", "i", "j").agg(F.sum("value").alias("_sum"), F.sum("met").alias("_met"))
    first = groups.select("lang", F.col("source").alias("_s1"), F.col("number").alias("i"), F.col("base").alias("_b1"), "kept")
    second = groups.select("lang", F.col("source").alias("_s2"), F.col("number").alias("j"), F.col("base").alias("_b2"))
    pairs = first.join(second, "lang").filter("i < j").join(sums, ["lang", "i", "j"], "left")
    value = F.expr("coalesce(_sum + (kept - _met) * abs(_b1 - _b2), 0L) AS value")
    return pairs.select("lang", "_s1", "_s2", value).selectExpr("lang", "inline(array(named_struct('source', _s1, 'item', _s2), named_struct('source', _s2, 'item', _s1)))", "value")


def preferred_terms(rows: DataFrame, names: DataFrame, top: int) -> DataFrame:
    """lang, source, item, value, rank: terms whose share in the source is above that in the language. Ties of the last rank are
    settled after the text is joined."""
    over = rows.filter("p > q").selectExpr("lang", "source", "digest", "split", "p - q AS value")
    near = over.withColumn("_rank", F.expr("rank() OVER (PARTITION BY lang, source ORDER BY value DESC)")).filter(F.col("_rank") <= top)
    named = near.join(names, "digest", "left").selectExpr("lang", "source", "coalesce(split, term) AS item", "value")
    return named.withColumn("rank", F.expr("row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)")).filter(F.col("rank") <= top)


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, hashed: Callable[[bytes], int] = digest) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value and rank. `docs` has text, lang and source."""
    counts = stage_table(counted(docs, hashed), "divergence-terms")
    kept, names = kept_terms(counts, least_docs)
    rows, groups = shares(kept, counts.filter("digest IS NULL").select("lang", "source").distinct())
    pairs = pair_values(rows, groups).withColumn("rank", F.expr("row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)"))
    order = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*order).unionByName(preferred_terms(rows, names, top).withColumn("part", F.lit("term")).select(*order))
