"""Quality rules: base statistics of every whole text, then robust multivariate outliers.

Documents that fail the base rules are rejected at once. The others are judged by the Mahalanobis
distance of their transformed statistics from a minimum-covariance-determinant (MCD) estimate of
their own language and source. All of it is DataFrame operations; each MCD step is one grouped
aggregate with partial sums, so a source that holds a third of all rows costs no task more than another.

MCD here: two deterministic starts per group (scaled and plain distance from the median), each
followed by `steps` concentration steps (keep the `subset` share of the group's rows nearest to the
current estimate, take their mean and covariance), then the start with the smaller determinant wins.
Statistics of clean text are often constant (no repeated line at all), which makes a plain covariance
singular. So every estimate is regularised with `prior_rows` rows of a diagonal covariance around the
language's median: small groups lean on their language, large ones do not notice.

Defined results: null or empty text has no words and fails the base rules; null language or source is a
group of its own; repeated rows are judged alike; an empty table gives an empty result; other columns of
the input are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions.text import let
from leadloom.llm.text import words
from leadloom.operators.stages import stage_table

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SUBSET = 0.75  # share of a group's rows that a concentration step keeps
STEPS = 3
PRIOR_ROWS = 30.0
TAIL = 1e-6  # an outlier lies beyond what this share of normal rows would reach
BINS = 16  # squared distances are binned this finely per e-fold when the nearest share is chosen
STATS = ("word_length", "symbols", "dup_lines", "repeats", "capitals", "line_words")
#: Added standard deviation of each statistic, in its own unit: smaller differences say nothing.
FLOOR = {"word_length": 0.04, "symbols": 0.03, "dup_lines": 0.12, "repeats": 0.12, "capitals": 0.03, "line_words": 0.3}
DIM = len(STATS)
PAIRS = [(i, j) for i in range(DIM) for j in range(i + 1)]


def repeat_words() -> str:
    """SQL expression over `_words`: words in windows found twice or more. Window hashes come from hashes of 1, 2 and 4
    words; where two agree, (hash, place) pairs are sorted and the places of equal neighbours counted once per word."""
    count = f"aggregate(transform(_at, (x, i) -> least({WINDOW}, get(_at, i + 1) - x)), 0, (a, x) -> a + x)"
    twice = "filter(_pairs, (x, j) -> coalesce(get(_pairs, j - 1).h = x.h, false) OR coalesce(get(_pairs, j + 1).h = x.h, false))"
    count = let("_at", f"sort_array(transform({twice}, x -> x.i))", count)
    count = let("_pairs", "sort_array(transform(_h8, (x, i) -> named_struct('h', x, 'i', i)))", count)
    count = let("_h8", f"slice(transform(_h4, (x, i) -> xxhash64(x, get(_h4, i + 4))), 1, greatest(size(_h4) - {WINDOW - 1}, 0))", f"CASE WHEN size(array_distinct(_h8)) < size(_h8) THEN {count} ELSE 0 END")
    count = let("_h4", "transform(_h2, (x, i) -> xxhash64(x, get(_h2, i + 2)))", count)
    count = let("_h2", "transform(_h1, (x, i) -> xxhash64(x, get(_h1, i + 1)))", count)
    return let("_h1", "transform(_words, x -> xxhash64(x))", count)


def base_statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep` and the counts of every text. Nothing is shuffled; repeats are found by hashes of
    8-word windows sorted within the text (64 bits: two different windows of one text practically never agree)."""
    lines = "filter(split(_text, '\\n', -1), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    step = docs.select(F.struct(F.lit(1).alias("_one"), *keep).alias("_doc"), F.coalesce(F.col(text), F.lit("")).alias("_text"), words(F.col(text)).alias("_words"))
    step = step.select("*", F.expr(lines).alias("_lines")).select(
        "_doc",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "_words")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.length("_text") - F.length(F.regexp_replace("_text", r"\p{Lu}+", ""))).cast("long").alias("n_capitals"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(repeat_words()).cast("long").alias("n_repeat_words"),
    )
    return step.select(*[F.col("_doc").getField(c).alias(c) for c in keep], *[c for c in step.columns if c != "_doc"])


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def transformed(stats: DataFrame) -> DataFrame:
    """Adds the statistic vector. Shares are smoothed by a few words' worth of nothing and square-rooted, which
    evens out their spread between short and long texts; lengths are logarithms."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return stats.withColumns(
        {
            "word_length": F.log((chars + 300.0) / (n + 50.0)),
            "symbols": F.sqrt(F.col("n_symbols") / (chars + 100.0)),
            "dup_lines": F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 4.0)),
            "repeats": F.sqrt(F.col("n_repeat_words") / (n + 50.0)),
            "capitals": F.sqrt(F.col("n_capitals") / (chars + 100.0)),
            "line_words": F.log((n + 50.0) / (F.col("n_lines") + 1.0)),
        }
    )


def chi2_below(x: float, dof: int) -> float:
    """Share of a chi-square distribution with an even number of degrees of freedom that lies below x."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))


def chi2_quantile(share: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_below(mid, dof) < share else (low, mid)
    return low


CUTOFF = chi2_quantile(1 - TAIL, DIM)
#: Makes the covariance of the nearest share agree with that of all rows, for normal rows.
CONSISTENCY = SUBSET / chi2_below(chi2_quantile(SUBSET, DIM), DIM + 2)


def grouped(stats: DataFrame, lang: str, source: str) -> DataFrame:
    """Adds the keys of a row's language and of its language and source; null is a value of its own."""
    return stats.withColumns(
        {
            "_lang": F.to_json(F.struct(F.col(lang).cast("string").alias("l"))),
            "_group": F.to_json(F.struct(F.col(lang).cast("string").alias("l"), F.col(source).cast("string").alias("s"))),
        }
    )


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Median and scaled quartile range of each statistic per key."""
    quarters = [F.percentile_approx(s, [0.25, 0.5, 0.75], 10000).alias(f"_q_{s}") for s in STATS]
    found = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *quarters)
    median = F.array(*[F.col(f"_q_{s}")[1] for s in STATS])
    scale = F.array(*[(F.col(f"_q_{s}")[2] - F.col(f"_q_{s}")[0]) / 1.349 for s in STATS])
    return found.select(key, "_n", median.alias("_median"), scale.alias("_scale"))


def priors(rows: DataFrame) -> DataFrame:
    """Per group: its size and median, and the median and scale of its language."""
    languages = spread(rows, "_lang").select("_lang", F.col("_median").alias("_prior"), F.col("_scale").alias("_prior_scale"))
    return spread(rows, "_group").join(rows.groupBy("_group").agg(F.min("_lang").alias("_lang")), "_group").join(languages, "_lang").drop("_scale")


def plus(terms: list[str]) -> str:
    return " + ".join(terms) or "0D"


def starts(groups: DataFrame) -> DataFrame:
    """Two first estimates per group: around its median (drawn to its language's while it is small), with the
    language's scales in one and the floors alone in the other. An estimate is a mean, the inverse of a covariance
    (lower half, row by row) and the logarithm of the covariance's determinant."""
    mean = ", ".join(f"(_n * _median[{i}] + {PRIOR_ROWS}D * _prior[{i}]) / (_n + {PRIOR_ROWS}D)" for i in range(DIM))
    floors = [f"{FLOOR[s] ** 2!r}D" for s in STATS]
    scaled = [f"_prior_scale[{i}] * _prior_scale[{i}] + {floors[i]}" for i in range(DIM)]

    def start(number: int, variances: list[str]) -> str:
        inverse = ", ".join(f"1D / ({variances[i]})" if i == j else "0D" for i, j in PAIRS)
        return f"named_struct('_start', {number}, '_inverse', array({inverse}), '_size', 0D)"

    return groups.selectExpr("_group", f"array({mean}) AS _mean", f"inline(array({start(0, scaled)}, {start(1, floors)}))")


def with_distance(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Each row with its squared Mahalanobis distance from each estimate of its group."""
    off = [f"({s} - _mean[{i}])" for i, s in enumerate(STATS)]
    terms = [f"{1 if i == j else 2}D * _inverse[{k}] * {off[i]} * {off[j]}" for k, (i, j) in enumerate(PAIRS)]
    return rows.join(estimates, "_group").selectExpr("*", f"{plus(terms)} AS distance")


def nearest_sums(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Sums over the nearest share of each group's rows, for each start. They are kept per distance bin, so that one
    aggregate both finds the share (to the bin) and has its sums; a group's bins are a few hundred rows at most."""
    near = with_distance(rows, estimates).selectExpr("_group", "_start", f"floor(ln(distance + 1e-9D) * {BINS}) AS _bin", *STATS)
    names = [*[f"_s{i}" for i in range(DIM)], *[f"_s{i}_{j}" for i, j in PAIRS]]
    values = [*STATS, *[f"{STATS[i]} * {STATS[j]}" for i, j in PAIRS]]
    binned = near.groupBy("_group", "_start", "_bin").agg(F.expr("count(1) AS _n"), *[F.expr(f"sum({v}) AS {c}") for c, v in zip(names, values, strict=True)])
    group = "PARTITION BY _group, _start"
    before = f"coalesce(sum(_n) OVER ({group} ORDER BY _bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _before"
    chosen = binned.selectExpr("*", before, f"sum(_n) OVER ({group}) AS _all").filter(f"_before < {SUBSET} * _all")
    return chosen.groupBy("_group", "_start").agg(*[F.expr(f"sum({c}) AS {c}") for c in ("_n", *names)])


def estimated(total: DataFrame) -> DataFrame:
    """Mean, inverse and determinant of the regularised covariance from sums: Cholesky factor L, then its inverse V,
    then the inverse covariance as V'V. One row per group and start, so the arithmetic costs nothing."""
    size = f"(_n + {PRIOR_ROWS}D)"
    out = total.selectExpr("*", *[f"(_s{i} + {PRIOR_ROWS}D * _prior[{i}]) / {size} AS _m{i}" for i in range(DIM)])
    cells = []
    for i, j in PAIRS:
        cell = f"(_s{i}_{j} - _m{i} * _s{j} - _m{j} * _s{i} + _n * _m{i} * _m{j}) * {CONSISTENCY!r}D / {size}"
        if i == j:
            cell = f"greatest({cell}, 0D) + _prior_scale[{i}] * _prior_scale[{i}] * {PRIOR_ROWS}D / {size} + {FLOOR[STATS[i]] ** 2!r}D"
        cells.append(f"{cell} AS _c{i}_{j}")
    out = out.selectExpr("*", *cells)
    for j in range(DIM):
        out = out.selectExpr("*", f"sqrt(_c{j}_{j} - ({plus([f'_l{j}_{k} * _l{j}_{k}' for k in range(j)])})) AS _l{j}_{j}")
        below = [f"(_c{i}_{j} - ({plus([f'_l{i}_{k} * _l{j}_{k}' for k in range(j)])})) / _l{j}_{j} AS _l{i}_{j}" for i in range(j + 1, DIM)]
        out = out.selectExpr("*", *below)
    for i in range(DIM):
        left = [f"-({plus([f'_l{i}_{k} * _v{k}_{j}' for k in range(j, i)])}) / _l{i}_{i} AS _v{i}_{j}" for j in range(i)]
        out = out.selectExpr("*", f"1D / _l{i}_{i} AS _v{i}_{i}", *left)
    mean = ", ".join(f"_m{i}" for i in range(DIM))
    inverse = ", ".join(plus([f"_v{k}_{i} * _v{k}_{j}" for k in range(i, DIM)]) for i, j in PAIRS)
    return out.selectExpr("_group", "_start", f"array({mean}) AS _mean", f"array({inverse}) AS _inverse", f"{plus([f'ln(_l{i}_{i})' for i in range(DIM)])} AS _size")


def fit(rows: DataFrame) -> DataFrame:
    """The MCD estimate of each group of `rows` (statistic vectors with their group keys): one row per group. Each
    step's small tables are written, which also keeps the plans short."""
    groups = stage_table(priors(rows), "mcd-groups")
    estimates = starts(groups)
    for _ in range(STEPS):
        total = nearest_sums(rows, estimates).join(groups.select("_group", "_prior", "_prior_scale"), "_group")
        estimates = stage_table(estimated(stage_table(total, "mcd-sums")), "mcd-estimates")
    best = F.min_by(F.struct("_mean", "_inverse"), F.struct("_size", "_start"))
    return estimates.groupBy("_group").agg(best.alias("_e")).select("_group", "_e.*")


def judged(stats: DataFrame, estimates: DataFrame) -> DataFrame:
    """Adds `distance` (null where the base rules failed) and `kept`."""
    failed = stats.filter("base_failed").withColumn("distance", F.lit(None).cast("double"))
    passed = with_distance(stats.filter("NOT base_failed"), estimates).select(*failed.columns)
    return passed.unionByName(failed).withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= CUTOFF))


def with_groups(docs: DataFrame, keep: list[str], text: str, lang: str, source: str) -> DataFrame:
    named = [*keep, *[c for c in (lang, source) if c not in keep]]
    stats = transformed(base_statistics(docs, named, text)).withColumn("base_failed", base_failed())
    return grouped(stats, lang, source)


def quality_verdicts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per document: `doc_id`, the base counts, `base_failed`, the statistic vector, `distance` and `kept`."""
    stats = stage_table(with_groups(docs, [doc_id], text, lang, source), "quality-stats")
    return judged(stats, fit(stats.filter("NOT base_failed"))).drop("_lang", "_group")


def quality_filter(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of `docs` that are kept, with all their columns. The statistics are computed twice, once for the
    estimates and once beside the texts, so that no text is shuffled. `_barrier` keeps the verdict from being pushed
    below the statistics, where its nested expressions would be copied over and over."""
    stats = stage_table(with_groups(docs, [], text, lang, source).drop(lang, source), "quality-stats")
    estimates = stage_table(fit(stats.filter("NOT base_failed")), "quality-estimates")
    whole = docs.select(F.struct("*").alias("_row"), F.col(text).alias("_t"), F.col(lang).alias("_l"), F.col(source).alias("_s"))
    beside = with_groups(whole, ["_row"], "_t", "_l", "_s").withColumn("_barrier", F.monotonically_increasing_id())
    return with_distance(beside, estimates).filter(f"NOT base_failed AND distance <= {CUTOFF!r}").select("_row.*")
