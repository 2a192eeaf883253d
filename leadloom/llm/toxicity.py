"""Toxicity by weak supervision.

Voters are lexicon entries (whole words) and patterns (beginnings of words) mined from a bounded sample of labelled
rows. A generative label model says how often each voter fires on toxic and on other texts; it is fitted by
expectation and maximisation over the votes on all documents, with known labels held fixed, and voters that fire
together within a class beyond chance are correlated and share their weight. A logistic regression over a wider vocabulary of
the same kind is then trained on labelled rows only: half of each target is the posterior, half the known label (posteriors alone
flag more clean rows, see README). Posteriors of rows without a label do not train it. Scores depend on the text alone.

Bounds (all parameters): `MAX_LABELLED` rows for mining and for training, `MAX_VOTERS` voters, `MAX_FEATURES` features; votes and
their statistics cover every document, and reach the driver as sums per voter and pair of voters only. Within `MAX_LABELLED` toxic
rows come first, up to half of it, or more where the others are fewer than the other half; shares and training weigh each class by what was left out. A
word longer than `LONGEST_WORD` letters is no feature as a whole, only its beginnings are. Without a voter (no feature in
`VOTER_ROWS` toxic rows and `VOTER_LIFT` times likelier there) the regression learns from the labels alone.

Defined results: null and empty texts get the score of a text without any feature; rows with a null id are never
learned from; null labels are no labels; repeated rows score alike; without any toxic or any other labelled row every score
is the share of toxic ones (0.5 without labels); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.operators.stages import stage_table

MAX_LABELLED = 20_000
MAX_VOTERS = 128
MAX_FEATURES = 2048
LONGEST_WORD = 40  # letters up to which a whole word is a feature
LEAST_ROWS = 4  # labelled rows a feature must occur in
VOTER_ROWS = 8  # toxic rows that a voter must occur in
VOTER_LIFT = 10.0  # how much likelier in toxic rows a voter must be
ITERATIONS = 4
NO_VOTE = 3.0  # log odds that the absence of every vote takes away
CORRELATED = 0.6  # correlation within a class from which two voters share their weight
PREFIXES = (4, 5, 6)
EDGE = ".,;:!?\"'()[]{}*%&#|<>~_-"
CACHE = 400_000


def word_features(word: str) -> list[str]:
    """Names of a chunk's features: the word without its edges, and its beginnings."""
    bare = word.strip(EDGE)
    if not bare:
        return []
    return [*([f"={bare}"] if len(bare) <= LONGEST_WORD else []), *[f"^{bare[:n]}" for n in PREFIXES if len(bare) > n]]


def features_of(text: str) -> set[str]:
    return {f for w in set(text.lower().split()) for f in word_features(w)}


def by_class(rows: DataFrame, label: str, row_id: str, limit: int) -> tuple[DataFrame, dict[int, float]]:
    """At most `limit` rows, toxic ones first up to half of it or what the others leave, by hash within a class; and for each class
    how many rows one taken row stands for."""
    n = {0: 0, 1: 0} | {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic = min(n[1], max(limit // 2, limit - n[0]))
    take = {1: toxic, 0: min(n[0], limit - toxic)}
    first, other = (rows.filter(F.col(label) == k).orderBy(F.xxhash64(row_id), row_id).limit(take[k]) for k in (1, 0))
    return first.unionByName(other), {k: n[k] / take[k] if take[k] else 1.0 for k in take}


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int) -> tuple[DataFrame, dict[int, float]]:
    """(text, toxic) of at most `limit` rows that may be learned from, and what a row of each class stands for. The list of ids is bounded, so it is broadcast."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic")).filter("_toxic IN (0, 1) AND pmod(crc32(CAST(_id AS STRING)), 5) <> 0")
    chosen, stands = by_class(known.groupBy("_id").agg(F.max("_toxic").alias("_toxic")), "_toxic", "_id", limit)
    return docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("text", "_toxic"), stands


def feature_counts(sample: DataFrame) -> DataFrame:
    """(feature, toxic rows, other rows): counted per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter, list[int]] = (Counter(), Counter(), [0, 0])

        def flush() -> pa.RecordBatch:
            names = list(counts[0].keys() | counts[1].keys())
            out = [pa.array([*names, ""]), *[pa.array([*[counts[k][n] for n in names], counts[2][k]], pa.int64()) for k in (1, 0)]]
            counts[0].clear(), counts[1].clear()
            counts[2][:] = [0, 0]
            return pa.RecordBatch.from_arrays(out, names=["feature", "n1", "n0"])

        for batch in batches:
            for text, toxic in zip(batch["text"], batch["_toxic"].to_pylist(), strict=True):
                counts[toxic].update(features_of(text.as_py() or ""))
                counts[2][toxic] += 1
                if len(counts[0]) > CACHE:
                    yield flush()
        yield flush()

    return sample.mapInArrow(run, "feature string, n1 long, n0 long").groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def chosen_features(counts: DataFrame, limit: int) -> tuple[list[tuple[str, int, int]], int, int]:
    """The features that tell most (by the G statistic), and the numbers of toxic and other rows."""
    total = counts.filter("feature = ''").first()
    n1, n0 = (total["n1"], total["n0"]) if total else (0, 0)
    if not n1 or not n0:
        return [], n1 or 0, n0 or 0
    part = "({a}) * ln(greatest({a}, 0.5D) / ({n} * (n1 + n0) / ({t}D)))"
    tells = part.format(a="n1", n=n1, t=n1 + n0) + " + " + part.format(a="n0", n=n0, t=n1 + n0)
    rows = counts.filter(f"feature <> '' AND n1 + n0 >= {LEAST_ROWS}").withColumn("_tells", F.expr(tells)).orderBy(F.desc("_tells"), "feature").limit(limit).collect()
    return [(r["feature"], r["n1"], r["n0"]) for r in rows], n1, n0


def found_features(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """doc_id and the sorted numbers of the vocabulary's features in the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = docs.select("doc_id", F.array(F.lit(0)).alias("found")).schema
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        get = shared.value.get
        for batch in batches:
            out = []
            for text in batch["text"]:
                words = set((text.as_py() or "").lower().split())
                for w in words.difference(known):
                    known[w] = tuple(n for n in map(get, word_features(w)) if n is not None)
                out.append(sorted({n for w in words if (some := known[w]) for n in some}))
                if len(known) > CACHE:
                    known.clear()
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "found"])

    return rows.mapInArrow(run, schema)


class LabelModel:
    """Naive-Bayes label model over binary voters: rates of firing per class, share of toxic rows, and for each voter the weight that
    its correlations leave it."""

    def __init__(self, on: np.ndarray, off: np.ndarray, share: float) -> None:
        self.on, self.off, self.share = on, off, share
        self.weight = np.ones(len(on))

    def terms(self) -> np.ndarray:
        """Log odds that each voter adds where it fires; one that is silent abstains."""
        return self.weight * np.log(self.on / self.off)

    def base(self) -> float:
        return math.log(self.share / (1 - self.share))


def posterior_sql(model: LabelModel) -> str:
    """SQL expression of the posterior of `votes`; a known label stands for itself."""
    table = "array(" + ", ".join(f"{t!r}D" for t in model.terms().tolist()) + ")"
    logit = f"aggregate(votes, {model.base() - NO_VOTE!r}D + CASE WHEN size(votes) > 0 THEN {NO_VOTE}D ELSE 0D END, (a, v) -> a + {table}[v])"
    return f"CASE WHEN known IS NOT NULL THEN CAST(known AS DOUBLE) ELSE 1D / (1D + exp(-({logit}))) END"


def fit_label_model(votes: DataFrame, start: LabelModel, iterations: int = ITERATIONS) -> LabelModel:
    """Expectation and maximisation over all rows (votes, known). Each step is one grouped sum per voter; the first also
    sums pairs of voters, from which correlations within the classes follow."""
    model, n = start, len(start.on)
    for step in range(iterations):
        scored = votes.select("votes", F.expr(posterior_sql(model)).alias("p"))
        if step == 0:
            pairs = scored.selectExpr("inline(flatten(transform(votes, a -> transform(filter(votes, b -> b > a), b -> named_struct('a', a, 'b', b, 'p', p)))))")
            both = pairs.groupBy("a", "b").agg(F.sum("p").alias("on"), F.sum(1 - F.col("p")).alias("off")).collect()  # at most MAX_VOTERS squared
        total = scored.agg(F.sum("p").alias("p"), F.count("p").alias("n")).first()
        fired = scored.selectExpr("explode(votes) AS v", "p").groupBy("v").agg(F.sum("p").alias("on"), F.sum(1 - F.col("p")).alias("off")).collect()
        on, off = np.full(n, 0.1), np.full(n, 0.1)
        for r in fired:
            on[r["v"]] += r["on"]
            off[r["v"]] += r["off"]
        toxic, other = (total["p"] or 0.0) + 1, (total["n"] or 0) - (total["p"] or 0.0) + 1
        weight = model.weight
        model = LabelModel(np.clip(on / toxic, 1e-6, 0.999), np.clip(off / other, 1e-7, 0.999), min(max(toxic / (toxic + other), 1e-4), 1 - 1e-4))
        model.weight = weight
        if step == 0:
            model.weight = shared_weight(model, both, toxic, other)
    return model


def shared_weight(model: LabelModel, both: list, toxic: float, other: float) -> np.ndarray:
    """1 / (1 + the sum of a voter's correlations with others, within the class where they are strongest)."""
    n = len(model.on)
    joint = np.zeros((2, n, n))
    for r in both:
        joint[0, r["a"], r["b"]] = joint[0, r["b"], r["a"]] = r["on"] / toxic
        joint[1, r["a"], r["b"]] = joint[1, r["b"], r["a"]] = r["off"] / other
    most = np.zeros((n, n))
    for k, rate in enumerate((model.on, model.off)):
        spread = np.sqrt(rate * (1 - rate))
        most = np.maximum(most, (joint[k] - np.outer(rate, rate)) / np.outer(spread, spread))
    most = np.where(most > CORRELATED, np.minimum(most, 1.0), 0.0)
    np.fill_diagonal(most, 0)
    return 1 / (1 + most.sum(axis=1))


def train(rows: list[list[int]], target: np.ndarray, first: np.ndarray, stands: np.ndarray, rounds: int = 200, decay: float = 3e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by full-batch gradient steps (Adam); rows are lists of feature numbers and count as `stands` says. Weights are
    drawn to `first`, what the label model gives its voters, so that a voter seen in few training rows keeps its say."""
    size = len(first)
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.fromiter((f for r in rows for f in r), np.int64, len(at))
    w, moment, square = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    part = stands / stands.sum()
    mean = min(max(float((target * part).sum()), 1e-3), 1 - 1e-3)
    w[:size], w[size] = first, math.log(mean / (1 - mean)) - NO_VOTE
    for step in range(1, rounds + 1):
        logit = w[size] + np.bincount(at, w[feature], len(rows))
        error = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - target) * part
        slope = np.append(np.bincount(feature, error[at], size), error.sum()) + decay * np.append(w[:size] - first, 0)
        moment, square = 0.9 * moment + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        w -= 0.1 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
    return w[:size], float(w[size])


def score_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted and weak_label (the label model's posterior) of every row. `labels` has doc_id and toxic."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sample, stands = labelled_sample(docs, labels, max_labelled)
    counts = stage_table(feature_counts(sample), "toxicity-counts")
    features, n1, n0 = chosen_features(counts, MAX_FEATURES)
    toxic, other = n1 * stands[1], n0 * stands[0]
    share = (toxic + 1) / (toxic + other + 2)
    names = [f for f, _, _ in features]
    rate = [(a / (n1 + 1) if a >= VOTER_ROWS else 0.0, (b + 1) / (n0 + 1)) for _, a, b in features]
    # Voters come first, so that a vote is a feature number below their count.
    order = sorted(range(len(names)), key=lambda i: rate[i][0] < VOTER_LIFT * rate[i][1])
    names, rate = [names[i] for i in order], [rate[i] for i in order]
    voters = min(MAX_VOTERS, sum(a >= VOTER_LIFT * b for a, b in rate))
    known = labels.filter("doc_id IS NOT NULL AND pmod(crc32(CAST(doc_id AS STRING)), 5) <> 0 AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("known"))
    found = found_features(docs, {f: i for i, f in enumerate(names)})
    rows = stage_table(found.join(known, "doc_id", "left").withColumn("votes", F.expr(f"filter(found, v -> v < {voters})")), "toxicity-votes")
    held = "coalesce(pmod(crc32(CAST(doc_id AS STRING)), 5) = 0, true) AS held_out"
    if not names:
        return rows.selectExpr("doc_id", held, f"{share!r}D AS score", f"CAST({share!r}D >= 0.5D AS INT) AS predicted", f"{share!r}D AS weak_label")
    if voters:
        start = LabelModel(np.clip([r[0] for r in rate[:voters]], 1e-6, 0.999), np.clip([r[1] for r in rate[:voters]], 1e-7, 0.999), share)
        model = fit_label_model(rows.select("votes", "known"), start)
        weak, terms = posterior_sql(model).replace("known IS NOT NULL", "false"), model.terms()
        target = f"({weak} + known) / 2"
    else:
        weak, terms, target = f"{share!r}D", np.zeros(0), "CAST(known AS DOUBLE)"
    taught, stands = by_class(rows.filter("known IS NOT NULL"), "known", "doc_id", max_labelled)
    sample = taught.select("found", "known", F.expr(target).alias("p")).collect()
    weights, bias = train(
        [r["found"] for r in sample], np.array([r["p"] for r in sample]), np.append(terms, np.zeros(len(names) - voters)), np.array([stands[r["known"]] for r in sample])
    )
    table = "array(" + ", ".join(f"{w!r}D" for w in weights.tolist()) + ")"
    logit = f"aggregate(found, {bias!r}D, (a, v) -> a + {table}[v])"
    scored = rows.selectExpr("doc_id", held, f"1D / (1D + exp(-({logit}))) AS score", f"{weak} AS weak_label")
    return scored.selectExpr("doc_id", "held_out", "score", "CAST(score >= 0.5D AS INT) AS predicted", "weak_label")
