"""Quality classifier by Bradley-Terry pairwise ranking.

Every text becomes a vector of statistics of its bytes, words and lines (`NAMES`). A labelled good text is preferred to a labelled bad one;
a document's strength is a linear score of its vector, and weights are learned from preference pairs by logistic loss on the difference of
their vectors. The cut is a quantile of the scores of all labelled rows that may be learned from: as many lie below it as are labelled bad.
A score of 0 to 1 is the logistic function of the distance to that cut, placed so that the cut has `CUT`.

Bounds (parameters): `MAX_LABELLED` labelled rows, by class as in the toxicity operator's sample, and `PARTNERS` pairs for each row of the
larger class; vectors of these rows alone reach the driver. Statistics, the quantile and the scores cover all rows.

Defined results: all texts without words (null, empty, blank) score alike; rows with a null id are never learned from; null
labels are no labels, of repeated labels the greater counts; ties score alike, as do repeated rows; without any good or any bad labelled
row every score is the share of good ones (0.5 without labels); a text of any length is read whole; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.toxicity import by_class
from leadloom.operators.stages import stage_table

MAX_LABELLED = 20_000
PARTNERS = 8
CUT = 0.3
LIMIT = 4.0  # standardised statistics are cut off here
ACCURACY = 100_000  # of the quantile: its error is at most one in so many rows

CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "blank": b" \t", "line": b"\n\r",
    "stop": b".?", "shout": b"!", "comma": b",;:", "quote": b"\"'`()[]{}", "symbol": b"#*$%&~^=+@_", "table": b"|<>/\\", "dash": b"-",
    "control": bytes(range(9)) + bytes(range(14, 32)) + b"\x7f", "beyond": bytes(range(0x80, 0x100)),
}
CLASS_OF = np.full(256, len(CLASSES), np.int64)
for _number, _members in enumerate(CLASSES.values()):
    CLASS_OF[list(_members)] = _number
NAMES = (*CLASSES, "words", "word_length", "distinct", "distinct_power", "commonest", "adjacent", "lines", "line_words", "repeated_lines", "repeated_words")
SMALL = 1e-3


def statistics(text: bytes) -> list[float]:
    """Shares of byte classes, then of words and lines; shares are given as logarithms, so that rare and common ones differ alike."""
    words = text.split()
    n = len(words)
    if not n:
        return [*[math.log(SMALL)] * len(CLASSES), *[0.0] * (len(NAMES) - len(CLASSES))]
    counts = np.bincount(CLASS_OF, np.bincount(np.frombuffer(text, np.uint8), minlength=256), len(CLASSES) + 1)[: len(CLASSES)]
    shares = np.log(counts / len(text) + SMALL).tolist()
    met = Counter(words)
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    again = [line for line, k in Counter(lines).items() if k > 1]
    doubled = sum(map(len, lines)) - sum(map(len, set(lines)))
    few = [
        math.log(n), math.log(sum(map(len, words)) / n), len(met) / n, math.log(len(met) + 1) / math.log(n + 1), math.log(max(met.values()) / n + SMALL),
        math.log(sum(map(eq, words, words[1:])) / n + SMALL), math.log(len(lines)), math.log(n / len(lines)), len(again) / len(lines), doubled / len(text),
    ]
    return [*shares, *few]


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the vector `stats` of every row of doc_id and text."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    schema = docs.select("doc_id", F.array(F.lit(0.0)).alias("stats")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([statistics(t.as_py()) for t in batch["text"]], pa.list_(pa.float64()))], names=["doc_id", "stats"])

    return rows.mapInArrow(run, schema)


def preference_pairs(good: int, bad: int, partners: int = PARTNERS) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs: each row of the larger class meets `partners` of the other, dealt in turn, so that all rows take part alike."""
    many, few = max(good, bad), min(good, bad)
    first = np.repeat(np.arange(many), min(partners, few))
    turn = np.tile(np.arange(min(partners, few)), many)
    second = (first + turn * max(1, few // partners)) % few
    return (first, second) if good >= bad else (second, first)


def fit_strengths(good: np.ndarray, bad: np.ndarray, rounds: int = 400, decay: float = 1e-3) -> np.ndarray:
    """Weights of least mean log(1 + exp(-(strength of the good - strength of the bad))), by full-batch steps (Adam)."""
    g, b = preference_pairs(len(good), len(bad))
    w = moment = square = np.zeros(good.shape[1])
    for step in range(1, rounds + 1):
        lead = (good @ w)[g] - (bad @ w)[b]
        lost = 1 / (1 + np.exp(np.clip(lead, -40, 40))) / len(g)
        slope = decay * w - np.bincount(g, lost, len(good)) @ good + np.bincount(b, lost, len(bad)) @ bad
        moment, square = 0.9 * moment + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        w = w - 0.05 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
    return w


def _array(values: np.ndarray) -> str:
    return "array(" + ", ".join(f"{v!r}D" for v in values.tolist()) + ")"


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted and strength of every row. `labels` has doc_id and quality."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = stage_table(text_statistics(docs), "quality-statistics")
    held = "coalesce(pmod(crc32(CAST(doc_id AS STRING)), 5) = 0, true) AS held_out"
    known = labels.filter("doc_id IS NOT NULL AND pmod(crc32(CAST(doc_id AS STRING)), 5) <> 0 AND quality IN (0, 1)").groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("known"))
    taught = stage_table(rows.join(known, "doc_id"), "quality-labelled")
    chosen, _ = by_class(taught, "known", "doc_id", max_labelled)
    sample = chosen.select("stats", "known").collect()
    total = taught.agg(F.count(F.lit(1)).alias("n"), F.sum("known").alias("good")).first()
    share = (float(total["good"] or 0) + 1) / (total["n"] + 2)
    x, is_good = np.array([r["stats"] for r in sample]).reshape(-1, len(NAMES)), np.array([r["known"] for r in sample], bool)
    if is_good.all() or not is_good.any():
        return rows.selectExpr("doc_id", held, f"{share!r}D AS score", f"CAST({share!r}D >= {CUT}D AS INT) AS predicted", "0D AS strength")
    middle, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = np.clip((x - middle) / spread, -LIMIT, LIMIT)
    weights = fit_strengths(x[is_good], x[~is_good])
    standard = f"least({LIMIT}D, greatest(-{LIMIT}D, (v - {_array(middle)}[i]) / {_array(spread)}[i]))"
    strength = f"aggregate(transform(stats, (v, i) -> {standard} * {_array(weights)}[i]), 0D, (a, v) -> a + v)"
    ranked = taught.selectExpr(f"{strength} AS strength")
    below = (total["n"] - total["good"]) / total["n"]
    at = ranked.agg(F.percentile_approx("strength", below, ACCURACY).alias("at")).first()["at"]
    edge = ranked.agg(F.expr(f"max(IF(strength <= {at!r}D, strength, NULL)) AS low"), F.expr(f"min(IF(strength > {at!r}D, strength, NULL)) AS high")).first()
    cut = (edge["low"] + edge["high"]) / 2 if edge["high"] is not None else edge["low"]
    scored = rows.selectExpr("doc_id", held, f"{strength} AS strength")
    score = f"1D / (1D + exp({cut!r}D - strength - {math.log(CUT / (1 - CUT))!r}D))"
    return scored.selectExpr("doc_id", "held_out", f"{score} AS score", f"CAST({score} >= {CUT}D AS INT) AS predicted", "strength")
