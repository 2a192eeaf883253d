"""Temperature mixing of sources, realised as budgeted block permutations.

A source's share of all tokens is raised to an exponent and normalised. The exponent is bisected (in `SECTIONS` parts
at a time, one grouped aggregate over the per-source totals each) until the mix meets a target: the flattest mix in
which no source is repeated more than `max_repetition` times, or the least flat one with at least `target_entropy` nats.
Without a budget the tokens to draw are the fewest at which every source is read at least once, so nothing is lost.

A source's budget is so many whole passes and a rest. Its documents lie in blocks of about `BLOCK_TOKENS` tokens by
hash; for the rest the blocks are permuted by hash and taken while they fit, and in the one block that the budget
ends in documents are permuted and taken while they fit. So windows run over block totals and over single blocks, never
over all documents of a source. All of it is DataFrame functions.

Defined results: a null source is a source of its own; texts without words have no tokens, count for no source's share
and are drawn once; repeated rows are drawn alike but for the block where the budget ends, where either may be taken;
one source alone is drawn once; an empty table gives no rows; other columns are carried along untouched.
"""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.text import words
from leadloom.operators.stages import stage_table

MAX_REPETITION = 2.0
BLOCK_TOKENS = 1_000_000
SECTIONS = 32
ROUNDS = 5
SEED = 17


def tokens_of(docs: DataFrame, carry: list[str], text: str = "text", source: str = "source") -> DataFrame:
    """`row` (a struct of the columns `carry`), `_source` (key of the source), `_draw` (hash of id and text) and n_tokens."""
    return docs.select(
        F.struct(*[F.col(c) for c in carry]).alias("row"),
        F.to_json(F.struct(F.col(source).cast("string").alias("s"))).alias("_source"),
        F.xxhash64(F.lit(SEED), F.col(carry[0]), F.col(text)).alias("_draw"),
        F.size(words(F.col(text))).cast("long").alias("n_tokens"),
    )


def _measured(totals: DataFrame, exponents: list[float], budget: float | None) -> list[tuple[float, float, float]]:
    """For each exponent: entropy of the weights and the largest number of times a source is read."""
    grid = "explode(array(" + ", ".join(f"{x!r}D" for x in exponents) + ")) AS _x"
    powers = totals.selectExpr("_tokens", "ln(_tokens / _all) AS _log", grid).selectExpr("*", "exp(_x * _log) AS _p")
    sums = powers.groupBy("_x").agg(
        F.expr("sum(_p) AS z"), F.expr("sum(_p * _log) AS pl"), F.expr("max(_p / _tokens) AS most"), F.expr("min(_p / _tokens) AS least")
    )
    out = []
    for r in sums.orderBy("_x").collect():  # one row per exponent
        drawn = budget if budget is not None else r["z"] / r["least"]
        out.append((r["_x"], log(r["z"]) - r["_x"] * r["pl"] / r["z"], drawn * r["most"] / r["z"]))
    return out


def exponent(totals: DataFrame, budget: float | None, max_repetition: float | None, target_entropy: float | None) -> float:
    """The exponent between 0 (all sources alike) and 1 (as they come) that meets the target; 1 if none does."""
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        step = (high - low) / SECTIONS
        grid = _measured(totals, [low + step * i for i in range(SECTIONS + 1)], budget)
        if not grid:
            return 1.0
        if target_entropy is not None:  # entropy falls as the exponent grows: the last that still meets it
            met = [x for x, entropy, _ in grid if entropy >= target_entropy]
            if not met:
                return 0.0
            low, high = met[-1], min(1.0, met[-1] + step)
        else:  # repetition falls as the exponent grows: the first that meets the limit
            met = [x for x, _, most in grid if most <= max_repetition + 1e-12]
            if not met:
                return 1.0
            low, high = max(0.0, met[0] - step), met[0]
        if low == high:
            break
    return low if target_entropy is not None else high


def source_plan(totals: DataFrame, x: float, budget: float | None) -> DataFrame:
    """Per source: weight, tokens to draw, whole passes, rest and number of blocks."""
    powers = totals.selectExpr("*", f"exp({x!r}D * ln(_tokens / _all)) AS _p")
    sums = powers.agg(F.expr("sum(_p) AS _z"), F.expr("min(_p / _tokens) AS _least"))
    drawn = f"{float(budget)!r}D" if budget is not None else "(_z / _least)"
    plan = powers.join(F.broadcast(sums)).selectExpr("_source", "_tokens", "_p / _z AS weight", f"CAST(round({drawn} * _p / _z) AS BIGINT) AS _budget")
    return plan.selectExpr(
        "_source", "weight", "_budget DIV _tokens AS _passes", "_budget % _tokens AS _rest", f"1 + _tokens DIV {BLOCK_TOKENS} AS _blocks"
    )


def mixed(rows: DataFrame, counted: DataFrame, budget: float | None = None, max_repetition: float | None = MAX_REPETITION, target_entropy: float | None = None) -> DataFrame:
    """Adds weight, block and copies (how often the row is drawn) to `rows`; `counted` has the same `_source`, `_draw`
    and n_tokens, and may be a narrow table written before."""
    per_source = counted.filter("n_tokens > 0").groupBy("_source").agg(F.sum("n_tokens").alias("_tokens"))
    per_source = stage_table(per_source, "mix-totals")
    totals = stage_table(per_source.join(F.broadcast(per_source.agg(F.sum("_tokens").alias("_all")))), "mix-totals")
    plan = stage_table(source_plan(totals, exponent(totals, budget, max_repetition, target_entropy), budget), "mix-plan")

    def blocked(table: DataFrame) -> DataFrame:
        return table.join(plan, "_source", "left").selectExpr("*", "coalesce(pmod(_draw, _blocks), 0L) AS block")

    blocks = blocked(counted.filter("n_tokens > 0")).groupBy("_source", "block").agg(F.sum("n_tokens").alias("_size"), F.max("_passes").alias("_turn"), F.max("_rest").alias("_limit"))
    order = f"PARTITION BY _source ORDER BY xxhash64({SEED}, _turn, block), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    placed = blocks.selectExpr("*", f"coalesce(sum(_size) OVER ({order}), 0L) AS _before")
    state = "CASE WHEN _before + _size <= _limit THEN 1 WHEN _before < _limit THEN 2 ELSE 0 END AS _state"
    states = stage_table(placed.selectExpr("_source", "block", "_before", state), "mix-blocks")

    at = blocked(rows).join(states, ["_source", "block"], "left")
    out = ["row", "_source", "n_tokens", "weight", "block"]
    whole = at.filter("coalesce(_state, 0) <> 2").selectExpr(*out, "CASE WHEN n_tokens = 0 THEN 1L ELSE _passes + coalesce(_state, 0) END AS copies")
    drawn = f"PARTITION BY _source, block ORDER BY xxhash64({SEED}, _passes, _draw), _draw ROWS UNBOUNDED PRECEDING"
    ended = at.filter("_state = 2").selectExpr("*", f"_before + sum(n_tokens) OVER ({drawn}) AS _reach")
    return whole.unionByName(ended.selectExpr(*out, "_passes + CASE WHEN n_tokens = 0 THEN 1L - _passes WHEN _reach <= _rest THEN 1L ELSE 0L END AS copies"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", budget: float | None = None, max_repetition: float | None = MAX_REPETITION, target_entropy: float | None = None) -> DataFrame:
    """One row per document: doc_id, source, n_tokens, weight of its source (null without tokens), block and copies."""
    rows = stage_table(tokens_of(docs, list(dict.fromkeys([doc_id, source])), text, source), "mix-rows")
    out = mixed(rows, rows, budget, max_repetition, target_entropy)
    return out.select(F.col("row").getField(doc_id).alias("doc_id"), F.col("row").getField(source).alias("source"), "n_tokens", "weight", "block", "copies")


def draw(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", budget: float | None = None, max_repetition: float | None = MAX_REPETITION, target_entropy: float | None = None) -> DataFrame:
    """The rows of `docs`, each as often as it is drawn. Tokens are counted twice, so that texts need no shuffle where
    the block table is small."""
    counted = stage_table(tokens_of(docs, [doc_id], text, source).drop("row"), "mix-rows")
    rows = tokens_of(docs, [doc_id, *[c for c in docs.columns if c != doc_id]], text, source)
    drawn = mixed(rows, counted, budget, max_repetition, target_entropy).filter("copies > 0")
    return drawn.selectExpr("row", "explode(sequence(1L, copies)) AS _copy").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
