"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is a grouped minimum (partial sums before the shuffle) and a join, so a node with very many links costs its
tasks one row per link and never a list. Every round is written to the shared stage folder; only two numbers per
round, the count and a checksum of the links, reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.operators.stages import stage_table


def _checksum(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum((F.xxhash64("a", "b") % 1_000_000_007).cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least node of its neighbourhood."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b")).filter("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them. Links are (a, b) with a > b."""
    least = links.groupBy("a").agg(F.min("b").alias("_m"))
    down = links.join(least, "a").filter("b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    return down.unionByName(least.select("a", F.col("_m").alias("b"))).distinct()


def components(links: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has a link; `links` has columns a and b of one orderable type. The
    component is its least node. Links of a node with itself and repeated links do no harm."""
    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    current = stage_table(ordered.distinct(), name)
    mark = _checksum(current)
    for _ in range(max_rounds):
        current = stage_table(_small_star(_large_star(current)), name)
        before, mark = mark, _checksum(current)
        if before == mark:
            least = current.select(F.col("b").alias("node")).distinct()
            return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(least.select("node", F.col("node").alias("component")))
    raise RuntimeError("components did not settle")
