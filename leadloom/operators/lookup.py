"""Left lookups into tables with one row per key.

The lookup side is unique per key, so a lookup never multiplies rows. Whether it is broadcast is
left to Spark, which knows the table's size; beyond the threshold it is a shuffle join.

Two kinds of skew are dealt with here. Rows without a key get a key of their own, because all
null keys of an outer join would otherwise hash to one task. And where one key may be asked for by
a large share of all rows (a company name, a town), `salts` spreads its rows over that many tasks,
at the price of that many copies of the (smaller) lookup table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

HOT_KEY_SALTS = 16


def lookup_left(left: DataFrame, table: DataFrame, on: str, row_id: str = "row_id", salts: int = 1) -> DataFrame:
    own_key = f"coalesce({on}, concat('\u0001', CAST({row_id} AS STRING))) AS _probe"
    answers = table.withColumnRenamed(on, "_probe")
    if salts <= 1:
        return left.selectExpr("*", own_key).join(answers, "_probe", "left").drop("_probe")
    salted = left.selectExpr("*", own_key, f"CAST(pmod(xxhash64({row_id}), {salts}) AS INT) AS _salt")
    copies = answers.selectExpr("*", f"explode(sequence(0, {salts - 1})) AS _salt")
    return salted.join(copies, ["_probe", "_salt"], "left").drop("_probe", "_salt")
