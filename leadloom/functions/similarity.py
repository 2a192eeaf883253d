"""Similarity of two names in 0..1."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from leadloom.functions.text import strip


def gestalt_ratio(a: Column, b: Column) -> Column:
    """Ratcliff/Obershelp ratio; null where a side is null."""

    # local, so that it travels to the workers by value and needs no package there
    @pandas_udf(DoubleType())
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        pairs = zip(x, y)
        return pd.Series(
            [None if p is None or q is None else SequenceMatcher(None, p, q).ratio() for p, q in pairs],
            dtype="float64",
        )

    return ratio(a, b)


def name_similarity(a: str, b: str, threshold: float, method: str = "gestalt") -> Column:
    """Similarity of lower-cased names; 0 where a side is blank or the lengths alone rule out `threshold`.

    Neither measure can exceed 2*min/(sum) of the lengths, so only open pairs reach the Arrow function.
    """
    x, y = (f"lower({strip(f'coalesce({v}, {empty})')})" for v, empty in ((a, "''"), (b, "''")))
    shorter, total = f"least(length({x}), length({y}))", f"(length({x}) + length({y}))"
    hopeless = f"({x} = '' OR {y} = '' OR 2.0D * {shorter} < {float(threshold)}D * {total})"
    if method == "levenshtein":
        return F.expr(f"if({hopeless}, 0.0D, 1.0D - levenshtein({x}, {y}) / greatest(length({x}), length({y})))")
    if method != "gestalt":
        raise ValueError(f"unknown similarity: {method}")
    undecided = f"NOT {hopeless} AND {x} <> {y}"
    ratio = gestalt_ratio(F.expr(f"if({undecided}, {x}, NULL)"), F.expr(f"if({undecided}, {y}, NULL)"))
    return F.coalesce(ratio, F.expr(f"if({hopeless}, 0.0D, 1.0D)"))
