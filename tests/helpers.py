"""Small frames for tests."""

from __future__ import annotations

from leadloom.constants import CANONICAL_FIELDS

PAGE_SCHEMA = "url string, status_code int, elapsed_ms bigint, html string"


def leads(spark, *rows: dict):
    """Normalised leads from dicts; row_id is the position unless given."""
    from leadloom.operators.normalize import typed_leads

    columns = ["row_id", *CANONICAL_FIELDS]
    data = [tuple({"row_id": i, "source": "input", **r}.get(c) for c in columns) for i, r in enumerate(rows)]
    schema = ", ".join(["row_id bigint", *[f"{c} string" for c in CANONICAL_FIELDS]])
    return typed_leads(spark.createDataFrame(data, schema))


def one(spark, expr: str, **values):
    """Value of a SQL expression over one row of text columns."""
    schema = ", ".join(f"{k} string" for k in values) or "x string"
    row = tuple(values.values()) or ("",)
    return spark.createDataFrame([row], schema).selectExpr(f"{expr} AS out").first()["out"]
