from __future__ import annotations

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use inside or return.
CLASHING = "n_words long, _key string, kept string, distance string, _text string, copies string, fingerprint string, _row string"


def prose(seed: int, n: int) -> str:
    """n distinct-looking words; the same for the same seed."""
    return " ".join(f"w{(seed * 7919 + i * i * 31 + i) % 99991}" for i in range(n))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, copies, and extra columns with clashing names."""
    shared = prose(5, 60)
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \t\n\x0b\f\r ", None, None, 7), (None, prose(1, 40), None, "a", 1),
        (4, prose(2, 50), "en", "a", 1), (4, prose(2, 50), "en", "a", 1), (5, prose(2, 50).upper(), "en", None, 1),
        (6, f"{prose(3, 10)} {shared} {prose(4, 5)}", "en", "b", 1), (7, f"{prose(8, 3)}\n{shared}\n{prose(9, 30)}", "de", "b", 1),
        (8, prose(11, 30_000), "de", "b", 1), (9, "one", "en", "b", 1), (10, "a|b # $ <x> &", "en", "a", 1), (11, "same line\n" * 40, "en", "a", 1),
        (12, f"{shared} {shared}", "fr", "b", 1), (13, "ünï çödé 日本語 🙂 <|endoftext|> it's", "fr", "b", 1), (14, prose(12, 36), "fr", "b", 1), (14, prose(13, 36), "fr", "b", 1),
    ]
    plain = spark.createDataFrame(rows, DOCS)
    names = [c.split()[0] for c in CLASHING.split(", ")]
    return plain.selectExpr("*", *[f"'x' AS {c}" for c in names])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
