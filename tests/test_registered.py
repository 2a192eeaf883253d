import pytest

import __spark_entry__ as entry
from workload.check import compare, duck
from workload.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, con, sf, name):
    result = compare(spark, con, sf, name)
    assert result["ok"] is not False, result.get("diff")


def test_only_the_gestalt_match_has_no_sql():
    assert QUERIES.keys() - entry.oracle_sql().keys() == {"place_match_ratio"}


def test_entry(spark):
    assert entry.entry(spark).first()["lead_score"] > 0
