"""The shape of the plans: what is shuffled, pushed down and aggregated early."""

import re

from leadloom.operators.pages import page_lookup, page_signals
from leadloom.operators.stages import new_path
from workload import queries as Q
from workload.views import view


def plan(df) -> str:
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def stage_path(spark, df) -> str:
    path = new_path(spark, "pages")
    df.write.parquet(path)
    return path


def test_html_is_never_shuffled(spark, sf):
    pages = view(spark, sf, "site_pages")
    stored = spark.read.parquet(stage_path(spark, pages))
    signals = page_signals(stored)
    assert "Exchange" not in plan(signals)
    text = plan(page_lookup(signals))
    shuffled = [line for line in text.splitlines() if "Exchange" in line]
    assert shuffled and not any("html#" in line for line in shuffled)


def test_dedup_aggregates_before_the_shuffle(spark, sf):
    text = plan(Q.QUERIES["dedup_leads"](spark, sf))
    assert re.search(r"Exchange hashpartitioning\(_groupingexpression", text) and "partial_min_by" in text


def test_no_query_is_a_cartesian_product(spark, sf):
    for name in ("dedup_leads", "place_match_lev", "website_discovery", "batch_progress", "lead_upsert", "signal_splits"):
        assert "CartesianProduct" not in plan(Q.QUERIES[name](spark, sf)), name


def test_only_needed_columns_are_read(spark, sf):
    text = plan(Q.QUERIES["batch_progress"](spark, sf))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "l_partkey" not in schema and "l_tax" not in schema


def test_status_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "runs")
    spark.createDataFrame([("a", "completed"), ("b", "failed")], "job_id string, status string").write.parquet(path)
    from leadloom.operators.runs import filter_runs

    assert "EqualTo(status,completed)" in plan(filter_runs(spark.read.parquet(path), "completed"))
