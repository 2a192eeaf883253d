import json

import pytest
from pyspark.sql import functions as F

from leadloom import sinks
from leadloom.constants import CANONICAL_FIELDS
from leadloom.operators import analytics, explore, runs
from leadloom.plans.lead_run import run_leads
from leadloom.sources.files import read_leads
from tests.helpers import leads
from workload import queries as Q


def test_batch_plan_progress_and_resume(spark):
    plan = runs.batch_plan(spark.createDataFrame([("j", 230), ("empty", 0)], "job_id string, total_rows bigint"), 100)
    rows = runs.in_index_order(plan).collect()
    assert [(r["start_row"], r["end_row"]) for r in rows] == [(0, 100), (100, 200), (200, 230)]
    done = plan.withColumn("status", F.expr("CASE batch_index WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE status END"))
    done = done.withColumn("processed_rows", F.expr("if(batch_index = 0, 100, 0)"))
    p = runs.batch_progress(done).first()
    assert (p["rows_total"], p["rows_processed"], p["failed_batches"], p["batches_started"]) == (230, 100, 1, 2)
    assert runs.resume_batches(done).where("status = 'pending'").count() == 2
    with pytest.raises(ValueError):
        runs.batch_plan(plan, 0)


def test_runs_page(spark):
    df = spark.createDataFrame([(f"j{i}", "completed", f"2026-01-0{i}") for i in (1, 2, 3)], "job_id string, status string, created_at string")
    page, total = runs.runs_page(df, limit=2)
    assert [r["job_id"] for r in page.collect()] == ["j3", "j2"] and total.first()["total"] == 3
    page, _ = runs.runs_page(df, limit=0, offset=-5)  # clamped to 1 and 0
    assert [r["job_id"] for r in page.collect()] == ["j3"]


def test_deep_page_by_key_equals_offset(spark, sf):
    scored = Q.offline_leads(spark, sf)
    first = explore.page_of(explore.by_score(scored), 0, 10).collect()
    second = explore.page_of(explore.by_score(scored), 1, 10).collect()
    by_key = explore.page_after(scored, first[-1]["lead_score"], first[-1]["row_id"], 10).collect()
    assert [r["row_id"] for r in by_key] == [r["row_id"] for r in second]


def test_empty_analytics(spark):
    none = leads(spark, {}).where("false")
    assert analytics.kpis(none).first().asDict() == {"leads": 0, "avg_score": 0, "verified_rate": 0}
    assert [r["leads"] for r in analytics.score_histogram(none).collect()] == [0] * 5
    assert analytics.missing_fields(none).count() == 0


def test_missing_fields_order(spark):
    got = analytics.missing_fields(leads(spark, {"email": "a@b.co"}, {"phone": "1"}, {"phone": "2", "website": ""})).collect()
    assert [(r["field"], r["pct"], r["missing"]) for r in got][:2] == [("website", 100, 3), ("agent_name", 100, 3)]
    assert [(r["field"], r["pct"]) for r in got][-2:] == [("email", 67), ("phone", 33)]


def test_unknown_chatbot_matches_neither(spark):
    df = leads(spark, {"company_name": "A"})
    assert explore.filter_leads(df, chatbot="yes").count() == explore.filter_leads(df, chatbot="no").count() == 0


def test_rate_is_recomputed_from_sums(spark):
    df = spark.createDataFrame([("j", 1, 2), ("j", 0, 8)], "job_id string, ok bigint, total bigint")
    assert runs.roll_up(df, ["job_id"], {"rate": ("ok", "total")}).first()["rate"] == 0.1


def test_write_run_round_trip(spark, tmp_path):
    src = tmp_path / "in.csv"
    src.write_text('company,phone,agent\n"Acme, ""A""",0825550100,Ann\n,1,\n')
    run = run_leads(read_leads(spark, str(src), dense_index=True), opts=Q.OFFLINE)
    paths = sinks.write_run(str(tmp_path / "out"), run.leads, run.rejects, run.summary)
    table = spark.read.csv(paths["leads_csv"], header=True, escape='"')
    assert tuple(table.columns) == CANONICAL_FIELDS and table.first()["company_name"] == 'Acme, "A"'
    lead = json.loads(spark.read.text(paths["leads_json"]).first()["value"])
    assert lead["enrichment_history"]["decisions"]["phone"]["chosen_value"] == "0825550100" and lead["website"] is None
    assert spark.read.json(paths["rejected_rows"]).first()["reason"] == "missing_required_identity"
    summary = json.loads(spark.read.text(paths["summary"]).first()["value"])
    assert (summary["input_rows"], summary["rejected_rows"], summary["output"]["summary"]) == (2, 1, paths["summary"])


def test_export_refusals(spark, tmp_path):
    df = leads(spark, {"company_name": "A"})
    with pytest.raises(ValueError, match="not completed"):
        sinks.export(df, str(tmp_path / "x"), "csv", run_status="processing")
    with pytest.raises(ValueError, match="unsupported"):
        sinks.export(df, str(tmp_path / "x"), "xml")


def test_writing_a_batch_again_changes_nothing_else(spark, tmp_path):
    path = str(tmp_path / "leads")
    batch = lambda b, rows: spark.createDataFrame([("j", b, r) for r in rows], "job_id string, batch_id int, row_id int")
    sinks.write_leads_table(batch(0, [1, 2]), path)
    sinks.write_leads_table(batch(1, [3]), path)
    sinks.write_leads_table(batch(0, [1, 2]), path)
    assert sorted(r["row_id"] for r in spark.read.parquet(path).collect()) == [1, 2, 3]
