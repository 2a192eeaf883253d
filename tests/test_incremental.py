import pytest
from pyspark.errors import StreamingQueryException

from leadloom.operators import pages, stages
from leadloom.plans import lead_run
from leadloom.streaming import incremental
from leadloom.streaming.incremental import FAILED, IncrementalLeads
from workload import queries as Q

MODES = ("state", "tables")


@pytest.fixture()
def parts(spark, sf):
    return Q.raw_parts(spark, sf)


def land(part, folder):
    part.write.mode("append").parquet(folder)
    return folder


def rows(df):
    return sorted(map(str, df.select("row_id", "company_name", "website", "email", "lead_score", "lead_reason").collect()))


def identities(flow):
    return [(r["identity"]["kind"], r["identity"]["value"]) for r in flow._finished("clean").select("identity").collect()]


@pytest.mark.parametrize("known", MODES)
def test_incremental_equals_batch(spark, sf, tmp_path, parts, known):
    flow = Q.arriving(IncrementalLeads(spark, str(tmp_path / "out"), Q.OFFLINE, known=known), parts)
    assert rows(flow.stored()) == rows(Q.offline_leads(spark, sf))
    assert {r["state"] for r in flow.batches().collect()} == {"done"} and flow.batches().count() == 3
    assert flow.rejects().count() == Q.QUERIES["rejected_rows"](spark, sf).count()


def failing(broken):
    """A flow whose batches in `broken` fail after part of them was written."""

    class Failing(IncrementalLeads):
        def _finish(self, clean, batch_id):
            super()._finish(clean, batch_id)
            if batch_id in broken:
                raise RuntimeError("lost")

    return Failing


@pytest.mark.parametrize("known", MODES)
def test_failed_batch_is_resumed_without_repeating_finished_ones(spark, sf, tmp_path, parts, known):
    out, landing = str(tmp_path / "out"), str(tmp_path / "landing")
    first = IncrementalLeads(spark, out, Q.OFFLINE, known=known)
    first.process(land(parts[0], landing), parts[0].schema, 1000)
    land(parts[1], landing)
    with pytest.raises(StreamingQueryException, match="lost"):
        failing({1})(spark, out, Q.OFFLINE, known=known).process(landing, parts[0].schema, 1000)
    assert {r["batch_id"]: r["state"] for r in first.batches().collect()} == {0: "done", 1: FAILED}
    first.process(landing, parts[0].schema, 1000)
    first.process(land(parts[2], landing), parts[0].schema, 1000)
    first.process(landing, parts[0].schema, 1000)  # nothing new
    assert first.batches().count() == 3 and rows(first.stored()) == rows(Q.offline_leads(spark, sf))


@pytest.mark.parametrize("known", MODES)
def test_going_on_after_an_error_reports_it(spark, sf, tmp_path, parts, known):
    broken = {1}
    flow = failing(broken)(spark, str(tmp_path / "out"), Q.OFFLINE, stop_on_error=False, known=known)
    for part in parts:
        flow.process(land(part, str(tmp_path / "landing")), part.schema, 1000)
    bad = [r for r in flow.batches().collect() if r["state"] == FAILED]
    assert [r["batch_id"] for r in bad] == [1] and "lost" in bad[0]["error"]
    assert {r["batch_id"] for r in flow.stored().select("batch_id").distinct().collect()} == {0, 2}
    # what the failed batch left behind is ignored, and a retry completes the table without duplicates
    broken.clear()
    flow.retry_failed()
    assert {r["state"] for r in flow.batches().collect()} == {"done"}
    found = identities(flow)
    assert len(found) == len(set(found)) == flow.stored().count() == Q.offline_leads(spark, sf).count()
    if known == "state":
        assert rows(flow.stored()) == rows(Q.offline_leads(spark, sf))


def test_replayed_files_meet_their_identities_in_the_state(spark, sf, tmp_path, parts):
    """A batch that passed the state and is then run again, with its files rewritten, adds nothing and loses nothing."""
    flow = IncrementalLeads(spark, str(tmp_path / "out"), Q.OFFLINE)
    flow.process(land(parts[0], str(tmp_path / "landing")), parts[0].schema, 1000)
    before = rows(flow.stored())
    flow._batch(flow._tagged(parts[0], 0, "parquet"), 0)
    assert rows(flow.stored()) == before


def test_state_keeps_earlier_batches_out_of_the_plan(spark, sf, tmp_path, parts, monkeypatch):
    """No stored identity is read while batches are processed; leads to be finished come from their own partition."""
    read, scans = [], []
    finish = IncrementalLeads._finish

    def watched(self, clean, batch_id):
        scans.append((batch_id, clean._jdf.queryExecution().toString().split("== Physical Plan ==")[1]))
        finish(self, clean, batch_id)

    monkeypatch.setattr(IncrementalLeads, "_finish", watched)
    monkeypatch.setattr(IncrementalLeads, "_finished", lambda self, name, schema=None: read.append(name))
    Q.arriving(IncrementalLeads(spark, str(tmp_path / "out"), Q.OFFLINE), parts)
    assert read == [] and [k for k, _ in scans] == [0, 1, 2]
    assert all(f"(batch_id#" in p and f"= {k})]" in p and "PartitionFilters: [isnotnull(batch_id" in p for k, p in scans)
    state = list((tmp_path / "out" / "identities" / "state" / "0").glob("*/*.changelog")) + list((tmp_path / "out" / "identities" / "state" / "0").glob("*/*.zip"))
    assert state, "the identities are not in a RocksDB state store"


def test_lookups_are_built_once(spark, sf, tmp_path, monkeypatch):
    built = []
    monkeypatch.setattr(incremental, "page_lookups", lambda s, o: built.append(1) or lead_run.page_lookups(s, o))
    parts = Q.parts_by_identity(spark, sf)
    landing = str(tmp_path / "landing")
    for k, part in enumerate(parts):
        part.drop("row_id").coalesce(1).write.mode("append").json(landing)
    flow = IncrementalLeads(spark, str(tmp_path / "out"), Q.FULL, Q.snapshots(spark, sf))
    flow.process(landing, files_per_batch=1, fmt="jsonl")
    assert built == [1] and flow.batches().count() == len(parts)
    full = Q.full_run(spark, sf).leads
    assert sorted(map(str, flow.stored().select(*Q.FULL_COLUMNS).collect())) == sorted(map(str, full.select(*Q.FULL_COLUMNS).collect()))
    ids = [r["row_id"] for r in flow.stored().select("row_id").collect()]
    assert len(set(ids)) == len(ids) and {i >> 44 for i in ids} <= {0, 1, 2}


def test_json_and_listing_files_as_they_arrive(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"leads": [{"company": "Ann Ltd"}, {"company": ""}, 7]}')
    (tmp_path / "b.json").write_text('{"none": 1}')
    flow = IncrementalLeads(spark, str(tmp_path / "out"), Q.OFFLINE)
    flow.process(str(tmp_path / "*.json"), fmt="json")
    assert [r["company_name"] for r in flow.stored().collect()] == ["Ann Ltd"]
    assert sorted(r["reason"] for r in flow.rejects().collect()) == ["invalid_json_root", "invalid_record_type", "missing_required_identity"]
    with pytest.raises(ValueError):
        flow.process(str(tmp_path), fmt="xml")
    with pytest.raises(ValueError):
        IncrementalLeads(spark, "x", known="nowhere")


def test_batches_without_a_lead(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"company": ""}\n\nnot json\n')
    for known in MODES:
        flow = IncrementalLeads(spark, stages.new_path(spark, "none"), Q.OFFLINE, known=known)
        flow.process(str(tmp_path / "*.jsonl"), fmt="jsonl")
        assert flow.rejects().count() == 2 and flow.batches().count() == 1


def test_row_ids_too_large_are_refused(spark):
    ask = incremental.batch_row_id(3)
    assert spark.sql(f"SELECT {ask} AS i FROM (SELECT (1L << 33) + 5L AS row_id)").first()["i"] == (3 << 44) + (1 << 28) + 5
    with pytest.raises(Exception, match="too large"):
        spark.sql(f"SELECT {ask} AS i FROM (SELECT (1L << 49) AS row_id)").first()


def test_lookups_serve_every_call_of_a_flow(spark, sf, monkeypatch):
    built = []
    monkeypatch.setattr(incremental, "page_lookups", lambda s, o: built.append(1) or lead_run.page_lookups(s, o))
    flow = IncrementalLeads(spark, stages.new_path(spark, "calls"), Q.FULL, Q.snapshots(spark, sf))
    Q.arriving(flow, Q.parts_by_identity(spark, sf), "jsonl")
    assert built == [1] and flow.batches().count() == 3


@pytest.mark.parametrize("fmt", ["jsonl", "csv"])
def test_text_is_mapped_once_a_batch(spark, tmp_path, monkeypatch, fmt):
    """Rejects and leads are read from mapped rows, never from the text."""
    plans = []
    write = IncrementalLeads._write

    def watched(self, df, name, batch_id):
        plans.append((name, df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]))
        write(self, df, name, batch_id)

    monkeypatch.setattr(IncrementalLeads, "_write", watched)
    (tmp_path / "a").write_text('{"company": "Ann Ltd"}\n{"company": ""}\n' if fmt == "jsonl" else "company\nAnn Ltd\n \n\"\"\n")
    flow = IncrementalLeads(spark, stages.new_path(spark, "mapped"), Q.OFFLINE)
    flow.process(str(tmp_path / "*"), fmt=fmt)
    assert {n for n, _ in plans} == {"rejects", "candidates", "leads", "batches"}
    assert not any(word in plan for _, plan in plans for word in ("parse_json", "from_csv", "FileScan text", "Scan text"))
    assert [r["company_name"] for r in flow.stored().collect()] == ["Ann Ltd"] and flow.rejects().count() == 1


def test_one_link_gives_the_same_sites(spark, sf):
    found = Q.snapshots(spark, sf).search_results
    wanted, got = (sorted(map(tuple, pages.discovered_sites(t).collect())) for t in (found, pages.one_link(found)))
    assert got == wanted and wanted and pages.one_link(found).count() == len(wanted)
