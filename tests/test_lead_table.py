"""The table of leads: keyed merge, which files it reads and rewrites, lookups by run."""

import contextlib
import io
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from leadloom.operators import runs
from leadloom.operators.lead_table import LeadTable

SCHEMA = "job_id string, row_index bigint, lead_score int"


def rows(spark, *data):
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture
def table(spark, tmp_path):
    return LeadTable(spark, str(tmp_path / "leads"), rows(spark).schema, buckets=4)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def files(table):
    return {str(p) for p in Path(table.path).rglob("*.parquet")}


def scans(df):
    """Partition filters of the scans."""
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return re.findall(r"PartitionFilters: \[(.*)\]", text.getvalue())


def test_merge_replaces_rows_of_the_same_key(spark, table):
    table.merge(rows(spark, ("a", 1, 10), ("a", 2, 20), ("b", 1, 30)))
    table.merge(rows(spark, ("a", 2, 21), ("c", 1, 40)))
    table.merge(rows(spark, ("a", 2, 21), ("c", 1, 40)))  # a second time changes nothing
    assert found(table.read()) == [("a", 1, 10), ("a", 2, 21), ("b", 1, 30), ("c", 1, 40)]
    assert table.read().columns == ["job_id", "row_index", "lead_score"]


def test_merge_equals_a_dictionary(spark, table):
    want = {}
    for step in range(3):
        data = [(f"j{i % 5}", i % 40, 100 * step + i) for i in range(step * 7, step * 7 + 60)]
        table.merge(rows(spark, *data), newest=["lead_score"])
        for job, index, score in data:  # scores grow within a step, so the last is the greatest
            want[job, index] = score
    assert found(table.read()) == sorted((j, i, s) for (j, i), s in want.items())


def test_only_touched_buckets_are_rewritten(spark, table):
    table.merge(rows(spark, *[(j, i, i) for j in "ab" for i in range(40)]))
    before = files(table)
    table.merge(rows(spark, ("a", 7, 99)))
    after = files(table)
    gone = {str(Path(p).parent) for p in before - after}
    assert len(gone) == 1 and "job_id=a/bucket4=" in gone.pop()
    assert table.read().count() == 80 and found(table.of_run("a", 7)) == [("a", 7, 99)]


def test_partitions_of_other_rows_are_not_read(spark, table):
    table.merge(rows(spark, *[(j, i, i) for j in "abcdef" for i in range(40)]))
    keyed = table._keyed(rows(spark, ("a", 7, 99)), [])
    held = table.touched_rows(keyed)
    assert any("dynamicpruning" in s and "job_id" in s and "bucket4" in s for s in scans(held))
    assert {r["job_id"] for r in held.collect()} == {"a"} and 0 < held.count() < 40


def test_keys_within_a_merge(spark, table):
    table.merge(rows(spark, ("a", 1, 5), ("a", 1, None), ("a", 1, 9)), newest=["lead_score"])
    assert found(table.read()) == [("a", 1, 9)]
    data = rows(spark, ("t", 1, 1), ("t", 1, 2), ("t", 1, 3))
    table.merge(data)
    first = found(table.of_run("t"))
    table.merge(data.orderBy(F.desc("lead_score")))  # ties do not depend on order
    assert found(table.of_run("t")) == first and len(first) == 1


def test_rows_without_index_stay_beside_each_other(spark, table):
    loose = rows(spark, ("a", None, 1), ("a", None, 1), ("a", None, 2))
    table.merge(loose)
    table.merge(rows(spark, ("a", None, 3), *[("a", i, 0) for i in range(20)]))
    table.merge(loose)
    assert sorted(r["lead_score"] for r in table.read().where("row_index IS NULL").collect()) == [1, 1, 1, 1, 2, 2, 3]
    assert table.read().count() == 27


def test_empty_tables_and_ids_that_look_like_numbers(spark, table):
    assert found(table.read()) == [] and found(table.of_run("a")) == []
    table.merge(rows(spark))
    assert found(table.read()) == []
    table.merge(rows(spark, ("007", 1, 1), ("7", 1, 2), ("a/b=c %", 1, 3)).withColumn("extra", F.lit(1)))
    assert found(table.of_run("007")) == [("007", 1, 1)] and found(table.of_run("a/b=c %")) == [("a/b=c %", 1, 3)]


@pytest.mark.parametrize("job", [None, ""])
def test_a_row_without_run_is_refused(spark, table, job):
    with pytest.raises(Exception, match="no job_id"):
        table.merge(rows(spark, (job, 1, 1)))
    assert found(table.read()) == []


def test_another_number_of_buckets_is_an_error(spark, table):
    table.merge(rows(spark, ("a", 1, 1)))
    other = LeadTable(spark, table.path, rows(spark).schema, buckets=8)
    with pytest.raises(Exception):
        other.merge(rows(spark, ("a", 1, 2)))
    assert found(table.read()) == [("a", 1, 1)]


def test_a_cut_off_copy_is_finished_from_the_stage(spark, table, monkeypatch):
    table.merge(rows(spark, ("a", 1, 1), ("a", 2, 2)))

    def broken(self, merged):
        raise RuntimeError("lost")

    with monkeypatch.context() as m, pytest.raises(RuntimeError) as caught:
        m.setattr(LeadTable, "replace", broken)
        table.merge(rows(spark, ("a", 2, 3)))
    table.replace(re.search(r"replace\('(.*)'\)", caught.value.__notes__[0]).group(1))
    assert found(table.read()) == [("a", 1, 1), ("a", 2, 3)]


def test_a_lookup_reads_one_run(spark, table):
    table.merge(rows(spark, *[(j, i, i) for j in "abc" for i in range(20)]))
    run, one = table.of_run("b"), table.of_run("b", 3)
    assert run.count() == 20 and found(one) == [("b", 3, 3)]
    assert any("job_id" in s and " = b" in s for s in scans(run))
    assert any("bucket4" in s for s in scans(one))
    assert len(one.inputFiles()) == len(files(table)) and len({r[0] for r in one.select(F.input_file_name()).collect()}) == 1


def test_newest_runs_prune_the_scan(spark, table):
    table.merge(rows(spark, *[(j, i, i) for j in "abcd" for i in range(10)]))
    listed = spark.createDataFrame(
        [("a", "completed", 4), ("b", "failed", 3), ("c", "completed", 2), ("d", "completed", 1)], "job_id string, status string, created_at int"
    )
    newest = table.of_runs(runs.newest_completed(listed, 2))
    assert {r["job_id"] for r in newest.collect()} == {"a", "c"} and newest.count() == 20
    assert any("dynamicpruning" in s for s in scans(newest))
