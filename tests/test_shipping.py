import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent
RUN = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("rows", entry.queries()["place_match_ratio"](spark, {sf!r}).count())
"""


def test_queries_with_python_workers_run_from_another_folder(sf, tmp_path):
    kept = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and Path(p).resolve() != REPO]
    done = subprocess.run(
        [sys.executable, "-c", RUN.format(repo=str(REPO), sf=sf)], cwd=tmp_path, env=os.environ | {"PYTHONPATH": os.pathsep.join(kept)}, capture_output=True, text=True, timeout=300, check=False
    )
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.split("rows")[-1]) > 0
