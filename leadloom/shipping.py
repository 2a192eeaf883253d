"""The package on the workers: Python functions of queries are pickled by module name, so executors must be able to import it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hand a zip of the package to Spark, which gives it to every executor. Once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    # read by the driver alone, which serves it to executors
    with tempfile.NamedTemporaryFile(prefix=f"{package.name}-", suffix=".zip", delete=False) as file, zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(package.rglob("*.py")):
            archive.write(path, path.relative_to(package.parent))
    context.addPyFile(file.name)
    _SHIPPED.add(context.applicationId)
