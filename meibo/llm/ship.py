"""Bring this package to the executors, and texts to it in parts that fit a worker's memory."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Rows that a Python worker gets at once; a text may be long, and results add to it.
BATCH_ROWS = 1000

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package once for each application, so that tasks can import it wherever they run."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}", "zip", package.parent, package.name)
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
