"""Puts this package on the Python path of the executors, so that its functions run wherever the cluster starts workers."""

from __future__ import annotations

import atexit
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip file to the Spark context, once for each context."""
    context = spark.sparkContext
    if getattr(context, "_loomlog_shipped", False):
        return
    root = Path(__file__).resolve().parent
    handle, name = tempfile.mkstemp(prefix="loomlog-", suffix=".zip")
    with os.fdopen(handle, "wb") as f, zipfile.ZipFile(f, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    atexit.register(lambda: os.path.exists(name) and os.unlink(name))  # served to the executors by the driver until then
    context.addPyFile(name)
    context._loomlog_shipped = True
