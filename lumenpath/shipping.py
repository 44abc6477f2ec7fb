"""Sends this package to the executors, for the operators that run Python there."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once in an application; the driver's file server serves the archive."""
    context = spark.sparkContext
    root = Path(__file__).resolve().parent
    if context.applicationId in _shipped or not root.is_dir():  # no folder: this is a shipped archive
        return
    archive = Path(tempfile.mkdtemp(prefix="lumenpath")) / "lumenpath.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, f"lumenpath/{path.relative_to(root)}")
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
