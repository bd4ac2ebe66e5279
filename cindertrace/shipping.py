"""Sends this package to the executors, for functions that run in Python there."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Once for each context."""
    context = spark.sparkContext
    if not getattr(context, "ships_cindertrace", False):
        root = Path(__file__).resolve().parents[1]
        path = Path(tempfile.mkdtemp(prefix="cindertrace-")) / "cindertrace.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted((root / "cindertrace").rglob("*.py")):
                z.write(f, f.relative_to(root))
        context.addPyFile(str(path))
        context.ships_cindertrace = True
    return spark
