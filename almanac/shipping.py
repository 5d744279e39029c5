"""This package on the executors, wherever their Python workers start."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package once; Spark's file server hands it out, so the driver's folder is enough."""
    sc = spark.sparkContext
    if sc.applicationId in _SENT:
        return
    package = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="almanac-")) / f"{package.name}-engine.zip"
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    sc.addPyFile(str(path))
    _SENT.add(sc.applicationId)
