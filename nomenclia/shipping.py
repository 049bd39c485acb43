"""Hands this package's code to the executors, wherever the session was started."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once an application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    home = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="nomenclia-code-")) / "nomenclia.zip"
    with zipfile.ZipFile(target, "w") as z:
        for file in sorted(home.rglob("*.py")):
            z.write(file, f"nomenclia/{file.relative_to(home)}")
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)
