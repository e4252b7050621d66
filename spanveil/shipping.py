"""Makes this package importable on executors, which don't share the driver's folders."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    _sent.add(sc.applicationId)
    here = Path(__file__).parent
    path = os.path.join(tempfile.mkdtemp(prefix="spanveil-"), "spanveil.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f"spanveil/{f.relative_to(here)}")
    sc.addPyFile(path)
