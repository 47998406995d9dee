"""Sends this package to executors, for the operators whose tasks run some of its Python."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package, as a zip, to the session's Python files, once: executors need not have it installed."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        top = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="skein-py-")) / "skein.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for file in sorted(top.rglob("*.py")):
                z.write(file, file.relative_to(top.parent))
        spark.sparkContext.addPyFile(str(archive))
        _shipped.add(app)
