"""Puts this package on the Python path of every executor, however the driver found it."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application: the package's sources as a zip through Spark's own file service."""
    context = spark.sparkContext
    if context.applicationId in _done:
        return
    top = Path(__file__).resolve().parents[2]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in [*sorted((top / "veritill").rglob("*.py")), *top.glob("corpus_pipeline.py")]:
            z.write(p, p.relative_to(top))
    at = Path(tempfile.mkdtemp(prefix="veritill-py-")) / "veritill-sources.zip"
    at.write_bytes(data.getvalue())
    context.addPyFile(str(at))
    _done.add(context.applicationId)
