"""Sends the package to the executors, so that its Python functions run where it isn't installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the packages beside this one to the session, once per application. Spark hands them to every executor."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    root = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="alertfold-")) / "alertfold.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for top in ("alertfold", "alertfold_checks"):
            for source in sorted((root / top).rglob("*.py")):
                out.write(source, source.relative_to(root))
    context.addPyFile(str(archive))
    _SENT.add(context.applicationId)
