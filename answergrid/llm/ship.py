"""Sends this package to the executors, so that it need not be installed there."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from answergrid.sources.shared import new_path

PACKAGE = Path(__file__).resolve().parents[1]
_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for file in sorted(PACKAGE.rglob("*.py")):
            archive.write(file, str(file.relative_to(PACKAGE.parent)))
    path = context._jvm.org.apache.hadoop.fs.Path(f"{new_path(spark, 'package')}/{PACKAGE.name}.zip")
    system = path.getFileSystem(context._jsc.hadoopConfiguration())
    out = system.create(path)
    out.write(packed.getvalue())
    out.close()
    context.addPyFile(system.makeQualified(path).toString())
    _SENT.add(context.applicationId)
