"""Hand the package to the executors, so that functions defined in it can run there."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Add the package to the context's Python files, once for each context."""
    context = spark.sparkContext
    if getattr(context, "_quernstone_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="quernstone-")) / f"{PACKAGE.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(PACKAGE.rglob("*.py")):
            archive.write(source, source.relative_to(PACKAGE.parent))
    context.addPyFile(str(target))
    context._quernstone_shipped = True
