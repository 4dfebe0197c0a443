"""Makes this package importable on executors, as Python functions in plans need it there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Gives executors this package, once for each application."""
    context = spark.sparkContext
    if getattr(context, "_quirework_shipped", False):
        return
    top = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="quirework-")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/quirework.zip", "w") as archive:
        for path in top.rglob("*.py"):
            archive.write(path, path.relative_to(top.parent))
    context.addPyFile(f"{folder}/quirework.zip")
    context._quirework_shipped = True
