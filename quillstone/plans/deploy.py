"""Sending the package to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once for a context: workers may run where the package is not on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_quillstone_shipped", None) is None:
        root = Path(__file__).resolve().parents[1]
        path = Path(tempfile.mkdtemp(prefix="quillstone-")) / "quillstone-package.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(path))
        sc._quillstone_shipped = True
