"""Sends this package to the executors, whose Python workers run its kernels."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package as a zip once a Spark context; every operator with a Python kernel calls this before it plans one.
    The zip lies in a temporary folder of the driver, whose file server hands it out."""
    sc = spark.sparkContext
    if not getattr(sc, "_gritmill_sent", False):
        package = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="gritmill-")) / f"{package.name}.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        sc.addPyFile(str(target))
        sc._gritmill_sent = True
    return spark
