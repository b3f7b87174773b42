"""Sends the package to executors, which need it to run its Python functions."""
from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    sc = spark.sparkContext
    if not getattr(sc, "_framelark_shipped", False):
        root, folder = Path(__file__).resolve().parents[1], tempfile.mkdtemp(prefix="framelark")
        atexit.register(shutil.rmtree, folder, True)
        path = os.path.join(folder, "framelark_package.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted((root / "framelark").rglob("*.py")):
                z.write(p, p.relative_to(root))
        sc.addPyFile(path)
        sc._framelark_shipped = True
    return spark
