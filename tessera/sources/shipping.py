"""Getting this package to Python workers that would not find it."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Send the package to all executors, once per context, unless their PYTHONPATH has it or it is an archive already.

    The driver serves the archive; executors share no folder with it for this.
    """
    context, package = spark.sparkContext, Path(__file__).resolve().parents[1]
    if getattr(context, "_tessera_shipped", False):
        return
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if package.is_dir() and str(package.parent) not in known:
        context.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), package.name), "zip", package.parent, package.name))
    context._tessera_shipped = True
