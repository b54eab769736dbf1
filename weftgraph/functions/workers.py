"""Getting this package to the Python workers of an application, wherever they run and whatever their PYTHONPATH."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Has Spark send the package to all workers, once for each application. The archive on the driver is only its source."""
    context = spark.sparkContext
    if getattr(context, "_weftgraph_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(root):
        path = os.path.join(tempfile.mkdtemp(prefix="weft-"), "weftgraph.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        whole = os.path.join(folder, name)
                        archive.write(whole, os.path.relpath(whole, os.path.dirname(root)))
        context.addPyFile(path)
    context._weftgraph_shipped = True
