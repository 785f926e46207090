"""The package for the workers: a zip of its Python files, sent once per Spark context."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make ``barloom`` importable in the Python workers, wherever the driver was started.

    The driver's file server hands the zip to the executors; the file itself is only read by the driver.
    """
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="barloom-code-"), "barloom.zip")
    with zipfile.ZipFile(target, "w") as out:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(target)
    _sent.add(context.applicationId)
