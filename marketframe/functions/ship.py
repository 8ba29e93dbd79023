"""Sending this package to executors that do not have it installed."""

from __future__ import annotations

import io
import os
import zipfile

from pyspark.sql import SparkSession

from .storage import new_folder

_SENT: set[str] = set()


def archive() -> bytes:
    """The package's modules as a zip file."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, files in os.walk(root):
            for file in sorted(f for f in files if f.endswith(".py")):
                path = os.path.join(folder, file)
                out.write(path, os.path.relpath(path, os.path.dirname(root)))
    return held.getvalue()


def ship(spark: SparkSession) -> None:
    """Add the package to the Python path of all tasks, once per application.

    The archive lies in the shared folder, so executors need neither an installed
    package nor the driver's working directory.
    """
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    path = f"{new_folder(spark, 'package')}/marketframe.zip"
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(context._jsc.hadoopConfiguration()).create(where)
    out.write(archive())
    out.close()
    context.addPyFile(path)
    _SENT.add(context.applicationId)
