"""Give the executors this package, where it is not installed on them."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import surcos

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the application, once: tasks then import them like any other."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(surcos.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="surcos-"), "surcos_sources.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)
