"""Intermediate tables in the folder that every executor can reach.

A few operators need a result to be fixed before it is used twice: a global
order, a model's training rows. They write it as parquet under
``spark.checkpoint.dir``. Unlike cached blocks the files survive the loss of
executors, later reads prune columns, and the size of the files is what the
optimizer looks at when it decides whether a join side may be broadcast.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DIR = "spark.checkpoint.dir"
_LOCAL: dict[str, str] = {}  # application -> own folder, only where all tasks share one machine


def _base(spark: SparkSession) -> str:
    base = spark.conf.get(_DIR, None)
    if base:
        return base
    context = spark.sparkContext
    if context.master.split("[")[0] != "local":
        raise RuntimeError(f"set {_DIR} to a folder that the driver and all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="surcos-")
    return _LOCAL[context.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the session's checkpoint folder."""
    app = spark.sparkContext.applicationId
    return f"{_base(spark).rstrip('/')}/surcos/{app}/{label}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` once, with ``options`` of the writer, and return the written table.

    The files are needed until the results built on them are written;
    :func:`release` removes them then, else the owner of the folder does.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(table: DataFrame) -> None:
    """Delete the files of a table that :func:`materialise` wrote, and only of such."""
    spark = table.sparkSession
    own = f"/surcos/{spark.sparkContext.applicationId}/"
    folders = {f.rpartition("/")[0] for f in table.inputFiles() if own in f}
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
