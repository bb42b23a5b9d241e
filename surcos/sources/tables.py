"""Catalog tables, views and bounded previews."""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from surcos.sources.scratch import scratch_path


def workspace(spark: SparkSession) -> str:
    """A database of this application, stored in the scratch folder."""
    name = "surcos_" + re.sub(r"\W", "_", spark.sparkContext.applicationId)
    if not spark.catalog.databaseExists(name):
        spark.sql(f"CREATE DATABASE {name} LOCATION '{scratch_path(spark, 'workspace')}'")
    return name


def fresh_name(spark: SparkSession, stem: str) -> str:
    """A table name in the workspace that nothing else uses."""
    return f"{workspace(spark)}.{stem}_{uuid.uuid4().hex[:8]}"


def replace_table(df: DataFrame, name: str, bucket: tuple[str, int] | None = None) -> DataFrame:
    """Create ``name`` from ``df``, replacing any earlier table of that name.

    ``bucket`` is (key, number): tables bucketed alike are joined or grouped on the
    key without a shuffle, which pays for a summary that many queries join.
    """
    writer = df.write.mode("overwrite")
    if bucket:
        key, number = bucket
        writer = writer.bucketBy(number, key).sortBy(key)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def _versions(spark: SparkSession, name: str) -> list[str]:
    """The written versions of a versioned table, oldest first."""
    database, _, stem = name.rpartition(".")
    listed = spark.catalog.listTables(database or None)
    own = re.compile(re.escape(stem.lower()) + r"__v\d{20}_[0-9a-f]{8}")
    return sorted((f"{database}." if database else "") + t.name for t in listed if own.fullmatch(t.name.lower()))


def replace_version(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a new version of ``name`` and then let the view ``name`` show it.

    Until the write has ended the view shows the version before, so a job that fails leaves
    that one, and readers that have planned on it go on. The switch is one catalog change.
    Versions stay until :func:`retire_versions`; one that a failed job has begun goes there too.
    """
    spark = df.sparkSession
    version = f"{name}__v{time.time_ns():020d}_{uuid.uuid4().hex[:8]}"
    df.write.saveAsTable(version)
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {version}")
    return spark.table(name)


def retire_versions(spark: SparkSession, name: str, keep: int = 1) -> list[str]:
    """Drop all but the last ``keep`` versions of ``name`` and the one it shows; gives those dropped."""
    # The view's text names its version.
    text = spark.sql(f"SHOW CREATE TABLE {name}").first()[0].lower()
    versions = _versions(spark, name)
    old = [v for v in versions[: len(versions) - keep] if v.rpartition(".")[2].lower() not in text]
    for version in old:
        spark.sql(f"DROP TABLE {version}")
    return old


def create_empty(spark: SparkSession, name: str, schema: str | StructType) -> DataFrame:
    """Create an empty typed table."""
    return replace_table(spark.createDataFrame([], schema), name)


def insert_select(df: DataFrame, name: str) -> DataFrame:
    """Append the columns of ``df`` to ``name`` by position, coerced to its types.

    A value that the target type cannot hold becomes null, it does not fail the
    insert.
    """
    target = df.sparkSession.table(name)
    if len(target.columns) != len(df.columns):
        raise ValueError(f"{name} has {len(target.columns)} columns, got {len(df.columns)}")
    renamed = df.toDF(*target.columns)
    renamed.select(
        *[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in target.schema]
    ).write.insertInto(name)
    return df.sparkSession.table(name)


def replace_view(spark: SparkSession, name: str, query: str) -> DataFrame:
    """Create or replace a stored query."""
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS {query}")
    return spark.table(name)


def session_view(df: DataFrame, name: str) -> str:
    """Make a DataFrame visible to SQL in this session."""
    df.createOrReplaceTempView(name)
    return name


def describe(spark: SparkSession, name: str) -> DataFrame:
    return spark.sql(f"DESCRIBE {name}")


def preview(df: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` rows, for display; the only hand-off to local rows is this."""
    return df.limit(n)
