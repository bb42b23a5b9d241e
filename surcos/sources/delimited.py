"""Delimited text with a header row: the four schema modes and dated files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from surcos.functions.scalar import parse_date


def read_delimited(
    spark: SparkSession,
    path: str,
    *,
    sep: str = ",",
    schema: str | StructType | None = None,
    infer: bool = False,
) -> DataFrame:
    """Read a delimited file.

    ``schema`` (DDL text or StructType) wins over ``infer``; without either, all
    columns are strings. Inference reads the whole file once more, so declare a
    schema for anything that is read repeatedly.
    """
    reader = spark.read.option("header", True).option("sep", sep)
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", infer).csv(path)


def delimited_table(
    spark: SparkSession,
    name: str,
    path: str,
    *,
    sep: str = ",",
    ddl: str | None = None,
    infer: bool = False,
) -> DataFrame:
    """Drop and create catalog table ``name`` over a delimited file."""
    columns = f"({ddl})" if ddl else ""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(
        f"CREATE TABLE {name} {columns} USING csv OPTIONS "
        f"(path '{path}', header 'true', sep '{sep}', inferSchema '{str(infer).lower()}')"
    )
    return spark.table(name)


def read_dated(
    spark: SparkSession, path: str, date: str, value: str, *, sep: str = ","
) -> DataFrame:
    """Read a dated file as ``(ds DATE, y DOUBLE)``; day-first dates are accepted."""
    raw = read_delimited(spark, path, sep=sep)
    return raw.select(
        parse_date(F.col(date)).alias("ds"), F.col(value).try_cast("double").alias("y")
    )


def write_delimited(df: DataFrame, path: str, *, sep: str = ",") -> str:
    df.write.option("header", True).option("sep", sep).csv(path)
    return path
