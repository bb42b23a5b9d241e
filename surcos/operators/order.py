"""Sorts, limits and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bottom_k(df: DataFrame, column: str, k: int, tie: str) -> DataFrame:
    """The k smallest (nulls first), ties broken by ``tie``; no full sort."""
    return df.orderBy(F.asc_nulls_first(column), tie).limit(k)


def top_k(df: DataFrame, column: str, k: int, tie: str) -> DataFrame:
    """The k largest (nulls last), ties broken by ``tie``; no full sort."""
    return df.orderBy(F.desc_nulls_last(column), tie).limit(k)


def chronological(
    df: DataFrame, series: str = "series_id", ds: str = "ds", ties: Sequence[str] = ()
) -> DataFrame:
    """Order for output; operators never depend on the position of rows.

    Name ``ties`` where a day has many rows: they then need not meet in one task.
    """
    return df.orderBy(series, ds, *ties)


def first_n(
    df: DataFrame, n: int, series: str = "series_id", ds: str = "ds", ties: Sequence[str] = ()
) -> DataFrame:
    """The first n rows of each series; ``ties`` decide between rows of one day.

    Spark keeps only n rows per series in every map task before the shuffle, so a
    series that dominates the table is cut down where it lies.
    """
    w = W.partitionBy(series).orderBy(F.asc(ds), *[F.asc(t) for t in ties])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def last_n(
    df: DataFrame, n: int, series: str = "series_id", ds: str = "ds", ties: Sequence[str] = ()
) -> DataFrame:
    """The last n rows of each series; ``ties`` decide between rows of one day."""
    w = W.partitionBy(series).orderBy(F.desc(ds), *[F.desc(t) for t in ties])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
