"""Splits and samples that do not depend on how the table is partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bucket(key: str, salt: str = "", buckets: int = 100) -> Column:
    """A stable pseudo-random bucket of a key: 32 bits of its md5, modulo ``buckets``. Null counts as ''."""
    text = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(salt))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % buckets).cast("int")


def hash_split(df: DataFrame, key: str, train: int = 70, salt: str = "") -> DataFrame:
    """Add ``split``: 'train' for about ``train`` percent of the keys, else 'test'."""
    return df.withColumn("split", F.when(bucket(key, salt) < train, "train").otherwise("test"))


def random_split(df: DataFrame, train: float = 0.7, seed: int = 1) -> list[DataFrame]:
    """Spark's own row-wise split; repeatable only for an unchanged input layout."""
    return df.randomSplit([train, 1 - train], seed)


def holdout_rounds(df: DataFrame, key: str, rounds: int = 3, train: int = 70) -> DataFrame:
    """Every row once per round, with an independent split in each."""
    expanded = df.withColumn("round", F.explode(F.array(*[F.lit(r) for r in range(rounds)])))
    text = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("#"), F.col("round").cast("string"))
    value = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % 100
    return expanded.withColumn("split", F.when(value < train, "train").otherwise("test"))


def hash_sample(df: DataFrame, key: str, percent: int, salt: str = "sample") -> DataFrame:
    """About ``percent`` percent of the keys, always the same ones."""
    return df.where(bucket(key, salt) < percent)


def bernoulli_sample(df: DataFrame, fraction: float, seed: int = 1) -> DataFrame:
    return df.sample(fraction=fraction, seed=seed)


def chronological_split(
    df: DataFrame, n_test: int, series: str = "series_id", ds: str = "ds"
) -> DataFrame:
    """Add ``split``: the last ``n_test`` rows of each series are the test part.

    For series with one row per day. The row number shares its partitioning with
    every later window over the series, so it costs no extra shuffle.
    """
    w = W.partitionBy(series).orderBy(F.desc(ds))
    return df.withColumn(
        "split", F.when(F.row_number().over(w) <= n_test, "test").otherwise("train")
    )
