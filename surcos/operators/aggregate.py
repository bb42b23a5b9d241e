"""Group summaries and profiles. Every one is a single pass with partial aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from surcos.operators.clean import quoted

STATS = ("count", "mean", "stddev", "min", "max")


def key_summary(
    df: DataFrame,
    key: str,
    *,
    largest: dict[str, str],
    averages: dict[str, str],
    count: str,
) -> DataFrame:
    """Per key: maxima, means and the row count; mappings are ``column -> name``."""
    return df.groupBy(key).agg(
        *[F.max(c).alias(a) for c, a in largest.items()],
        *[F.avg(c).alias(a) for c, a in averages.items()],
        F.count("*").alias(count),
    )


def summary_partials(
    df: DataFrame, key: str, *, largest: Sequence[str], averages: Sequence[str]
) -> DataFrame:
    """What :func:`key_summary` needs of some rows, per key: maxima, sums, numbers of values and rows.

    Partials of more rows are added by :func:`merge_partials`, so a summary follows a table
    that grows without reading its old rows again.
    """
    return df.groupBy(key).agg(
        *[F.max(c).alias(f"max_{c}") for c in largest],
        *[f(c).alias(f"{name}_{c}") for c in averages for name, f in (("sum", F.sum), ("n", F.count))],
        F.count("*").alias("rows"),
    )


def merge_partials(one: DataFrame, *more: DataFrame, key: str) -> DataFrame:
    """Partials of the rows of all tables together, a row per key."""
    rows = one
    for other in more:
        rows = rows.unionByName(other)
    parts = [c for c in one.columns if c != key]
    return rows.groupBy(key).agg(*[(F.max if c.startswith("max_") else F.sum)(c).alias(c) for c in parts])


def finish_partials(
    partials: DataFrame, key: str, *, largest: dict[str, str], averages: dict[str, str], count: str
) -> DataFrame:
    """The summary that partials stand for, with the names of :func:`key_summary`."""
    return partials.select(
        key,
        *[F.col(f"max_{c}").alias(a) for c, a in largest.items()],
        *[F.try_divide(F.col(f"sum_{c}"), F.col(f"n_{c}")).alias(a) for c, a in averages.items()],
        F.col("rows").alias(count),
    )


def distribution(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    """Rows per key combination; null is a group of its own."""
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def value_counts(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Rows per non-null value, most frequent first, ties by value."""
    return (
        distribution(df.where(F.col(quoted(column)).isNotNull()), column, name=name)
        .orderBy(F.desc(name), column)
    )


def group_means(df: DataFrame, key: str) -> DataFrame:
    """Mean of every numeric column per key, under the plain column names."""
    numeric = [
        f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name != key
    ]
    return df.groupBy(key).agg(*[F.avg(quoted(c)).alias(c) for c in numeric])


def shape(df: DataFrame) -> DataFrame:
    """One row: number of rows and of columns."""
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def null_counts(df: DataFrame) -> DataFrame:
    """(column, n_null) for every column, counted in one pass."""
    wide = df.agg(*[F.count_if(F.col(quoted(c)).isNull()).alias(c) for c in df.columns])
    return wide.unpivot([], [F.col(quoted(c)) for c in df.columns], "column", "n_null")


_TEXT = ("string", "boolean", "date", "timestamp", "timestamp_ntz")


def _texts(df: DataFrame, columns: Sequence[str]) -> set[str]:
    """Those of the columns that are no numbers; the schema is read once."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return {c for c in columns if kinds[c] in _TEXT}


def _number(column: str, texts: set[str]):
    """The column as numbers: what cannot be read as one counts as missing."""
    if column in texts:
        return F.expr(f"try_cast({quoted(column)} AS DOUBLE)")
    return F.col(quoted(column)).cast("double")


def describe_long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, stat, value) with count, mean, stddev, min and max, in one pass.

    All columns numeric: values are doubles. With a text column among them values are
    text, as in a description for reading: minimum and maximum by text order, mean and
    deviation over the entries that read as numbers.
    """
    texts = _texts(df, columns)
    kind = "string" if texts else "double"
    raw = lambda make: lambda c: make(quoted(c)).cast(kind)
    number = lambda make: lambda c: make(_number(c, texts)).cast(kind)
    makers = (raw(F.count), number(F.avg), number(F.stddev_samp), raw(F.min), raw(F.max))
    wide = df.agg(
        *[make(c).alias(f"{i}_{stat}") for i, c in enumerate(columns) for stat, make in zip(STATS, makers)]
    )
    parts = ", ".join(
        f"'{c}', '{stat}', `{i}_{stat}`" for i, c in enumerate(columns) for stat in STATS
    )
    count = len(columns) * len(STATS)
    return wide.selectExpr(f"stack({count}, {parts}) AS (column, stat, value)")


def summary_approx(df: DataFrame, columns: Sequence[str], accuracy: int = 10_000) -> DataFrame:
    """describe_long plus approximate quartiles, which need bounded memory only."""
    texts = _texts(df, columns)
    kind = "STRING" if texts else "DOUBLE"
    wide = df.agg(
        *[
            F.percentile_approx(_number(c, texts), [0.25, 0.5, 0.75], accuracy).alias(f"q{i}")
            for i, c in enumerate(columns)
        ]
    )
    parts = ", ".join(
        f"'{c}', '{p}%', CAST(q{i}[{j}] AS {kind})"
        for i, c in enumerate(columns)
        for j, p in enumerate((25, 50, 75))
    )
    quartiles = wide.selectExpr(f"stack({3 * len(columns)}, {parts}) AS (column, stat, value)")
    return describe_long(df, columns).unionByName(quartiles)


def describe_groups(df: DataFrame, key: str, column: str) -> DataFrame:
    """Count, mean, stddev, min, exact interpolated quartiles and max per group.

    Exact percentiles keep the distinct values of a group in memory, so this is
    for groups of bounded size such as a series with one row per day. For a whole
    table column use :func:`surcos.operators.quantiles.quartiles_exact`.
    """
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return (
        df.groupBy(key)
        .agg(
            F.count(column).alias("count"),
            F.avg(column).alias("mean"),
            F.stddev_samp(column).alias("std"),
            F.min(column).alias("min"),
            q.alias("q"),
            F.max(column).alias("max"),
        )
        .select(
            key, "count", "mean", "std", "min",
            F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"),
            "max",
        )
    )


def min_max(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with ``<column>_min`` and ``<column>_max``."""
    return df.agg(
        *[f(c).alias(f"{c}_{f.__name__}") for c in columns for f in (F.min, F.max)]
    )


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, lo, hi, n) over equal-width bins; the last bin is closed on the right."""
    value = F.col(column)
    span = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    width = (hi - lo) / bins
    raw = F.coalesce(F.floor(F.try_divide(value - lo, width)), F.lit(0))
    counted = (
        df.where(value.isNotNull())
        .select(F.least(raw, F.lit(bins - 1)).cast("int").alias("bin"))
        .groupBy("bin")
        .agg(F.count("*").alias("n"))
    )
    return counted.select(
        "bin", (lo + F.col("bin") * width).alias("lo"), (lo + (F.col("bin") + 1) * width).alias("hi"), "n"
    )


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n): the distributions of several columns in one pass."""
    parts = ", ".join(f"'{c}', CAST({quoted(c)} AS STRING)" for c in columns)
    long = df.selectExpr(f"stack({len(columns)}, {parts}) AS (column, value)")
    return distribution(long, "column", "value")
