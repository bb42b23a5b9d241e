"""Global order: ranks and running totals over a whole table.

A window without partition would put the table into one task. Instead the rows
are range-sorted (every task holds one range), written once so that the order is
fixed, and each range is shifted by the totals of the ranges before it. The only
single-task step sees one row per range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from surcos.sources.scratch import materialise

_POS, _RANGE = "_pos", "_range"
SMALL = 50_000  # distinct values that are put in order on the driver
_ROW_BITS = 33  # monotonically_increasing_id: task number above, row in task below


def _ranges(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Rows in order, with their range and their place inside it, fixed on disk."""
    placed = df.orderBy(*order).withColumn(_POS, F.monotonically_increasing_id())
    return materialise(placed, "ranges").withColumn(_RANGE, F.shiftright(_POS, _ROW_BITS))


def _offsets(per_range: DataFrame, names: Sequence[str]) -> DataFrame:
    """Totals of all earlier ranges; one row per range, so the one task is small."""
    earlier = W.orderBy(_RANGE).rowsBetween(W.unboundedPreceding, -1)
    return per_range.select(
        F.col(_RANGE).alias("_r"),
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_before_{n}") for n in names],
    )


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Number the rows 0, 1, ... in the given order, which must be unique."""
    placed = _ranges(df, order)
    sizes = placed.groupBy(_RANGE).agg(F.count("*").alias("rows"))
    # At most one row per shuffle partition: the broadcast cannot grow with data.
    joined = placed.join(
        F.broadcast(_offsets(sizes, ["rows"])), F.col(_RANGE) == F.col("_r")
    )
    in_range = F.col(_POS).bitwiseAND((1 << _ROW_BITS) - 1)
    return joined.select(*df.columns, (F.col("_before_rows") + in_range).alias(name))


def running_totals(df: DataFrame, order: Sequence[Column], measures: Sequence[str]) -> DataFrame:
    """Add ``cum_<m>``: the total of ``m`` up to and including each row.

    The order must be unique. Nulls count as nothing.
    """
    placed = _ranges(df, order)
    totals = placed.groupBy(_RANGE).agg(*[F.sum(m).alias(m) for m in measures])
    joined = placed.join(
        F.broadcast(_offsets(totals, measures)), F.col(_RANGE) == F.col("_r")
    )
    so_far = W.partitionBy(_RANGE).orderBy(_POS).rowsBetween(W.unboundedPreceding, 0)
    return joined.select(
        *df.columns,
        *[
            (F.col(f"_before_{m}") + F.coalesce(F.sum(m).over(so_far), F.lit(0))).alias(f"cum_{m}")
            for m in measures
        ],
    )


def ordered_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): the distinct values of a column numbered in their order; nulls have no code.

    The greatest code is that of the greatest value, so a maximum of text becomes one of
    numbers, which needs no sort. Up to ``SMALL`` values are ordered on the driver, more by a
    range sort. Runs Spark jobs.
    """
    values = df.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct()
    few = [r["value"] for r in values.limit(SMALL + 1).collect()]
    if len(few) > SMALL:
        return materialise(global_rank(values, [F.asc("value")], "code"), "codes")
    # Text is in order of its bytes, as in a sort of the engine.
    few.sort(key=lambda v: v.encode() if isinstance(v, str) else v)
    kind = values.schema["value"].dataType.simpleString()
    return df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(few)], f"value {kind}, code bigint")
