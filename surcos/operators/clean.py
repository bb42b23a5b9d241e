"""Projection and cleaning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def quoted(name: str) -> str:
    """A column reference that is safe for names containing dots."""
    return "`" + name.replace("`", "``") + "`"


def pick(df: DataFrame, columns: Sequence[str] | Mapping[str, str]) -> DataFrame:
    """Select columns; a mapping renames ``old -> new`` on the way."""
    if isinstance(columns, Mapping):
        return df.select(*[F.col(quoted(old)).alias(new) for old, new in columns.items()])
    return df.select(*[F.col(quoted(c)) for c in columns])


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename columns, dotted names included; positions stay."""
    return df.toDF(*[mapping.get(c, c) for c in df.columns])


def drop_nulls(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Keep rows with no null (and no NaN) in any of the columns.

    Written as one plain predicate per column: those travel through joins down
    to the scans and turn outer joins below into inner ones.
    """
    wanted = set(columns or df.columns)
    tests = []
    for field in df.schema:
        if field.name in wanted:
            col = F.col(quoted(field.name))
            tests.append(col.isNotNull())
            if isinstance(field.dataType, (DoubleType, FloatType)):
                tests.append(~F.isnan(col))
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def trim_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Strip blanks so that equal categories group together."""
    return df.withColumns({c: F.trim(F.col(quoted(c))) for c in columns})


def as_category(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Turn coded numbers into text so that they are not treated as quantities."""
    return df.withColumns({c: F.col(quoted(c)).cast("string") for c in columns})
