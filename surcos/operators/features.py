"""Category indexes, one-hot columns and feature vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surcos.operators.aggregate import distribution
from surcos.operators.encoder import CategoryEncoder
from surcos.operators.ranking import global_rank
from surcos.sources.scratch import materialise


def category_index(df: DataFrame, column: str) -> DataFrame:
    """(value, n, index): categories numbered from the most frequent, ties by value."""
    counts = distribution(
        df.where(F.col(column).isNotNull()), column, name="n"
    ).withColumnRenamed(column, "value")
    return global_rank(counts, [F.desc("n"), F.asc("value")], "index")


def string_index(
    df: DataFrame,
    column: str,
    output: str,
    *,
    fitted: DataFrame | None = None,
    unseen: str = "skip",
) -> DataFrame:
    """Add the category index of ``column``; any number of categories.

    ``fitted`` comes from :func:`category_index` on other rows. Rows whose value is
    unknown or null are dropped ('skip'), get null ('keep') or fail ('error').
    """
    labels = (category_index(df, column) if fitted is None else fitted).select(
        F.col("value").alias("_value"), F.col("index").alias(output)
    )
    how = "inner" if unseen == "skip" else "left"
    joined = df.join(labels, F.col(column) == F.col("_value"), how).drop("_value")
    if unseen != "error":
        return joined
    checked = F.coalesce(
        F.col(output), F.raise_error(F.concat(F.lit(f"unseen value in {column}: "), F.col(column)))
    )
    return joined.withColumn(output, checked.cast("bigint"))


def label_index(df: DataFrame, column: str, output: str, positive: str | None = None) -> DataFrame:
    """Index of a two-class label as 0.0 / 1.0.

    By frequency: the larger class is 0, so the rarer one is "positive". Name
    ``positive`` to decide it instead.
    """
    if positive is not None:
        return df.withColumn(output, (F.col(column) == positive).cast("double"))
    indexed = string_index(df, column, output)
    return indexed.withColumn(output, F.col(output).cast("double"))


def one_hot(df: DataFrame, column: str, values: Sequence[str], prefix: str | None = None) -> DataFrame:
    """Add a 0/1 column ``<prefix>_0`` … for each category that the caller names; null is none of them."""
    name = prefix or column
    return df.withColumns(
        {f"{name}_{i}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for i, v in enumerate(values)}
    )


def one_hot_vector(df: DataFrame, column: str, output: str) -> DataFrame:
    """Add a sparse one-hot vector with a slot for every category but the rarest.

    Any number of categories: the index is joined to the rows, and only its size, one
    number, reaches the driver. A null has an empty vector.
    """
    ranked = materialise(category_index(df, column), "categories")
    slots = OneHotEncoder(inputCols=["_index"], outputCols=[output], handleInvalid="error", dropLast=True)
    size = ranked.count()
    indexed = string_index(df, column, "_index", fitted=ranked, unseen="keep")
    # A null takes the last index, the one without a slot.
    filled = indexed.withColumn("_index", F.coalesce("_index", F.lit(max(size, 2) - 1)).cast("double"))
    sized = filled.withMetadata("_index", {"ml_attr": {"type": "nominal", "name": column, "num_vals": max(size, 2)}})
    return slots.fit(sized).transform(sized).drop("_index")


def assemble(df: DataFrame, columns: Sequence[str], output: str = "features") -> DataFrame:
    """Put numeric columns into one vector column; nulls must be gone by now."""
    return VectorAssembler(inputCols=list(columns), outputCol=output).transform(df)


def vector_slots(df: DataFrame, vector: str, names: Sequence[str]) -> DataFrame:
    """Spread a vector column over plain columns."""
    values = df.withColumn("_slots", vector_to_array(vector))
    return values.withColumns({n: F.col("_slots")[i] for i, n in enumerate(names)}).drop("_slots")


def varying(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns with at least two values; a constant one has no one-hot slot."""
    row = df.agg(*[(F.min(c) < F.max(c)).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def encoder_stages(
    categories: Sequence[str],
    numerics: Sequence[str],
    *,
    label: str | None = None,
    unseen: str = "skip",
) -> list:
    """Pipeline stages: one-hot the categories, append the numbers, index the label.

    The feature vector holds the one-hot slots first, then the numbers. Categories are
    numbered by :class:`CategoryEncoder`, whose labels are a table, so there may be any
    number of them; classes of the label are few and stay on the driver.
    """
    encoder = CategoryEncoder(inputCols=list(categories), numericCols=list(numerics), outputCol="features", handleInvalid=unseen)
    return [encoder, StringIndexer(inputCol=label, outputCol="label")] if label else [encoder]


def fitted_pipeline(train: DataFrame, stages: Sequence):
    return Pipeline(stages=list(stages)).fit(train)


def slot_names(df: DataFrame, vector: str = "features") -> list[str]:
    """Names of the vector's slots, in order, from the column metadata."""
    groups = df.schema[vector].metadata["ml_attr"]["attrs"]
    slots = [slot for group in groups.values() for slot in group]
    return [s["name"] for s in sorted(slots, key=lambda s: s["idx"])]
