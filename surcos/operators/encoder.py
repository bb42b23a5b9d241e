"""A pipeline stage that encodes categories and numbers as one vector, with labels in a table.

Fitted labels are rows (column, value, n, index), not a list on the driver, so a column may
have any number of categories. They are written and read with the pipeline, and joined to the
rows they encode. What the driver holds is the number of categories per column, and names of
slots where there are at most ``NAMED`` of them.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasHandleInvalid, HasInputCols, HasOutputCol
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
    MLReadable, MLReader, MLWritable, MLWriter,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from surcos.operators.aggregate import profile
from surcos.operators.clean import quoted
from surcos.operators.ranking import global_rank
from surcos.sources.scratch import materialise

SMALL = 10_000  # categories of all columns together that are numbered on the driver
NAMED = 1_000  # slots up to which a vector carries their names
DENSE = 64  # categories and numbers up to which vectors are dense
_LABELS = "column string, value string, n bigint, index bigint"
_VECTOR = StructType([StructField("v", VectorUDT())])


def category_labels(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n, index): the categories of each column from the most frequent, ties by value.

    Values are compared as text, nulls left out. All columns are counted in one pass. Runs Spark jobs.
    """
    return _labels(df, columns)[0]


def _labels(df: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, list[str]] | None]:
    """The label table, and the labels themselves if there are at most ``SMALL``."""
    spark = df.sparkSession
    if not columns:
        return spark.createDataFrame([], _LABELS), {}
    counts = profile(df, columns).where(F.col("value").isNotNull())
    few = counts.limit(SMALL + 1).collect()
    if len(few) <= SMALL:
        held: dict[str, list[str]] = {c: [] for c in columns}
        rows = []
        for r in sorted(few, key=lambda r: (-r["n"], r["value"].encode())):
            rows.append((r["column"], r["value"], r["n"], len(held[r["column"]])))
            held[r["column"]].append(r["value"])
        return spark.createDataFrame(rows, _LABELS), held
    ranked = materialise(global_rank(counts, [F.asc("column"), F.desc("n"), F.asc("value")], "rank"), "categories")
    first = ranked.groupBy(F.col("column").alias("_c")).agg(F.min("rank").alias("first"))
    # One row for each column.
    labels = ranked.join(F.broadcast(first), F.col("column") == F.col("_c"))
    return materialise(labels.select("column", "value", "n", (F.col("rank") - F.col("first")).alias("index")), "labels"), None


def sparse_vector(slots: list[tuple[int, Column]], numbers: list[Column]) -> Column:
    """One-hot slots, (how many, which one or null) for each group, followed by numbers."""
    size = sum(n for n, _ in slots) + len(numbers)
    before, entries = 0, []
    for n, which in slots:
        entries.append(F.when((which >= 0) & (which < n), F.struct((which + before).cast("int").alias("i"), F.lit(1.0).alias("v"))))
        before += n
    entries += [F.when(x != 0, F.struct(F.lit(before + j).alias("i"), x.alias("v"))) for j, x in enumerate(numbers)]
    present = F.filter(F.array(*entries), lambda e: e.isNotNull())
    plain = F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"),
        F.transform(present, lambda e: e["i"]).alias("indices"), F.transform(present, lambda e: e["v"]).alias("values"),
    )
    # No built-in function makes a sparse vector, but a vector is read from text by its own schema.
    return F.from_json(F.to_json(F.struct(plain.alias("v"))), _VECTOR)["v"]


class _EncoderParams(HasInputCols, HasOutputCol, HasHandleInvalid):
    numericCols = Param(Params._dummy(), "numericCols", "numbers after the slots", typeConverter=TypeConverters.toListString)

    def __init__(self):
        super().__init__()
        self._setDefault(inputCols=[], numericCols=[], outputCol="features", handleInvalid="skip")


class CategoryEncoder(Estimator, _EncoderParams, DefaultParamsReadable, DefaultParamsWritable):
    """Number the categories of the input columns; see :class:`CategoryEncoderModel`.

    ``handleInvalid`` for values that were not seen and nulls: 'skip' drops the row, 'keep'
    leaves all slots of the column empty, 'error' fails.
    """

    @keyword_only
    def __init__(self, *, inputCols=None, numericCols=None, outputCol=None, handleInvalid=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> CategoryEncoderModel:
        columns = list(self.getInputCols())
        labels, held = _labels(dataset, columns)
        if held is not None:
            sizes = {c: len(held[c]) for c in columns}
        else:
            found = {r["column"]: r["n"] for r in labels.groupBy("column").agg(F.count("*").alias("n")).collect()}
            sizes = {c: found.get(c, 0) for c in columns}
        model = CategoryEncoderModel(labels, sizes)
        model.held = held
        return self._copyValues(model)


class CategoryEncoderModel(Model, _EncoderParams, MLReadable, MLWritable):
    """Add the vector: for each column a slot for every category but the rarest, then the numbers.

    Slots are in the order of frequency, so a column with one category has none. A null or
    NaN among the numbers is an error, as in the library's assembler.
    """

    def __init__(self, labels: DataFrame | None = None, sizes: dict[str, int] | None = None):
        super().__init__()
        self.labels, self.sizes = labels, sizes or {}
        self.held: dict[str, list[str]] | None = None

    def _slots(self, column: str) -> int:
        return max(self.sizes[column] - 1, 0)

    @property
    def n_slots(self) -> int:
        return sum(map(self._slots, self.sizes)) + len(self.getOrDefault("numericCols"))

    @property
    def labelsArray(self) -> list[list[str]]:
        """The labels of every column in order, for columns of few categories: it holds them."""
        if self.held is None:
            rows = self.labels.orderBy("index").collect()
            self.held = {c: [r["value"] for r in rows if r["column"] == c] for c in self.getInputCols()}
        return [self.held[c] for c in self.getInputCols()]

    def slot_names(self) -> list[str] | None:
        """Names of the slots, or None if there are more than ``NAMED``."""
        if self.n_slots > NAMED:
            return None
        hot = zip(self.getInputCols(), self.labelsArray)
        return [f"{c}_vec_{v}" for c, values in hot for v in values[:-1]] + list(self.getOrDefault("numericCols"))

    def _checked(self, known: Column, column: str) -> Column:
        """An error for a value that is not known."""
        wrong = F.concat(F.lit(f"unseen value in {column}: "), F.coalesce(F.col(quoted(column)).cast("string"), F.lit("null")))
        return F.when(F.coalesce(known, F.lit(False)), True).otherwise(F.raise_error(wrong).cast("boolean"))

    def _dense(self, rows: DataFrame, numbers: list[Column]) -> tuple[DataFrame, Column]:
        """Few slots: each is a comparison with its label, without joins."""
        unseen, hot = self.getHandleInvalid(), []
        for column, labels in zip(self.getInputCols(), self.labelsArray):
            value = F.col(quoted(column)).cast("string")
            if unseen != "keep":
                known = value.isin(labels) if labels else F.lit(False)
                rows = rows.where(self._checked(known, column) if unseen == "error" else known)
            hot += [F.coalesce((value == label).cast("double"), F.lit(0.0)) for label in labels[:-1]]
        return rows, array_to_vector(F.array(*hot, *numbers).cast("array<double>"))

    def _sparse(self, rows: DataFrame, numbers: list[Column]) -> tuple[DataFrame, Column]:
        """Many slots: the label table is joined to the rows."""
        unseen, slots = self.getHandleInvalid(), []
        for i, column in enumerate(self.getInputCols()):
            own = self.labels.where(F.col("column") == column).select(F.col("value").alias(f"_value{i}"), F.col("index").alias(f"_index{i}"))
            same = F.col(quoted(column)).cast("string") == F.col(f"_value{i}")
            rows = rows.join(own, same, "inner" if unseen == "skip" else "left").drop(f"_value{i}")
            index = F.col(f"_index{i}")
            if unseen == "error":
                rows = rows.where(self._checked(index.isNotNull(), column))
            slots.append((self._slots(column), index))
        return rows, sparse_vector(slots, numbers)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        numbers = []
        for column in self.getOrDefault("numericCols"):
            value = F.col(quoted(column)).cast("double")
            missing = F.raise_error(F.lit(f"null or NaN in {column}")).cast("double")
            numbers.append(F.when(value.isNull() | F.isnan(value), missing).otherwise(value))
        few = sum(self.sizes.values()) + len(numbers) <= DENSE
        rows, encoded = (self._dense if few else self._sparse)(dataset, numbers)
        out, names = self.getOutputCol(), self.slot_names()
        attributes = {"num_attrs": self.n_slots}
        if names is not None:
            hot = self.n_slots - len(numbers)
            kinds = {"binary": names[:hot], "numeric": names[hot:]}
            start = {"binary": 0, "numeric": hot}
            attributes["attrs"] = {k: [{"idx": start[k] + j, "name": n} for j, n in enumerate(v)] for k, v in kinds.items() if v}
        made = rows.withColumn(out, encoded).withMetadata(out, {"ml_attr": attributes})
        return made.select(*[F.col(quoted(c)) for c in dataset.columns], out)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, instance: CategoryEncoderModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata={"sizes": self.instance.sizes})
        self.instance.labels.write.parquet(f"{path}/labels")


class _Reader(MLReader):
    def load(self, path: str) -> CategoryEncoderModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        labels = self.sparkSession.read.schema(_LABELS).parquet(f"{path}/labels")
        model = CategoryEncoderModel(labels, metadata["sizes"])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
