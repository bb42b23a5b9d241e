"""Classifiers and clustering on MLlib, with reproducible hold-out rounds."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surcos.operators.features import slot_names
from surcos.operators.metrics import balanced_accuracy
from surcos.operators.split import hash_split
from surcos.sources.scratch import materialise, release

SEED = 1
TASK_ROWS = 1 << 20  # rows that one task may hold while a model is fitted
PLAIN = {"compression": "none", "parquet.enable.dictionary": "false", "parquet.block.size": str(4 << 20)}


def logistic(**params) -> LogisticRegression:
    return LogisticRegression(featuresCol="features", labelCol="label", **params)


def elastic_logistic() -> LogisticRegression:
    return logistic(regParam=0.01, elasticNetParam=0.5, maxIter=150)


def boosted_trees(depth: int = 5, bins: int = 8, rounds: int = 25) -> GBTClassifier:
    return GBTClassifier(
        featuresCol="features", labelCol="label",
        maxIter=rounds, maxDepth=depth, maxBins=bins, seed=SEED,
    )


def decision_tree(depth: int = 5, bins: int = 32) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(
        featuresCol="features", labelCol="label", maxDepth=depth, maxBins=bins, seed=SEED
    )


def segmenter(k: int = 5, seed: int = SEED) -> KMeans:
    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="prediction")


@dataclass
class Trained:
    """A fitted pipeline, its predictions on the test part and the metric per round."""

    model: PipelineModel
    results: DataFrame
    auc: list[float]

    @property
    def mean_auc(self) -> float:
        return sum(self.auc) / len(self.auc)


def holdout(df: DataFrame, key: str, salt: str = "") -> tuple[DataFrame, DataFrame]:
    """The training and the test part of a 70/30 split by key."""
    parts = hash_split(df, key, salt=salt)
    train, test = (parts.where(F.col("split") == name).drop("split") for name in ("train", "test"))
    return train, test


def narrowed(df: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(rows, back): encoded rows of up to 64 named slots in fewer bytes, and what makes vectors of them again.

    Slots that the vector's metadata calls binary become the bits of one number, the others a
    column each. Other columns stay. Vectors without such metadata stay as they are.
    """
    meta = df.schema["features"].metadata
    groups = meta.get("ml_attr", {}).get("attrs", {})
    size = sum(map(len, groups.values()))
    if not 0 < size <= 64:
        return df, lambda rows: rows
    binary = sorted(slot["idx"] for slot in groups.get("binary", []))
    others = [i for i in range(size) if i not in binary]
    bit = {i: (1 << j) - (1 << 64 if j == 63 else 0) for j, i in enumerate(binary)}

    slot = lambda i: F.col("_slots")[i]
    wrong = F.raise_error(F.lit("a binary slot that is neither 0 nor 1")).cast("bigint")
    bits = [F.when(slot(i) == 1, F.lit(bit[i])).when(slot(i) == 0, F.lit(0)).otherwise(wrong).cast("bigint") for i in binary]
    kept = [c for c in df.columns if c != "features"]
    spread = df.select(*kept, vector_to_array("features").alias("_slots"))
    rows = spread.select(
        *kept, *([reduce(Column.bitwiseOR, bits).alias("_bits")] if bits else []), *[slot(i).alias(f"_slot{i}") for i in others])

    def back(rows: DataFrame) -> DataFrame:
        one = lambda i: (F.col("_bits").bitwiseAND(F.lit(bit[i]).cast("bigint")) != 0).cast("double")
        values = F.array(*[one(i) if i in bit else F.col(f"_slot{i}") for i in range(size)])
        return rows.select(*kept, array_to_vector(values).alias("features")).withMetadata("features", meta)

    return rows, back


def training_rows(df: DataFrame, rows: int) -> DataFrame:
    """Training rows of a table of ``rows``, written plain if those are more than ``TASK_ROWS``.

    A scan makes its tasks by the bytes of the files, but a fit keeps a task's rows as objects
    and reads them again in every pass. Encoded and compressed, rows that resemble each other
    take next to no bytes, so a task would get any number of them; plain, a row takes what
    its numbers take, and ``spark.sql.files.maxPartitionBytes`` bounds what a task holds. They
    are written :func:`narrowed`, in files of at most ``TASK_ROWS``, of which a task of 128 MB takes one.
    """
    if rows <= TASK_ROWS:
        return df
    narrow, back = narrowed(df)
    return back(materialise(narrow, "training", **PLAIN, maxRecordsPerFile=str(TASK_ROWS)))


def fits_at_once(df: DataFrame, rows: int, parallelism: int) -> int:
    """How many fits run side by side: fewer where one alone fills the cluster and its memory."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(1, min(parallelism, parallelism * cores // max(1, math.ceil(rows / TASK_ROWS))))


def _slim(encoded: DataFrame) -> DataFrame:
    return encoded.select([c for c in ("label", "features") if c in encoded.columns])


def fit_holdout(
    df: DataFrame, stages: Sequence, estimator: Estimator, key: str
) -> tuple[PipelineModel, DataFrame]:
    """One pipeline fitted on the training part, and its predictions on the test part.

    ``df`` is read several times, once to count it: hand in a written table.
    """
    train, test = holdout(df, key)
    encoder = Pipeline(stages=list(stages)).fit(train)
    fitted = estimator.fit(training_rows(_slim(encoder.transform(train)), df.count()))
    model = PipelineModel([*encoder.stages, fitted])
    return model, model.transform(test)


def compare_models(
    df: DataFrame,
    stages: Sequence,
    estimators: Mapping[str, Estimator],
    key: str,
    rounds: int = 3,
    keep: str = "best",
    parallelism: int = 4,
) -> tuple[dict[str, Trained], DataFrame]:
    """Fit and test all estimators on the same ``rounds`` hold-outs.

    Gives the kept model of each estimator (the best or the last round) and a table
    (model, round, auc). Of equal rounds the first is kept, and a model is returned
    whatever its score. ``df`` is read several times: hand in a written table. The
    encoding stages are fitted once per round, on its training part, and the encoded
    parts are written.

    Training is many short jobs with a driver step between them, so up to
    ``parallelism`` fits run side by side to fill the cluster; one at a time where its own
    tasks do, as the rows that each of them keeps would push the others' to disk.

    Where the fits of a large table run one at a time, one round is made after the other. Its training
    rows go when its fits are done, unless the summary of a model that may be kept reads them, and
    its test part is encoded as it is read, also by the results: keep ``df`` as long as these.
    """
    size, encoded, fits = df.count(), {}, {}
    at_once = fits_at_once(df, size, parallelism)
    large, apart = size > TASK_ROWS, size > TASK_ROWS and at_once == 1

    def encode(r: int) -> tuple[PipelineModel, DataFrame, DataFrame]:
        train, test = holdout(df, key, f"#{r}")
        encoder = Pipeline(stages=list(stages)).fit(train)
        # Written once a round: every estimator passes over these rows many times.
        rows, tested = _slim(encoder.transform(train)), encoder.transform(test)
        written = training_rows(rows, size) if large else materialise(rows, "encoded")
        return encoder, written, tested if apart else materialise(tested, "encoded")

    def fit(task: tuple[str, int]) -> tuple[PipelineModel, DataFrame, float]:
        name, r = task
        encoder, train, test = encoded[r]
        # A copy each: the wrapped estimator object is not made for several threads.
        model = estimators[name].copy().fit(train)
        results = model.transform(test)
        score = balanced_accuracy(results, "label", "prediction").first()["auc"] or 0.0
        return PipelineModel([*encoder.stages, model]), results, float(score)

    def scores(name: str) -> list[float]:
        return [fits[name, r][2] for r in range(rounds) if (name, r) in fits]

    def chosen(name: str) -> int:
        """Of the rounds so far."""
        return len(scores(name)) - 1 if keep == "last" else scores(name).index(max(scores(name)))

    for batch in [[r] for r in range(rounds)] if apart else [range(rounds)]:
        encoded |= {r: encode(r) for r in batch}
        tasks = [(name, r) for name in estimators for r in batch]
        with ThreadPoolExecutor(at_once) as pool:
            fits |= zip(tasks, pool.map(inheritable_thread_target(df.sparkSession)(fit), tasks))
        read = {chosen(n) for n in estimators if getattr(fits[n, chosen(n)][0].stages[-1], "hasSummary", False)}
        for r in [r for r in encoded if apart and r not in read]:
            release(encoded.pop(r)[1])

    trained = {name: Trained(*fits[name, chosen(name)][:2], scores(name)) for name in estimators}
    rows = [(name, r, auc) for name, t in trained.items() for r, auc in enumerate(t.auc)]
    return trained, df.sparkSession.createDataFrame(rows, "model string, round int, auc double")


def train_rounds(
    df: DataFrame,
    stages: Sequence,
    estimator: Estimator,
    key: str,
    *,
    rounds: int = 3,
    keep: str = "best",
) -> Trained:
    """One estimator through ``rounds`` independent hold-outs."""
    trained, _ = compare_models(df, stages, {"model": estimator}, key, rounds, keep=keep)
    return trained["model"]


def scored(results: DataFrame, *keep: str) -> DataFrame:
    """Label, prediction and probability of class 1."""
    return results.select(
        *keep, "label", "prediction", vector_to_array("probability")[1].alias("probability")
    )


def importances(model: PipelineModel, transformed: DataFrame) -> DataFrame:
    """(feature, importance) of a tree model, by the names of the vector's slots."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(n, float(v)) for n, v in zip(slot_names(transformed), values)]
    return transformed.sparkSession.createDataFrame(rows, "feature string, importance double")


def model_text(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """One row with the readable form of a tree model."""
    return spark.createDataFrame([(model.stages[-1].toDebugString,)], "tree string")


def loss_curve(spark: SparkSession, summary) -> DataFrame:
    """(iteration, loss) of an iterative fit, from its training summary."""
    rows = [(i, float(v)) for i, v in enumerate(summary.objectiveHistory)]
    return spark.createDataFrame(rows, "iteration int, loss double")
