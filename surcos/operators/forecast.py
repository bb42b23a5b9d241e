"""One-step forecasters on lag windows: linear in the lags, or by a recurrent state.

They take the place of a trained recurrent network: same samples, same scaling, same
metrics; forecast values differ from a network's. The recurrent one is an echo state: fixed
weights fold each window into a state, and only the linear readout is fitted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from surcos.operators.timeseries import lag_arrays, lag_windows, minmax_unscale, series_window

UNITS = 16  # of the recurrent state
RING, INPUT = 0.8, 0.9  # weights between units and from the input
RIDGE = 1e-7


def _train(column: str):
    return F.when(F.col("split") == "train", F.col(column))


def ar1_fit(windows: DataFrame) -> DataFrame:
    """(series_id, slope, intercept, n): least squares of target on l1, training part."""
    train = windows.where(F.col("split") == "train")
    return train.groupBy("series_id").agg(
        F.regr_slope("target", "l1").alias("slope"),
        F.regr_intercept("target", "l1").alias("intercept"),
        F.regr_count("target", "l1").alias("n"),
    )


def ar1_forecast(windows: DataFrame) -> DataFrame:
    """Add ``predicted``, each series with its own coefficients.

    Fitted and applied in one window per series: no join, no second pass.
    """
    slope = F.regr_slope(_train("target"), _train("l1")).over(series_window())
    intercept = F.regr_intercept(_train("target"), _train("l1")).over(series_window())
    return windows.withColumn("predicted", slope * F.col("l1") + intercept)


def _finite(c):
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def _solve(sums: pd.Series, means: pd.Series, counts: pd.Series, ridges: pd.Series) -> pd.DataFrame:
    """Weights and intercept of every series in a batch from its centred products.

    The ridge is added to the diagonal of the correlations.
    """
    weights, intercepts = [], []
    for flat, mean, n, ridge in zip(sums, means, counts, ridges):
        k = len(mean) - 1
        full = np.zeros((k + 1, k + 1))
        full[np.tril_indices(k + 1)] = flat
        full += np.tril(full, -1).T
        gram, cross = full[:k, :k], full[:k, k]
        usable = n > k + 1 and np.isfinite(full).all()
        if usable:
            scale = np.sqrt(np.diag(gram))
            usable = (scale > 0).all()
        if usable:
            related = gram / np.outer(scale, scale) + ridge * np.eye(k)
            usable = np.linalg.matrix_rank(related, tol=1e-10) == k
        if usable:
            w = np.linalg.solve(related, cross / scale) / scale
            weights.append(w)
            intercepts.append(float(mean[k] - w @ mean[:k]))
        else:
            weights.append(None)
            intercepts.append(None)
    return pd.DataFrame({"weights": weights, "intercept": pd.Series(intercepts, dtype="float64")})


def _keyed(samples: DataFrame) -> DataFrame:
    """The series id inside a struct, which is never null and equals others by content.

    Ids that are structs already stay, and with them a partitioning by ``series_id``.
    """
    if isinstance(samples.schema["series_id"].dataType, StructType):
        return samples
    return samples.withColumn("series_id", F.struct("series_id"))


def _plain(keyed: DataFrame, like: DataFrame) -> DataFrame:
    if isinstance(like.schema["series_id"].dataType, StructType):
        return keyed
    return keyed.withColumn("series_id", F.col("series_id.series_id"))


def least_squares(samples: DataFrame, inputs: str, k: int, ridge: float = 0.0) -> DataFrame:
    """(series_id, weights, intercept) of ``target`` on the ``k`` numbers of ``inputs``, training part.

    Means and centred products are mergeable aggregates of one pass; Python solves the small
    systems, many series a batch. Samples with a null, NaN or infinite number are left out. A
    series with no more than k + 1 samples, or with inputs that depend on each other, has null
    weights; a ridge lets nearly dependent inputs pass.
    """
    whole = F.coalesce(_finite(F.col("target")) & F.forall(inputs, _finite), F.lit(False))
    train = samples.where((F.col("split") == "train") & whole).select(
        "series_id", F.concat(inputs, F.array("target")).alias("_v"))
    at = lambda i: F.get("_v", F.lit(i))
    products = train.groupBy("series_id").agg(
        F.array(*[F.covar_pop(at(i), at(j)) for i in range(k + 1) for j in range(i + 1)]).alias("sums"),
        F.array(*[F.avg(at(i)) for i in range(k + 1)]).alias("means"),
        F.count("*").alias("n"),
    )
    solve = F.pandas_udf(_solve, "weights array<double>, intercept double")
    solved = products.select("series_id", solve("sums", "means", "n", F.lit(float(ridge))).alias("fit"))
    return solved.select("series_id", "fit.weights", "fit.intercept")


def linear_forecast(samples: DataFrame, inputs: str, k: int, ridge: float = 0.0) -> DataFrame:
    """Add ``predicted`` by :func:`least_squares`, each series with its own weights; null where it has none."""
    keyed = _keyed(samples)
    total = F.aggregate(F.zip_with(inputs, "weights", lambda v, w: v * w), F.lit(0.0), lambda a, b: a + b)
    fitted = least_squares(keyed, inputs, k, ridge).withColumnRenamed("series_id", "_fitted")
    predicted = (
        keyed.join(fitted, F.col("series_id") == F.col("_fitted"), "left")
        .withColumn("predicted", total + F.col("intercept"))
        .drop("_fitted", "weights", "intercept")
    )
    return _plain(predicted, samples)


def n_lags(samples: DataFrame) -> int:
    """The length of the lag arrays; runs a Spark job, so pass it where it is known."""
    return samples.select(F.max(F.size("x"))).first()[0] or 0


def ar_fit(samples: DataFrame, k: int | None = None) -> DataFrame:
    """(series_id, weights, intercept): least squares of target on x, per series.

    ``samples`` comes from :func:`lag_arrays` with ``k`` lags.
    """
    fitted = least_squares(_keyed(samples), "x", n_lags(samples) if k is None else k)
    return _plain(fitted, samples)


def ar_forecast(samples: DataFrame, k: int | None = None) -> DataFrame:
    """Add ``predicted``, linear in the lags; one shuffle by series on each side, none if there is one already."""
    return linear_forecast(samples, "x", n_lags(samples) if k is None else k)


def echo_weights(units: int) -> tuple[list[float], list[float]]:
    """Input weight and bias of every unit: signs by the parity of its number's bits, biases evenly over [-1, 1]."""
    signs = [1.0 - 2 * (bin(i).count("1") % 2) for i in range(units)]
    return [INPUT * s for s in signs], [2 * (i + 0.5) / units - 1 for i in range(units)]


def echo_states(samples: DataFrame, units: int = UNITS) -> DataFrame:
    """Add ``state``: the units of a recurrent ring after the window ``x``, oldest day first.

    From zero, each day sets unit i to tanh(RING * (unit i - 1 before, the last before the
    first) + weight_i * (2 x - 1) + bias_i). The ring's spectral radius is RING < 1, so
    early days fade. A null in the window makes the state null.
    """
    weights, biases = echo_weights(units)

    def day(state, x):
        signal = 2 * x - 1
        return F.array(
            *[F.tanh(RING * F.get(state, F.lit((i - 1) % units)) + w * signal + b) for i, (w, b) in enumerate(zip(weights, biases))]
        )

    folded = F.aggregate("x", F.array(*[F.lit(0.0)] * units), day)
    whole = F.coalesce(F.forall("x", lambda v: v.isNotNull()), F.lit(False))
    return samples.withColumn("state", F.when(whole, folded))


def echo_forecast(samples: DataFrame, units: int = UNITS, ridge: float = RIDGE) -> DataFrame:
    """Add ``predicted``: a readout of the recurrent state, fitted for each series."""
    return linear_forecast(echo_states(samples, units), "state", units, ridge).drop("state")


def ar_fit_pooled(windows: DataFrame, k: int) -> LinearRegressionModel:
    """One linear regression of target on l1..lk for the training rows of all series.

    Windows should be scaled, so that series of different size weigh alike. The
    normal equations are summed on the executors; only k + 1 coefficients return.
    """
    lags = [f"l{j}" for j in range(1, k + 1)]
    train = windows.where(F.col("split") == "train").select(*lags, "target").na.drop()
    vectors = VectorAssembler(inputCols=lags, outputCol="features").transform(train)
    return LinearRegression(
        featuresCol="features", labelCol="target", predictionCol="predicted", solver="normal"
    ).fit(vectors)


def ar_forecast_pooled(model: LinearRegressionModel, windows: DataFrame) -> DataFrame:
    """Add ``predicted`` as a plain expression over the lag columns."""
    value = F.lit(float(model.intercept))
    for j, weight in enumerate(model.coefficients.toArray(), start=1):
        value = value + F.lit(float(weight)) * F.col(f"l{j}")
    return windows.withColumn("predicted", value)


def forecast(scaled: DataFrame, k: int, *, pooled: bool = False, units: int = 0) -> DataFrame:
    """Scaled series to (series_id, ds, split, actual, predicted) in original units.

    Every series has coefficients of its own, or, ``pooled``, all share one set. With
    ``units`` the forecast reads out a recurrent state of that size folded over the k lags.
    """
    if units:
        predicted = echo_forecast(lag_arrays(scaled, k, "z"), units)
    elif pooled:
        windows = lag_windows(scaled, k, "z")
        predicted = ar_forecast_pooled(ar_fit_pooled(windows, k), windows)
    elif k == 1:
        predicted = ar1_forecast(lag_windows(scaled, 1, "z"))
    else:
        predicted = ar_forecast(lag_arrays(scaled, k, "z"), k)
    return minmax_unscale(predicted, {"predicted": "predicted"}).select(
        "series_id", "ds", "split", F.col("y").alias("actual"), "predicted"
    )
