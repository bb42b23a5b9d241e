"""Daily series: (series_id, ds DATE, y DOUBLE), one row per series and day.

Everything after :func:`daily_totals` works on daily rows, so a series is as long
as its calendar, however many events went into it. All windows are partitioned by
the series; after the first one they reuse the same shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from surcos.functions.scalar import rescale, unscale


def series_window() -> WindowSpec:
    return W.partitionBy("series_id")


def day_window() -> WindowSpec:
    return series_window().orderBy("ds")


def daily_totals(events: DataFrame, series: str | None, date: str, value: str) -> DataFrame:
    """Sum per series and day, with every day between first and last present.

    Without a series column all events are one series. Days without events count
    zero. The gap after each day is filled from the next day's date, so no calendar
    table is joined.
    """
    name = F.col(series) if series else F.lit("all")
    daily = (
        events.groupBy(name.alias("series_id"), F.to_date(date).alias("ds"))
        .agg(F.sum(value).alias("y"))
        .where(F.col("ds").isNotNull())
    )
    next_day = F.lead("ds").over(day_window())
    last_free = F.coalesce(F.date_sub(next_day, 1), F.col("ds"))
    filled = daily.withColumn("_last", last_free).withColumn(
        "day", F.explode(F.sequence("ds", "_last"))
    )
    return filled.select(
        "series_id",
        F.col("day").alias("ds"),
        F.when(F.col("day") == F.col("ds"), F.coalesce("y", F.lit(0.0))).otherwise(0.0).alias("y"),
    )


def decompose(daily: DataFrame, period: int) -> DataFrame:
    """Additive decomposition: adds ``trend``, ``seasonal`` and ``resid``.

    The trend is a centred moving average of ``period`` days (for an even period
    of period + 1 days whose ends count half), the seasonal part the mean deviation
    per phase, shifted to sum to zero. Trend and residual are null for the first
    and last period // 2 days; a series shorter than two periods has no components.
    """
    half = period // 2
    around = day_window().rowsBetween(-half, half)
    total = F.sum("y").over(around)
    if period % 2 == 0:
        ends = F.lag("y", half).over(day_window()) + F.lead("y", half).over(day_window())
        total = total - ends / 2
    complete = (F.count("y").over(around) == 2 * half + 1) & (F.count("*").over(series_window()) >= 2 * period)
    phases = W.partitionBy("series_id", "_phase")
    return (
        daily.withColumns(
            {
                "_i": F.row_number().over(day_window()) - 1,
                "trend": F.when(complete, total / period),
            }
        )
        .withColumn("_phase", F.col("_i") % period)
        .withColumn("_phase_mean", F.avg(F.col("y") - F.col("trend")).over(phases))
        # The first `period` rows hold each phase once.
        .withColumn(
            "seasonal",
            F.col("_phase_mean")
            - F.avg(F.when(F.col("_i") < period, F.col("_phase_mean"))).over(series_window()),
        )
        .withColumn("resid", F.col("y") - F.col("trend") - F.col("seasonal"))
        .drop("_i", "_phase", "_phase_mean")
    )


def minmax_scale(split: DataFrame) -> DataFrame:
    """Add ``z``, scaled by the training part's range, and that range.

    Test values may leave [0, 1]; a constant training part gives null.
    """
    train = F.when(F.col("split") == "train", F.col("y"))
    return split.withColumns(
        {"y_min": F.min(train).over(series_window()), "y_max": F.max(train).over(series_window())}
    ).withColumn("z", rescale(F.col("y"), F.col("y_min"), F.col("y_max")))


def minmax_unscale(scaled: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Undo :func:`minmax_scale` for ``scaled column -> result column``."""
    return scaled.withColumns(
        {
            out: unscale(F.col(c), F.col("y_min"), F.col("y_max"))
            for c, out in columns.items()
        }
    )


def lag_windows(split: DataFrame, k: int, value: str = "y") -> DataFrame:
    """Design matrix: ``l1`` (previous day) to ``lk``, and ``target``.

    Windows stay inside their part, so the first k rows of train and of test give
    no sample. All columns of the input are kept.
    """
    order = W.partitionBy("series_id", "split").orderBy("ds")
    lags = {f"l{j}": F.lag(value, j).over(order) for j in range(1, k + 1)}
    rows = split.withColumns({**lags, "_rn": F.row_number().over(order)})
    return rows.where(F.col("_rn") > k).drop("_rn").withColumn("target", F.col(value))


def lag_arrays(split: DataFrame, k: int, value: str = "y") -> DataFrame:
    """Like :func:`lag_windows` with the window as one array, oldest day first."""
    wide = lag_windows(split, k, value)
    lags = [f"l{j}" for j in range(k, 0, -1)]
    return wide.withColumn("x", F.array(*lags)).drop(*lags)


def forecast_overlay(forecast: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(series_id, step, segment, value): history, then true values and predictions.

    Steps are numbered per series, training rows first; each test row gives two
    points at the same step.
    """
    order = day_window()

    def point(name, col):
        return F.struct(F.lit(name).alias("segment"), F.col(col).alias("value"))

    points = F.when(F.col("split") == "train", F.array(point("history", actual))).otherwise(
        F.array(point("true", actual), point("prediction", predicted))
    )
    return (
        forecast.withColumn("step", F.row_number().over(order) - 1)
        .withColumn("_p", F.explode(points))
        .select("series_id", "step", "_p.segment", "_p.value")
    )
