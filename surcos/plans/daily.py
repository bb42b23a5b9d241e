"""Daily forecasting for many series: dated events to forecasts and their errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surcos.operators.clean import drop_nulls
from surcos.operators.forecast import forecast
from surcos.operators.metrics import forecast_errors
from surcos.operators.split import chronological_split
from surcos.operators.timeseries import daily_totals, minmax_scale
from surcos.sources.scratch import materialise


def prepared(events: DataFrame, series: str | None, date: str, value: str, n_test: int) -> DataFrame:
    """Gap-free daily totals, split in time, scaled with the training range."""
    clean = drop_nulls(events.select(*([series] if series else []), date, value))
    return minmax_scale(chronological_split(daily_totals(clean, series, date, value), n_test))


def forecasts(
    events: DataFrame, series: str | None, date: str, value: str, *, n_test: int, k: int,
    pooled: bool = False, units: int = 0,
) -> DataFrame:
    """The whole analysis up to (series_id, ds, split, actual, predicted).

    Where the days are read once to fit and once to apply, they are written first, so
    the events are read once. Shuffled by series when read again, they need no other
    shuffle for windows, fit and join.
    """
    days = prepared(events, series, date, value, n_test)
    if k == 1 and not pooled and not units:
        return forecast(days, k)
    # A struct is never null, so events without a series are one in the joins as well.
    keyed = materialise(days.withColumn("series_id", F.struct("series_id")), "days")
    return forecast(keyed.repartition("series_id"), k, pooled=pooled, units=units).withColumn("series_id", F.col("series_id.series_id"))


def errors(forecasted: DataFrame) -> DataFrame:
    """RMSE and MAPE of the test part, per series."""
    test = forecasted.where("split = 'test'")
    return forecast_errors(test, "actual", "predicted", "series_id")
