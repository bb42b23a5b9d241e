from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from surcos.operators import forecast as fc
from surcos.operators import metrics, split
from surcos.operators import timeseries as ts
from surcos.plans import daily

DAY0 = dt.date(2024, 1, 1)


def day(i):
    return DAY0 + dt.timedelta(days=i)


def series(spark, **values):
    data = [(s, day(i), float(v)) for s, ys in values.items() for i, v in enumerate(ys)]
    random.Random(0).shuffle(data)
    return spark.createDataFrame(data, "series_id string, ds date, y double").repartition(3)


def by_day(df, column, name):
    return [r[column] for r in df.where(F.col("series_id") == name).orderBy("ds").collect()]


# --- splits -------------------------------------------------------------------

def test_hash_split_is_stable_and_complete(spark):
    df = spark.range(2000)
    a = split.hash_split(df, "id")
    b = split.hash_split(df.repartition(11), "id")
    assert rows(a) == rows(b)
    train = a.where("split = 'train'").count()
    assert 1300 < train < 1500 and train + a.where("split = 'test'").count() == 2000
    other = split.hash_split(df, "id", salt="#1")
    assert rows(a) != rows(other)


def test_holdout_rounds(spark):
    rounds = split.holdout_rounds(spark.range(1000), "id", 3)
    assert rounds.count() == 3000
    members = [set(r[0] for r in rounds.where(f"round = {i} AND split = 'test'").select("id").collect()) for i in range(3)]
    assert all(200 < len(m) < 400 for m in members)
    assert members[0] != members[1] != members[2]


def test_samples(spark):
    df = spark.range(1000)
    assert 400 < split.hash_sample(df, "id", 50).count() < 600
    train, test = split.random_split(df)
    assert train.count() + test.count() == 1000
    assert 400 < split.bernoulli_sample(df, 0.5).count() < 600


def test_chronological_split(spark):
    got = split.chronological_split(series(spark, a=range(10), b=range(2)), 3)
    assert by_day(got, "split", "a") == ["train"] * 7 + ["test"] * 3
    assert by_day(got, "split", "b") == ["test"] * 2


# --- daily series -------------------------------------------------------------

def test_gaps_become_zero_days(spark):
    events = spark.createDataFrame(
        [("a", dt.datetime(2024, 1, 1, 5), 1.0), ("a", dt.datetime(2024, 1, 1, 9), 2.0),
         ("a", dt.datetime(2024, 1, 4), 5.0), ("b", dt.datetime(2024, 2, 28), 1.0),
         ("b", dt.datetime(2024, 3, 1), None), ("b", None, 9.0)],
        "s string, t timestamp_ntz, v double",
    )
    got = ts.daily_totals(events, "s", "t", "v")
    assert [(r["ds"].day, r["y"]) for r in got.where("series_id = 'a'").orderBy("ds").collect()] == [
        (1, 3.0), (2, 0.0), (3, 0.0), (4, 5.0)
    ]
    assert by_day(got, "y", "b") == [1.0, 0.0, 0.0]


def test_one_series_without_a_name(spark):
    got = ts.daily_totals(series(spark, a=[1, 2], b=[3]), None, "ds", "y")
    assert by_day(got, "y", "all") == [4.0, 2.0]
    days = daily.prepared(series(spark, a=[1, 2, 5]), None, "ds", "y", 1)
    assert by_day(days, "z", "all") == [0.0, 1.0, 4.0]


def classical(y, p):
    """The published algorithm, in numpy."""
    n, h = len(y), p // 2
    taps = np.ones(p) / p if p % 2 else np.r_[0.5, np.ones(p - 1), 0.5] / p
    trend = np.full(n, np.nan)
    for i in range(h, n - h):
        trend[i] = np.dot(taps, y[i - h : i + h + 1])
    means = np.array([np.nanmean((y - trend)[k::p]) for k in range(p)])
    seasonal = np.resize(means - means.mean(), n)
    return trend, seasonal, y - trend - seasonal


@pytest.mark.parametrize("p", [4, 7, 60])
def test_decompose_equals_numpy(spark, p):
    rnd = random.Random(p)
    ys = {"a": [rnd.gauss(100, 10) for _ in range(2 * p + 9)], "b": [rnd.random() for _ in range(3 * p)]}
    got = ts.decompose(series(spark, **ys), p)
    for name, y in ys.items():
        for column, want in zip(("trend", "seasonal", "resid"), classical(np.array(y), p)):
            have = np.array([math.nan if v is None else v for v in by_day(got, column, name)])
            np.testing.assert_allclose(have, want, atol=1e-9)


@pytest.mark.parametrize("p", [4, 7])
def test_noise_free_series_leaves_no_residual(spark, p):
    pattern = np.arange(p) - (p - 1) / 2
    y = [3.0 * i + pattern[i % p] for i in range(6 * p)]
    resid = [r for r in by_day(ts.decompose(series(spark, a=y), p), "resid", "a") if r is not None]
    assert len(resid) == 6 * p - 2 * (p // 2) and max(map(abs, resid)) < 1e-9


def test_short_series_has_no_components(spark):
    got = ts.decompose(series(spark, a=range(13)), 7)
    assert got.count() == 13
    assert got.where("trend IS NOT NULL OR seasonal IS NOT NULL OR resid IS NOT NULL").count() == 0


def test_scaling_uses_training_range_and_is_undone(spark):
    parts = split.chronological_split(series(spark, a=[0, 5, 10, 20], c=[4, 4, 4, 9]), 1)
    scaled = ts.minmax_scale(parts)
    assert by_day(scaled, "z", "a") == [0.0, 0.5, 1.0, 2.0]
    assert by_day(scaled, "z", "c") == [None] * 4
    back = ts.minmax_unscale(scaled, {"z": "again"})
    assert by_day(back, "again", "a") == by_day(back, "y", "a")


def test_lag_windows_do_not_cross_the_split(spark):
    parts = split.chronological_split(series(spark, a=range(10), b=range(3)), 4)
    got = ts.lag_windows(parts, 2)
    pairs = rows(got.where("series_id = 'a'"), "split", "l2", "l1", "target")
    assert pairs == [("test", 6.0, 7.0, 8.0), ("test", 7.0, 8.0, 9.0)] + [
        ("train", float(i), i + 1.0, i + 2.0) for i in range(4)
    ]
    assert rows(got.where("series_id = 'b'"), "l2", "l1", "target") == [(0.0, 1.0, 2.0)]
    assert ts.lag_windows(parts, 9).count() == 0
    arrays = ts.lag_arrays(parts, 2).where("series_id = 'b'").first()
    assert arrays["x"] == [0.0, 1.0] and arrays["target"] == 2.0


def test_series_windows_share_one_shuffle(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = ts.minmax_scale(split.chronological_split(series(spark, a=range(9)).repartition(5), 2))
        plan = fc.ar1_forecast(ts.lag_windows(parts, 1, "z"))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(series_id") == 1
        assert "SinglePartition" not in plan and "Join" not in plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


# --- forecasts ----------------------------------------------------------------

def noisy(seed, n=80):
    rnd, y = random.Random(seed), [10.0]
    for _ in range(n - 1):
        y.append(4 + 0.6 * y[-1] + rnd.gauss(0, 1))
    return y


def scaled(spark, n_test=15, **ys):
    return ts.minmax_scale(split.chronological_split(series(spark, **ys), n_test))


def test_ar1_equals_least_squares_per_series(spark):
    ys = {"a": noisy(1), "b": noisy(2)}
    windows = ts.lag_windows(scaled(spark, **ys), 1, "z")
    fit = {r["series_id"]: r for r in fc.ar1_fit(windows).collect()}
    predicted = fc.ar1_forecast(windows)
    for name, y in ys.items():
        train = np.array(y[:-15])
        z = (np.array(y) - train.min()) / (train.max() - train.min())
        slope, intercept = np.polyfit(z[:64], z[1:65], 1)
        assert (fit[name]["slope"], fit[name]["intercept"]) == pytest.approx((slope, intercept))
        test = predicted.where("split = 'test'")
        assert by_day(test, "predicted", name) == pytest.approx(list(slope * z[65:79] + intercept))


def least_squares(y, k, n_train):
    z = (np.array(y) - min(y[:n_train])) / (max(y[:n_train]) - min(y[:n_train]))
    x = np.array([[*z[i - k : i], 1.0] for i in range(k, n_train)])
    return z, np.linalg.lstsq(x, z[k:n_train], rcond=None)[0]


def test_ar_k_equals_least_squares_per_series(spark):
    ys = {"a": noisy(3, 120), "b": noisy(8, 60)}
    got = fc.forecast(scaled(spark, **ys), 3).where("split = 'test'")
    for name, y in ys.items():
        n = len(y) - 15
        z, want = least_squares(y, 3, n)
        lo, hi = min(y[:n]), max(y[:n])
        expected = [(np.dot(want[:3], z[i - 3 : i]) + want[3]) * (hi - lo) + lo for i in range(n + 3, len(y))]
        assert by_day(got, "predicted", name) == pytest.approx(expected)
        assert by_day(got, "actual", name) == y[n + 3 :]


def test_series_too_short_for_training_samples(spark):
    df = scaled(spark, a=noisy(3, 60), b=noisy(4, 17))
    got = fc.forecast(df, 3).where("split = 'test'")
    assert by_day(got, "predicted", "b") == [None] * 12
    assert None not in by_day(got, "predicted", "a")


def test_pooled_equals_least_squares_for_one_series(spark):
    y = noisy(3, 120)
    df = scaled(spark, a=y)
    windows = ts.lag_windows(df, 3, "z")
    model = fc.ar_fit_pooled(windows, 3)
    _, want = least_squares(y, 3, 105)
    assert list(model.coefficients)[::-1] == pytest.approx(list(want[:3]), abs=1e-8)
    assert model.intercept == pytest.approx(want[3], abs=1e-8)
    each = by_day(fc.forecast(df, 3), "predicted", "a")
    assert by_day(fc.forecast(df, 3, pooled=True), "predicted", "a") == pytest.approx(each)


def states_by_hand(z, k, units):
    weights, biases = map(np.array, fc.echo_weights(units))
    out = []
    for i in range(k, len(z)):
        state = np.zeros(units)
        for x in z[i - k : i]:
            state = np.tanh(fc.RING * np.roll(state, 1) + weights * (2 * x - 1) + biases)
        out.append(state)
    return np.array(out)


def chaotic(start, n=160):
    """The logistic map: the next day is a parabola of this one, no line fits it."""
    y = [start]
    for _ in range(n - 1):
        y.append(3.9 * y[-1] * (1 - y[-1]))
    return [100 * v for v in y]


def test_echo_forecast_is_the_readout_of_folded_states(spark):
    ys = {"a": chaotic(0.3), "b": chaotic(0.61, 120)}
    df, k, units = scaled(spark, **ys), 5, 8
    states = fc.echo_states(ts.lag_arrays(df, k, "z"), units)
    got = fc.forecast(df, k, units=units).where("split = 'test'")
    for name, y in ys.items():
        n = len(y) - 15
        z = (np.array(y) - min(y[:n])) / (max(y[:n]) - min(y[:n]))
        train, test = states_by_hand(z[:n], k, units), states_by_hand(z[n:], k, units)
        mine = {r["ds"]: r["state"] for r in states.where(f"series_id = '{name}' AND split = 'train'").collect()}
        assert np.allclose([mine[d] for d in sorted(mine)], train, atol=1e-12)
        off, mean = train - train.mean(axis=0), z[k:n].mean()
        size = np.sqrt((off**2).mean(axis=0))
        gram = (off / size).T @ (off / size) / len(off) + fc.RIDGE * np.eye(units)
        w = np.linalg.solve(gram, (off / size).T @ (z[k:n] - mean) / len(off)) / size
        expected = ((test - train.mean(axis=0)) @ w + mean) * (max(y[:n]) - min(y[:n])) + min(y[:n])
        assert by_day(got, "predicted", name) == pytest.approx(list(expected), rel=1e-5)


def test_echo_forecast_follows_what_no_line_can(spark):
    df = scaled(spark, a=chaotic(0.3), b=chaotic(0.61))
    error = lambda f: {r["series_id"]: r["rmse"] for r in daily.errors(f).collect()}
    linear, echo = error(fc.forecast(df, 7)), error(fc.forecast(df, 7, units=fc.UNITS))
    assert all(echo[s] < 0.2 * linear[s] for s in ("a", "b"))


def test_echo_forecast_of_awkward_series(spark):
    """A constant series, one too short, one with missing values, and one without a name."""
    df = ts.minmax_scale(split.chronological_split(series(spark, flat=[5.0] * 40, short=noisy(2, 9)), 5))
    assert {r["predicted"] for r in fc.forecast(df, 3, units=4).collect()} == {None}
    some = scaled(spark, a=noisy(3)).withColumn("z", F.when(F.dayofmonth("ds") != 5, F.col("z")))
    samples = ts.lag_arrays(some, 3, "z")
    got = fc.echo_forecast(samples, 4)
    holes = F.exists("x", lambda v: v.isNull())
    assert got.where(holes & F.col("predicted").isNotNull()).count() == 0
    assert got.where(~holes & F.col("predicted").isNull()).count() == 0
    events = series(spark, a=noisy(5)).withColumn("series_id", F.lit(None).cast("string"))
    known = daily.forecasts(series(spark, a=noisy(5)), "series_id", "ds", "y", n_test=10, k=3, units=4)
    other = daily.forecasts(events.unionByName(series(spark, b=noisy(6))), None, "ds", "y", n_test=10, k=3, units=4)
    assert known.where("predicted IS NULL").count() == 0 and other.where("predicted IS NULL").count() == 0


@pytest.mark.parametrize("kind", [{}, {"units": 4}])
def test_series_without_a_name_are_one_series(spark, kind):
    named = ts.minmax_scale(split.chronological_split(series(spark, a=noisy(5)), 10))
    unnamed = named.withColumn("series_id", F.lit(None).cast("string"))
    value = lambda df: [r["predicted"] for r in fc.forecast(df, 3, **kind).orderBy("ds").collect()]
    assert value(unnamed) == pytest.approx(value(named))


def test_overlay_aligns_truth_and_prediction(spark):
    got = ts.forecast_overlay(fc.forecast(scaled(spark, 4, a=noisy(4, 20)), 1), "actual", "predicted")
    steps = {}
    for r in got.collect():
        steps.setdefault(r["segment"], []).append(r["step"])
    assert sorted(steps["history"]) == list(range(15))
    assert sorted(steps["true"]) == sorted(steps["prediction"]) == [15, 16, 17]


def test_errors_skip_and_count_zero_days(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("a", 2.0, 1.0), ("a", -4.0, -3.0)], "s string, t double, p double")
    got = metrics.forecast_errors(df, "t", "p", "s").first()
    assert got["rmse"] == pytest.approx(1.0)
    assert got["mape"] == pytest.approx((50 + 25) / 2)
    assert got["zero_days"] == 1


def test_fit_and_apply_share_the_partitioning(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = daily.forecasts(series(spark, a=noisy(5)), "series_id", "ds", "y", n_test=10, k=7)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(series_id") == 2  # once per branch
        assert "split#" not in "".join(ln for ln in plan.split("\n") if "Exchange" in ln)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_whole_analysis(spark):
    events = series(spark, a=noisy(5), b=noisy(6))
    errors = daily.errors(daily.forecasts(events, "series_id", "ds", "y", n_test=10, k=7))
    assert {r["series_id"] for r in errors.collect()} == {"a", "b"}
    assert all(0 < r["rmse"] < 5 for r in errors.collect())
