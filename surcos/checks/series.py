"""Splits, daily series, forecasts and their errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from surcos.checks.registry import query
from surcos.checks.relational import rounded
from surcos.checks.standins import INVOICES_SQL, TRAFFIC_SQL, invoices, load, traffic
from surcos.operators import forecast as fc
from surcos.operators import metrics, order, split
from surcos.operators import timeseries as ts
from surcos.plans import daily as plan
from surcos.sources.scratch import materialise

N_TEST = 100


def invoice_days(spark, sf):
    return ts.daily_totals(invoices(spark, sf), "serie", "Fecha", "total")


def traffic_days(spark, sf):
    return ts.daily_totals(traffic(spark, sf), "serie", "Fecha", "Trafico")


def prepared(spark, sf):
    return plan.prepared(invoices(spark, sf), "serie", "Fecha", "total", N_TEST)


BUCKET = "CAST(('0x' || substr(md5({k}), 1, 8)) AS BIGINT) % 100"

SPLIT_SQL = INVOICES_SQL + f""",
parts AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) <= {N_TEST}
                         THEN 'test' ELSE 'train' END AS split FROM daily),
ranges AS (SELECT series_id, min(y) AS y_min, max(y) AS y_max FROM parts
           WHERE split = 'train' GROUP BY series_id),
scaled AS (SELECT p.*, y_min, y_max, (y - y_min) / nullif(y_max - y_min, 0) AS z
           FROM parts p JOIN ranges r ON r.series_id = p.series_id),
windows AS (SELECT *, lag(z) OVER w AS l1, z AS target, row_number() OVER w AS rn FROM scaled
            WINDOW w AS (PARTITION BY series_id, split ORDER BY ds)),
samples AS (SELECT * FROM windows WHERE rn > 1),
fit AS (SELECT series_id, regr_slope(target, l1) AS slope, regr_intercept(target, l1) AS intercept,
               count(*) AS n
        FROM samples WHERE split = 'train' GROUP BY series_id),
forecasts AS (SELECT s.series_id, s.ds, s.split, s.y AS actual,
                     (slope * l1 + intercept) * (y_max - y_min) + y_min AS predicted
              FROM samples s JOIN fit f ON f.series_id = s.series_id)
"""


# --- splits -------------------------------------------------------------------

@query("hash_split", f"""SELECT o_orderkey,
  CASE WHEN {BUCKET.format(k="CAST(o_orderkey AS VARCHAR)")} < 70 THEN 'train' ELSE 'test' END AS split
  FROM orders""")
def hash_split(spark, sf):
    return split.hash_split(load(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


ROUNDS_SQL = f"""rounds AS (
  SELECT o_orderkey, o_totalprice, r AS round,
    CASE WHEN {BUCKET.format(k="CAST(o_orderkey AS VARCHAR) || '#' || CAST(r AS VARCHAR)")} < 70
         THEN 'train' ELSE 'test' END AS split
  FROM orders, (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS r))"""


@query("holdout_rounds", f"WITH {ROUNDS_SQL} SELECT * FROM rounds")
def holdout_rounds(spark, sf):
    df = load(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return split.holdout_rounds(df, "o_orderkey")


@query("mean_of_rounds", f"""WITH {ROUNDS_SQL}
  SELECT round(avg(m), 4) AS mean_metric
  FROM (SELECT round, avg(o_totalprice) AS m FROM rounds WHERE split = 'test' GROUP BY round)""")
def mean_of_rounds(spark, sf):
    df = split.holdout_rounds(load(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    per_round = df.where("split = 'test'").groupBy("round").agg(F.avg("o_totalprice").alias("metric"))
    return rounded(metrics.mean_metric(per_round, "metric"), 4, "mean_metric")


@query("hash_sample", f"""SELECT c_custkey, c_name FROM customer
  WHERE {BUCKET.format(k="CAST(c_custkey AS VARCHAR) || 'sample'")} < 50""")
def hash_sample(spark, sf):
    return split.hash_sample(load(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey", 50)


@query("random_split")
def random_split(spark, sf):
    train, test = split.random_split(load(spark, sf, "orders").select("o_orderkey"))
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


@query("bernoulli_sample")
def bernoulli_sample(spark, sf):
    return split.bernoulli_sample(load(spark, sf, "orders").select("o_orderkey"), 0.5)


@query("chrono_split", f"WITH {SPLIT_SQL} SELECT series_id, ds, split FROM parts")
def chrono_split(spark, sf):
    return split.chronological_split(invoice_days(spark, sf), N_TEST).select("series_id", "ds", "split")


@query("first_last_n", f"""WITH {INVOICES_SQL},
  n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds) AS a,
               row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) AS b FROM daily)
  SELECT series_id, ds, round(y, 2) AS y, 'first' AS part FROM n WHERE a <= 10
  UNION ALL SELECT series_id, ds, round(y, 2) AS y, 'last' AS part FROM n WHERE b <= 5""")
def first_last_n(spark, sf):
    days = invoice_days(spark, sf)
    ends = order.first_n(days, 10).withColumn("part", F.lit("first")).unionByName(
        order.last_n(days, 5).withColumn("part", F.lit("last"))
    )
    return rounded(ends, 2, "y")


# --- daily series -------------------------------------------------------------

@query("daily_resample", f"WITH {INVOICES_SQL} SELECT series_id, ds, round(y, 2) AS y FROM daily")
def daily_resample(spark, sf):
    return rounded(invoice_days(spark, sf), 2, "y")


@query("daily_traffic", f"WITH {TRAFFIC_SQL} SELECT series_id, ds, round(y, 2) AS y FROM daily")
def daily_traffic(spark, sf):
    return rounded(traffic_days(spark, sf), 2, "y")


def decompose_sql(p: int) -> str:
    h = p // 2
    half = f"- (lag(y, {h}) OVER d + lead(y, {h}) OVER d) / 2" if p % 2 == 0 else ""
    return f"""WITH {INVOICES_SQL},
  t AS (SELECT *, row_number() OVER d - 1 AS i,
          CASE WHEN count(*) OVER a = {2 * h + 1} AND count(*) OVER (PARTITION BY series_id) >= {2 * p}
               THEN (sum(y) OVER a {half}) / {p} END AS trend
        FROM daily WINDOW d AS (PARTITION BY series_id ORDER BY ds),
          a AS (PARTITION BY series_id ORDER BY ds ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)),
  m AS (SELECT series_id, i % {p} AS phase, avg(y - trend) AS mean FROM t GROUP BY ALL),
  c AS (SELECT series_id, avg(mean) AS shift FROM m GROUP BY series_id)
  SELECT t.series_id, ds, round(y, 2) AS y, round(trend, 5) AS trend,
         round(mean - shift, 5) AS seasonal, round(y - trend - (mean - shift), 5) AS resid
  FROM t JOIN m ON m.series_id = t.series_id AND m.phase = i % {p}
  JOIN c ON c.series_id = t.series_id"""


def _decomposed(spark, sf, period):
    df = ts.decompose(invoice_days(spark, sf), period)
    return rounded(rounded(df, 2, "y"), 5, "trend", "seasonal", "resid")


@query("decompose_7", decompose_sql(7))
def decompose_7(spark, sf):
    return _decomposed(spark, sf, 7)


@query("decompose_60", decompose_sql(60))
def decompose_60(spark, sf):
    return _decomposed(spark, sf, 60)


@query("minmax_scale", f"""WITH {SPLIT_SQL}
  SELECT series_id, ds, split, round(y_min, 2) AS y_min, round(y_max, 2) AS y_max, round(z, 9) AS z
  FROM scaled""")
def minmax_scale(spark, sf):
    df = rounded(rounded(prepared(spark, sf), 9, "z"), 2, "y_min", "y_max")
    return df.select("series_id", "ds", "split", "y_min", "y_max", "z")


@query("unscale", f"""WITH {SPLIT_SQL}
  SELECT series_id, ds, split, round(z * (y_max - y_min) + y_min, 2) AS y FROM scaled""")
def unscale(spark, sf):
    back = ts.minmax_unscale(prepared(spark, sf).drop("y"), {"z": "y"})
    return rounded(back, 2, "y").select("series_id", "ds", "split", "y")


def lag_sql(k: int) -> str:
    lags = ", ".join(f"lag(z, {j}) OVER w AS l{j}" for j in range(1, k + 1))
    shown = ", ".join(f"round(l{j}, 9) AS l{j}" for j in range(1, k + 1))
    return f"""WITH {SPLIT_SQL},
  lagged AS (SELECT series_id, ds, split, z, {lags}, row_number() OVER w AS rn FROM scaled
             WINDOW w AS (PARTITION BY series_id, split ORDER BY ds))
  SELECT series_id, ds, split, round(z, 9) AS target, {shown} FROM lagged WHERE rn > {k}"""


def _lagged(k):
    def run(spark, sf):
        lags = [f"l{j}" for j in range(1, k + 1)]
        df = ts.lag_windows(prepared(spark, sf), k, "z")
        return rounded(df, 9, "target", *lags).select("series_id", "ds", "split", "target", *lags)

    return run


for _k in (1, 7, 14, 30):
    query(f"lag_windows_{_k}", lag_sql(_k))(_lagged(_k))


@query("lag_arrays_7")
def lag_arrays_7(spark, sf):
    return ts.lag_arrays(prepared(spark, sf), 7, "z").select("series_id", "ds", "split", "x", "target")


# --- forecasts ----------------------------------------------------------------

def one_step(spark, sf, k=1, pooled=False):
    return plan.forecasts(
        invoices(spark, sf), "serie", "Fecha", "total", n_test=N_TEST, k=k, pooled=pooled
    )


@query("ar1_fit", f"""WITH {SPLIT_SQL}
  SELECT series_id, round(slope, 7) AS slope, round(intercept, 7) AS intercept, n FROM fit""")
def ar1_fit(spark, sf):
    fit = fc.ar1_fit(ts.lag_windows(prepared(spark, sf), 1, "z"))
    return rounded(fit, 7, "slope", "intercept")


@query("ar1_forecast", f"""WITH {SPLIT_SQL}
  SELECT series_id, ds, split, round(actual, 2) AS actual, round(predicted, 3) AS predicted
  FROM forecasts""")
def ar1_forecast(spark, sf):
    return rounded(rounded(one_step(spark, sf), 2, "actual"), 3, "predicted")


@query("ar_2_forecast", f"""WITH {SPLIT_SQL},
  two AS (SELECT series_id, ds, split, y, z, y_min, y_max, lag(z, 1) OVER w AS a, lag(z, 2) OVER w AS b,
                 row_number() OVER w AS rn
          FROM scaled WINDOW w AS (PARTITION BY series_id, split ORDER BY ds)),
  m AS (SELECT series_id, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab,
               covar_pop(a, z) AS az, covar_pop(b, z) AS bz, avg(a) AS ma, avg(b) AS mb, avg(z) AS mz
        FROM two WHERE rn > 2 AND split = 'train' GROUP BY series_id),
  c AS (SELECT *, (bb * az - ab * bz) / (aa * bb - ab * ab) AS wa,
               (aa * bz - ab * az) / (aa * bb - ab * ab) AS wb FROM m)
  SELECT two.series_id, ds, split, round(y, 2) AS actual,
         round((wa * a + wb * b + mz - wa * ma - wb * mb) * (y_max - y_min) + y_min, 3) AS predicted
  FROM two JOIN c ON c.series_id = two.series_id WHERE rn > 2""")
def ar_2_forecast(spark, sf):
    """The smallest case of the k-lag fit, where the solution can be written out."""
    return rounded(rounded(one_step(spark, sf, 2), 2, "actual"), 3, "predicted")


@query("ar_7_forecast")
def ar_7_forecast(spark, sf):
    return one_step(spark, sf, 7)


@query("ar_14_forecast")
def ar_14_forecast(spark, sf):
    return one_step(spark, sf, 14)


@query("ar_30_forecast")
def ar_30_forecast(spark, sf):
    return one_step(spark, sf, 30)


@query("ar_7_pooled_forecast")
def ar_7_pooled_forecast(spark, sf):
    return one_step(spark, sf, 7, pooled=True)


def echo_sql(k: int, units: int) -> str:
    """Every day of the window as a table of its own, with one column per unit."""
    weights, biases = fc.echo_weights(units)
    step = ", ".join(
        f"tanh({fc.RING} * u{(i - 1) % units} + {w} * (2 * x{{d}} - 1) + {b}) AS u{i}" for i, (w, b) in enumerate(zip(weights, biases))
    )
    lags = ", ".join(f"lag(z, {k - d}) OVER w AS x{d}" for d in range(k))
    days = ", ".join(
        f"day{d + 1} AS (SELECT series_id, ds, {', '.join(f'x{j}' for j in range(k))}, {step.format(d=d)} FROM day{d})" for d in range(k)
    )
    start = ", ".join(f"0.0::DOUBLE AS u{i}" for i in range(units))
    shown = ", ".join(f"round(u{i}, 9) AS u{i}" for i in range(units))
    return f"""WITH {SPLIT_SQL},
  lagged AS (SELECT series_id, split, ds, {lags}, row_number() OVER w AS rn FROM scaled
             WINDOW w AS (PARTITION BY series_id, split ORDER BY ds)),
  day0 AS (SELECT *, {start} FROM lagged WHERE rn > {k}), {days}
  SELECT series_id, ds, {shown} FROM day{k}"""


@query("echo_states_7", echo_sql(7, 6))
def echo_states_7(spark, sf):
    """States of a small recurrent ring after every window of seven days."""
    states = fc.echo_states(ts.lag_arrays(prepared(spark, sf), 7, "z"), 6)
    return states.select("series_id", "ds", *[F.round(F.get("state", F.lit(i)), 9).alias(f"u{i}") for i in range(6)])


@query("echo_7_forecast")
def echo_7_forecast(spark, sf):
    """Forecasts by the readout of a recurrent state."""
    return plan.forecasts(invoices(spark, sf), "serie", "Fecha", "total", n_test=N_TEST, k=7, units=fc.UNITS)


@query("ar_traffic_forecast")
def ar_traffic_forecast(spark, sf):
    return plan.forecasts(traffic(spark, sf), "serie", "Fecha", "Trafico", n_test=9, k=7)


@query("forecast_overlay", f"""WITH {SPLIT_SQL},
  s AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS step FROM forecasts)
  SELECT series_id, CAST(step AS INTEGER) AS step, 'history' AS segment, round(actual, 2) AS value
  FROM s WHERE split = 'train'
  UNION ALL SELECT series_id, CAST(step AS INTEGER), 'true', round(actual, 2) FROM s WHERE split = 'test'
  UNION ALL SELECT series_id, CAST(step AS INTEGER), 'prediction', round(predicted, 2)
  FROM s WHERE split = 'test'""")
def forecast_overlay(spark, sf):
    return rounded(ts.forecast_overlay(one_step(spark, sf), "actual", "predicted"), 2, "value")


@query("rmse", f"""WITH {SPLIT_SQL}
  SELECT series_id, round(sqrt(avg((actual - predicted) * (actual - predicted))), 3) AS rmse
  FROM forecasts WHERE split = 'test' GROUP BY series_id""")
def rmse(spark, sf):
    return rounded(plan.errors(one_step(spark, sf)), 3, "rmse").select("series_id", "rmse")


@query("mape", f"""WITH {SPLIT_SQL}
  SELECT series_id, round(avg(abs((actual - predicted) / nullif(actual, 0))) * 100, 5) AS mape,
         count(*) FILTER (WHERE actual = 0) AS zero_days
  FROM forecasts WHERE split = 'test' GROUP BY series_id""")
def mape(spark, sf):
    return rounded(plan.errors(one_step(spark, sf)), 5, "mape").select("series_id", "mape", "zero_days")


@query("rmse_by_lags")
def rmse_by_lags(spark, sf):
    """Test errors of the same series for 1, 7 and 14 lags."""
    days = materialise(prepared(spark, sf), "days")
    parts = [plan.errors(fc.forecast(days, k)).withColumn("lags", F.lit(k)) for k in (1, 7, 14)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
