"""Summaries, distributions and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from surcos.checks.registry import query
from surcos.checks.relational import MEANS, bank_means, rounded
from surcos.checks.standins import (
    BANK_SQL, CALLS_SQL, FREQUENCY, INVOICES_SQL, STATUSES, bank, calls, invoices, load,
)
from surcos.operators import aggregate, quantiles
from surcos.operators.timeseries import daily_totals
from surcos.plans import credit, telecom
from surcos.sources.scratch import materialise
from surcos.sources.tables import fresh_name, retire_versions

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _stats_sql(table: str, columns: list[str]) -> str:
    one = """SELECT '{c}' AS "column", unnest(['count', 'mean', 'stddev', 'min', 'max']) AS stat,
             unnest([CAST(count({c}) AS DOUBLE), round(avg({c}), 6), round(stddev_samp({c}), 6),
                     min({c}), max({c})]) AS value FROM {t}"""
    return " UNION ALL ".join(one.format(c=c, t=table) for c in columns)


@query("account_summary", f"""WITH {BANK_SQL}
  SELECT act_id AS account_id, operation, {MEANS}, cantidad_transacciones FROM turnover""")
def account_summary(spark, sf):
    return bank_means(credit.transaction_summary(bank(spark, sf).trans))


@query("appended_summary", f"""WITH {BANK_SQL}
  SELECT act_id AS account_id, operation, {MEANS}, cantidad_transacciones FROM turnover""")
def appended_summary(spark, sf):
    """The summary of all transactions, brought up to date by three appends of a part of them each."""
    trans, name = bank(spark, sf).trans, fresh_name(spark, "turnover")
    for part in range(3):
        summary = credit.append_transactions(spark, name, trans.where(F.pmod(F.xxhash64(*trans.columns), F.lit(3)) == part))
    retire_versions(spark, name)
    return bank_means(summary)


@query("distribution_one_key", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority")
def distribution_one_key(spark, sf):
    return aggregate.distribution(load(spark, sf, "orders"), "o_orderpriority")


@query("count_by_two_keys", f"""WITH {CALLS_SQL}
  SELECT state, churn, count(*) AS n FROM calls GROUP BY state, churn""")
def count_by_two_keys(spark, sf):
    return aggregate.distribution(telecom.cleaned(calls(spark, sf)), "state", "churn")


@query("group_means", f"""WITH {CALLS_SQL}
  SELECT state, round(avg(number_vmail_messages), 6) AS number_vmail_messages,
         round(avg(number_customer_service_calls), 6) AS number_customer_service_calls
  FROM calls GROUP BY state""")
def group_means(spark, sf):
    columns = ["number_vmail_messages", "number_customer_service_calls"]
    df = telecom.cleaned(calls(spark, sf)).select("state", *columns)
    return rounded(aggregate.group_means(df, "state"), 6, *columns)


@query("value_counts", """SELECT event_type, count(*) AS n FROM events
  WHERE event_type IS NOT NULL GROUP BY event_type ORDER BY n DESC, event_type""")
def value_counts(spark, sf):
    return aggregate.value_counts(load(spark, sf, "events"), "event_type")


@query("shape", "SELECT count(*) AS n_rows, 11 AS n_columns FROM lineitem")
def shape(spark, sf):
    return aggregate.shape(load(spark, sf, "lineitem"))


NULLABLE = ["client_id", "region", "operation", "cantidad_transacciones", "loan_id"]


@query("null_counts", f"WITH {BANK_SQL} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) - count({c}) AS n_null FROM minable""" for c in NULLABLE
))
def null_counts(spark, sf):
    return aggregate.null_counts(credit.minable(bank(spark, sf), FREQUENCY).select(*NULLABLE))


@query("describe_long", _stats_sql("lineitem", MEASURES))
def describe_long(spark, sf):
    df = aggregate.describe_long(load(spark, sf, "lineitem"), MEASURES)
    soft = F.col("stat").isin("mean", "stddev")
    return df.withColumn("value", F.when(soft, F.round("value", 6)).otherwise(F.col("value")))


TEXT_STATS = ("c_name", "c_mktsegment")


@query("describe_text", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", unnest(['count', 'mean', 'stddev', 'min', 'max']) AS stat,
        unnest([CAST(count({c}) AS VARCHAR), CAST(avg(TRY_CAST({c} AS DOUBLE)) AS VARCHAR),
                CAST(stddev_samp(TRY_CAST({c} AS DOUBLE)) AS VARCHAR), min({c}), max({c})]) AS value FROM customer"""
    for c in TEXT_STATS
) + """ UNION ALL SELECT 'c_custkey', 'count', CAST(count(c_custkey) AS VARCHAR) FROM customer
  UNION ALL SELECT 'c_custkey', 'min', CAST(min(c_custkey) AS VARCHAR) FROM customer
  UNION ALL SELECT 'c_custkey', 'max', CAST(max(c_custkey) AS VARCHAR) FROM customer""")
def describe_text(spark, sf):
    """Text columns with all their figures; of a number only those that are written alike everywhere."""
    stats = aggregate.describe_long(load(spark, sf, "customer"), [*TEXT_STATS, "c_custkey"])
    return stats.where("column <> 'c_custkey' OR stat IN ('count', 'min', 'max')")


@query("summary_rank_error", """SELECT c AS "column", s AS stat, true AS within
  FROM (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS c),
       (SELECT unnest(['25%', '50%', '75%']) AS s)""")
def summary_rank_error(spark, sf):
    """Approximate quartiles: is the rank of each within 1 / accuracy of the one asked for?"""
    table, columns = load(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    quartiles = aggregate.summary_approx(table, columns).where("stat LIKE '%\\%'")
    long = table.select(F.expr("stack(4, " + ", ".join(f"'{c}', {c}" for c in columns) + ") AS (c, v)"))
    ranks = long.join(F.broadcast(quartiles), F.col("c") == F.col("column")).groupBy("column", "stat").agg(
        F.count_if(F.col("v") < F.col("value")).alias("below"), F.count_if(F.col("v") <= F.col("value")).alias("upto"), F.count("v").alias("n"))
    wanted = F.regexp_extract("stat", "[0-9]+", 0).cast("double") / 100 * F.col("n")
    slack = F.col("n") / 10_000 + 1
    return ranks.select("column", "stat", ((F.col("below") <= wanted + slack) & (F.col("upto") >= wanted - slack)).alias("within"))


@query("summary_approx")
def summary_approx(spark, sf):
    return aggregate.summary_approx(load(spark, sf, "lineitem"), MEASURES)


@query("series_describe", f"""WITH {INVOICES_SQL}
  SELECT series_id, count(y) AS "count", round(avg(y), 4) AS mean, round(stddev_samp(y), 4) AS std,
         round(min(y), 2) AS min, round(quantile_cont(y, 0.25), 4) AS p25,
         round(quantile_cont(y, 0.5), 4) AS p50, round(quantile_cont(y, 0.75), 4) AS p75,
         round(max(y), 2) AS max
  FROM daily GROUP BY series_id""")
def series_describe(spark, sf):
    daily = daily_totals(invoices(spark, sf), "serie", "Fecha", "total")
    df = aggregate.describe_groups(daily, "series_id", "y")
    return rounded(rounded(df, 4, "mean", "std", "p25", "p50", "p75"), 2, "min", "max")


@query("quartiles_exact", """SELECT p, CASE p WHEN 0.25 THEN round(a, 6) WHEN 0.5 THEN round(b, 6)
              ELSE round(c, 6) END AS value
  FROM (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.5) AS b,
               quantile_cont(l_extendedprice, 0.75) AS c FROM lineitem),
       (SELECT CAST(unnest([0.25, 0.5, 0.75]) AS DOUBLE) AS p)""")
def quartiles_exact(spark, sf):
    return rounded(quantiles.quartiles_exact(load(spark, sf, "lineitem"), "l_extendedprice"), 6, "value")


@query("daily_quantiles", """SELECT event_type, p, count(value) AS n, true AS within
  FROM events, (SELECT CAST(unnest([0.25, 0.5, 0.75]) AS DOUBLE) AS p)
  GROUP BY event_type, p HAVING count(value) > 0""")
def daily_quantiles(spark, sf):
    """Quartiles per key from merged daily summaries: is the rank of each within the stated error?"""
    table = load(spark, sf, "events")
    days = table.withColumn("day", F.to_date("ts"))
    keys = ["event_type"]
    stored = materialise(quantiles.quantile_states(days, [*keys, "day"], "value"), "daily-quantiles")
    merged = quantiles.merge_quantile_states(stored.drop("day"), keys)
    read = materialise(quantiles.quantiles_of(merged, keys), "quantiles")
    named = read.select(F.col("event_type").alias("_k"), "p", F.col("value").alias("_q"), "n", "error")
    ranks = table.join(named, F.col("event_type").eqNullSafe(F.col("_k"))).groupBy("event_type", "p", "n", "error").agg(
        F.count_if(F.col("value") < F.col("_q")).alias("below"), F.count_if(F.col("value") <= F.col("_q")).alias("upto"))
    wanted = F.col("p") * F.col("n")
    within = (F.col("below") <= wanted + F.col("error")) & (F.col("upto") >= wanted - F.col("error"))
    return ranks.select("event_type", "p", "n", within.alias("within"))


@query("min_max", """SELECT min(o_totalprice) AS o_totalprice_min, max(o_totalprice) AS o_totalprice_max,
  min(o_orderkey) AS o_orderkey_min, max(o_orderkey) AS o_orderkey_max FROM orders""")
def min_max(spark, sf):
    return aggregate.min_max(load(spark, sf, "orders"), ["o_totalprice", "o_orderkey"])


@query("histogram", """WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
  b AS (SELECT CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, lo, hi
        FROM orders, s)
  SELECT bin, round(min(lo) + bin * ((min(hi) - min(lo)) / 20), 6) AS lo,
         round(min(lo) + (bin + 1) * ((min(hi) - min(lo)) / 20), 6) AS hi, count(*) AS n
  FROM b GROUP BY bin""")
def histogram(spark, sf):
    return rounded(aggregate.histogram(load(spark, sf, "orders"), "o_totalprice", 20), 6, "lo", "hi")


PROFILED = ["region", "frecuencia_emision", "operation", "candidato"]


@query("profile", f"WITH {BANK_SQL} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {c} AS value, count(*) AS n FROM model GROUP BY {c}""" for c in PROFILED
))
def profile(spark, sf):
    df = credit.candidates(bank(spark, sf), FREQUENCY, STATUSES)
    return aggregate.profile(df, PROFILED)
