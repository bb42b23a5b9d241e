"""What holds of every fit, split and sample, whatever its random numbers: checked on the fits themselves."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from surcos.checks.models import fitted, loans, segments
from surcos.checks.registry import query
from surcos.checks.series import prepared
from surcos.checks.standins import BANK_SQL, load
from surcos.operators import metrics, models, split
from surcos.operators.forecast import ar_forecast
from surcos.operators.timeseries import lag_arrays
from surcos.sources import tables
from surcos.sources.scratch import materialise

_SERIES = "SELECT DISTINCT o_orderpriority AS series_id, true AS centred, true AS orthogonal FROM orders"
_TESTED = """(('0x' || substr(md5(CAST(loan_id AS VARCHAR)), 1, 8))::BIGINT % 100) >= 70"""


def _residuals(spark, sf, k):
    """Training residuals of a least-squares fit add up to nothing, also weighted by any lag."""
    done = ar_forecast(lag_arrays(prepared(spark, sf), k, "z"), k).where("split = 'train' AND target IS NOT NULL")
    off = done.withColumn("_r", F.col("target") - F.col("predicted"))
    lags = F.array(*[F.abs(F.sum(F.col("_r") * F.get("x", F.lit(i)))) for i in range(k)])
    return off.groupBy("series_id").agg(
        (F.abs(F.sum("_r")) < 1e-6).alias("centred"), (F.array_max(lags) < 1e-6).alias("orthogonal")
    )


@query("ar_7_residuals", _SERIES)
def ar_7_residuals(spark, sf):
    return _residuals(spark, sf, 7)


@query("ar_14_residuals", _SERIES)
def ar_14_residuals(spark, sf):
    return _residuals(spark, sf, 14)


@query("ar_30_residuals", _SERIES)
def ar_30_residuals(spark, sf):
    return _residuals(spark, sf, 30)


def _tested(spark, sf, estimator):
    """Rows of each tested loan, and whether label, prediction and score are possible ones."""
    _, results = fitted(spark, sf, estimator)
    rows = models.scored(results, "loan_id")
    sound = F.col("label").isin(0.0, 1.0) & F.col("prediction").isin(0.0, 1.0) & F.col("probability").between(0, 1)
    return rows.groupBy("loan_id").agg(F.count("*").alias("n"), F.min(sound).alias("sound"))


_TESTED_SQL = f"WITH {BANK_SQL} SELECT loan_id, count(*) AS n, true AS sound FROM model WHERE {_TESTED} GROUP BY loan_id"


@query("logreg_tested", _TESTED_SQL)
def logreg_tested(spark, sf):
    return _tested(spark, sf, models.logistic())


@query("gbt_tested", _TESTED_SQL)
def gbt_tested(spark, sf):
    return _tested(spark, sf, models.boosted_trees())


@query("tree_tested", _TESTED_SQL)
def tree_tested(spark, sf):
    return _tested(spark, sf, models.decision_tree())


@query("scored_rows", f"""WITH {BANK_SQL},
  classes AS (SELECT candidato, row_number() OVER (ORDER BY count(*) DESC, candidato) - 1 AS idx
              FROM model WHERE NOT {_TESTED} GROUP BY candidato)
  SELECT loan_id, CAST(idx AS DOUBLE) AS label, count(*) AS n, true AS agrees
  FROM model JOIN classes ON classes.candidato = model.candidato WHERE {_TESTED} GROUP BY loan_id, idx""")
def scored_rows(spark, sf):
    """Keys and labels of the scored rows, and whether each prediction is that of its probability."""
    _, results = fitted(spark, sf, models.logistic())
    agrees = F.col("prediction") == (F.col("probability") > 0.5).cast("double")
    rows = models.scored(results, "loan_id").groupBy("loan_id", "label")
    return rows.agg(F.count("*").alias("n"), F.min(agrees).alias("agrees"))


@query("preview_rows", "SELECT least(20, count(*)) AS n, CAST(0 AS BIGINT) AS strangers FROM orders")
def preview_rows(spark, sf):
    """How many rows a preview has, and how many of them the table has not."""
    table = load(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    known = table.select(F.col("o_orderkey").alias("_k"), F.col("o_totalprice").alias("_t")).distinct().withColumn("_known", F.lit(1))
    same = F.col("o_orderkey").eqNullSafe(F.col("_k")) & F.col("o_totalprice").eqNullSafe(F.col("_t"))
    shown = tables.preview(table, 20).join(known, same, "left")
    return shown.agg(F.count("*").alias("n"), F.count_if(F.col("_known").isNull()).alias("strangers"))


@query("importances_sum", "SELECT true AS whole, false AS negative FROM orders LIMIT 1")
def importances_sum(spark, sf):
    model, results = fitted(spark, sf, models.decision_tree(10, 32))
    weights = models.importances(model, results)
    value = [c for c, t in weights.dtypes if t == "double"][0]
    return weights.agg(
        (F.abs(F.sum(value) - 1) < 1e-9).alias("whole"), (F.min(value) < 0).alias("negative")
    )


@query("loss_rises", "SELECT CAST(count(*) AS BIGINT) AS rises FROM orders WHERE o_orderkey IS NULL")
def loss_rises(spark, sf):
    """Steps of the base model's training at which the loss went up."""
    model, _ = fitted(spark, sf, models.elastic_logistic())
    history = model.stages[-1].summary.objectiveHistory
    steps = spark.createDataFrame([(float(a), float(b)) for a, b in zip(history, history[1:])], "a double, b double")
    return steps.agg(F.count_if(F.col("b") > F.col("a") + 1e-12).alias("rises"))


@query("kmeans_astray", "SELECT CAST(count(*) AS BIGINT) AS astray FROM customer WHERE c_custkey IS NULL")
def kmeans_astray(spark, sf):
    """Points whose predicted cluster is not that of the nearest fitted centre."""
    model, results = segments(spark, sf)
    centres = [(i, c.tolist()) for i, c in enumerate(model.stages[-1].clusterCenters())]
    names = [f"f{i}" for i in range(len(centres[0][1]))]
    points = results.select("prediction", vector_to_array("features").alias("f")).select(
        "prediction", *[F.col("f")[i].alias(n) for i, n in enumerate(names)])
    near = metrics.nearest_centre(materialise(points, "points"), names, centres, "near")
    return near.agg(F.count_if(F.col("near") != F.col("prediction")).alias("astray"))


@query("random_split_parts", "SELECT o_orderkey, CAST(1 AS BIGINT) AS parts FROM orders")
def random_split_parts(spark, sf):
    """In how many parts of the random split each row is."""
    train, test = split.random_split(load(spark, sf, "orders").select("o_orderkey"))
    return train.unionByName(test).groupBy("o_orderkey").agg(F.count("*").alias("parts"))


@query("bernoulli_sample_strangers", """SELECT CAST(0 AS BIGINT) AS strangers, true AS near_half FROM customer LIMIT 1""")
def bernoulli_sample_strangers(spark, sf):
    """Sampled rows that the table does not have, and whether about half were taken."""
    table = load(spark, sf, "customer").select("c_custkey")
    taken = split.bernoulli_sample(table, 0.5)
    strangers = taken.join(table, "c_custkey", "left_anti").agg(F.count("*").alias("strangers"))
    share = taken.agg(F.count("*").alias("n")).withColumn("all", table.agg(F.count("*").alias("n")).scalar())
    near = share.select((F.abs(F.col("n") / F.col("all") - 0.5) < 0.2).alias("near_half"))
    return strangers.withColumn("near_half", near.scalar())


@query("loans_held_out", f"""WITH {BANK_SQL}
  SELECT CASE WHEN {_TESTED} THEN 'test' ELSE 'train' END AS part, count(*) AS n FROM model GROUP BY part""")
def loans_held_out(spark, sf):
    train, test = models.holdout(loans(spark, sf), "loan_id")
    parts = train.select(F.lit("train").alias("part")).unionByName(test.select(F.lit("test").alias("part")))
    return parts.groupBy("part").agg(F.count("*").alias("n"))
