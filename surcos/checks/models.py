"""Fitted models. Their numbers come from iterative training, so no SQL states them."""

from __future__ import annotations

from functools import partial

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import functions as F

from surcos.checks.registry import query
from surcos.checks.series import prepared
from surcos.checks.standins import FREQUENCY, STATUSES, bank, calls, shop
from surcos.operators import metrics, models, split
from surcos.operators.aggregate import distribution, value_counts
from surcos.operators.forecast import ar_fit
from surcos.operators.order import top_k
from surcos.operators.timeseries import lag_arrays
from surcos.plans import credit, retail, telecom
from surcos.sources.scratch import materialise

_WRITTEN: dict[tuple, object] = {}


def written(spark, sf, name, make):
    """Write a training table once per session; every fit reads the written one."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _WRITTEN:
        _WRITTEN[key] = materialise(make(), name)
    return _WRITTEN[key]


def loans(spark, sf):
    return written(
        spark, sf, "candidates",
        lambda: credit.candidates(bank(spark, sf), FREQUENCY, STATUSES, key="loan_id"),
    )


def fitted(spark, sf, estimator):
    """(model, predictions of the test part) of one 70/30 hold-out."""
    return models.fit_holdout(loans(spark, sf), credit.stages(), estimator, "loan_id")


def _scored(make, spark, sf):
    _, results = fitted(spark, sf, make())
    return models.scored(results, "loan_id")


CLASSIFIERS = {
    "logreg": models.logistic,
    "logreg_elastic": models.elastic_logistic,
    "gbt": models.boosted_trees,
    "gbt_deep": partial(models.boosted_trees, 6, 16),
    "tree": models.decision_tree,
    "tree_deep": partial(models.decision_tree, 10, 32),
}
for _name, _make in CLASSIFIERS.items():
    query(_name)(partial(_scored, _make))


@query("logreg_short")
def logreg_short(spark, sf):
    """The five-table variant, with the district as a category."""
    df = written(
        spark, sf, "candidates_short",
        lambda: credit.candidates_short(bank(spark, sf), FREQUENCY, STATUSES, key="loan_id"),
    )
    _, results = models.fit_holdout(df, credit.stages_short(), models.logistic(), "loan_id")
    return models.scored(results, "loan_id")


@query("model_auc")
def model_auc(spark, sf):
    """Hard-label and score AUC of the base model on the test part."""
    _, results = fitted(spark, sf, models.logistic())
    rows = models.scored(results)
    hard = metrics.balanced_accuracy(rows, "label", "prediction").withColumn("kind", F.lit("hard"))
    soft = metrics.auc_score(rows, "label", "probability").withColumn("kind", F.lit("score"))
    return hard.unionByName(soft)


@query("model_roc")
def model_roc(spark, sf):
    """ROC curve of the base model on its training part."""
    model, _ = fitted(spark, sf, models.logistic())
    train, _ = models.holdout(loans(spark, sf), "loan_id")
    return metrics.roc_curve(models.scored(model.transform(train)), "label", "probability")


@query("model_roc_chart")
def model_roc_chart(spark, sf):
    """The same curve in at most 200 points, for a chart."""
    model, _ = fitted(spark, sf, models.logistic())
    train, _ = models.holdout(loans(spark, sf), "loan_id")
    return metrics.roc_bounded(models.scored(model.transform(train)), "label", "probability", points=200)


@query("model_comparison")
def model_comparison(spark, sf):
    _, table = models.compare_models(loans(spark, sf), credit.stages(), credit.classifiers(), "loan_id")
    return table


@query("tree_text")
def tree_text(spark, sf):
    model, _ = fitted(spark, sf, models.decision_tree())
    return models.model_text(spark, model)


@query("importances")
def importances(spark, sf):
    model, results = fitted(spark, sf, models.decision_tree(10, 32))
    return models.importances(model, results)


@query("scored")
def scored(spark, sf):
    """The table behind a preview of label, prediction and probability."""
    _, results = fitted(spark, sf, models.logistic())
    return models.scored(results)


@query("loss_curve")
def loss_curve(spark, sf):
    model, _ = fitted(spark, sf, models.elastic_logistic())
    return models.loss_curve(spark, model.stages[-1].summary)


@query("ar_coefficients")
def ar_coefficients(spark, sf):
    """Weights of the seven-lag forecaster of each series."""
    return ar_fit(lag_arrays(prepared(spark, sf), 7, "z"), 7)


def segments(spark, sf):
    return telecom.segments(calls(spark, sf))


@query("kmeans")
def kmeans(spark, sf):
    _, results = segments(spark, sf)
    return results.select("account", *telecom.SEGMENT_CATEGORIES, "prediction")


@query("kmeans_sizes")
def kmeans_sizes(spark, sf):
    return distribution(segments(spark, sf)[1], "prediction")


@query("kmeans_sampled_sizes")
def kmeans_sampled_sizes(spark, sf):
    return value_counts(split.bernoulli_sample(segments(spark, sf)[1], 0.5), "prediction")


@query("kmeans_top")
def kmeans_top(spark, sf):
    columns = ["voice_mail_plan", "account", "prediction"]
    return top_k(segments(spark, sf)[1].select(*columns), "voice_mail_plan", 5, "account")


@query("kmeans_silhouette")
def kmeans_silhouette(spark, sf):
    score = ClusteringEvaluator().evaluate(segments(spark, sf)[1])
    return spark.createDataFrame([(float(score),)], "silhouette double")


@query("kmeans_retail")
def kmeans_retail(spark, sf):
    _, results = retail.segments(shop(spark, sf))
    return results.select("cliente_id", "prediction")
