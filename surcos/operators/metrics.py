"""Evaluation of classifiers, clusterings and forecasts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from surcos.functions.scalar import percentage_error
from surcos.operators.ranking import global_rank, running_totals


def balanced_accuracy(df: DataFrame, label: str, prediction: str, *by: str) -> DataFrame:
    """(TPR + TNR) / 2: the area under the ROC curve of hard 0/1 predictions."""
    pos, neg = F.col(label) == 1, F.col(label) == 0
    tpr = F.try_divide(F.count_if(pos & (F.col(prediction) == 1)), F.count_if(pos))
    tnr = F.try_divide(F.count_if(neg & (F.col(prediction) == 0)), F.count_if(neg))
    return df.groupBy(*by).agg(((tpr + tnr) / 2).alias("auc"))


def _by_score(df: DataFrame, label: str, score: str) -> DataFrame:
    counts = (
        df.where(F.col(score).isNotNull())
        .groupBy(F.col(score).cast("double").alias("score"))
        .agg(
            F.count_if(F.col(label) == 1).alias("pos"),
            F.count_if(F.col(label) == 0).alias("neg"),
        )
    )
    return running_totals(counts, [F.desc("score")], ["pos", "neg"])


def _origin(df: DataFrame) -> DataFrame:
    return df.sparkSession.range(1).select(
        F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(None).cast("double").alias("score")
    )


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """(fpr, tpr, score): one point per distinct score, and the two corners.

    A point is what predicting 1 from that score on would give. The corner (0, 0)
    has no score; (1, 1) is the point of the lowest score.
    """
    steps = _by_score(df, label, score)
    ends = steps.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    p, n = ends.select("p").scalar(), ends.select("n").scalar()
    points = steps.select(
        F.try_divide(F.col("cum_neg"), n).alias("fpr"),
        F.try_divide(F.col("cum_pos"), p).alias("tpr"),
        "score",
    )
    return _origin(df).unionByName(points)


def roc_bounded(df: DataFrame, label: str, score: str, points: int = 200, fine: int = 64) -> DataFrame:
    """(fpr, tpr, score, lost): at most ``points`` points of the ROC curve, for charts.

    With fewer distinct scores than that the curve is exact. Otherwise scores are counted in
    ``points * fine`` bins of equal width, which merge from any number of tasks, and
    neighbouring bins are put together into groups of about equal weight. ``lost`` is the most
    that the area up to a point can be off by its group: half of its positives times its
    negatives; their sum bounds the error of the area. Runs a Spark job.
    """
    rows = df.where(F.col(score).isNotNull()).select(F.col(label).alias("_l"), F.col(score).cast("double").alias("_s"))
    if rows.select("_s").distinct().limit(points).count() < points:
        return roc_curve(df, label, score).withColumn("lost", F.lit(0.0))
    span = rows.agg(F.min("_s").alias("lo"), F.max("_s").alias("hi"))
    lo, hi, bins = span.select("lo").scalar(), span.select("hi").scalar(), points * fine
    place = F.least(F.floor((F.col("_s") - lo) / (hi - lo) * bins), F.lit(bins - 1))
    counted = rows.withColumn("bin", place).groupBy("bin").agg(
        F.count_if(F.col("_l") == 1).alias("pos"), F.count_if(F.col("_l") == 0).alias("neg"),
        F.min("_s").alias("low"), F.max("_s").alias("high"),
    )
    # The one task that orders them sees at most points * fine rows, whatever the table.
    so_far, all_ = W.orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0), W.partitionBy()
    weighed = counted.withColumns({
        "cum": F.sum(F.col("pos") + F.col("neg")).over(so_far), "total": F.sum(F.col("pos") + F.col("neg")).over(all_)})
    group = F.floor((F.col("cum") - 1) * (points - 1) / F.col("total"))
    merged = weighed.groupBy(group.alias("group")).agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.min("low").alias("low"), F.max("high").alias("high"))
    upto = W.orderBy("group").rowsBetween(W.unboundedPreceding, 0)
    p, n = F.sum("pos").over(all_), F.sum("neg").over(all_)
    missed = F.when(F.col("low") < F.col("high"), F.try_divide(F.col("pos") * F.col("neg"), 2 * p * n)).otherwise(0.0)
    curve = merged.select(
        F.try_divide(F.sum("neg").over(upto), n).alias("fpr"), F.try_divide(F.sum("pos").over(upto), p).alias("tpr"),
        F.col("low").alias("score"), missed.alias("lost"),
    )
    return _origin(df).withColumn("lost", F.lit(0.0)).unionByName(curve)


def auc_score(df: DataFrame, label: str, score: str) -> DataFrame:
    """Exact area under the ROC curve (trapezoids, ties counted half)."""
    area = F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2)
    return _by_score(df, label, score).agg(
        F.try_divide(F.sum(area), F.sum("pos") * F.sum("neg")).alias("auc")
    )


def mean_metric(rounds: DataFrame, metric: str) -> DataFrame:
    """Mean of a metric over the rounds of a repeated hold-out."""
    return rounds.agg(F.avg(metric).alias(f"mean_{metric}"))


def _plus(terms) -> Column:
    return reduce(lambda a, b: a + b, terms)


def _one_value(df: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """Add column ``name``: all of ``rows`` as one array of structs, ordered by their first column.

    The expressions that walk it are the same for any number of rows. ``rows`` are the k
    centres of a clustering; k is the caller's own parameter, not a number that grows
    with the table.
    """
    folded = rows.agg(F.sort_array(F.collect_list(F.struct(*rows.columns))).alias(name))
    return df.withColumn(name, folded.scalar())


def _squares(columns: Sequence[str], values: Column) -> Column:
    return _plus((F.col(c) - F.get(values, F.lit(i))) ** 2 for i, c in enumerate(columns))


def nearest_centre(
    df: DataFrame, columns: Sequence[str], centres: Sequence[tuple[int, Sequence[float]]] | DataFrame,
    output: str = "cluster",
) -> DataFrame:
    """Add the number of the nearest centre (squared Euclidean, ties to the lower).

    ``centres`` are (number, values), or a table with these two columns. The k of them
    are one array value that each row walks, so the plan does not grow with k.
    """
    if not isinstance(centres, DataFrame):
        typed = [(int(n), [float(v) for v in values]) for n, values in centres]
        centres = df.sparkSession.createDataFrame(typed, "number int, values array<double>")
    held = _one_value(df, centres.select("number", "values"), "_centres")
    nearest = F.array_min(
        F.transform("_centres", lambda c: F.struct(_squares(columns, c["values"]).alias("d"), c["number"].alias("c")))
    )
    return held.withColumn(output, nearest["c"]).drop("_centres")


def group_centres(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Mean of each group as (number, values), numbered in the order of the group's value."""
    means = df.groupBy(group).agg(F.array(*[F.avg(c) for c in columns]).alias("values"))
    return global_rank(means, [F.asc(group)], "number").select(F.col("number").cast("int").alias("number"), "values")


def silhouette(df: DataFrame, columns: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Mean silhouette with squared Euclidean distance, in two passes.

    The mean distance of a point to a cluster follows from the cluster's size, sum
    vector and sum of squared norms, so no pair of points is formed. The k clusters'
    sums are one array value of the second pass. A point alone in its cluster scores
    0; with fewer than two clusters the score is not defined and an error.
    """
    norm = _plus(F.col(c) ** 2 for c in columns)
    stats = df.groupBy(F.col(cluster).alias("id")).agg(
        F.count("*").cast("double").alias("n"),
        F.sum(norm).alias("norms"),
        F.array(*[F.sum(c) for c in columns]).alias("sums"),
    )
    if len(stats.limit(2).take(2)) < 2:
        raise ValueError("the silhouette needs at least 2 clusters")

    def total(c: Column) -> Column:
        """Sum of squared distances from the point to all members of a cluster."""
        dot = _plus(F.col(name) * F.get(c["sums"], F.lit(i)) for i, name in enumerate(columns))
        return c["n"] * F.col("_norm") + c["norms"] - 2 * dot

    held = _one_value(df.withColumn("_norm", norm), stats, "_clusters")
    own = F.filter("_clusters", lambda c: c["id"].eqNullSafe(F.col(cluster)))
    others = F.filter("_clusters", lambda c: ~c["id"].eqNullSafe(F.col(cluster)))
    points = held.select(
        F.get(F.transform(own, lambda c: F.when(c["n"] > 1, total(c) / (c["n"] - 1))), F.lit(0)).alias("a"),
        F.array_min(F.transform(others, lambda c: total(c) / c["n"])).alias("b"),
    )
    score = F.when(F.col("a").isNull(), 0.0).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    )
    return points.agg(F.avg(score).alias("silhouette"))


def forecast_errors(df: DataFrame, actual: str, predicted: str, *by: str) -> DataFrame:
    """RMSE and MAPE per group.

    Days with an actual value of zero have no percentage error; they are left out
    of the MAPE and counted in ``zero_days``.
    """
    squared = (F.col(actual) - F.col(predicted)) ** 2
    return df.groupBy(*by).agg(
        F.sqrt(F.avg(squared)).alias("rmse"),
        F.avg(percentage_error(F.col(actual), F.col(predicted))).alias("mape"),
        F.count_if(F.col(actual) == 0).alias("zero_days"),
    )
