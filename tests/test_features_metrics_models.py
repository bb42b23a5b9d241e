from __future__ import annotations

import os
import random

import pytest
from conftest import rows
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from surcos.operators import encoder, features, ledger, metrics, models
from surcos.plans import retail
from surcos.sources import scratch


@pytest.fixture(scope="module")
def colours(spark):
    data = ["red"] * 3 + ["blue"] * 3 + ["green"] * 5 + ["black"]
    return spark.createDataFrame([(i, c) for i, c in enumerate(data)], "id int, c string").repartition(3)


def test_index_order_and_ties_like_the_library(colours):
    index = {r["value"]: r["index"] for r in features.category_index(colours, "c").collect()}
    assert index == {"green": 0, "blue": 1, "red": 2, "black": 3}
    theirs = StringIndexer(inputCol="c", outputCol="i").fit(colours).transform(colours)
    ours = features.string_index(colours, "c", "i")
    assert rows(ours.select("id", F.col("i").cast("double"))) == rows(theirs.select("id", "i"))


def test_unseen_categories(spark, colours):
    fitted = features.category_index(colours, "c")
    other = spark.createDataFrame([(1, "red"), (2, "pink"), (3, None)], "id int, c string")
    assert rows(features.string_index(other, "c", "i", fitted=fitted), "id", "i") == [(1, 2)]
    kept = features.string_index(other, "c", "i", fitted=fitted, unseen="keep")
    assert rows(kept, "id", "i") == [(1, 2), (2, None), (3, None)]
    with pytest.raises(Exception, match="pink"):
        features.string_index(other.where("id = 2"), "c", "i", fitted=fitted, unseen="error").collect()
    with pytest.raises(Exception):
        features.string_index(other.where("id = 3"), "c", "i", fitted=fitted, unseen="error").collect()


def test_one_hot_equals_the_library(colours):
    indexed = StringIndexer(inputCol="c", outputCol="i").fit(colours).transform(colours)
    theirs = OneHotEncoder(inputCol="i", outputCol="v").fit(indexed).transform(indexed)
    want = {r["id"]: tuple(map(int, r["a"])) for r in theirs.select("id", vector_to_array("v").alias("a")).collect()}
    names = [r["value"] for r in features.category_index(colours, "c").orderBy("index").collect()]
    got = features.one_hot(colours, "c", names[:-1], "c")
    assert {r["id"]: (r["c_0"], r["c_1"], r["c_2"]) for r in got.collect()} == want
    slots = features.vector_slots(features.assemble(got, ["c_0", "id"]), "features", ["a", "b"])
    assert slots.where("id = 4").select("b").first()[0] == 4.0


def test_one_hot_vectors_of_many_categories(spark):
    df = spark.range(3000).selectExpr("id", "concat('k', id) AS c").unionByName(spark.createDataFrame([(9000, None)], "id long, c string"))
    got = features.one_hot_vector(df, "c", "v").where("id IN (0, 1, 9000)").collect()
    assert all(r["v"].size == 2999 for r in got)
    assert sorted(r["v"].numNonzeros() for r in got if r["id"] != 9000) == [1, 1]
    assert [r["v"].numNonzeros() for r in got if r["id"] == 9000] == [0]


def library(train, categories, numerics, unseen="skip"):
    """The same encoding by the library's stages."""
    indexed, vectors = [f"{c}_i" for c in categories], [f"{c}_vec" for c in categories]
    return Pipeline(stages=[
        StringIndexer(inputCols=categories, outputCols=indexed, handleInvalid=unseen),
        OneHotEncoder(inputCols=indexed, outputCols=vectors), VectorAssembler(inputCols=[*vectors, *numerics], outputCol="features"),
    ]).fit(train)


@pytest.fixture(params=["small", "many"])
def size(request, monkeypatch):
    """Few categories are numbered on the driver and give dense vectors, many neither."""
    if request.param == "many":
        monkeypatch.setattr(encoder, "SMALL", 3)
        monkeypatch.setattr(encoder, "DENSE", 2)
    return request.param


def test_encoder_equals_library_stages_and_survives_saving(spark, tmp_path, size):
    rnd = random.Random(3)
    data = [(i, rnd.choice(["b", "ä", "z", "b", " "]), rnd.randrange(12), rnd.choice([None, 1.5, 2.0]) or 0.0, "k") for i in range(200)]
    df = spark.createDataFrame(data, "id int, `a.b` string, g int, x double, value string").repartition(3)
    stage = encoder.CategoryEncoder(inputCols=["a.b", "g"], numericCols=["x", "id"])
    model = features.fitted_pipeline(df, [stage])
    named = df.withColumnRenamed("a.b", "ab")
    theirs = library(named, ["ab", "g"], ["x", "id"]).transform(named)
    ours = model.transform(df)
    assert ours.columns == [*df.columns, "features"]
    assert rows(ours, "id", "features") == rows(theirs, "id", "features")
    assert [s.replace("a.b", "ab") for s in features.slot_names(ours)] == [s for s in features.slot_names(theirs)]
    model.write().overwrite().save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    assert rows(again.transform(df), "id", "features") == rows(ours, "id", "features")
    Pipeline(stages=[stage]).write().overwrite().save(str(tmp_path / "unfitted"))
    refitted = Pipeline.load(str(tmp_path / "unfitted")).fit(df)
    assert rows(refitted.transform(df), "id", "features") == rows(ours, "id", "features")


def test_encoder_with_unseen_and_missing_values(spark, size):
    train = spark.createDataFrame([(i, "abcde"[i % 5 if i < 9 else 0], 1.0) for i in range(20)], "id int, c string, x double")
    other = spark.createDataFrame([(1, "a", 2.0), (2, "new", 3.0), (3, None, 4.0), (4, "e", 5.0)], "id int, c string, x double")
    fit = lambda unseen: encoder.CategoryEncoder(inputCols=["c"], numericCols=["x"], handleInvalid=unseen).fit(train)
    expected = library(train, ["c"], ["x"]).transform(other)
    assert rows(fit("skip").transform(other), "id", "features") == rows(expected, "id", "features")
    kept = {r["id"]: list(r["features"].toArray()) for r in fit("keep").transform(other).collect()}
    assert kept == {1: [1, 0, 0, 0, 2], 2: [0, 0, 0, 0, 3], 3: [0, 0, 0, 0, 4], 4: [0, 0, 0, 0, 5]}
    for row in (2, 3):
        with pytest.raises(Exception, match="unseen value in c"):
            fit("error").transform(other.where(f"id = {row}")).collect()
    for bad in ("CAST(NULL AS DOUBLE)", "double('NaN')"):
        with pytest.raises(Exception, match="null or NaN in x"):
            fit("skip").transform(other.withColumn("x", F.expr(bad))).collect()


def test_encoder_without_rows_or_categories(spark, size):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "a", 3.0)], "id int, c string, x double")
    constant = encoder.CategoryEncoder(inputCols=["c"], numericCols=["x"]).fit(df).transform(df)
    assert [list(r["features"].toArray()) for r in constant.orderBy("id").collect()] == [[2.0], [3.0]]
    numbers = encoder.CategoryEncoder(numericCols=["x"]).fit(df).transform(df)
    assert [list(r["features"].toArray()) for r in numbers.orderBy("id").collect()] == [[2.0], [3.0]]
    empty = df.where("false")
    assert encoder.CategoryEncoder(inputCols=["c"], numericCols=["x"]).fit(empty).transform(df).collect() == []


def test_encoder_of_many_categories_keeps_them_off_the_driver(spark, tmp_path):
    n = 120_000
    df = spark.range(2 * n).selectExpr("id", f"concat('name ', id % {n}) AS name", "id % 3 AS g", "id * 0.5 AS x")
    model = encoder.CategoryEncoder(inputCols=["name", "g"], numericCols=["x"]).fit(df)
    assert model.n_slots == n - 1 + 2 + 1 and model.slot_names() is None
    got = model.transform(df)
    assert len(got.schema["features"].json()) < 1000
    one = got.where("id = 17").first()
    at = model.labels.where("column = 'name' AND value = 'name 17'").first()["index"]
    assert one["features"].size == model.n_slots and one["features"][int(at)] == 1.0 and one["features"][n + 1] == 8.5
    model.write().save(str(tmp_path / "m"))
    again = encoder.CategoryEncoderModel.load(str(tmp_path / "m"))
    spelled = lambda m: m.transform(df).select("id", F.to_json(F.struct("features")))
    assert spelled(model).exceptAll(spelled(again)).count() == 0 and spelled(again).count() == 2 * n


def test_many_clusters(spark):
    df = spark.range(8000).selectExpr("id", "id % 2000 AS cluster", "CAST(id % 2000 AS DOUBLE) * 10 AS x", "CAST(id DIV 2000 AS DOUBLE) AS y")
    centres = metrics.group_centres(df, "cluster", ["x", "y"])
    near = metrics.nearest_centre(df, ["x", "y"], centres, "near")
    assert near.where("near <> cluster").count() == 0
    assert 0.5 < metrics.silhouette(df, ["x", "y"]).first()[0] < 1


def test_rarer_class_is_one(spark):
    df = spark.createDataFrame([(1, "yes"), (2, "yes"), (3, "no")], "id int, y string")
    assert rows(features.label_index(df, "y", "label"), "id", "label") == [(1, 0.0), (2, 0.0), (3, 1.0)]
    assert rows(features.label_index(df, "y", "label", positive="yes"), "id", "label") == [(1, 1.0), (2, 1.0), (3, 0.0)]


def test_constant_category_is_left_out(spark):
    summary = spark.createDataFrame(
        [(i, "n" if i % 2 else "m", 1.0 * i, 1.0, 2.0, 3.0, 7, 1) for i in range(20)],
        "cliente_id int, Nombre string, precio_total double, prod_vendido double, stock double, "
        "prod_mov double, prod_dest int, cantidad_compras int",
    )
    stages = retail.stages(summary)
    model = features.fitted_pipeline(summary, [*stages, models.segmenter(2)])
    result = model.transform(summary)
    assert features.slot_names(result)[0] == "Nombre_vec_m"
    assert result.select("prediction").distinct().count() == 2


# --- metrics ------------------------------------------------------------------

@pytest.fixture(scope="module")
def scored(spark):
    rnd = random.Random(2)
    data = []
    for _ in range(400):
        label = rnd.random() < 0.4
        score = round(rnd.gauss(0.6 if label else 0.4, 0.2), 2)
        data.append((float(label), float(score > 0.5), score))
    return spark.createDataFrame(data, "label double, prediction double, score double").repartition(4)



def area(points):
    at = sorted((r["fpr"], r["tpr"]) for r in points)
    return sum((x2 - x1) * (y1 + y2) / 2 for (x1, y1), (x2, y2) in zip(at, at[1:]))


@pytest.mark.parametrize("limit", [2, 5, 20, 60])
def test_bounded_roc_keeps_the_area_within_its_bound(scored, limit):
    got = metrics.roc_bounded(scored, "label", "score", points=limit, fine=4).collect()
    exact = metrics.auc_score(scored, "label", "score").first()["auc"]
    assert len(got) <= limit
    assert abs(area(got) - exact) <= sum(r["lost"] for r in got) + 1e-12
    corners = {(r["fpr"], r["tpr"]) for r in got}
    assert {(0.0, 0.0), (1.0, 1.0)} <= corners
    truth = {(r["fpr"], r["tpr"]) for r in metrics.roc_curve(scored, "label", "score").collect()}
    assert corners <= truth


def test_bounded_roc_is_exact_for_few_scores(spark, scored):
    got = metrics.roc_bounded(scored, "label", "score", points=500)
    assert rows(got.drop("lost")) == rows(metrics.roc_curve(scored, "label", "score"))
    assert {r["lost"] for r in got.collect()} == {0.0}
    odd = spark.createDataFrame([(1.0, None), (0.0, 0.5), (None, 0.5), (1.0, 0.5)], "label double, score double")
    assert [tuple(r) for r in metrics.roc_bounded(odd, "label", "score").orderBy("fpr").collect()] == [(0.0, 0.0, None, 0.0), (1.0, 1.0, 0.5, 0.0)]
    assert metrics.roc_bounded(odd.where("false"), "label", "score").count() == 1


def evaluator(column):
    return BinaryClassificationEvaluator(rawPredictionCol=column, labelCol="label", numBins=0)


def test_auc_of_hard_predictions(scored):
    got = metrics.balanced_accuracy(scored, "label", "prediction").first()["auc"]
    assert got == pytest.approx(evaluator("prediction").evaluate(scored))


def test_roc_and_auc_with_ties(scored):
    want = evaluator("score").evaluate(scored)
    assert metrics.auc_score(scored, "label", "score").first()["auc"] == pytest.approx(want)
    points = sorted((r["fpr"], r["tpr"]) for r in metrics.roc_curve(scored, "label", "score").collect())
    assert points[0] == (0.0, 0.0) and points[-1] == (1.0, 1.0)
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))
    assert area == pytest.approx(want)
    assert len(points) == scored.select("score").distinct().count() + 1


def test_one_class_only(spark):
    df = spark.createDataFrame([(1.0, 1.0, 0.3)], "label double, prediction double, score double")
    assert metrics.balanced_accuracy(df, "label", "prediction").first()["auc"] is None
    assert metrics.auc_score(df, "label", "score").first()["auc"] is None


def points(spark, seed=0):
    rnd = random.Random(seed)
    data = [(i, i % 3, rnd.gauss(5 * (i % 3), 2), rnd.gauss(0, 1)) for i in range(90)]
    return spark.createDataFrame(data + [(90, 7, 100.0, 100.0)], "id int, cluster int, x double, y double")


def test_silhouette_equals_the_library(spark):
    df = points(spark)
    vectors = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(df)
    want = ClusteringEvaluator(predictionCol="cluster").evaluate(vectors)
    assert metrics.silhouette(df, ["x", "y"]).first()[0] == pytest.approx(want)
    with pytest.raises(ValueError):
        metrics.silhouette(df.where("cluster = 1"), ["x", "y"])


def test_nearest_centre(spark):
    df = points(spark)
    centres = metrics.group_centres(df, "cluster", ["x", "y"])
    centres = [(r["number"], r["values"]) for r in centres.orderBy("number").collect()]
    assert [c for c, _ in centres] == [0, 1, 2, 3]
    for r in metrics.nearest_centre(df, ["x", "y"], centres, "near").collect():
        want = min((sum((a - b) ** 2 for a, b in zip((r["x"], r["y"]), p)), c) for c, p in centres)[1]
        assert r["near"] == want


# --- models -------------------------------------------------------------------

@pytest.fixture(scope="module")
def training(spark):
    rnd = random.Random(7)
    data = []
    for i in range(600):
        x, g = rnd.gauss(0, 1), rnd.choice("abc")
        data.append((i, g, x, rnd.random(), "si" if x + (g == "a") + rnd.gauss(0, 0.5) > 0.8 else "no"))
    return spark.createDataFrame(data, "id int, g string, x double, noise double, y string").repartition(2).cache()


def stages():
    return features.encoder_stages(["g"], ["x", "noise"], label="y")


def test_rounds_keep_best_or_last(training):
    best = models.train_rounds(training, stages(), models.decision_tree(), "id")
    last = models.train_rounds(training, stages(), models.decision_tree(), "id", keep="last")
    assert best.auc == last.auc and len(set(best.auc)) > 1
    assert best.mean_auc == pytest.approx(sum(best.auc) / 3)

    def score(t):
        return metrics.balanced_accuracy(t.results, "label", "prediction").first()["auc"]

    assert score(best) == pytest.approx(max(best.auc))
    assert score(last) == pytest.approx(last.auc[-1])


@pytest.mark.parametrize("fit", ["holdout", "comparison", "ledger"])
def test_tasks_of_a_fit_hold_a_bounded_number_of_like_rows(spark, tmp_path, monkeypatch, fit):
    seen, plain = [], models.DecisionTreeClassifier._fit

    def watched(self, dataset):
        per_task = dataset.groupBy(F.spark_partition_id()).count()
        seen.append(per_task.agg(F.max("count"), F.sum("count")).first())
        return plain(self, dataset)

    monkeypatch.setattr(models.DecisionTreeClassifier, "_fit", watched)
    for module in (models, ledger):
        monkeypatch.setattr(module, "TASK_ROWS", 1000)
    names = [f"x{i}" for i in range(30)]
    like = spark.range(0, 150_000, 1, 1).select(
        "id", F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("y"), *[(F.col("id") % 3 + i + 0.5).alias(c) for i, c in enumerate(names)])
    steps, tree = features.encoder_stages([], names, label="y"), models.decision_tree(1)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 6 << 20)
    try:
        if fit == "holdout":
            _, results = models.fit_holdout(like, steps, tree, "id")
            assert results.where("prediction <> label").count() == 0
        elif fit == "comparison":
            _, table = models.compare_models(like, steps, {"tree": tree}, "id", rounds=1)
            assert [r["auc"] for r in table.collect()] == [1.0]
        else:
            ledger.compare_resumable(like, steps, {"tree": tree}, "id", str(tmp_path), rounds=1)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (most, total), = seen
    assert total > 100_000 and most * 30 * 8 <= 2 * (6 << 20)


def test_a_large_comparison_keeps_one_round_on_disk(spark, training, monkeypatch):
    """Three rounds lay there at once, train and test parts; now those of one, and what a kept summary reads."""
    base, seen, plain = os.path.dirname(scratch.scratch_path(spark, "any")), [], models.DecisionTreeClassifier._fit

    def parts():
        return {f for f in os.listdir(base) if f.startswith(("training-", "encoded-"))}

    def watched(self, dataset):
        seen.append(len(parts() - there))
        return plain(self, dataset)

    estimators = {"tree": models.decision_tree(), "lr": models.elastic_logistic()}
    _, small = models.compare_models(training, stages(), estimators, "id")
    monkeypatch.setattr(models.DecisionTreeClassifier, "_fit", watched)
    # Many tasks to a fit, so that one fills the cluster.
    monkeypatch.setattr(models, "TASK_ROWS", 600 // (8 * spark.sparkContext.defaultParallelism))
    there = parts()
    trees, _ = models.compare_models(training, stages(), {"tree": estimators["tree"]}, "id")
    assert seen == [1, 1, 1] and parts() == there
    trained, large = models.compare_models(training, stages(), estimators, "id")
    assert max(seen) == 2 and len(parts() - there) == 1
    assert [tuple(r)[:2] for r in large.collect()] == [tuple(r)[:2] for r in small.collect()]
    assert [r["auc"] for r in large.collect()] == pytest.approx([r["auc"] for r in small.collect()])
    assert trees["tree"].auc == trained["tree"].auc
    for t in trained.values():
        score = metrics.balanced_accuracy(t.results, "label", "prediction").first()["auc"]
        assert score == pytest.approx(max(t.auc))
    best = trained["lr"].auc.index(max(trained["lr"].auc))
    train, _ = models.holdout(training, "id", f"#{best}")
    assert trained["lr"].model.stages[-1].summary.predictions.count() == train.count()


@pytest.mark.parametrize("hot", [0, 5, 64])
def test_narrowed_rows_come_back_as_they_were(spark, tmp_path, hot):
    names = [f"s{i}" for i in range(max(hot, 8))]
    attrs = [{"idx": i, "name": n} for i, n in enumerate(names)]
    # The numbers come first here, the binary slots after them.
    groups = {"numeric": attrs[: len(names) - hot], "binary": attrs[len(names) - hot:]}
    meta = {"ml_attr": {"num_attrs": len(names), "attrs": {k: v for k, v in groups.items() if v}}}
    values = [F.when(F.lit(i >= len(names) - hot), ((F.col("id") * (i + 3)) % 7 % 2).cast("double")).otherwise(F.col("id") / (i + 3)) for i in range(len(names))]
    df = spark.range(3000).select((F.col("id") % 2).cast("double").alias("label"), array_to_vector(F.array(*values)).alias("features")).withMetadata("features", meta)
    narrow, back = models.narrowed(df)
    narrow.write.options(**models.PLAIN).parquet(f"{tmp_path}/narrow")
    got = back(spark.read.schema(narrow.schema).parquet(f"{tmp_path}/narrow"))
    assert got.schema["features"].metadata == meta and got.columns == df.columns
    assert rows(got) == rows(df)
    size = lambda folder: sum(f.stat().st_size for f in folder.glob("*.parquet"))
    df.write.options(**models.PLAIN).parquet(f"{tmp_path}/vectors")
    assert size(tmp_path / "narrow") < size(tmp_path / "vectors")
    if hot:
        odd = df.withColumn("features", array_to_vector(F.array(*[F.lit(0.5)] * len(names)))).withMetadata("features", meta)
        with pytest.raises(Exception, match="neither 0 nor 1"):
            models.narrowed(odd)[0].collect()


def test_vectors_without_named_slots_stay(spark):
    df = spark.range(3).select(array_to_vector(F.array(F.col("id").cast("double"))).alias("features"))
    narrow, back = models.narrowed(df)
    assert narrow is df and back(df) is df


def test_small_training_tables_stay_as_they_are(training):
    assert models.training_rows(training, models.TASK_ROWS) is training
    cores = training.sparkSession.sparkContext.defaultParallelism
    assert models.fits_at_once(training, 100, 4) == 4 and models.fits_at_once(training, 4 * cores * models.TASK_ROWS, 4) == 1


def test_a_useless_model_is_still_returned(training):
    constant = training.withColumn("x", F.lit(0.0)).withColumn("noise", F.lit(0.0)).withColumn("g", F.expr("if(id % 2 = 0, 'a', 'b')"))
    got = models.train_rounds(constant, stages(), models.logistic(regParam=100.0, elasticNetParam=1.0), "id", rounds=2)
    assert got.model is not None and got.auc == pytest.approx([0.5, 0.5])


def test_comparison_table(training):
    trained, table = models.compare_models(
        training, stages(), {"tree": models.decision_tree(), "lr": models.elastic_logistic()}, "id", rounds=2
    )
    assert len(rows(table)) == 4 and set(trained) == {"tree", "lr"}
    assert all(r["auc"] > 0.7 for r in table.collect())


def test_comparison_goes_on_where_it_ended(spark, training, tmp_path, monkeypatch):
    """A run that fails at its third fit of four leaves two, and the next run fits the other two only."""
    fits, own = [], type(models.logistic())._fit

    def counted(self, dataset):
        fits.append(self.getMaxIter())
        if len(fits) == 3:
            raise RuntimeError("ended")
        return own(self, dataset)

    monkeypatch.setattr(type(models.logistic()), "_fit", counted)
    estimators = {"short": models.logistic(maxIter=2), "long": models.logistic(maxIter=20)}
    run = lambda df, given=estimators: ledger.compare_resumable(
        df, stages(), given, "id", str(tmp_path), rounds=2, parallelism=1
    )
    with pytest.raises(RuntimeError, match="ended"):
        run(training)
    trained, table = run(training)
    assert len(fits) == 5 and len(rows(table)) == 4
    again, same = run(training.repartition(7))
    assert len(fits) == 5 and rows(same) == rows(table)
    _, plain = models.compare_models(training, stages(), estimators, "id", rounds=2)
    assert [r[:2] for r in rows(plain)] == [r[:2] for r in rows(table)]
    assert [r[2] for r in rows(plain)] == pytest.approx([r[2] for r in rows(table)])
    for name, t in again.items():
        score = metrics.balanced_accuracy(t.results, "label", "prediction").first()["auc"]
        assert score == pytest.approx(max(t.auc)) and t.auc == trained[name].auc
    before = len(fits)
    run(training, {**estimators, "long": models.logistic(maxIter=21)})
    assert len(fits) == before + 2  # another parameter
    run(training.where("id <> 3"))
    assert len(fits) == before + 6  # another table


def test_model_reports(spark, training):
    model = features.fitted_pipeline(training, [*stages(), models.boosted_trees(rounds=3)])
    result = model.transform(training)
    weights = {r["feature"]: r["importance"] for r in models.importances(model, result).collect()}
    assert set(weights) == {"g_vec_" + v for v in features_kept(model)} | {"x", "noise"}
    assert max(weights, key=weights.get) == "x" and sum(weights.values()) == pytest.approx(1)
    tree = features.fitted_pipeline(training, [*stages(), models.decision_tree()])
    assert "If (feature" in models.model_text(spark, tree).first()["tree"]
    lr = features.fitted_pipeline(training, [*stages(), models.logistic(maxIter=5)])
    losses = [r["loss"] for r in models.loss_curve(spark, lr.stages[-1].summary).orderBy("iteration").collect()]
    assert losses == sorted(losses, reverse=True) and len(losses) > 2
    scored = models.scored(lr.transform(training), "id")
    assert scored.columns == ["id", "label", "prediction", "probability"]
    roc = metrics.roc_curve(scored, "label", "probability").count()
    assert roc == scored.select("probability").distinct().count() + 1


def features_kept(model):
    return model.stages[0].labelsArray[0][:-1]


def test_pipeline_equals_library_pipeline(training):
    own = features.fitted_pipeline(training, stages()).transform(training)
    manual = Pipeline(
        stages=[
            StringIndexer(inputCol="g", outputCol="gi"), OneHotEncoder(inputCol="gi", outputCol="gv"),
            VectorAssembler(inputCols=["gv", "x", "noise"], outputCol="features"),
        ]
    ).fit(training).transform(training)
    assert rows(own, "id", "features") == rows(manual, "id", "features")
