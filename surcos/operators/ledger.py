"""Model comparisons that can be taken up again where they ended."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surcos.operators.clean import quoted
from surcos.operators.metrics import balanced_accuracy
from surcos.operators.models import PLAIN, TASK_ROWS, Trained, fits_at_once, holdout

_FIT = "model string, round int, auc double"


def fingerprint(df: DataFrame) -> str:
    """A digest of the rows of a table in any order, repeats counted, and of its columns. One pass."""
    row = F.xxhash64(*[F.col(quoted(c)) for c in df.columns]).cast("decimal(20,0)")
    n, total = df.agg(F.count("*"), F.sum(row)).first()
    return _digest([df.schema.simpleString(), n, str(total)])


def _digest(parts: Sequence) -> str:
    return hashlib.sha256(json.dumps(parts).encode()).hexdigest()[:16]


def _settings(stage) -> list:
    """Class and parameters of a stage, whatever its uid."""
    own = {p.name: str(v) for p, v in stage.extractParamMap().items() if not str(v).startswith(stage.uid)}
    return [type(stage).__name__, sorted(own.items())]


def _done(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _written(df: DataFrame, folder: str, **options: str) -> DataFrame:
    """The table in ``folder``, written first unless a run before has ended writing it."""
    spark = df.sparkSession
    if not _done(spark, folder):
        df.write.mode("overwrite").options(**options).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def compare_resumable(
    df: DataFrame,
    stages: Sequence,
    estimators: Mapping[str, Estimator],
    key: str,
    folder: str,
    rounds: int = 3,
    keep: str = "best",
    parallelism: int = 4,
) -> tuple[dict[str, Trained], DataFrame]:
    """As ``models.compare_models``, with every finished fit entered in a ledger below ``folder``.

    A fit is its encoder and model, saved, and then one row (model, round, auc); the row is
    written last, so what has one is whole. A run that starts again with the same rows,
    stages, estimators and key fits what is missing only. The place of an entry is a digest
    of these, so another table or another parameter never meets old entries. ``folder`` must
    be one that all executors share.
    """
    spark = df.sparkSession
    base = f"{folder.rstrip('/')}/{_digest([fingerprint(df), key, [_settings(s) for s in stages]])}"
    places = {
        (name, r): f"{base}/round-{r}/{_digest([name, _settings(e)])}" for name, e in estimators.items() for r in range(rounds)
    }
    missing = [task for task, place in places.items() if not _done(spark, f"{place}/score")]

    size, encoded = df.count(), {}
    for r in sorted({r for _, r in missing}):
        train, test = holdout(df, key, f"#{r}")
        saved = f"{base}/round-{r}/encoder"
        if not _done(spark, f"{saved}-saved"):
            Pipeline(stages=list(stages)).fit(train).write().overwrite().save(saved)
            spark.range(1).write.mode("overwrite").parquet(f"{saved}-saved")
        encoder = PipelineModel.load(saved)
        rows = encoder.transform(train)
        slim = rows.select([c for c in ("label", "features") if c in rows.columns])
        plain = PLAIN if size > TASK_ROWS else {}
        encoded[r] = encoder, _written(slim, f"{base}/round-{r}/train", **plain), _written(encoder.transform(test), f"{base}/round-{r}/test")

    def fit(task: tuple[str, int]) -> None:
        (name, r), place = task, places[task]
        encoder, train, test = encoded[r]
        model = estimators[name].copy().fit(train)
        score = balanced_accuracy(model.transform(test), "label", "prediction").first()["auc"] or 0.0
        PipelineModel([*encoder.stages, model]).write().overwrite().save(f"{place}/model")
        entry = spark.createDataFrame([(name, r, float(score))], _FIT)
        entry.write.mode("overwrite").parquet(f"{place}/score")

    with ThreadPoolExecutor(fits_at_once(df, size, parallelism)) as pool:
        list(pool.map(inheritable_thread_target(spark)(fit), missing))

    table = spark.read.schema(_FIT).parquet(*[f"{place}/score" for place in places.values()])
    scores = {(e["model"], e["round"]): e["auc"] for e in table.collect()}
    trained = {}
    for name in estimators:
        of = [scores[name, r] for r in range(rounds)]
        chosen = rounds - 1 if keep == "last" else of.index(max(of))
        model = PipelineModel.load(f"{places[name, chosen]}/model")
        trained[name] = Trained(model, model.transform(holdout(df, key, f"#{chosen}")[1]), of)
    return trained, table
