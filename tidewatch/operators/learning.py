"""Training and scoring with Spark ML; the data never leaves the executors."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import and_
from collections.abc import Callable, Iterator, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tidewatch.functions.expr import churn_label, naive, rounded
from tidewatch.sources.readers import list_versions, spark_path

LABEL = "label"
FEATURES = "features"


def assembler(cols: Sequence[str]) -> VectorAssembler:
    """Rows with a null or NaN feature are skipped."""
    return VectorAssembler(inputCols=list(cols), outputCol=FEATURES, handleInvalid="skip")


def assemble_features(df: DataFrame, cols: Sequence[str], label: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    labels = [F.col(label).cast("double").alias(LABEL)] if label else []
    inputs = df.select(*dict.fromkeys([*keep, *cols]), *labels)
    return assembler(cols).transform(inputs).select(*keep, FEATURES, *([LABEL] if label else []))


def random_forest(trees: int = 100, depth: int = 10, seed: int = 42, **params) -> RandomForestClassifier:
    return RandomForestClassifier(
        featuresCol=FEATURES, labelCol=LABEL, numTrees=trees, maxDepth=depth, seed=seed, **params
    )


def gradient_boosting(
    iterations: int = 100, depth: int = 5, step: float = 0.1, seed: int = 42, **params
) -> GBTClassifier:
    """Lineage grows with every tree; the checkpoint interval cuts it."""
    return GBTClassifier(
        featuresCol=FEATURES, labelCol=LABEL, maxIter=iterations, maxDepth=depth, stepSize=step, seed=seed,
        **{"checkpointInterval": 10, **params},
    )


def logistic(iterations: int = 1000, reg: float = 0.01, elastic: float = 0.0, **params) -> LogisticRegression:
    return LogisticRegression(
        featuresCol=FEATURES, labelCol=LABEL, maxIter=iterations, regParam=reg, elasticNetParam=elastic, **params
    )


def train(df: DataFrame, classifier, cols: Sequence[str], label: str) -> PipelineModel:
    labelled = df.select(*cols, F.col(label).cast("double").alias(LABEL))
    return Pipeline(stages=[assembler(cols), classifier]).fit(labelled)


def batch_score(
    model: PipelineModel, df: DataFrame, keep: Sequence[str], batch_id: str, scored_at: dt.datetime
) -> DataFrame:
    """Class, churn probability, status and confidence of every row, in one pass.

    A row with a null or NaN feature comes out unscored, all four null.
    """
    fitted = model.stages[0]
    every = VectorAssembler(inputCols=fitted.getInputCols(), outputCol=fitted.getOutputCol(), handleInvalid="keep")
    values = [F.col(c).cast("double") for c in fitted.getInputCols()]
    complete = reduce(and_, [v.isNotNull() & ~F.isnan(v) for v in values])
    known = lambda value: F.when(complete, value)
    probability = known(vector_to_array("probability")[1])
    return PipelineModel([every, *model.stages[1:]]).transform(df).select(
        *keep,
        known(F.col("prediction").cast("int")).alias("prediction"),
        probability.alias("probability"),
        known(churn_label(F.col("prediction"), "Churn", "Retain")).alias("status"),
        rounded(100 * probability, 2).alias("confidence"),
        F.lit(batch_id).alias("batch_id"),
        naive(scored_at).alias("scored_at"),
    )


def score_with(
    df: DataFrame, predict: Callable[[Iterator], Iterator], schema: StructType | str
) -> DataFrame:
    """Score with a model of the caller's own, batch by Arrow batch."""
    return df.mapInPandas(predict, schema)


def feature_importance(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """Importance per named feature; a linear model gives its absolute weights."""
    names = model.stages[0].getInputCols()
    classifier = model.stages[-1]
    if hasattr(classifier, "featureImportances"):
        weights = classifier.featureImportances.toArray()
    else:
        weights = abs(classifier.coefficients.toArray())
    rows = [(name, float(w)) for name, w in zip(names, weights)]
    return spark.createDataFrame(rows, "feature string, importance double")


def top_features(importance: DataFrame, n: int = 20) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(n)


LINEAGE = "run_ts string, dataset_version string, stages int, classifier string, train_rows bigint"


def save_model(
    model: PipelineModel, root: str, version: str, dataset_version: str | None = None, train_rows: int | None = None
) -> str:
    """Store a pipeline under its version, and beside it which dataset it was fitted on."""
    path = f"{spark_path(root)}/models/run_ts={version}"
    model.write().overwrite().save(path)
    last = type(model.stages[-1]).__name__
    row = [(version, dataset_version, len(model.stages), last, train_rows)]
    spark = SparkSession.active()
    spark.createDataFrame(row, LINEAGE).drop("run_ts").coalesce(1).write.mode("overwrite").json(
        f"{spark_path(root)}/lineage/run_ts={version}"
    )
    return path


def lineage(spark: SparkSession, root: str) -> DataFrame:
    """One row per stored model: its version, its dataset's version, stages, classifier, training rows."""
    rows = spark.read.schema(LINEAGE).json(f"{spark_path(root)}/lineage")
    return rows.select("run_ts", "dataset_version", "stages", "classifier", "train_rows")


def load_model(spark: SparkSession, root: str, version: str | None = None) -> PipelineModel:
    """A saved model, the newest one unless a version is named."""
    if version is None:
        versions = list_versions(spark, root, "models")
        if not versions:
            raise FileNotFoundError(f"no model below {root}")
        version = versions[-1]
    return PipelineModel.load(f"{spark_path(root)}/models/run_ts={version}")
