"""Preprocessing and model as one saved pipeline: what was fitted in training serves unchanged.

Each step is a Spark ML transformer whose fitted values are parameters, so a pipeline of
them is saved and loaded with its model.  Serving fits nothing: categories and scaler
limits are those of the training rows, an unseen category gets zeros, a missing credit
score the middle class.  The raw row travels along in one column, so a scored event can
still name its customer.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from tidewatch.operators import binning as B
from tidewatch.operators import encoding as E
from tidewatch.operators import scaling as S
from tidewatch.operators.learning import FEATURES, LABEL
from tidewatch.operators.projections import align_features, model_columns

RAW = "_raw"  # the column that holds the row as it came
UNKNOWN_CLASS = 2  # fixed value: the credit class of a row without a credit score


class _Stored(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A step whose fitted values are one JSON parameter."""

    fitted = Param(Params._dummy(), "fitted", "what training found, as JSON", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, fitted: str | None = None):
        super().__init__()
        if fitted is not None:
            self._set(fitted=fitted)

    @classmethod
    def of(cls, value) -> _Stored:
        return cls(fitted=json.dumps(value))

    @property
    def value(self):
        return json.loads(self.getOrDefault(self.fitted))


class KeepRaw(_Stored):
    """Adds the row as it came as one struct column."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.value, F.struct(*[F.col(f"`{c}`") for c in df.columns]))


class StoredOneHot(_Stored):
    """0/1 columns of the training categories; a column that is absent is left to the alignment."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return E.one_hot_apply(df, {c: v for c, v in self.value.items() if c in df.columns})


class StoredBins(_Stored):
    """The ordinal credit class beside the credit score."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return B.bin_ordinal(df, null_code=self.value) if "CreditScore" in df.columns else df


class StoredScaler(_Stored):
    """Min-max scaling by the training limits."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return S.scale_apply(df, {c: tuple(limits) for c, limits in self.value.items()})


class Aligned(_Stored):
    """The model columns in their order; absent ones are 0, others go, the raw row stays."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return align_features(df, self.value, keep=[RAW])


def fit_preprocessing(
    train: DataFrame, nominal: Sequence[str], scaled: Sequence[str], categories: Mapping[str, Sequence[str]] | None = None
) -> PipelineModel:
    """The steps with the values of the training rows: one job for categories, one for limits."""
    known = {c: list(v) for c, v in (categories or E.categories(train, nominal)).items()}
    row = S.fit_minmax(train, scaled).first()
    limits = {c: (row[f"{c}_min"], row[f"{c}_max"]) for c in scaled if row[f"{c}_min"] is not None}
    return PipelineModel(
        [KeepRaw.of(RAW), StoredOneHot.of(known), StoredBins.of(UNKNOWN_CLASS), StoredScaler.of(limits), Aligned.of(model_columns(known))]
    )


def fit_serving(
    train: DataFrame, classifier, label: str, nominal: Sequence[str], scaled: Sequence[str],
    categories: Mapping[str, Sequence[str]] | None = None,
) -> PipelineModel:
    """Preprocessing and classifier, fitted on the training rows, as one pipeline to save.

    Rows with a null feature are not learnt from; serving leaves them unscored.
    """
    steps = fit_preprocessing(train, nominal, scaled, categories)
    columns = steps.stages[-1].value
    assembler = VectorAssembler(inputCols=columns, outputCol=FEATURES, handleInvalid="keep")
    ready = steps.transform(train).select(F.col(f"{RAW}.{label}").cast("double").alias(LABEL), *columns).dropna()
    return PipelineModel([*steps.stages, assembler, classifier.fit(assembler.transform(ready))])


def preprocess(model: PipelineModel, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The model matrix of raw rows, and the raw columns ``keep``."""
    steps = [s for s in model.stages if isinstance(s, _Stored)]
    ready = PipelineModel(steps).transform(df)
    return ready.select(*[F.col(f"{RAW}.`{c}`").alias(c) for c in keep], *steps[-1].value)


def serve(model: PipelineModel, df: DataFrame) -> DataFrame:
    """The raw rows with probability and prediction, both null where a feature is missing."""
    steps = [s for s in model.stages if isinstance(s, _Stored)]
    found = model.transform(df)
    complete = F.lit(True)
    for c in steps[-1].value:
        value = F.col(f"`{c}`").cast("double")
        complete = complete & value.isNotNull() & ~F.isnan(value)
    return found.select(
        f"{RAW}.*",
        F.when(complete, vector_to_array("probability")[1]).alias("probability"),
        F.when(complete, F.col("prediction").cast("int")).alias("prediction"),
    )
