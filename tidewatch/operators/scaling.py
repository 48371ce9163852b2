"""Scaling by fitted statistics.

``fit_*`` gives a one-row DataFrame, ``apply_*`` turns it into expressions.
Fit on the training side and apply to both sides to keep the test rows out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import MinMaxScaler, StandardScaler, VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.expr import rounded
from tidewatch.functions.stats import attach, stat
from tidewatch.operators.profile import per_column

STATS = "_scale"


def fit_minmax(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.agg(
        *[F.min(c).cast("double").alias(f"{c}_min") for c in cols],
        *[F.max(c).cast("double").alias(f"{c}_max") for c in cols],
    )


def _minmax(column: str, low: Column, high: Column, constant: float) -> Column:
    value = F.col(column).cast("double")
    return F.when(high == low, F.when(value.isNotNull(), F.lit(float(constant)))).otherwise(
        F.try_divide(value - low, high - low)
    )


def apply_minmax(df: DataFrame, stats: DataFrame, cols: Sequence[str], constant: float = 0.5) -> DataFrame:
    """(x − min) / (max − min); ``constant`` where the column had one value only."""
    scaled = attach(df, stats, STATS)
    return scaled.withColumns(
        {c: _minmax(c, stat(f"{c}_min", STATS), stat(f"{c}_max", STATS), constant) for c in cols}
    ).drop(STATS)


def scale_minmax(
    df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None, constant: float = 0.5
) -> DataFrame:
    return apply_minmax(df, fit_minmax(df if fit_on is None else fit_on, cols), cols, constant)


def scale_apply(
    df: DataFrame, limits: Mapping[str, tuple[float, float]], constant: float = 0.0
) -> DataFrame:
    """Apply stored minima and maxima; nothing is fitted."""
    return df.withColumns(
        {c: _minmax(c, F.lit(float(a)), F.lit(float(b)), constant) for c, (a, b) in limits.items() if c in df.columns}
    )


def fit_standard(df: DataFrame, cols: Sequence[str], ddof: int = 1) -> DataFrame:
    deviation = {0: F.stddev_pop, 1: F.stddev_samp}[ddof]
    return df.agg(
        *[F.avg(c).alias(f"{c}_mean") for c in cols],
        *[deviation(c).alias(f"{c}_sd") for c in cols],
    )


def apply_standard(
    df: DataFrame, stats: DataFrame, cols: Sequence[str], with_mean: bool = True, with_std: bool = True
) -> DataFrame:
    """Centre and divide; a column without spread is only centred."""
    def scaled(c: str) -> Column:
        value = F.col(c).cast("double")
        if with_mean:
            value = value - stat(f"{c}_mean", STATS)
        if with_std:
            sd = stat(f"{c}_sd", STATS)
            value = F.when(sd > 0, F.try_divide(value, sd)).otherwise(value)
        return value

    return attach(df, stats, STATS).withColumns({c: scaled(c) for c in cols}).drop(STATS)


def scale_standard(
    df: DataFrame,
    cols: Sequence[str],
    fit_on: DataFrame | None = None,
    with_mean: bool = True,
    with_std: bool = True,
    ddof: int = 1,
) -> DataFrame:
    stats = fit_standard(df if fit_on is None else fit_on, cols, ddof)
    return apply_standard(df, stats, cols, with_mean, with_std)


def scale_vector(df: DataFrame, cols: Sequence[str], kind: str = "minmax", nulls: str = "error") -> DataFrame:
    """Assemble ``cols`` and scale them as one vector, ``scaled_features``.

    A row with a null or NaN among them is an error, or with ``nulls="keep"`` stays
    without a vector; the scaler is fitted on complete rows.
    """
    scalers = {
        "minmax": MinMaxScaler(inputCol="_features", outputCol="scaled_features"),
        "standard": StandardScaler(inputCol="_features", outputCol="scaled_features"),
    }
    if kind not in scalers:
        raise ValueError(f"unknown scaling {kind!r}")
    if nulls not in ("error", "keep"):
        raise ValueError(f"nulls must be 'error' or 'keep', not {nulls!r}")
    assembler = VectorAssembler(inputCols=list(cols), outputCol="_features", handleInvalid="error")
    rows = df.dropna(subset=list(cols)) if nulls == "keep" else df
    scaled = Pipeline(stages=[assembler, scalers[kind]]).fit(rows).transform(rows).drop("_features")
    if nulls == "error":
        return scaled
    complete = F.lit(True)
    for c in cols:
        value = F.col(c).cast("double")
        complete = complete & value.isNotNull() & ~F.isnan(value)
    return scaled.unionByName(df.where(~complete).withColumn("scaled_features", F.lit(None).cast(VectorUDT())))


def scaler_params(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fitted parameters in long form, as stored next to a dataset."""
    return per_column(
        df,
        cols,
        {
            "data_min": lambda c: F.min(c).cast("double"),
            "data_max": lambda c: F.max(c).cast("double"),
            "mean": lambda c: rounded(F.avg(c), 6),
            "stddev": lambda c: rounded(F.stddev_samp(c), 6),
        },
    )
