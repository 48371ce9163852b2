"""The two feature plans, end to end: clean, bin, encode, scale, split.

Statistics of one step read the rows of the step before, so the cleaned rows are
written once to the shared folder instead of being recomputed by every reader.
``fit_scope="train"`` fits scalers and encoders on the training rows only;
``"all"`` fits them on every row, as the published job does.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from tidewatch.operators import binning as B
from tidewatch.operators import encoding as E
from tidewatch.operators import missing as M
from tidewatch.operators import outliers as O
from tidewatch.operators import scaling as S
from tidewatch.operators import split as SP
from tidewatch.operators.projections import align_features, drop_identifiers, model_columns
from tidewatch.schemas import TARGET
from tidewatch.session import materialize

# The columns each step works on.
OUTLIER_COLUMNS = ["CreditScore", "Age", "NumOfProducts"]
NOMINAL = ["Geography", "Gender"]
SCALED = ["Balance", "EstimatedSalary", "Age"]


def _fit_side(df: DataFrame, fit_scope: str) -> DataFrame:
    if fit_scope == "all":
        return df
    if fit_scope != "train":
        raise ValueError(f"fit_scope must be 'train' or 'all', not {fit_scope!r}")
    return df.where(F.col(SP.SIDE) == "train")


def cleaned_sides(
    df: DataFrame, key: Sequence[str] = ("CustomerId",), exact_split: bool = True, test_size: float = 0.2, seed: int = 42
) -> DataFrame:
    """Rows without missing values, with the side they fall on; written once.

    The side of a row depends on its key and class alone, so the split may come first and
    everything that is fitted can be fitted on the training side.
    """
    clean = M.missing_policy_pandas(materialize(df, "raw")).withColumn(TARGET, F.col(TARGET).cast("int"))
    return materialize(SP.split_stratified(materialize(clean, "clean"), list(key), TARGET, test_size, seed, exact_split), "sided")


def one_hot_matrix(
    sided: DataFrame, categories: Mapping[str, Sequence[str]], key: Sequence[str] = ("CustomerId",), fit_scope: str = "train"
) -> DataFrame:
    """The key, the ordered model columns, the target and ``split`` of cleaned rows."""
    binned = B.bin_ordinal(E.one_hot_apply(sided, categories))
    scaled = S.scale_minmax(binned, SCALED, _fit_side(sided, fit_scope), constant=0.0)
    return align_features(scaled, model_columns(categories), keep=[*key, TARGET, SP.SIDE])


def one_hot_features(
    df: DataFrame,
    categories: Mapping[str, Sequence[str]],
    key: Sequence[str] = ("CustomerId",),
    fit_scope: str = "train",
    exact_split: bool = True,
    test_size: float = 0.2,
    seed: int = 42,
) -> DataFrame:
    """Medians and modes, 0/1 columns, ordinal credit bins, min-max scaling, stratified split.

    Returns the key, the ordered model columns, the target and ``split``.
    """
    return one_hot_matrix(cleaned_sides(df, key, exact_split, test_size, seed), categories, key, fit_scope)


def indexed_features(
    df: DataFrame,
    key: Sequence[str] = ("CustomerId",),
    fit_scope: str = "train",
    test_size: float = 0.2,
    seed: int = 42,
    nulls: str = "drop",
) -> DataFrame:
    """Mean age, outlier rows removed, named credit bins, frequency codes, min-max scaling, random split."""
    clean = materialize(M.missing_policy_spark(df), "clean")
    inliers = O.outlier_remove(clean, OUTLIER_COLUMNS, nulls=nulls)
    binned = B.bin_named_ranges(inliers, "CreditScore", B.CREDIT_RANGES, first={850: "Excellent"})
    sided = materialize(SP.split_random(binned, list(key), test_size, seed), "sided")
    fitted_on = _fit_side(sided, fit_scope)
    coded = E.index_by_frequency(sided, NOMINAL, fitted_on)
    ordinal = E.ordinal_encode(coded, {"CreditScoreBins": B.CREDIT_CODES})
    scaled = S.scale_minmax(ordinal, SCALED, fitted_on)
    return drop_identifiers(scaled, [c for c in ("RowNumber", "CustomerId", "Firstname", "Lastname") if c not in key])


def manifest(
    sided: DataFrame, categories: Mapping[str, Sequence[str]], scaled: Sequence[str] = SCALED, fit_scope: str = "train"
) -> DataFrame:
    """One row that describes a dataset of ``one_hot_matrix``: columns, shapes, classes, and
    what serving needs to repeat it: the categories and the fitted scaler limits."""
    columns = model_columns(categories)
    limits = S.fit_minmax(_fit_side(sided, fit_scope), scaled)
    train, churned = F.col(SP.SIDE) == "train", F.col(TARGET) == 1
    shape = sided.agg(
        F.lit(",".join(columns)).alias("feature_columns"),
        F.lit(TARGET).alias("target_column"),
        F.lit(len(columns)).alias("n_features"),
        F.lit(",".join(scaled)).alias("scaled_columns"),
        *[F.lit(",".join(v)).alias(f"{c}_categories") for c, v in categories.items()],
        F.count(F.when(train, 1)).alias("train_rows"),
        F.count(F.when(~train, 1)).alias("test_rows"),
        F.count(F.when(train & churned, 1)).alias("train_churned"),
        F.count(F.when(~train & churned, 1)).alias("test_churned"),
    )
    names = [f"{c}_{e}" for c in scaled for e in ("min", "max")]
    return shape.withColumn("_limits", limits.select(F.struct("*")).scalar()).select(
        *shape.columns, *[F.col(f"_limits.{n}").alias(n) for n in names],
    )


def as_json(row: DataFrame) -> DataFrame:
    """A one-row description as one JSON text."""
    return row.select(F.to_json(F.struct("*")).alias("manifest"))
