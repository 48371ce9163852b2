"""Interquartile-range and z-score outliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.expr import count_if, share
from tidewatch.functions.stats import attach, quantiles, stat, widened
from tidewatch.operators.profile import per_column

STATS = "_iqr"


def iqr_bounds(df: DataFrame, cols: Sequence[str], k: float = 1.5, method: str = "exact") -> DataFrame:
    """Per column: quartiles and the fences k·IQR beyond them."""
    spread = F.col("q1") - F.col("q0")
    return quantiles(df, cols, [0.25, 0.75], method).select(
        "feature",
        F.col("q0").alias("first_quartile"),
        F.col("q1").alias("third_quartile"),
        (F.col("q0") - k * spread).alias("lower_bound"),
        (F.col("q1") + k * spread).alias("upper_bound"),
    )


def _one_row(bounds: DataFrame, cols: Sequence[str]) -> DataFrame:
    return bounds.agg(
        *widened(cols, F.col("lower_bound"), "_lo"), *widened(cols, F.col("upper_bound"), "_hi")
    )


def _beyond(column: str) -> Column:
    c = F.col(column)
    return (c < stat(f"{column}_lo", STATS)) | (c > stat(f"{column}_hi", STATS))


def iqr_flag(df: DataFrame, cols: Sequence[str], bounds: DataFrame | None = None, method: str = "exact") -> DataFrame:
    """Add ``<col>_outlier``; null where the value is null."""
    bounds = iqr_bounds(df, cols, method=method) if bounds is None else bounds
    flagged = attach(df, _one_row(bounds, cols), STATS)
    return flagged.withColumns({f"{c}_outlier": _beyond(c) for c in cols}).drop(STATS)


def outlier_remove(
    df: DataFrame,
    cols: Sequence[str],
    min_outliers: int = 2,
    nulls: str = "drop",
    bounds: DataFrame | None = None,
    method: str = "exact",
) -> DataFrame:
    """Keep rows with fewer than ``min_outliers`` flags.

    A null in a checked column makes the flag count null, which drops the row;
    ``nulls="keep"`` counts it as no outlier instead.
    """
    if nulls not in ("drop", "keep"):
        raise ValueError(f"nulls must be 'drop' or 'keep', not {nulls!r}")
    bounds = iqr_bounds(df, cols, method=method) if bounds is None else bounds
    attached = attach(df, _one_row(bounds, cols), STATS)
    flags = [_beyond(c).cast("int") for c in cols]
    if nulls == "keep":
        flags = [F.coalesce(f, F.lit(0)) for f in flags]
    total = flags[0]
    for f in flags[1:]:
        total = total + f
    return attached.where(total < min_outliers).drop(STATS)


def outlier_cap(df: DataFrame, cols: Sequence[str], bounds: DataFrame | None = None, method: str = "exact") -> DataFrame:
    """Clamp to the fences; null stays null."""
    bounds = iqr_bounds(df, cols, method=method) if bounds is None else bounds
    attached = attach(df, _one_row(bounds, cols), STATS)

    def clamp(c: str) -> Column:
        low, high = stat(f"{c}_lo", STATS), stat(f"{c}_hi", STATS)
        return F.when(F.col(c) < low, low).when(F.col(c) > high, high).otherwise(F.col(c))

    return attached.withColumns({c: clamp(c) for c in cols}).drop(STATS)


def zscore_flag(df: DataFrame, cols: Sequence[str], threshold: float = 3.0) -> DataFrame:
    """Add ``<col>_outlier``: more than ``threshold`` standard deviations off the mean."""
    stats = df.agg(
        *[F.avg(c).alias(f"{c}_mean") for c in cols],
        *[F.stddev_samp(c).alias(f"{c}_sd") for c in cols],
    )
    attached = attach(df, stats, STATS)
    flags = {
        f"{c}_outlier": F.abs(F.col(c) - stat(f"{c}_mean", STATS)) > threshold * stat(f"{c}_sd", STATS)
        for c in cols
    }
    return attached.withColumns(flags).drop(STATS)


def outlier_share(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column the number and percentage of IQR outliers."""
    flagged = iqr_flag(df, cols)
    return per_column(
        flagged,
        cols,
        {
            "outliers": lambda c: count_if(F.col(f"{c}_outlier")),
            "outlier_percentage": lambda c: share(count_if(F.col(f"{c}_outlier")), F.count("*")),
        },
    )
