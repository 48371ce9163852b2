"""Binning of numbers into named, half-open or ordinal bins."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# The published bin edges, labels and codes.
CREDIT_RANGES = {
    "Poor": [300, 580],
    "Fair": [580, 670],
    "Good": [670, 740],
    "Very Good": [740, 800],
    "Excellent": [800, 850],
}
CREDIT_CODES = {"Poor": 0, "Fair": 1, "Good": 2, "Very Good": 3, "Excellent": 4}
CREDIT_SPLITS = [0, 450, 580, 680, 750, math.inf]
CREDIT_SPLIT_LABELS = ["Poor", "Fair", "Good", "Very Good", "Excellent"]
CREDIT_LIMITS = [580, 670, 740, 800]


def bin_named_ranges(
    df: DataFrame,
    column: str,
    ranges: Mapping[str, Sequence[float]],
    first: Mapping[float, str] | None = None,
    otherwise: str = "Invalid",
) -> DataFrame:
    """Replace ``column`` by ``<column>Bins``.

    Ranges include both ends and the first match wins; one number means no upper
    end.  ``first`` maps single values that are decided before any range.
    Everything else, null included, becomes ``otherwise``.
    """
    value = F.col(column)
    rules = [(value == v, label) for v, label in (first or {}).items()]
    for label, edges in ranges.items():
        inside = value >= edges[0]
        rules.append((inside & (value <= edges[1]) if len(edges) == 2 else inside, label))
    return df.withColumn(f"{column}Bins", _first_match(rules, otherwise)).drop(column)


def bin_splits(
    df: DataFrame,
    column: str,
    splits: Sequence[float],
    labels: Sequence[str] | None = None,
    otherwise: str = "Unknown",
) -> DataFrame:
    """Replace ``column`` by the half-open bin [a, b) it falls in.

    The last bin includes its upper end.  Without labels the bin number (a
    double) is kept; null, NaN and values outside are then null, else ``otherwise``.
    """
    value = F.col(column)
    is_number = ~F.isnan(value.cast("double"))
    last = len(splits) - 2
    rules = []
    for i in range(last + 1):
        inside = is_number & (value >= float(splits[i]))
        if splits[i + 1] != math.inf:
            upper = float(splits[i + 1])
            inside = inside & (value <= upper if i == last else value < upper)
        rules.append((inside, labels[i] if labels else float(i)))
    return df.withColumn(f"{column}Bins", _first_match(rules, otherwise if labels else None)).drop(column)


def bin_credit_preset(df: DataFrame, column: str = "CreditScore") -> DataFrame:
    return bin_splits(df, column, CREDIT_SPLITS, CREDIT_SPLIT_LABELS)


def bin_ordinal(
    df: DataFrame,
    column: str = "CreditScore",
    limits: Sequence[float] = CREDIT_LIMITS,
    null_code: int | None = None,
) -> DataFrame:
    """Add ``<column>Bins``: how many limits lie below the value.

    Null counts as beyond the last limit, as in training; serving passes 2.
    """
    value = F.col(column)
    null_code = len(limits) if null_code is None else null_code
    rules = [(value.isNull(), null_code)] + [(value <= limit, i) for i, limit in enumerate(limits)]
    return df.withColumn(f"{column}Bins", _first_match(rules, len(limits)))


def _first_match(rules: Sequence[tuple[Column, object]], otherwise: object) -> Column:
    out = None
    for condition, result in rules:
        out = F.when(condition, F.lit(result)) if out is None else out.when(condition, F.lit(result))
    return out.otherwise(F.lit(otherwise))
