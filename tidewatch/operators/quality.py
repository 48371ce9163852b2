"""Data checks and drift.  Each rule is a row (check, column, observed, threshold, passed)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidewatch.functions.expr import count_if, rounded
from tidewatch.functions.stats import running_counts, unpivoted
from tidewatch.operators.outliers import outlier_share
from tidewatch.operators.profile import duplicates_in
from tidewatch.operators.reports import union_all
from tidewatch.schemas import CATEGORICAL, NUMERIC, REQUIRED, TARGET

# The published limits.
MIN_ROWS = 5000
MIN_COLUMNS = 12
MAX_MISSING = 8.0
MAX_DUPLICATES = 1.0
MIN_MINORITY = 20.0
MAX_MAJORITY = 80.0
MAX_OUTLIERS = 10.0
DRIFT_LEVEL = 0.05
DRIFT_HIGH = 0.01
RANGES = {
    "CreditScore": (300, 900),
    "Age": (18, 100),
    "Tenure": (0, 10),
    "Balance": (0, 1000000),
    "NumOfProducts": (1, 4),
    "EstimatedSalary": (0, 1000000),
    "Exited": (0, 1),
}
ALLOWED = {"Geography": ["France", "Spain", "Germany"], "Gender": ["Male", "Female"]}
OUTLIER_COLUMNS = ["CreditScore", "Age", "Balance", "NumOfProducts"]

Rule = tuple[str, str, Column, float | None, Column]


def rules_frame(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """All rules from one scan: a single aggregate row, unfolded afterwards."""
    rows = [
        F.struct(
            F.lit(check).alias("check"),
            F.lit(column).alias("column"),
            rounded(observed, 6).alias("observed"),
            F.lit(threshold).cast("double").alias("threshold"),
            F.coalesce(passed, F.lit(True)).alias("passed"),
        )
        for check, column, observed, threshold, passed in rules
    ]
    return df.agg(F.array(*rows).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


def shape_rules(df: DataFrame, min_rows: int = MIN_ROWS, min_columns: int = MIN_COLUMNS) -> list[Rule]:
    rows, columns = F.count("*"), F.lit(len(df.columns))
    return [
        ("rows", "*", rows, min_rows, rows >= min_rows),
        ("columns", "*", columns, min_columns, columns >= min_columns),
    ]


def column_rules(df: DataFrame, required: Sequence[str] = REQUIRED) -> list[Rule]:
    """Is each column there; ``observed`` is its number of values."""
    return [
        ("required_column", c, F.count(c) if c in df.columns else F.lit(0), None, F.lit(c in df.columns))
        for c in required
    ]


def type_rules(
    df: DataFrame, numeric: Sequence[str] = (*NUMERIC, TARGET), text: Sequence[str] = CATEGORICAL
) -> list[Rule]:
    kinds = [(c, T.NumericType, "numeric_type") for c in numeric] + [(c, T.StringType, "text_type") for c in text]
    return [
        (check, c, F.count(c), None, F.lit(isinstance(df.schema[c].dataType, kind)))
        for c, kind, check in kinds
        if c in df.columns
    ]


def range_rules(df: DataFrame, ranges: Mapping[str, tuple[float, float]] = RANGES) -> list[Rule]:
    out = []
    for c, (low, high) in ranges.items():
        if c in df.columns:
            out.append(("minimum", c, F.min(c), low, F.min(c) >= low))
            out.append(("maximum", c, F.max(c), high, F.max(c) <= high))
    return out


def category_rules(df: DataFrame, allowed: Mapping[str, Sequence[str]] = ALLOWED) -> list[Rule]:
    """Rows outside the list; a null is one of them."""
    out = []
    for c, values in allowed.items():
        if c in df.columns:
            invalid = count_if(F.col(c).isNull() | ~F.col(c).isin(list(values)))
            out.append(("invalid_category", c, invalid, 0, invalid == 0))
    return out


def unexpected_values(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """The values that are not in the list, with their row counts."""
    outside = df.where(F.col(column).isNull() | ~F.col(column).isin(list(allowed)))
    return outside.groupBy(F.lit(column).alias("column"), F.col(column).alias("value")).agg(
        F.count("*").alias("count")
    )


def missing_rules(
    df: DataFrame, cols: Sequence[str] = REQUIRED, limit: float = MAX_MISSING
) -> list[Rule]:
    out = []
    for c in cols:
        if c in df.columns:
            percentage = F.try_divide(100.0 * count_if(F.col(c).isNull()), F.count("*"))
            out.append(("missing_percentage", c, percentage, limit, percentage <= limit))
    return out


def balance_rules(
    df: DataFrame,
    target: str = TARGET,
    min_minority: float = MIN_MINORITY,
    max_majority: float = MAX_MAJORITY,
) -> list[Rule]:
    if target not in df.columns:
        return []
    zero = F.try_divide(100.0 * count_if(F.col(target) == 0), F.count("*"))
    one = F.try_divide(100.0 * count_if(F.col(target) == 1), F.count("*"))
    minority, majority = F.least(zero, one), F.greatest(zero, one)
    return [
        ("minority_percentage", target, minority, min_minority, minority >= min_minority),
        ("majority_percentage", target, majority, max_majority, majority <= max_majority),
        ("imbalance_ratio", target, F.try_divide(majority, minority), None, F.lit(True)),
    ]


def check_duplicates(df: DataFrame, key: str = "CustomerId", limit: float = MAX_DUPLICATES) -> DataFrame:
    def row(found: DataFrame, check: str, column: str) -> DataFrame:
        percentage = F.try_divide(100.0 * F.col("duplicate_rows"), F.col("total_rows"))
        return found.select(
            F.lit(check).alias("check"),
            F.lit(column).alias("column"),
            rounded(percentage, 6).alias("observed"),
            F.lit(float(limit)).alias("threshold"),
            F.coalesce(percentage <= limit, F.lit(True)).alias("passed"),
        )

    # Distinct rows with their counts serve both checks: the table is read and shuffled once.
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("n"))
    parts = [row(duplicates_in(groups), "duplicate_rows", "*")]
    if key in df.columns:
        keys = groups.groupBy(key).agg(F.sum("n").alias("n"))
        parts.insert(0, row(duplicates_in(keys), "duplicate_keys", key))
    return union_all(parts)


def check_outlier_share(
    df: DataFrame, cols: Sequence[str] = OUTLIER_COLUMNS, limit: float = MAX_OUTLIERS
) -> DataFrame:
    return outlier_share(df, cols).select(
        F.lit("outlier_percentage").alias("check"),
        "column",
        F.col("outlier_percentage").alias("observed"),
        F.lit(float(limit)).alias("threshold"),
        F.coalesce(F.col("outlier_percentage") <= limit, F.lit(True)).alias("passed"),
    )


def kolmogorov_tail(x: Column, terms: int = 100) -> Column:
    """P(K > x) of the Kolmogorov distribution, by its alternating series."""
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * x * x),
    )
    return F.when(x < 0.04, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def drift_ks(
    current: DataFrame,
    reference: DataFrame,
    cols: Sequence[str],
    level: float = DRIFT_LEVEL,
    high: float = DRIFT_HIGH,
) -> DataFrame:
    """Two-sample Kolmogorov–Smirnov per column, with the asymptotic p-value.

    Equal values are counted before anything is ordered, and the order is built
    in value ranges, so neither a hot value nor a large column ends in one task.
    """
    sides = unpivoted(reference, cols).select("feature", "value", F.lit(1).alias("r"), F.lit(0).alias("c")).unionByName(
        unpivoted(current, cols).select("feature", "value", F.lit(0).alias("r"), F.lit(1).alias("c"))
    )
    points = sides.groupBy("feature", "value").agg(
        F.sum("r").cast("bigint").alias("n_reference"), F.sum("c").cast("bigint").alias("n_current")
    )
    totals = points.groupBy("feature").agg(
        F.sum("n_reference").alias("reference_rows"), F.sum("n_current").alias("current_rows")
    )
    # One row per feature name.
    steps = running_counts(points, ["n_reference", "n_current"], ["feature"]).join(F.broadcast(totals), "feature")
    gap = F.abs(
        F.try_divide(F.col("upto_n_reference").cast("double"), F.col("reference_rows"))
        - F.try_divide(F.col("upto_n_current").cast("double"), F.col("current_rows"))
    )
    n1, n2 = F.col("reference_rows").cast("double"), F.col("current_rows").cast("double")
    measured = (
        steps.groupBy("feature", "reference_rows", "current_rows")
        .agg(F.max(gap).alias("d"))
        .where(F.col("d").isNotNull())
        .withColumn("p", kolmogorov_tail(F.sqrt(n1 * n2 / (n1 + n2)) * F.col("d")))
    )
    return measured.select(
        F.col("feature").alias("column"),
        "reference_rows",
        "current_rows",
        rounded(F.col("d"), 9).alias("statistic"),
        rounded(F.col("p"), 6).alias("p_value"),
        F.when(F.col("p") < high, "HIGH").when(F.col("p") < level, "MEDIUM").otherwise("NONE").alias("severity"),
        (F.col("p") >= high).alias("passed"),
    )


def scan_rules(df: DataFrame) -> list[Rule]:
    return [
        *shape_rules(df), *column_rules(df), *type_rules(df), *range_rules(df),
        *category_rules(df), *missing_rules(df), *balance_rules(df),
    ]


# The report line each rule belongs to.
REPORT_LINES = {
    "Shape": ["rows", "columns"],
    "Required Columns": ["required_column"],
    "Data Types": ["numeric_type", "text_type"],
    "Value Ranges": ["minimum", "maximum"],
    "Categorical Values": ["invalid_category"],
    "Missing Values": ["missing_percentage"],
    "Duplicates": ["duplicate_keys", "duplicate_rows"],
    "Class Balance": ["minority_percentage", "majority_percentage", "imbalance_ratio"],
    "Data Drift": ["drift"],
}


def validation_report(df: DataFrame, drift: DataFrame | None = None, key: str = "CustomerId") -> DataFrame:
    """PASS or FAIL per check and in total.

    Without reference data the drift check passes.  Two passes over the table:
    one scan for all simple rules, one aggregation for the duplicates.
    """
    rules = union_all([rules_frame(df, scan_rules(df)), check_duplicates(df, key)])
    found = rules.select("check", "passed")
    if drift is not None:
        found = found.unionByName(drift.select(F.lit("drift").alias("check"), "passed"))
    line = F.lit(None).cast("string")
    for name, checks in REPORT_LINES.items():
        line = F.when(F.col("check").isin(checks), name).otherwise(line)
    # Every rule counts for its line and for the total, in one aggregation.
    counted = found.select(F.explode(F.array(line, F.lit("Total"))).alias("name"), "passed")
    return (
        counted.groupBy("name")
        .agg(F.count("*").alias("rules"), count_if(~F.col("passed")).alias("failed_rules"))
        .withColumn("status", F.when(F.col("failed_rules") == 0, "PASS").otherwise("FAIL"))
    )
