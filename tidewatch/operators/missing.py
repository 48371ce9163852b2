"""Missing values.  Fill values are scalar subqueries, so each op stays lazy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.expr import hash32
from tidewatch.functions.stats import attach, numbered, quantiles, stat, widened
from tidewatch.operators.profile import numeric_columns, text_columns, text_counts
from tidewatch.schemas import IDENTIFIERS

STATS = "_fill"


def drop_missing(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a null in ``cols``, or in any column."""
    return df.dropna(subset=list(cols) if cols else None)


def present(df: DataFrame, column: str) -> Column:
    """The value of a column, null where it is not a number."""
    c = F.col(column)
    return F.when(~F.isnan(c), c) if df.schema[column].dataType.typeName() in ("double", "float") else c


def mean_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.agg(*[F.avg(present(df, c)).alias(c) for c in cols])


def median_stats(df: DataFrame, cols: Sequence[str], method: str = "exact") -> DataFrame:
    return quantiles(df, cols, [0.5], method).agg(*widened(cols, F.col("q0")))


def mode_stats(df: DataFrame, column: str, default: str | None = None) -> DataFrame:
    """The most frequent non-null value; of equally frequent ones the smallest."""
    best = (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("_n"))
        .orderBy(F.desc("_n"), F.asc(column))
        .limit(1)
    )
    return best.agg(F.coalesce(F.max(column), F.lit(default)).alias(column))


def modes_stats(df: DataFrame, cols: Sequence[str], default: str | None = None) -> DataFrame:
    """The modes of several text columns from one scan."""
    best = F.min(F.struct((-F.col("n")).alias("rank"), "value")).alias("best")
    per_column = text_counts(df, cols).groupBy(F.col("column").alias("feature")).agg(best)
    found = per_column.agg(*widened(cols, F.col("best.value")))
    return found.select(*[F.coalesce(F.col(c), F.lit(default)).alias(c) for c in cols])


def fill_from(df: DataFrame, stats: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fill nulls and NaN of ``cols`` from the one-row ``stats`` (fitted on any frame)."""
    filled = attach(df, stats, STATS)
    return filled.withColumns({c: F.coalesce(present(df, c), stat(c, STATS)) for c in cols}).drop(STATS)


def fill_mean(df: DataFrame, column: str) -> DataFrame:
    return fill_from(df, mean_stats(df, [column]), [column])


def fill_median(df: DataFrame, column: str, method: str = "exact") -> DataFrame:
    return fill_from(df, median_stats(df, [column], method), [column])


def fill_mode(df: DataFrame, column: str) -> DataFrame:
    return fill_from(df, mode_stats(df, column), [column])


def fill_constant(df: DataFrame, column: str, value) -> DataFrame:
    return df.fillna({column: value})


def fill_constant_all(df: DataFrame, value) -> DataFrame:
    """Constant into every column of a compatible type."""
    return df.fillna(value)


def impute_numeric(df: DataFrame, cols: Sequence[str] | None = None, method: str = "mean") -> DataFrame:
    """All numeric columns at once; one scan for the means."""
    cols = list(cols or numeric_columns(df))
    stats = median_stats(df, cols) if method == "median" else mean_stats(df, cols)
    return fill_from(df, stats, cols)


def coalesce_from_lookup(
    df: DataFrame, lookup: DataFrame, keys: Sequence[str], column: str, missing: Column | None = None
) -> DataFrame:
    """Fill ``column`` from ``lookup`` on ``keys``; the row count never changes.

    Only the rows that need a value take part in the join; the rest, and with
    them any hot key, is not shuffled.  Of several lookup rows for one key the
    smallest value is used.
    """
    missing = F.col(column).isNull() if missing is None else missing
    needs = F.coalesce(missing, F.lit(False))
    answers = lookup.where(F.col(column).isNotNull()).groupBy(*keys).agg(F.min(column).alias("_found"))
    open_rows = df.where(needs).join(answers, list(keys), "left")
    done = open_rows.withColumn(column, F.coalesce("_found", F.col(column))).select(*df.columns)
    return df.where(~needs).unionByName(done)


def majority_lookup(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Per key the most frequent known value, ties to the smallest."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("_rank"), F.col(column).alias("_value")))
    return counts.groupBy(*keys).agg(best.alias("_best")).select(*keys, F.col("_best._value").alias(column))


def impute_random_valid(df: DataFrame, column: str, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Each missing value becomes one of the observed values, drawn uniformly.

    The draw hashes the row key, so a rerun or another partitioning draws the
    same.  The distinct values are numbered on the executors, and only the rows that
    need one are joined to the number they drew.  Without any value nothing is filled.
    """
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("_value")).distinct()
    options = numbered(values, F.col("_value"), name="_number")
    count = F.greatest(values.agg(F.count("*")).scalar(), F.lit(1).cast("bigint"))
    number = hash32(seed, *[F.col(k) for k in key]) % count
    missing = df.where(F.col(column).isNull()).withColumn("_number", number).join(options, "_number", "left")
    drawn = missing.withColumn(column, F.col("_value")).select(*df.columns)
    return df.where(F.col(column).isNotNull()).unionByName(drawn)


def missing_policy_pandas(df: DataFrame, skip: Sequence[str] = IDENTIFIERS, method: str = "exact") -> DataFrame:
    """Numbers → median, missing Gender → row dropped, other texts → mode or 'Unknown'.

    Medians see every row, also those dropped for their Gender; modes see the
    rows that are left.  Identifiers are no measurements and stay as they are.
    ``method="approx"`` takes medians from a sketch.
    """
    numeric = [c for c in numeric_columns(df) if c not in skip]
    known = df.dropna(subset=["Gender"]) if "Gender" in df.columns else df
    filled = fill_from(known, median_stats(df, numeric, method), numeric)
    texts = [c for c in text_columns(df) if c != "Gender" and c not in skip]
    return fill_from(filled, modes_stats(known, texts, "Unknown"), texts) if texts else filled


def missing_policy_spark(df: DataFrame, critical: Sequence[str] = ("Firstname",)) -> DataFrame:
    """Drop rows without critical values, Age → mean, Gender → 'Unknown'."""
    kept = drop_missing(df, critical)
    return fill_constant(fill_mean(kept, "Age"), "Gender", "Unknown")


def fill_sentinel(df: DataFrame, cols: Sequence[str], sentinel: str = "MISSING") -> DataFrame:
    return df.fillna(sentinel, subset=list(cols))
