"""Profiles of a table: missing values, column statistics, duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tidewatch.functions.expr import count_if, rounded, share
from tidewatch.functions.stats import quantiles


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def is_missing(df: DataFrame, column: str) -> Column:
    """Null, or NaN where the type has one."""
    missing = F.col(column).isNull()
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        missing = missing | F.isnan(column)
    return missing


def per_column(df: DataFrame, cols: Sequence[str], aggs: dict[str, object]) -> DataFrame:
    """One row per column from a single scan.

    ``aggs`` maps an output name to a function (column name → aggregate).  The
    one result row is turned into ``len(cols)`` rows afterwards.
    """
    wide = df.agg(
        *[F.struct(F.lit(c).alias("column"), *[f(c).alias(n) for n, f in aggs.items()]).alias(c) for c in cols]
    )
    return wide.select(F.explode(F.array(*[F.col(f"`{c}`") for c in cols])).alias("r")).select("r.*")


def missing_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return per_column(
        df,
        cols or df.columns,
        {
            "missing_count": lambda c: count_if(is_missing(df, c)),
            "missing_percentage": lambda c: share(count_if(is_missing(df, c)), F.count("*")),
        },
    )


def dataset_profile(df: DataFrame) -> DataFrame:
    """Rows, columns and types, with count, mean, sd, min and max of the numbers."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    numeric = set(numeric_columns(df))

    def number(f, places: int = 6):
        return lambda c: rounded(f(F.col(c).cast("double")), places) if c in numeric else F.lit(None).cast("double")

    return per_column(
        df,
        df.columns,
        {
            "data_type": lambda c: F.lit(types[c]),
            "total_rows": lambda c: F.count("*"),
            "total_columns": lambda c: F.lit(len(types)),
            "non_null": lambda c: F.count(c),
            "mean": number(F.avg),
            "stddev": number(F.stddev_samp),
            "min": number(F.min),
            "max": number(F.max),
        },
    )


def numeric_column_stats(df: DataFrame, cols: Sequence[str], method: str = "exact") -> DataFrame:
    basics = per_column(
        df,
        cols,
        {
            "null_count": lambda c: count_if(F.col(c).isNull()),
            "null_percentage": lambda c: share(count_if(F.col(c).isNull()), F.count("*")),
            "mean": lambda c: rounded(F.avg(c), 6),
            "stddev": lambda c: rounded(F.stddev_samp(c), 6),
            "min": lambda c: rounded(F.min(c), 6),
            "max": lambda c: rounded(F.max(c), 6),
        },
    )
    quartiles = quantiles(df, cols, [0.25, 0.5, 0.75], method).select(
        F.col("feature").alias("column"),
        rounded(F.col("q0"), 6).alias("q1"),
        rounded(F.col("q1"), 6).alias("median"),
        rounded(F.col("q2"), 6).alias("q3"),
    )
    return basics.join(quartiles, "column", "left")


def text_counts(df: DataFrame, cols: Sequence[str], null_as: str | None = None) -> DataFrame:
    """``(column, value, n)``: rows per value of every column, from one scan and one shuffle.

    Nulls are left out, or counted as ``null_as``.
    """
    texts = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit(null_as)).alias(c) for c in cols])
    long = texts.unpivot([], list(cols), "column", "value")
    return long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("n"))


def top_per_column(counts: DataFrame, n: int) -> DataFrame:
    """The ``n`` most frequent values of each column.

    A rank with a limit: every task keeps its best ``n`` per column before the
    shuffle, however many values there are.
    """
    rank = F.row_number().over(W.partitionBy("column").orderBy(F.desc("n"), F.asc("value")))
    return counts.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def categorical_column_stats(df: DataFrame, cols: Sequence[str], n: int = 10) -> DataFrame:
    """Distinct count and the top values of each text column."""
    counts = text_counts(df, cols)
    distinct = counts.groupBy("column").agg(F.count("*").alias("distinct_count"))
    # One row per column name.
    return top_per_column(counts, n).join(F.broadcast(distinct), "column").select(
        "column", "distinct_count", "value", F.col("n").alias("count")
    )


def duplicate_count(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows beyond the first of each group; nulls equal each other."""
    return duplicates_in(df.groupBy(*(cols or df.columns)).agg(F.count("*").alias("n")))


def duplicates_in(groups: DataFrame) -> DataFrame:
    """The same from groups that are counted already (``n``)."""
    rows = F.coalesce(F.sum("n"), F.lit(0))
    extra = F.coalesce(F.sum(F.col("n") - 1), F.lit(0))
    return groups.agg(
        rows.alias("total_rows"),
        extra.alias("duplicate_rows"),
        share(extra, rows).alias("duplicate_percentage"),
    )
