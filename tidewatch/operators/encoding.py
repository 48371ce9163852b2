"""Categories to numbers.

Fitted encoders are small DataFrames ``(column, category, code)``, one row per
category.  They can be fitted on one side of a split and applied to the other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import DataFrame, Window as W, functions as F

from tidewatch.functions.stats import numbered
from tidewatch.operators.missing import fill_sentinel
from tidewatch.operators.profile import text_counts, top_per_column
from tidewatch.session import materialize


def _positions(counts: DataFrame, cols: Sequence[str], by_frequency: bool) -> DataFrame:
    """Number the categories of each column from 0, on the executors and in one path at any size.

    All columns come out of the same counts, one scan and one shuffle of the table; the
    categories of all are numbered together, column by column, and each column's numbers
    start where those before it end.  The result is written once: it is joined several times.
    """
    named = counts.where(F.col("column").isin(list(cols))).select("column", F.col("value").alias("category"), "n")
    named = materialize(named, "categories")  # numbering reads them several times, the table only once
    order = [F.col("column"), -F.col("n"), F.col("category")] if by_frequency else [F.col("column"), F.col("category")]
    placed = numbered(named, *order, name="_at")
    # One row per column name, taken from a schema.
    before = W.partitionBy(F.lit(0)).orderBy("column").rowsBetween(W.unboundedPreceding, -1)
    sizes = named.groupBy("column").agg(F.count("*").alias("_size"))
    first = sizes.select("column", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_first"))
    coded = placed.join(F.broadcast(first), "column")
    return materialize(coded.select("column", "category", (F.col("_at") - F.col("_first")).cast("int").alias("code")), "encoder")


def frequency_encoder(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Codes by falling frequency, ties in alphabetical order; nulls as 'MISSING'."""
    return _positions(text_counts(df, cols, "MISSING"), cols, True)


def alphabetical_encoder(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Codes in alphabetical order; nulls as 'nan', the text a missing value has there."""
    return _positions(text_counts(df, cols, "nan"), cols, False)


def apply_encoder(
    df: DataFrame, encoder: DataFrame, cols: Sequence[str], null_as: str, unseen: str = "next"
) -> DataFrame:
    """Replace each text by its code; an unseen one gets the number of categories ("next") or null.

    The encoder is joined without a hint: a handful of categories is broadcast
    by size, a million of them is not.
    """
    for c in cols:
        mine = encoder.where(F.col("column") == c)
        lookup = mine.select(F.col("category").alias("_category"), F.col("code").alias("_code"))
        joined = df.join(lookup, F.coalesce(F.col(c).cast("string"), F.lit(null_as)) == F.col("_category"), "left")
        other = mine.agg(F.count("*").cast("int").alias("n")).scalar() if unseen == "next" else F.lit(None).cast("int")
        code = F.coalesce(F.col("_code"), other)
        df = joined.select(*[code.alias(c) if name == c else F.col(name) for name in df.columns])
    return df


def index_by_frequency(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    encoder = frequency_encoder(df if fit_on is None else fit_on, cols)
    # Nothing is unseen in the frame the encoder was fitted on.
    return apply_encoder(df, encoder, cols, "MISSING", unseen="null" if fit_on is None else "next")


def label_encode_alpha(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    encoder = alphabetical_encoder(df if fit_on is None else fit_on, cols)
    return apply_encoder(df, encoder, cols, "nan", unseen="null")


def one_hot_vector(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Replace each text by the sparse vector of its frequency index; an unseen one has no entry.

    Codes are joined, and each row's vector is built where the row is: of the categories only
    their number is needed anywhere else.
    """
    encoder = frequency_encoder(df if fit_on is None else fit_on, cols)
    coded = apply_encoder(fill_sentinel(df, cols), encoder, cols, "MISSING")
    index = [f"{c}_index" for c in cols]
    # One row with the largest code of each column, from which the lengths follow.
    largest = encoder.agg(*[
        F.coalesce(F.max(F.when(F.col("column") == c, F.col("code"))), F.lit(0)).cast("double").alias(i) for c, i in zip(cols, index)
    ])
    model = OneHotEncoder(inputCols=index, outputCols=[f"{c}_vec" for c in cols], handleInvalid="keep").fit(largest)
    numbers = coded.withColumns({i: F.col(c).cast("double") for c, i in zip(cols, index)})
    return model.transform(numbers).drop(*cols, *index)


def one_hot_capped(df: DataFrame, cols: Sequence[str], max_categories: int = 50) -> DataFrame:
    """As ``one_hot_vector``, leaving alone columns with more than ``max_categories`` values."""
    counts = fill_sentinel(df, cols).agg(*[F.countDistinct(c).alias(c) for c in cols]).first()
    few = [c for c in cols if counts[c] <= max_categories]
    return one_hot_vector(df, few) if few else df


def ordinal_encode(df: DataFrame, mappings: Mapping[str, Mapping[str, int]], unmapped: int = -1) -> DataFrame:
    """Replace by the mapped number; null stays null, other values become ``unmapped``."""
    out = df
    for c, mapping in mappings.items():
        code = F.when(F.col(c).isNull(), F.lit(None).cast("int"))
        for value, number in mapping.items():
            code = code.when(F.col(c) == value, number)
        out = out.withColumn(c, code.otherwise(unmapped))
    return out


def categories(df: DataFrame, cols: Sequence[str], max_categories: int | None = None) -> dict[str, list[str]]:
    """The sorted values of each column, as plain lists.

    They become column names, so they must be known when the plan is built.  One job for
    all columns.  With ``max_categories`` a column of more values raises before they are
    fetched; as columns they are many, and an index or a vector serves better.
    """
    found: dict[str, list[str]] = {c: [] for c in cols}
    counts = text_counts(df, cols)
    rows = counts if max_categories is None else top_per_column(counts, max_categories + 1)
    for row in rows.select("column", "value").toLocalIterator():
        found[row["column"]].append(row["value"])
    for c, values in found.items():
        if max_categories is not None and len(values) > max_categories:
            raise ValueError(f"{c} has more than {max_categories} categories; index it instead")
    return {c: sorted(values) for c, values in found.items()}


def one_hot_apply(df: DataFrame, values: Mapping[str, Sequence[str]]) -> DataFrame:
    """A 0/1 column per known category; an unseen value or null gives zeros."""
    kept = [c for c in df.columns if c not in values]
    hot = [
        F.when(F.col(c) == v, 1).otherwise(0).alias(f"{c}_{v}") for c, known in values.items() for v in known
    ]
    return df.select(*kept, *hot)


def one_hot_columns(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    return one_hot_apply(df, categories(df if fit_on is None else fit_on, cols))


def encoder_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Alphabetical codes of the non-null categories, as published next to a dataset."""
    return _positions(text_counts(df, cols), cols, False)
