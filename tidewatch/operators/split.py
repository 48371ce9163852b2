"""Train/test splits and samples that depend on row keys alone.

A row lands on its side because of the hash of its key, so adding executors,
repartitioning or rerunning never moves it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewatch.functions.expr import hash32, share
from tidewatch.functions.stats import attach, stat

SPACE = 2**32
SIDE = "split"


def split_random(df: DataFrame, key: Sequence[str], test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``split``; no shuffle.  The shares hold in expectation."""
    cut = int(test_size * SPACE)
    return df.withColumn(SIDE, F.when(hash32(seed, *_cols(key)) < cut, "test").otherwise("train"))


def split_stratified(
    df: DataFrame,
    key: Sequence[str],
    target: str,
    test_size: float = 0.2,
    seed: int = 42,
    exact: bool = False,
    cells: int = 65536,
) -> DataFrame:
    """Add ``split`` with equal class shares on both sides.

    By default the hash decides and the shares hold in expectation.  With
    ``exact`` the per-class numbers are those of a stratified draw of
    ceil(test_size · n) rows: largest remainders, ties to the smaller class.
    The rows with the largest hashes of a class form the test side.  A class is
    never sorted as a whole: the hash range is cut into ``cells``, counting
    them shows which single cell is divided, and only its rows are ordered.
    """
    if not exact:
        return split_random(df, key, test_size, seed)
    placed = df.withColumns({"_hash": hash32(seed, *_cols(key)), "_class": F.col(target)}).withColumn(
        "_cell", F.floor(F.col("_hash") * F.lit(cells) / F.lit(SPACE)).cast("int")
    )
    # One row per class and cell from here to `limits`.
    cell_counts = placed.groupBy("_class", "_cell").agg(F.count("*").alias("_n"))
    quotas = train_quotas(cell_counts.groupBy("_class").agg(F.sum("_n").alias("_n")), test_size)
    before = W.partitionBy("_class").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    limits = (
        cell_counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .join(quotas, F.col("_class").eqNullSafe(F.col("_quota_class")))
        .where((F.col("_before") <= F.col("_quota")) & (F.col("_quota") < F.col("_before") + F.col("_n")))
        .select(
            F.col("_class").alias("_limit_class"),
            F.col("_cell").alias("_limit_cell"),
            (F.col("_quota") - F.col("_before")).alias("_left"),
        )
    )
    # One row per class; a class without a limit goes to the training side whole.
    known = placed.join(F.broadcast(limits), F.col("_class").eqNullSafe(F.col("_limit_class")), "left")
    divided = F.coalesce(F.col("_cell") == F.col("_limit_cell"), F.lit(False))
    whole = known.where(~divided).withColumn(
        SIDE, F.when(F.col("_cell") > F.col("_limit_cell"), "test").otherwise("train")
    )
    order = W.partitionBy("_class").orderBy("_hash", *_cols(key))
    partly = known.where(divided).withColumn(
        SIDE, F.when(F.row_number().over(order) > F.col("_left"), "test").otherwise("train")
    )
    return whole.unionByName(partly).select(*df.columns, SIDE)


def train_quotas(class_counts: DataFrame, test_size: float) -> DataFrame:
    """Training rows per class (``_quota``); input and output have one row per class."""
    total = class_counts.agg(F.sum("_n").alias("n"))
    everyone = attach(class_counts, total, "_all")
    n = stat("n", "_all")
    train = n - F.ceil(n * F.lit(test_size))
    wanted = F.col("_n") * train / n
    shares = everyone.select(
        F.col("_class").alias("_quota_class"),
        F.floor(wanted).cast("bigint").alias("_floor"),
        F.round(wanted - F.floor(wanted), 9).alias("_rest"),
        train.alias("_train"),
    )
    assigned = shares.agg(F.sum("_floor").alias("floor"))
    rank = F.row_number().over(W.partitionBy("_train").orderBy(F.desc("_rest"), F.asc("_quota_class")))
    ranked = attach(shares, assigned, "_assigned").withColumn("_rank", rank)
    extra = (F.col("_rank") <= F.col("_train") - stat("floor", "_assigned")).cast("int")
    return ranked.select("_quota_class", (F.col("_floor") + extra).alias("_quota"))


def side(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col(SIDE) == name).drop(SIDE)


def sample_n(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer), the same ones on every run."""
    order = [hash32(seed, *_cols(key)), *_cols(key)]
    return df.orderBy(*order).limit(n)


def sample_fraction(df: DataFrame, fraction: float, key: Sequence[str], seed: int = 42) -> DataFrame:
    return df.where(hash32(seed, *_cols(key)) < math.floor(fraction * SPACE))


def split_report(df: DataFrame, target: str) -> DataFrame:
    """Rows per side and class, the class share within the side and the side share."""
    counts = df.groupBy(SIDE, target).agg(F.count("*").alias("count"))
    # One row per side and class.
    within = F.sum("count").over(W.partitionBy(SIDE))
    total = counts.agg(F.sum("count").alias("total"))
    return attach(counts.withColumn("side_rows", within), total).select(
        SIDE,
        F.col(target).alias("target"),
        "count",
        "side_rows",
        share(F.col("count"), F.col("side_rows")).alias("class_percentage"),
        share(F.col("side_rows"), stat("total")).alias("side_percentage"),
    )


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]
