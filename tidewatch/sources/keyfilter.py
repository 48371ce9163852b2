"""Bloom filters of the keys in each day folder of a keyed table.

An insert must know which of its keys the table has, whatever their day.  Beside the
table lies, for a set of key columns, a folder of split-block Bloom filters: eight words
of 64 bits a block, one bit of each set by a key.  Looking a batch up in them names the
few days that may hold one of its keys; only the keys of those days are read.  Each
write adds the blocks of its own rows, so filters are never rewritten, and it adds them
before the rows: after a failure a filter knows too much, never too little.

Filters are built and looked up with built-in functions alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch.session import discard
from tidewatch.sources.readers import path_exists, spark_path

WORDS = 8
KEYS_PER_BLOCK = 32  # 512 bits: sixteen a key
LEAST_BLOCKS = 64
SCHEMA = f"day date, blocks bigint, block bigint, {', '.join(f'w{i} bigint' for i in range(WORDS))}"


def folder(path: str, keys: Sequence[str]) -> str:
    return f"{root(path)}/{','.join(keys)}"


def root(path: str) -> str:
    return f"{spark_path(path).rstrip('/')}_keys"


def known(spark: SparkSession, path: str) -> list[list[str]]:
    """The sets of key columns that a table has filters for."""
    if not path_exists(spark, root(path)):
        return []
    place = spark._jvm.org.apache.hadoop.fs.Path(root(path))
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)
    return [s.getPath().getName().split(",") for s in found if s.isDirectory()]


def _marks(keys: Sequence[str]) -> list[Column]:
    """The key's hash, and the bit it sets in each word."""
    spread = F.xxhash64(F.xxhash64(*keys), F.lit(1))
    bits = [
        F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(spread, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
        for i in range(WORDS)
    ]
    return [F.xxhash64(*keys).alias("hash"), *[b.alias(f"m{i}") for i, b in enumerate(bits)]]


def blocks_of(rows: DataFrame, keys: Sequence[str], day: Column) -> DataFrame:
    """The filter blocks of the rows that have a key, per day (null included)."""
    marked = rows.dropna(subset=list(keys)).select(day.alias("day"), *_marks(keys))
    size = f"greatest({LEAST_BLOCKS}, CAST(pow(2, ceil(log2(count(*) / {KEYS_PER_BLOCK}))) AS BIGINT))"
    sizes = marked.groupBy(F.col("day").alias("_day")).agg(F.expr(size).alias("blocks"))
    # One row per calendar day: there are under four million of them.
    sized = marked.join(F.broadcast(sizes), F.col("day").eqNullSafe(F.col("_day")))
    placed = sized.withColumn("block", F.expr("pmod(hash, blocks)"))
    return placed.groupBy("day", "blocks", "block").agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS)])


def add(spark: SparkSession, path: str, rows: DataFrame, day: Column) -> None:
    """Add the keys of ``rows`` to every filter of the table."""
    for keys in known(spark, path):
        blocks_of(rows, keys, day).write.mode("append").parquet(folder(path, keys))


def build(spark: SparkSession, path: str, table: DataFrame, keys: Sequence[str], day: Column) -> None:
    """The filters of a whole table, from one reading of its keys; also packs those there are."""
    blocks_of(table, keys, day).write.mode("overwrite").parquet(folder(path, keys))


def forget(spark: SparkSession, path: str) -> None:
    discard(spark, root(path))


def days_with(spark: SparkSession, path: str, batch: DataFrame, keys: Sequence[str]) -> list:
    """The days that may hold a key of ``batch``; a list of folder names, no data."""
    filters = spark.read.schema(SCHEMA).parquet(folder(path, keys))
    sizes = [r[0] for r in filters.select("blocks").distinct().collect()]  # powers of two: some forty at most
    if not sizes:
        return []
    marked = batch.dropna(subset=list(keys)).select(*_marks(keys)).distinct()
    asked = marked.withColumn("blocks", F.explode(F.array(*[F.lit(s).cast("bigint") for s in sizes])))
    asked = asked.withColumn("block", F.expr("pmod(hash, blocks)"))
    held = F.lit(True)
    for i in range(WORDS):
        held = held & (F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) != 0)
    # A day has its own blocks of every write: a key may be spread over none of them alone,
    # but each of its rows is whole in one.
    return [r[0] for r in asked.join(filters, ["blocks", "block"]).where(held).select("day").distinct().collect()]
