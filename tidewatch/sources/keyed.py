"""Keyed writes into Parquet tables: insert-if-absent, upsert, archive.

The functions without ``_table`` are plain DataFrame algebra.  The ``_table``
functions apply them to a table partitioned by day and rewrite only the days
that change.  A row without a time lies in a folder of its own, the day null.
Tables have one writer at a time; their work copies are deleted when it is done.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch.functions.expr import naive
from tidewatch.session import scratch
from tidewatch.sources import keyfilter
from tidewatch.sources.readers import path_exists, spark_path


def one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: str) -> DataFrame:
    """The first or last row of each key in ``order``.

    Min and max of a struct combine before the shuffle, so a key that holds most
    of the batch is one row per task when it arrives.  All columns take part in
    the order, which makes the choice unique.
    """
    pick = {"first": F.min, "last": F.max}[keep]
    rest = [c for c in df.columns if c not in keys]
    ordered = [*order, *[c for c in rest if c not in order]]
    best = df.groupBy(*keys).agg(pick(F.struct(*[F.col(c) for c in ordered if c not in keys])).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def _has_key(keys: Sequence[str]) -> Column:
    known = F.col(keys[0]).isNotNull()
    for k in keys[1:]:
        known = known & F.col(k).isNotNull()
    return known


def new_rows(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows of ``batch`` an insert-if-absent adds: the first of each unknown key.

    A null never equals a null, so rows without a key are all new; they skip the
    join and do not pile up in one partition.
    """
    keyed = one_per_key(batch.where(_has_key(keys)), keys, order, "first")
    fresh = keyed.join(target.select(*keys), list(keys), "left_anti").select(*batch.columns)
    return fresh.unionByName(batch.where(~_has_key(keys)))


def insert_if_absent(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return target.unionByName(new_rows(target, batch, keys, order))


def upsert(target: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``target`` with the rows of ``changes`` in place of those with the same key."""
    last = one_per_key(changes.where(_has_key(keys)), keys, order, "last")
    untouched = target.where(_has_key(keys)).join(last.select(*keys), list(keys), "left_anti")
    return union_parts(
        [untouched.select(*target.columns), target.where(~_has_key(keys)), last, changes.where(~_has_key(keys))]
    )


def union_parts(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def split_by_age(df: DataFrame, cutoff: Column, column: str = "predicted_at") -> tuple[DataFrame, DataFrame]:
    """(old, current): one cut-off decides both, so no row is in neither or both."""
    return df.where(F.col(column) < cutoff), df.where(F.col(column) >= cutoff)


# --- tables ----------------------------------------------------------------

DAY = "predicted_date"


def with_day(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(DAY, F.to_date(column))


def by_day(df: DataFrame, column: str) -> DataFrame:
    """Rows gathered per day for writing, in files of reasonable size.

    Rebalancing splits a day that holds a third of the rows into many tasks and
    joins small ones, where a plain repartition would give each day one task.
    """
    return with_day(df, column).hint("rebalance", F.col(DAY))


def append_table(df: DataFrame, path: str, column: str) -> None:
    """Add rows as they are; filters that the table has learn their keys first."""
    keyfilter.add(df.sparkSession, path, df, F.to_date(column))
    by_day(df, column).write.mode("append").partitionBy(DAY).parquet(spark_path(path))


def read_table(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table at ``path``, or an empty one with the columns of ``like``."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], like.schema)
    return spark.read.schema(with_schema(like)).parquet(spark_path(path)).select(*like.columns)


def with_schema(like: DataFrame) -> str:
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema.fields]
    return ", ".join([*fields, f"`{DAY}` date"])


def _days(df: DataFrame, column: str) -> list:
    """The distinct days of a batch: partition names, not data."""
    return [r[0] for r in df.select(F.to_date(column)).distinct().collect()]


def _on(day: Column, days: list) -> Column:
    """Whether a day is one of ``days``; rows without a time share the day null."""
    return F.when(day.isNull(), F.lit(None in days)).otherwise(day.isin([d for d in days if d is not None]))


def _replace_days(df: DataFrame, path: str, column: str) -> None:
    (
        by_day(df, column)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(DAY)
        .parquet(spark_path(path))
    )


def _only_days(spark: SparkSession, path: str, like: DataFrame, days: list) -> DataFrame:
    """The rows of some days, from their folders alone."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], like.schema)
    table = spark.read.schema(with_schema(like)).parquet(spark_path(path))
    dated = F.col(DAY).isin([d for d in days if d is not None])
    chosen = dated | F.col(DAY).isNull() if None in days else dated  # a partition filter: other folders stay unread
    return table.where(chosen).select(*like.columns)


def known_rows(spark: SparkSession, path: str, batch: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """The keys of the days that may hold a key of ``batch``."""
    like = batch.select(*dict.fromkeys([*keys, column]))
    if not path_exists(spark, keyfilter.folder(path, keys)):
        keyfilter.build(spark, path, read_table(spark, path, like), keys, F.to_date(column))
    return _only_days(spark, path, like, keyfilter.days_with(spark, path, batch, keys)).select(*keys)


def insert_table(
    spark: SparkSession, path: str, batch: DataFrame, keys: Sequence[str], order: Sequence[str], column: str,
    decided: bool = False,
) -> None:
    """Append the rows with unknown keys; running it twice adds nothing.

    A key is known whatever day it came with, or without one.  Bloom filters name the
    days that may hold a key of the batch; of those only the key columns are read.
    Rows without a key are always new.  With ``decided`` the batch is what ``new_rows``
    has just found to be new for the table's only writer: it is appended as it is.
    """
    if decided:
        append_table(batch, path, column)
        return
    with scratch(spark) as keep:
        rows = keep(batch, "batch")
        fresh = keep(new_rows(known_rows(spark, path, rows, keys, column), rows, keys, order), "fresh")
        append_table(fresh, path, column)


def upsert_table(
    spark: SparkSession,
    path: str,
    changes: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    column: str,
    compare: bool = True,
) -> None:
    """Upsert on keys that fix the day.

    Days that only gain rows are appended to; a day is rewritten when a row of it
    really changes, so a repeated batch writes nothing.  Without ``compare`` every
    day of the batch is rewritten, which is cheaper where most batches change a
    few rows of small days.  Rewritten days are written aside first and the swap
    reads that copy: an interrupted swap can be repeated.
    """
    with scratch(spark) as keep:
        # First of all, and once: every use of a streaming batch computes it anew.
        batch = keep(changes, "changes")
        days = _days(batch, column)
        if not days:
            return
        last = one_per_key(batch.where(_has_key(keys)), keys, order, "last")
        staged = last.unionByName(batch.where(~_has_key(keys)))
        stored = _only_days(spark, path, changes, days)
        day, rewritten = F.to_date(column), days
        if compare:
            rest = [c for c in changes.columns if c not in keys]
            before = stored.select(*keys, F.struct(*rest).alias("_before"))
            changed = staged.join(before, list(keys)).where(~F.struct(*rest).eqNullSafe(F.col("_before")))
            rewritten = _days(changed, column)
            fresh = staged.join(stored.select(*keys), list(keys), "left_anti").select(*changes.columns)
            append_table(keep(fresh.where(~_on(day, rewritten)) if rewritten else fresh, "fresh"), path, column)
        if rewritten:
            merged = upsert(stored.where(_on(day, rewritten)), staged.where(_on(day, rewritten)), keys, order)
            merged = keep(merged, "merged")
            keyfilter.add(spark, path, merged, day)
            _replace_days(merged, path, column)


# --- archive -----------------------------------------------------------------

SWAP = "_swap.json"  # names the files of an unfinished archive run


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(spark_path(path))
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _finish_swap(spark: SparkSession, live: str) -> None:
    """Carry out what an archive run has written down: old files go, their kept rows come back.

    Each step may be repeated.  The kept rows return as files of fixed names.
    """
    note, fs = _file_system(spark, f"{live}/{SWAP}")
    if not fs.exists(note):
        return
    stream = fs.open(note)
    plan = json.loads(bytes(stream.readAllBytes()).decode())
    stream.close()
    for name in plan["old"]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(name), False)
    for name, target in plan["kept"]:
        source, goal = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (name, target))
        if fs.exists(source):
            fs.mkdirs(goal.getParent())
            fs.rename(source, goal)
    fs.delete(note, False)
    for name in plan["folders"]:
        place = spark._jvm.org.apache.hadoop.fs.Path(name)
        if fs.exists(place) and not fs.listStatus(place):
            fs.delete(place, False)


def archive_table(spark: SparkSession, live: str, archive: str, cutoff, keys: Sequence[str], column: str, like: DataFrame) -> None:
    """Move the rows older than ``cutoff`` (a datetime) from one table to another.

    Rows reach the archive before they leave the live table, and the archive
    ignores known keys: a rerun after a failure completes the move.  Only files that
    were read are removed, so rows that arrive meanwhile stay.
    """
    _finish_swap(spark, live)
    limit = naive(cutoff)
    whole = spark.read.schema(with_schema(like)).parquet(spark_path(live))
    # A snapshot: names of files, no data.
    names = whole.where(F.col(DAY) <= F.to_date(limit)).select("_metadata.file_path").distinct().collect()
    files = [spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI.create(n)).toString() for (n,) in names]
    if not files:
        return
    table = spark.read.schema(with_schema(like)).option("basePath", spark_path(live)).parquet(*files).select(*like.columns)
    old, kept = split_by_age(table, limit, column)
    insert_table(spark, archive, old, keys, [column], column)
    staged, fs = _file_system(spark, f"{spark_path(live).rstrip('/')}_kept")
    by_day(kept, column).write.mode("overwrite").partitionBy(DAY).parquet(staged.toString())
    moves = []
    for status in fs.listStatus(staged):
        if status.isDirectory() and status.getPath().getName().startswith(f"{DAY}="):
            for file in fs.listStatus(status.getPath()):
                name = file.getPath()
                moves.append((name.toString(), f"{spark_path(live)}/{status.getPath().getName()}/{name.getName()}"))
    folders = sorted({f.rsplit("/", 1)[0] for f in files})
    note, fs = _file_system(spark, f"{live}/{SWAP}")
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{note.toString()}.draft")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps({"old": files, "kept": moves, "folders": folders}).encode()))
    out.close()
    fs.rename(draft, note)
    _finish_swap(spark, live)
    fs.delete(staged, True)
