"""Rollup states as a log: each batch appends the windows it changed, the newest state counts.

No day of a table is read or rewritten when a late event revises its hour.  A batch that is
repeated replaces its own part.  A job that starts anew without its checkpoint opens a new
generation, whose states replace those of the same windows in earlier ones.  ``compact``
folds what has piled up into one part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.session import discard
from tidewatch.sources.readers import path_exists, spark_path

START = "window_start"


def _names(spark: SparkSession, folder: str) -> list[str]:
    if not path_exists(spark, folder):
        return []
    place = spark._jvm.org.apache.hadoop.fs.Path(spark_path(folder))
    return [s.getPath().getName() for s in place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)]


def generation(spark: SparkSession, log: str, query: str) -> int:
    """The number of a query's generation; a query not seen before gets the next one."""
    seen = dict(reversed(n.split("-", 1)) for n in _names(spark, f"{log}/_queries"))
    if query in seen:
        return int(seen[query])
    number = 1 + max(map(int, seen.values()), default=0)
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{spark_path(log)}/_queries/{number}-{query}")
    mark.getFileSystem(spark._jsc.hadoopConfiguration()).create(mark).close()
    return number


def append(states: DataFrame, log: str, number: int, batch: int) -> None:
    """Store the states of a batch; even parts are batches, odd ones compactions."""
    states.write.mode("overwrite").parquet(f"{spark_path(log)}/generation={number}/part={2 * batch}")


def newest(spark: SparkSession, log: str, like: DataFrame) -> DataFrame:
    """The newest state of every window; ``like`` has the columns of a state."""
    if not any(n.startswith("generation=") for n in _names(spark, log)):
        return spark.createDataFrame([], like.schema)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema.fields)
    rows = spark.read.schema(f"{fields}, generation int, part bigint").parquet(spark_path(log))
    rest = [c for c in like.columns if c != START]
    best = rows.groupBy(START).agg(F.max_by(F.struct(*rest), F.struct("generation", "part")).alias("_state"))
    return best.select(*[F.col(c) if c == START else F.col(f"_state.`{c}`").alias(c) for c in like.columns])


def compact(spark: SparkSession, log: str, like: DataFrame) -> None:
    """One part with the newest states in place of all there are.

    It is written before the others go, so readers may meet a state twice but never
    none, and a run that was killed is completed by the next.
    """
    parts = [
        (int(g.split("=")[1]), int(p.split("=")[1]), f"{spark_path(log)}/{g}/{p}")
        for g in _names(spark, log) if g.startswith("generation=") for p in _names(spark, f"{log}/{g}") if p.startswith("part=")
    ]
    if len(parts) < 2:
        return
    number, last, _ = max(parts)
    target = f"{spark_path(log)}/generation={number}/part={last + 1 if last % 2 == 0 else last + 2}"
    newest(spark, log, like).write.mode("overwrite").parquet(target)
    discard(spark, *[path for _, _, path in parts])
