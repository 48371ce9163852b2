"""The progress of streaming queries as a table: one row per batch, however long they run.

A listener notes every batch in a small file of its own; a repeated batch replaces its
note.  Offsets are kept as the source states them.  Lag is what the source says is still
waiting: the offsets a topic is ahead by, or the files not yet read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidewatch.sources.readers import path_exists, spark_path

_SCHEMA = (
    "id string, name string, batchId bigint, timestamp string, numInputRows bigint, processedRowsPerSecond double, "
    "durationMs map<string,bigint>, sources array<struct<description string, startOffset string, endOffset string, "
    "latestOffset string, numInputRows bigint, metrics map<string,string>>>"
)


class ProgressLog(StreamingQueryListener):
    """Notes the batches of all queries of a session below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, spark_path(folder)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.note(str(event.progress.id), event.progress.batchId, event.progress.json)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def note(self, query: str, batch: int, text: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/query={query}/{batch}.json")
        out = place.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(place, True)
        out.write(bytearray(re.sub(r"\s*\n\s*", " ", text).encode()))
        out.close()


def flush(spark: SparkSession) -> None:
    """Wait until listeners have heard of everything that has happened."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()


def progress_rows(spark: SparkSession, folder: str, query: StreamingQuery | None = None) -> DataFrame:
    """query, batch_id, started_at, input_rows, duration_ms, rows_per_second, start_offsets,
    end_offsets, lag; of one query, or of all that were listened to."""
    if not path_exists(spark, folder):
        rows = spark.createDataFrame([], _SCHEMA)
    else:
        rows = spark.read.schema(_SCHEMA).option("recursiveFileLookup", "true").json(spark_path(folder))
    if query is not None:
        rows = rows.where(F.col("id") == str(query.id))
    behind = F.expr(
        "aggregate(transform(sources, s -> coalesce(try_cast(s.metrics['maxOffsetsBehindLatest'] AS BIGINT),"
        " try_cast(s.metrics['numFilesOutstanding'] AS BIGINT), 0L)), 0L, (a, x) -> a + x)"
    )
    return rows.select(
        F.col("id").alias("query"), F.col("batchId").alias("batch_id"), F.col("timestamp").alias("started_at"),
        F.col("numInputRows").alias("input_rows"), F.col("durationMs")["triggerExecution"].cast("double").alias("duration_ms"),
        F.coalesce("processedRowsPerSecond", F.lit(0.0)).alias("rows_per_second"),
        F.expr("transform(sources, s -> s.startOffset)").alias("start_offsets"),
        F.expr("transform(sources, s -> s.endOffset)").alias("end_offsets"), behind.alias("lag"),
    )
