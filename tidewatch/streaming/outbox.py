"""Exactly-once hand-over of a batch's results to the next job, through a folder of messages.

A batch is first written aside whole, then its files are moved into the topic folder one
by one, then it is marked as done.  Whoever repeats the batch continues where it stopped:
files that are there are not moved again, a batch that is done is only read back.  So a
reader of the topic sees every file once, whatever was killed in between.  Each message
carries its event id and its batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.schemas import MESSAGE
from tidewatch.sources.readers import spark_path
from tidewatch.streaming.messages import PACKED, file_messages

_FIELDS = "event_id string, batch string"


def _file_system(spark: SparkSession, name: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(name)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def folder(outbox: str, query: str, batch: int) -> str:
    return f"{spark_path(outbox)}/query={query}/batch={batch}"


def done(spark: SparkSession, outbox: str, query: str, batch: int) -> bool:
    mark, fs = _file_system(spark, f"{spark_path(outbox)}/_done/{query}-{batch}")
    return fs.exists(mark)


def hand_over(spark: SparkSession, outbox: str, query: str, batch: int, messages: Callable[[], DataFrame]) -> None:
    """Put the batch's ``messages`` (computed only if they are not written yet) into the topic."""
    if done(spark, outbox, query, batch):
        return
    staged, fs = _file_system(spark, f"{spark_path(outbox)}/_staged/{query}-{batch}")
    path = spark._jvm.org.apache.hadoop.fs.Path
    if not fs.exists(path(staged, "_SUCCESS")):
        messages().write.mode("overwrite").options(**PACKED).json(staged.toString())
    target = path(folder(outbox, query, batch))
    fs.mkdirs(target)
    for status in fs.listStatus(staged):
        file = status.getPath()
        if file.getName().startswith("part-"):
            fs.rename(file, path(target, file.getName()))
    fs.create(path(f"{spark_path(outbox)}/_done/{query}-{batch}")).close()
    fs.delete(staged, True)


def handed_over(spark: SparkSession, outbox: str, query: str, batch: int) -> DataFrame:
    """The messages of a batch that is done."""
    return spark.read.schema(_schema()).json(folder(outbox, query, batch))


def topic(spark: SparkSession, outbox: str, max_files: int | None = None) -> DataFrame:
    """Everything handed over, as a stream of messages."""
    return file_messages(spark, f"{spark_path(outbox)}/query=*/batch=*", max_files)


def _schema() -> str:
    return ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in MESSAGE.fields], _FIELDS])
