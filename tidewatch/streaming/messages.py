"""Message topics: reading and writing keyed JSON records.

A topic is Kafka in production and a folder of JSON lines with the same record
shape in tests and replays; the jobs only see a DataFrame of messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch.schemas import MESSAGE

# The published micro-batch limits.
MAX_MESSAGES = 1000
MAX_DELAY = "30 seconds"

# Message files of bounded size: compressed files are read whole by a task each.
PACKED = {"compression": "snappy", "maxRecordsPerFile": "100000"}


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def kafka_options(
    servers: str, topic: str, from_start: bool = False, max_messages: int | None = None, max_delay: str = MAX_DELAY,
    least_messages: int = MAX_MESSAGES,
) -> dict[str, str]:
    """A trigger fires at ``least_messages`` or after ``max_delay``, whichever is first.

    It takes all that has arrived, unless ``max_messages`` limits it.  ``startingOffsets``
    matters on the first run only; later runs continue from the checkpoint.
    """
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "earliest" if from_start else "latest",
        "minOffsetsPerTrigger": str(least_messages),
        "maxTriggerDelay": max_delay,
    }
    return options if max_messages is None else options | {"maxOffsetsPerTrigger": str(max_messages)}


def kafka_messages(spark: SparkSession, **options) -> DataFrame:
    """A Kafka topic as messages (needs the Kafka connector on the class path)."""
    raw = spark.readStream.format("kafka").options(**kafka_options(**options)).load()
    return raw.select(
        "topic", "partition", "offset", iso(F.col("timestamp")).alias("timestamp"),
        F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"),
    )


def file_messages(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A folder of message files as a stream."""
    reader = spark.readStream.schema(MESSAGE)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def publish_files(messages: DataFrame, path: str, packed: bool = False) -> None:
    """Append a batch of messages to a topic folder; ``packed`` writes compressed files of bounded size."""
    messages.write.mode("append").options(**(PACKED if packed else {})).json(path)


def kafka_sink(messages: DataFrame, servers: str, checkpoint: str):
    """The stream writer that publishes messages to Kafka."""
    return (
        messages.select("topic", "key", "value")
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("checkpointLocation", checkpoint)
    )


def kafka_publish(messages: DataFrame, servers: str) -> None:
    """Send a batch of messages; a batch that is repeated is sent again."""
    rows = messages.select("topic", "key", "value")
    rows.write.format("kafka").option("kafka.bootstrap.servers", servers).save()


def file_sink(messages: DataFrame, path: str, checkpoint: str):
    return messages.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint)
