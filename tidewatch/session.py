"""Session settings the jobs are written for, and the shared work folder."""

from __future__ import annotations

import contextlib
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

# Runtime settings only: each can be changed on a live session.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def local_session(cpus: int | str = 8, name: str = "tidewatch") -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for one run, below the folder the cluster shares.

    ``spark.checkpoint.dir`` names that folder.  Only a local session, whose
    executors live in this process, may fall back to a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = _own_folder()
    return f"{base.rstrip('/')}/tidewatch/{purpose}-{uuid.uuid4().hex}"


@functools.cache
def _own_folder() -> str:
    """The temporary folder of this process, for local sessions without a shared one."""
    return tempfile.mkdtemp(prefix="tidewatch-")


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete work folders that nothing reads any more."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """``materialize`` for work that ends here: its copies are deleted at the end."""
    paths: list[str] = []

    def keep(df: DataFrame, purpose: str) -> DataFrame:
        path = work_folder(spark, purpose)
        paths.append(path)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield keep
    finally:
        discard(spark, *paths)


def materialize(df: DataFrame, purpose: str, spark: SparkSession | None = None) -> DataFrame:
    """Write ``df`` to the shared work folder and read it back.

    For a frame that several later steps read: it is computed once, its lineage
    ends here, and unlike a cache it does not go away with an executor.  A
    streaming batch is read back in the session ``spark`` that started the
    stream: the batch's own session has adaptive execution switched off.
    """
    spark = spark or df.sparkSession
    path = work_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
