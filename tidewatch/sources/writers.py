"""Writing tables.  Every write runs on the executors."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from tidewatch.operators.split import side
from tidewatch.session import scratch
from tidewatch.sources.readers import CSV_OPTIONS, VERSION, spark_path


def save_table(df: DataFrame, path: str, fmt: str, mode: str = "overwrite", **options) -> None:
    """Write in any Spark format; Parquet is compressed with snappy unless told otherwise."""
    defaults = {"csv": {"header": "true", "quote": '"', "escape": '"'}, "parquet": {"compression": "snappy"}}
    df.write.format(fmt).mode(mode).options(**{**defaults.get(fmt, {}), **options}).save(spark_path(path))


def write_json_records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines; null fields are written, so a record always has all columns."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(spark_path(path))


def write_json_arrays(df: DataFrame, path: str, group, mode: str = "overwrite", most: int = 10_000) -> None:
    """JSON arrays of records, one array per value of ``group`` and line.

    An array holds about ``most`` rows: a larger group becomes several arrays, dealt by
    hash, so no array grows with the data.
    """
    record = F.struct(*df.columns)
    rows = df.select(group.alias("_group"), record.alias("_record"), F.monotonically_increasing_id().alias("_row"))
    sizes = rows.groupBy(F.col("_group").alias("_of")).agg(F.ceil(F.count("*") / most).alias("_parts"))
    dealt = rows.join(sizes, F.col("_group").eqNullSafe(F.col("_of"))).withColumn("_part", F.expr("pmod(xxhash64(_row), _parts)"))
    arrays = dealt.groupBy("_group", "_part").agg(F.collect_list("_record").alias("records"))
    lines = arrays.select(F.to_json("records", {"ignoreNullFields": "false"}).alias("value"))
    lines.write.mode(mode).text(spark_path(path))


def split_tables(df: DataFrame, target: str, keep: Sequence[str] = ()) -> dict[str, DataFrame]:
    """The four published tables of a split frame; ``keep`` columns appear in all of them."""
    out = {}
    for name in ("train", "test"):
        rows = side(df, name)
        out[f"X_{name}"] = rows.drop(target)
        out[f"Y_{name}"] = rows.select(*keep, target)
    return out


def write_both(tables: Mapping[str, DataFrame], root: str) -> dict[str, str]:
    """Each table as CSV and as Parquet below ``root``."""
    paths = {}
    for name, df in tables.items():
        for fmt in ("parquet", "csv"):
            paths[f"{name}_{fmt}"] = f"{root}/{name}.{fmt}"
            save_table(df, paths[f"{name}_{fmt}"], fmt)
    return paths


def write_version(df: DataFrame, root: str, name: str, version: str) -> str:
    """One immutable version of a dataset; writing an existing one is an error."""
    if not re.fullmatch(r"\d{14}", version):
        raise ValueError(f"a version is YYYYMMDDHHMMSS, not {version!r}")
    path = f"{spark_path(root)}/{name}/{VERSION}={version}"
    df.write.mode("error").parquet(path)
    return path


def export_reports(reports: Mapping[str, DataFrame], root: str, stamp: str) -> list[str]:
    """Each non-empty report as CSV, computed once; empty ones leave nothing behind.

    Rows are gathered into files of a reasonable size: a report is one file, and a
    frame that turns out to be large is not forced through one task.
    """
    written = []
    for name, df in reports.items():
        path = f"{root}/{name}_{stamp}"
        with scratch(df.sparkSession) as keep:
            rows = keep(df, "report")
            if rows.isEmpty():
                continue
            save_table(rows.hint("rebalance"), path, "csv")
        written.append(path)
    return written
