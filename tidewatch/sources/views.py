"""The reporting tables, their layout, and the dashboard views."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tidewatch import schemas
from tidewatch.operators import reports as R
from tidewatch.sources.keyed import DAY, by_day


@dataclass(frozen=True)
class Table:
    name: str
    path: str
    schema: StructType
    time_column: str


def create_tables(spark: SparkSession, root: str) -> dict[str, Table]:
    """The five reporting tables below ``root``, empty."""
    # Table names and the column that dates a row.
    specs = {
        "churn_predictions": (schemas.PREDICTIONS, "predicted_at"),
        "churn_metrics_hourly": (schemas.HOURLY, "hour_timestamp"),
        "churn_metrics_daily": (schemas.DAILY, "date"),
        "high_risk_customers": (schemas.ALERTS, "detected_at"),
        "churn_predictions_archive": (schemas.PREDICTIONS, "predicted_at"),
    }
    tables = {n: Table(n, f"{root}/{n}", schema, column) for n, (schema, column) in specs.items()}
    for t in tables.values():
        write_by_day(spark.createDataFrame([], t.schema), t.path, t.time_column)
    return tables


def write_by_day(df: DataFrame, path: str, column: str, sort_by: Sequence[str] = (), mode: str = "append") -> None:
    """Append, one folder per day, rows of a file sorted for min/max skipping.

    The day prunes folders, the order inside a file lets Parquet statistics skip
    row groups: together they stand in for the indexes of a database.
    """
    by_day(df, column).sortWithinPartitions(DAY, *sort_by).write.mode(mode).partitionBy(DAY).parquet(path)


def load(df: DataFrame, table: Table) -> None:
    """Append rows to a reporting table, columns by name and type by schema."""
    typed = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema.fields])
    write_by_day(typed, table.path, table.time_column)


def read(spark: SparkSession, table: Table) -> DataFrame:
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields)
    return spark.read.schema(f"{fields}, `{DAY}` date").parquet(table.path).drop(DAY)


def create_views(predictions: DataFrame, as_of) -> None:
    """The three dashboard views, as temporary views over the operators."""
    R.realtime_dashboard(predictions, as_of).createOrReplaceTempView("v_realtime_dashboard")
    R.top_risk_customers(predictions, as_of).createOrReplaceTempView("v_top_risk_customers")
    R.geography_churn(predictions, as_of).createOrReplaceTempView("v_geography_churn")
