"""Reading tables: CSV, Parquet, JSON, versioned datasets, SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

# CSV conventions, also used for writing.
CSV_OPTIONS = {
    "header": "true",
    "ignoreLeadingWhiteSpace": "true",
    "ignoreTrailingWhiteSpace": "true",
    "nullValue": "",
    "nanValue": "NaN",
    "quote": '"',
    "escape": '"',
}


def spark_path(path: str) -> str:
    return "s3a://" + path[len("s3://"):] if path.startswith("s3://") else path


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None, **options) -> DataFrame:
    """CSV with a given schema; ``schema=None`` infers it, at the price of another pass."""
    reader = spark.read.options(**{**CSV_OPTIONS, **options})
    reader = reader.option("inferSchema", "true") if schema is None else reader.schema(schema)
    return reader.csv(spark_path(path))


def read_parquet(spark: SparkSession, path: str, **options) -> DataFrame:
    return spark.read.options(**options).parquet(spark_path(path))


def read_json_records(spark: SparkSession, path: str, schema: StructType | str, whole_file: bool = False) -> DataFrame:
    """Records, or arrays of records, one per line; ``whole_file`` for one array per file.

    Lines can be split over tasks, a whole file cannot.
    """
    reader = spark.read.schema(schema)
    return (reader.option("multiLine", "true") if whole_file else reader).json(spark_path(path))


def load_table(
    spark: SparkSession, path: str, fmt: str, schema: StructType | str | None = None, **options
) -> DataFrame:
    """Any Spark format with an optional schema.  Nothing is counted."""
    if fmt == "csv":
        return read_csv(spark, path, schema, **options)
    reader = spark.read.format(fmt).options(**options)
    return (reader if schema is None else reader.schema(schema)).load(spark_path(path))


_BY_EXTENSION = {"csv": "csv", "parquet": "parquet", "json": "json"}


def scan_by_extension(
    spark: SparkSession, path: str, schema: StructType | str | None = None, **options
) -> DataFrame:
    extension = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if extension not in _BY_EXTENSION:
        raise ValueError(f"no reader for {path!r}: expected one of {sorted(_BY_EXTENSION)}")
    return load_table(spark, path, _BY_EXTENSION[extension], schema, **options)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(spark_path(path))
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_prefer_parquet(spark: SparkSession, base: str, schema: StructType | str | None = None) -> DataFrame:
    """``<base>.parquet`` if it exists, else ``<base>.csv``."""
    if path_exists(spark, f"{base}.parquet"):
        return read_parquet(spark, f"{base}.parquet")
    return read_csv(spark, f"{base}.csv", schema)


def sql_source(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    """The result of ``text`` over the given tables; errors are raised, not swallowed."""
    return spark.sql(text, **tables) if tables else spark.sql(text)


def jdbc_options(
    url: str,
    table: str | None = None,
    query: str | None = None,
    partition_column: str | None = None,
    bounds: tuple[object, object] | None = None,
    partitions: int | None = None,
    fetch_size: int = 10_000,
    **more: str,
) -> dict[str, str]:
    """Options of a database read, of a table or of a query.

    With a partition column (a number, a date or a timestamp), its bounds and a number of
    partitions the read is split over as many tasks.  The bounds only place the cuts: rows
    beyond them belong to the first and the last task.  Without them one task reads all.
    """
    if (table is None) == (query is None):
        raise ValueError("name either a table or a query")
    options = {"url": url, "fetchsize": str(fetch_size), **more}
    split = (partition_column, bounds, partitions)
    if any(s is not None for s in split):
        if any(s is None for s in split):
            raise ValueError("a split read needs a partition column, its bounds and a number of partitions")
        if partitions < 1 or not bounds[0] < bounds[1]:
            raise ValueError(f"cannot cut {bounds!r} into {partitions} parts")
        options |= {
            "partitionColumn": partition_column, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
        # A split read takes no query option, but a query in the place of a table.
        table = table or f"({query}) AS source"
    return options | ({"dbtable": table} if table else {"query": query})


def day_predicates(column: str, days: Sequence) -> list[str]:
    """Conditions that cut a table at ``days`` (dates in order): one task each, no row lost or read
    twice, rows without a day included."""
    if not days or any(a >= b for a, b in zip(days, list(days)[1:])):
        raise ValueError("days must be given in ascending order")
    edges = [f"DATE '{d.isoformat()}'" for d in days]
    inner = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(edges, edges[1:])]
    return [f"{column} < {edges[0]} OR {column} IS NULL", *inner, f"{column} >= {edges[-1]}"]


def jdbc_source(spark: SparkSession, options: dict[str, str], predicates: Sequence[str] | None = None) -> DataFrame:
    """A database table, split by the options or with one task per predicate (needs its driver
    on the class path).  Filters and columns are pushed to the database."""
    if predicates is None:
        return spark.read.format("jdbc").options(**options).load()
    rest = {k: v for k, v in options.items() if k not in ("url", "dbtable")}
    return spark.read.jdbc(options["url"], options["dbtable"], predicates=list(predicates), properties=rest)


# --- versioned datasets ----------------------------------------------------

VERSION = "run_ts"
_VERSION_PATTERN = r"^\d{14}$"


def list_versions(spark: SparkSession, root: str, name: str) -> list[str]:
    """The 14-digit versions of a dataset, oldest first.  A folder listing, no data."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{spark_path(root)}/{name}")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory()]
    versions = [n.split("=", 1)[1] for n in found if n.startswith(f"{VERSION}=")]
    return sorted(v for v in versions if len(v) == 14 and v.isdigit())


def read_version(spark: SparkSession, root: str, name: str, version: str) -> DataFrame:
    path = f"{spark_path(root)}/{name}"
    # The version is a partition column read as text: a literal filter prunes folders.
    frame = spark.read.option("basePath", path).parquet(f"{path}/{VERSION}={version}")
    return frame.withColumn(VERSION, F.lit(version))


def read_latest(spark: SparkSession, root: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """The newest version of each dataset; a name without versions is left out."""
    newest = {n: (list_versions(spark, root, n) or [None])[-1] for n in names}
    return {n: read_version(spark, root, n, v) for n, v in newest.items() if v is not None}
