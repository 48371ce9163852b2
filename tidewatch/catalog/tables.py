"""Sources, sinks, keyed tables and views: written, read back and compared."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidewatch.catalog.registry import query
from tidewatch.catalog.reports import ALERTS, DASHBOARD, GEOGRAPHY, HOURLY, TOP_RISK, geography_report
from tidewatch.catalog.sqltext import on_customers, on_predictions, rnd
from tidewatch.operators import reports as R
from tidewatch.operators import split as SP
from tidewatch.plans.fixtures import customers, latest_instant, predictions, score_facts
from tidewatch.schemas import CUSTOMER
from tidewatch.session import work_folder
from tidewatch.sources import keyed, readers, views, writers

_ALL_CUSTOMERS = on_customers("SELECT * FROM customers")


# --- scans and sinks -----------------------------------------------------------

@query("csv_scan", _ALL_CUSTOMERS)
def csv_scan(spark, folder):
    path = work_folder(spark, "csv") + "/customers.csv"
    writers.save_table(customers(spark, folder), path, "csv")
    return readers.read_csv(spark, path, CUSTOMER)


@query("parquet_scan", "SELECT event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND value >= 100")
def parquet_scan(spark, folder):
    events = readers.read_parquet(spark, f"{folder}/events.parquet")
    wanted = (F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")) & (F.col("value") >= 100)
    return events.where(wanted).select("event_id", "value")


@query(
    "scan_by_extension",
    on_customers(
        " UNION ALL ".join(
            f"""SELECT '{e}' AS extension, count(*) AS rows, count("Age") AS ages, {rnd('sum("Balance")', 2)} AS balance
            FROM customers""" for e in ("csv", "json", "parquet")
        )
    ),
)
def scan_by_extension(spark, folder):
    root, df = work_folder(spark, "scan"), customers(spark, folder)
    parts = []
    for extension in ("csv", "json", "parquet"):
        path = f"{root}/customers.{extension}"
        writers.save_table(df, path, extension)
        parts.append(
            readers.scan_by_extension(spark, path, CUSTOMER).agg(
                F.lit(extension).alias("extension"),
                F.count("*").alias("rows"),
                F.count("Age").alias("ages"),
                rounded_sum("Balance").alias("balance"),
            )
        )
    return R.union_all(parts)


def rounded_sum(column: str):
    return F.round(F.sum(column).cast("decimal(28,9)"), 2).cast("double")


@query("typed_load", on_customers('SELECT "CustomerId", "Age", "Balance" FROM customers'))
def typed_load(spark, folder):
    path = work_folder(spark, "load")
    writers.save_table(customers(spark, folder).select("CustomerId", "Age", "Balance"), path, "orc")
    return readers.load_table(spark, path, "orc", "CustomerId bigint, Age int, Balance double")


@query(
    "typed_save",
    on_customers('SELECT "CustomerId", "Geography" FROM customers UNION ALL SELECT "CustomerId", "Geography" FROM customers'),
)
def typed_save(spark, folder):
    path = work_folder(spark, "save")
    df = customers(spark, folder).select("CustomerId", "Geography")
    writers.save_table(df, path, "parquet", "overwrite")
    writers.save_table(df, path, "parquet", "append")
    return readers.load_table(spark, path, "parquet", df.schema)


_SPLIT = "CASE WHEN CAST('0x' || substring(md5('42|' || CAST(\"CustomerId\" AS VARCHAR)), 1, 8) AS BIGINT) < 858993459 THEN 'test' ELSE 'train' END"


@query(
    "dataset_write_both",
    on_customers(
        " UNION ALL ".join(
            f"""SELECT '{name}_{side}' AS name, '{fmt}' AS format, count(*) AS rows, {checksum} AS checksum
            FROM customers WHERE {_SPLIT} = '{side}'"""
            for side in ("train", "test") for fmt in ("csv", "parquet")
            for name, checksum in (("X", rnd('sum("CreditScore")', 2)), ("Y", rnd('sum("Exited")', 2)))
        )
    ),
)
def dataset_write_both(spark, folder):
    df = customers(spark, folder).select("CustomerId", "CreditScore", "Age", "Exited")
    tables = writers.split_tables(SP.split_random(df, ["CustomerId"]), "Exited", keep=["CustomerId"])
    paths = writers.write_both(tables, work_folder(spark, "both"))
    parts = []
    for name, frame in tables.items():
        for fmt in ("csv", "parquet"):
            back = readers.load_table(spark, paths[f"{name}_{fmt}"], fmt, frame.schema)
            column = "CreditScore" if name.startswith("X") else "Exited"
            parts.append(
                back.agg(
                    F.lit(name).alias("name"), F.lit(fmt).alias("format"), F.count("*").alias("rows"),
                    rounded_sum(column).alias("checksum"),
                )
            )
    return R.union_all(parts)


@query("json_records_write", _ALL_CUSTOMERS)
def json_records_write(spark, folder):
    path = work_folder(spark, "json")
    writers.write_json_records(customers(spark, folder), path)
    return readers.read_json_records(spark, path, CUSTOMER)


@query("json_records_read", _ALL_CUSTOMERS)
def json_records_read(spark, folder):
    path = work_folder(spark, "json")
    # Keys are unique, so an array holds a thousand records at most.
    thousand = F.floor(F.col("CustomerId") / 1000)
    writers.write_json_arrays(customers(spark, folder), path, thousand)
    return readers.read_json_records(spark, path, CUSTOMER)


@query(
    "read_prefer_parquet",
    on_customers("SELECT 'both' AS found, \"CustomerId\", \"Age\" FROM customers UNION ALL SELECT 'csv', \"CustomerId\", \"Age\" FROM customers"),
)
def read_prefer_parquet(spark, folder):
    root, df = work_folder(spark, "prefer"), customers(spark, folder).select("CustomerId", "Age")
    writers.write_both({"both": df}, root)
    writers.save_table(df, f"{root}/only.csv", "csv")
    found = {"both": f"{root}/both", "csv": f"{root}/only"}
    return R.union_all(
        [
            readers.read_prefer_parquet(spark, base, df.schema).select(F.lit(name).alias("found"), "CustomerId", "Age")
            for name, base in found.items()
        ]
    )


_VERSIONS = ["20240101000000", "20240115120000"]


def _write_versions(spark, folder) -> str:
    root, df = work_folder(spark, "versions"), customers(spark, folder).select("CustomerId", "CreditScore")
    writers.write_version(df.where(F.col("CreditScore") < 600), root, "scores", _VERSIONS[0])
    writers.write_version(df, root, "scores", _VERSIONS[1])
    return root


@query(
    "versioned_write",
    on_customers(
        f"""SELECT '{_VERSIONS[0]}' AS run_ts, "CustomerId", "CreditScore" FROM customers WHERE "CreditScore" < 600
        UNION ALL SELECT '{_VERSIONS[1]}', "CustomerId", "CreditScore" FROM customers"""
    ),
)
def versioned_write(spark, folder):
    root = _write_versions(spark, folder)
    versions = readers.list_versions(spark, root, "scores")
    return R.union_all([readers.read_version(spark, root, "scores", v) for v in versions])


@query("versioned_read_latest", on_customers(f"SELECT '{_VERSIONS[1]}' AS run_ts, \"CustomerId\", \"CreditScore\" FROM customers"))
def versioned_read_latest(spark, folder):
    root = _write_versions(spark, folder)
    return readers.read_latest(spark, root, ["scores", "never_written"])["scores"]


_SQL = """SELECT geography, count(*) AS predictions, sum(prediction) AS churns
FROM {events} WHERE risk_score >= 0.7 GROUP BY geography"""


@query(
    "sql_source",
    on_predictions(
        """SELECT geography, count(*) AS predictions, CAST(sum(prediction) AS BIGINT) AS churns FROM predictions
        WHERE risk_score >= 0.7 GROUP BY geography"""
    ),
)
def sql_source(spark, folder):
    return readers.sql_source(spark, _SQL, events=predictions(spark, folder))


@query(
    "report_export",
    on_predictions(
        f"""SELECT 'geography' AS report, geography AS label, churn_rate AS value FROM by_geography
        UNION ALL SELECT 'dashboard', strftime(hour, '%Y-%m-%d %H:%M:%S'), churn_rate FROM dashboard""",
        GEOGRAPHY, DASHBOARD,
    ),
)
def report_export(spark, folder):
    as_of = latest_instant(spark, folder)
    reports = {
        "geography": geography_report(spark, folder).select(
            F.col("geography").alias("label"), F.col("churn_rate").alias("value")
        ),
        "dashboard": R.realtime_dashboard(score_facts(spark, folder), as_of).select(
            F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("label"), F.col("churn_rate").alias("value")
        ),
        "empty": customers(spark, folder).where("CreditScore < 0").select(
            F.col("Geography").alias("label"), F.col("Balance").alias("value")
        ),
    }
    paths = writers.export_reports(reports, work_folder(spark, "reports"), "20240131_000000")
    names = [p.rsplit("/", 1)[-1].split("_")[0] for p in paths]
    return R.union_all(
        [
            readers.read_csv(spark, path, "label string, value double").select(F.lit(name).alias("report"), "label", "value")
            for name, path in zip(names, paths)
        ]
    )


# --- keyed writes --------------------------------------------------------------

_OLD = "old AS (SELECT * FROM predictions WHERE predicted_at < TIMESTAMP '2024-01-20')"
_KEYED_COLUMNS = "event_id, customer_id, risk_score, predicted_at"


def _halves(spark, folder):
    """A table up to the 20th and a batch from the 10th on: they overlap for ten days."""
    facts = score_facts(spark, folder).select("event_id", "customer_id", "risk_score", "predicted_at")
    until, since = (F.lit(d).cast("timestamp_ntz") for d in ("2024-01-20", "2024-01-10"))
    batch = facts.where(F.col("predicted_at") >= since).withColumn("risk_score", F.col("risk_score") + 1)
    return facts.where(F.col("predicted_at") < until), batch


@query(
    "insert_if_absent",
    on_predictions(
        """SELECT event_id, customer_id, risk_score + CASE WHEN predicted_at < TIMESTAMP '2024-01-20' THEN 0 ELSE 1 END
          AS risk_score, predicted_at FROM predictions"""
    ),
)
def insert_if_absent(spark, folder):
    target, batch = _halves(spark, folder)
    # The batch twice: the second copy of each event is ignored.
    return keyed.insert_if_absent(target, batch.unionByName(batch), ["event_id"], ["predicted_at"])


_UPSERTED = on_predictions(
    """SELECT event_id, customer_id, risk_score + CASE WHEN predicted_at >= TIMESTAMP '2024-01-10' THEN 1 ELSE 0 END
      AS risk_score, predicted_at FROM predictions"""
)


@query("upsert", _UPSERTED)
def upsert(spark, folder):
    target, batch = _halves(spark, folder)
    return keyed.upsert(target, batch, ["event_id"], ["predicted_at"])


@query(
    "table_upsert_sink",
    on_predictions(
        """SELECT event_id, customer_id, risk_score + CASE WHEN predicted_at >= TIMESTAMP '2024-01-10' THEN 1 ELSE 0 END
          AS risk_score, predicted_at, CAST(predicted_at AS DATE) AS predicted_date FROM predictions"""
    ),
)
def table_upsert_sink(spark, folder):
    target, batch = _halves(spark, folder)
    path = work_folder(spark, "sink")
    keyed.append_table(target, path, "predicted_at")
    keyed.upsert_table(spark, path, batch, ["event_id"], ["predicted_at"], "predicted_at")
    # A repeated batch changes nothing, neither as upsert nor as insert.
    keyed.insert_table(spark, path, batch, ["event_id"], ["predicted_at"], "predicted_at")
    return spark.read.schema(keyed.with_schema(batch)).parquet(path)


@query(
    "archive_old",
    on_predictions(
        """SELECT CASE WHEN predicted_at < TIMESTAMP '2024-01-12 06:30:00' THEN 'archive' ELSE 'live' END AS part,
          event_id, customer_id, risk_score, predicted_at FROM predictions"""
    ),
)
def archive_old(spark, folder):
    facts = score_facts(spark, folder).select("event_id", "customer_id", "risk_score", "predicted_at")
    root = work_folder(spark, "archive")
    live, archive = f"{root}/live", f"{root}/archive"
    keyed.append_table(facts, live, "predicted_at")
    cutoff = dt.datetime(2024, 1, 12, 6, 30)
    for _ in range(2):  # the second run finds nothing to do
        keyed.archive_table(spark, live, archive, cutoff, ["event_id"], "predicted_at", facts)
    return R.union_all(
        [
            keyed.read_table(spark, path, facts).select(F.lit(part).alias("part"), "*")
            for part, path in (("live", live), ("archive", archive))
        ]
    )


# --- tables and views ------------------------------------------------------------

@query(
    "create_tables",
    on_predictions(
        f"""SELECT 'churn_predictions' AS table_name, count(*) AS rows, 16 AS columns FROM predictions
        UNION ALL SELECT 'churn_metrics_hourly', count(*), 9 FROM hourly
        UNION ALL SELECT 'churn_metrics_daily', count(DISTINCT CAST(predicted_at AS DATE)), 9 FROM predictions
        UNION ALL SELECT 'high_risk_customers', count(*), 9 FROM alerts
        UNION ALL SELECT 'churn_predictions_archive', 0, 16""",
        HOURLY, ALERTS,
    ),
)
def create_tables(spark, folder):
    root, scored = work_folder(spark, "tables"), predictions(spark, folder)
    tables = views.create_tables(spark, root)
    views.load(scored.withColumn("estimated_salary", F.lit(None).cast("double")), tables["churn_predictions"])
    # The other tables come from the stored predictions: the join is not repeated.
    stored = views.read(spark, tables["churn_predictions"])
    views.load(R.rollup_hourly(stored), tables["churn_metrics_hourly"])
    views.load(R.rollup_daily(stored), tables["churn_metrics_daily"])
    views.load(R.high_risk_alerts(stored), tables["high_risk_customers"])
    return R.union_all(
        [
            views.read(spark, t).agg(
                F.lit(name).alias("table_name"), F.count("*").alias("rows"), F.lit(len(t.schema.fields)).alias("columns")
            )
            for name, t in tables.items()
        ]
    )


@query(
    "create_views",
    on_predictions(
        """SELECT 'realtime' AS view, CAST(hour AS VARCHAR) AS label, churn_rate AS value FROM dashboard
        UNION ALL SELECT 'geography', geography, churn_rate FROM by_geography
        UNION ALL SELECT 'top_risk', customer_id, max_risk_score FROM top_risk""",
        DASHBOARD, GEOGRAPHY, TOP_RISK,
    ),
)
def create_views(spark, folder):
    views.create_views(predictions(spark, folder), latest_instant(spark, folder))
    return spark.sql(
        """SELECT 'realtime' AS view, CAST(hour AS STRING) AS label, churn_rate AS value FROM v_realtime_dashboard
        UNION ALL SELECT 'geography', geography, churn_rate FROM v_geography_churn
        UNION ALL SELECT 'top_risk', customer_id, max_risk_score FROM v_top_risk_customers"""
    )


@query(
    "table_layout",
    on_predictions(
        """SELECT predicted_date, count(*) AS rows, count(DISTINCT customer_id) AS customers
        FROM (SELECT CAST(predicted_at AS DATE) AS predicted_date, customer_id FROM predictions)
        WHERE predicted_date >= DATE '2024-01-25' GROUP BY predicted_date"""
    ),
)
def table_layout(spark, folder):
    facts = score_facts(spark, folder).drop("user_id")
    path = work_folder(spark, "layout")
    views.write_by_day(facts, path, "predicted_at", ["customer_id"])
    stored = spark.read.schema(keyed.with_schema(facts)).parquet(path)
    return (
        stored.where(F.col(keyed.DAY) >= F.lit("2024-01-25").cast("date"))
        .groupBy(keyed.DAY)
        .agg(F.count("*").alias("rows"), F.countDistinct("customer_id").alias("customers"))
    )
