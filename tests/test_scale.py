"""Hot keys, plan shapes and independence from partitioning."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.util import rows, spark_rows
from tidewatch.operators import evaluation as V
from tidewatch.operators import quality as Q
from tidewatch.operators import split as SP
from tidewatch.plans.fixtures import customers, latest_instant, predictions, score_facts
from tidewatch.schemas import SOURCES

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def skewed(spark, folder, tmp_path_factory):
    """The small data set with a third of the events and orders on one customer, a third of the values equal."""
    out = str(tmp_path_factory.mktemp("skewed"))
    for name in SOURCES:
        df = spark.read.schema(SOURCES[name]).parquet(f"{folder}/{name}.parquet")
        if name == "events":
            df = df.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, 7).otherwise(F.col("user_id")))
            df = df.withColumn("user_id", F.when(F.col("event_id") % 101 != 0, F.col("user_id")).cast("bigint"))
            df = df.withColumn("value", F.when(F.col("event_id") % 3 == 1, 42.0).otherwise(F.col("value")))
        if name == "orders":
            df = df.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, 7).otherwise(F.col("o_custkey")).cast("bigint"))
        df.write.parquet(f"{out}/{name}.parquet")
    return out


@pytest.fixture(scope="module")
def skewed_duck(skewed):
    con = duckdb.connect()
    for name in SOURCES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{skewed}/{name}.parquet/*.parquet'")
    return con


@pytest.fixture
def no_broadcast(conf):
    conf(**{"spark.sql.autoBroadcastJoinThreshold": "-1"})


@pytest.mark.parametrize(
    "name",
    [
        "rollup_hourly", "rollup_daily", "realtime_dashboard", "geography_churn", "demographics", "demographics_pivot",
        "overall_kpis", "top_risk_customers", "top_risk_customers_latest", "high_risk_alerts", "recent_predictions",
        "prediction_summary", "classification_report", "overfit_gap", "roc_auc", "drift_ks", "iqr_bounds", "fill_median",
        "numeric_column_stats", "outlier_remove", "impute_by_key", "index_by_frequency", "label_encode_alpha",
        "split_stratified", "duplicate_count", "top_values", "validation_report", "upsert", "insert_if_absent",
    ],
)
def test_hot_keys_without_broadcasts(spark, skewed, skewed_duck, no_broadcast, name):
    found = entry.queries()[name](spark, skewed)
    expected = skewed_duck.execute(SQL[name])
    assert spark_rows(found) == rows([c[0] for c in expected.description], expected.fetchall())


def test_a_hot_customer_is_split_in_the_join(spark, skewed, no_broadcast, conf):
    conf(
        **{
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
            "spark.sql.files.maxPartitionBytes": "4KB",
            "spark.sql.files.openCostInBytes": "0",
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
        }
    )
    events = score_facts(spark, skewed).repartition(16)
    from tidewatch.plans.fixtures import with_attributes

    df = with_attributes(spark, skewed, events)
    df.collect()
    assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()


def test_condensed_rows_are_what_is_shuffled(spark, skewed, no_broadcast):
    """The hot customer reaches the join as one row per hour, not as a third of the events."""
    df = entry.queries()["geography_churn"](spark, skewed)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftOuter") < plan.index("Aggregate [customer_id")


PLANS = sorted(
    set(entry.queries())
    - {"train_gbt", "train_random_forest", "train_logistic", "model_save", "model_load", "batch_score",
       "feature_importance", "top_features"}
    - {n for n in entry.queries() if n.startswith("stream_")}
)


@pytest.mark.parametrize("name", PLANS)
def test_no_plan_multiplies_rows_or_leaves_the_jvm(spark, folder, no_broadcast, name):
    plan = entry.queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    for forbidden in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas"):
        assert forbidden not in plan


def test_time_filter_reaches_the_files(spark, folder):
    plan = entry.queries()["realtime_dashboard"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[IsNotNull\(ts\), GreaterThanOrEqual\(ts,ScalarSubquery", plan)
    assert "ReadSchema: struct<ts:timestamp_ntz,value:double>" in plan


def test_only_needed_columns_are_read(spark, folder):
    plan = entry.queries()["risk_segments"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"ReadSchema: struct<([^>]*)>", plan) == ["value:double"]


@pytest.mark.parametrize("parts", [1, 7])
def test_partitioning_changes_nothing(spark, folder, parts):
    people = customers(spark, folder)
    spread = people.repartition(parts, "Balance")

    def results(df):
        return [
            spark_rows(SP.split_stratified(df, ["CustomerId"], "Exited", exact=True)),
            spark_rows(Q.validation_report(df)),
            spark_rows(Q.drift_ks(df.where("CustomerId % 2 = 0"), df.where("CustomerId % 2 = 1"), ["Balance", "Age"])),
        ]

    assert results(people) == results(spread)


def test_one_hot_score_in_the_auc(spark):
    """Half of all rows share one score; counting pairs gives the same area."""
    df = spark.range(3000).select(
        (F.col("id") % 4 == 0).cast("int").alias("true_label"),
        F.when(F.col("id") % 2 == 0, 0.5).otherwise(F.col("id") / 3000).alias("prediction_probability"),
    )
    data = [(r[0], r[1]) for r in df.collect()]
    up, down = [p for y, p in data if y], [p for y, p in data if not y]
    expected = sum((a > b) + 0.5 * (a == b) for a in up for b in down) / (len(up) * len(down))
    assert V.roc_auc(df).first()["roc_auc"] == pytest.approx(expected, abs=1e-9)


def test_instant_is_the_newest_event(spark, folder):
    newest = predictions(spark, folder).agg(F.max("predicted_at")).first()[0]
    assert latest_instant(spark, folder).first()[0] == newest
