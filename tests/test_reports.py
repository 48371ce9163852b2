import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.util import column, spark_rows
from tidewatch.functions.expr import risk_score, rounded, share
from tidewatch.operators import reports as R

NOW = dt.datetime(2024, 1, 31, 12, 0)


def scored(spark, rows):
    """(event_id, customer, probability, hours before NOW[, geography[, age]])"""
    full = [(*r[:3], float(r[3]), *(r[4:] or ("ASIA", 30))) for r in rows]
    df = spark.createDataFrame(full, "event_id string, customer_id string, probability double, hours double, geography string, age int")
    prediction = F.when(F.col("probability") >= 0.5, 1).otherwise(0)
    at = F.lit(NOW).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(0), secs=(F.col("hours") * 3600).cast("decimal(18,6)"))
    return df.select(
        "event_id", "customer_id", prediction.alias("prediction"), "probability",
        risk_score(F.col("probability"), prediction).alias("risk_score"), at.alias("predicted_at"),
        "geography", F.lit("Male").alias("gender"), "age", F.lit(3).alias("tenure"), F.lit(100.0).alias("balance"),
        F.col("customer_id").alias("user_id"),
    )


@pytest.fixture
def events(spark):
    return scored(
        spark,
        [
            ("e1", "1", 0.9, 0.1, "ASIA", 20),
            ("e2", "1", 0.1, 0.2, "ASIA", 21),
            ("e3", "2", 0.6, 1.5, "EUROPE", None),
            ("e4", "3", 0.95, 30, "EUROPE", 50),
            ("e5", "3", 0.5, 24 * 8, None, 50),
            ("e6", "4", 0.2, 24 * 31, "ASIA", 60),
        ],
    )


def test_time_ranges(events):
    assert column(R.last(events, NOW, "24 HOURS"), "event_id", "event_id") == ["e1", "e2", "e3"]
    assert column(R.last(events, NOW, "30 DAYS"), "event_id", "event_id") == ["e1", "e2", "e3", "e4", "e5"]
    assert column(R.previous_hour(events, NOW), "event_id", "event_id") == ["e1", "e2"]
    assert column(R.on_date(events, F.lit("2024-01-31")), "event_id", "event_id") == ["e1", "e2", "e3"]
    clock = events.agg(F.max("predicted_at").alias("as_of"))
    assert column(R.previous_hour(events, clock), "event_id", "event_id") == ["e3"]


def test_range_ends(spark):
    df = scored(spark, [("now", "1", 0.9, 0.0), ("edge", "1", 0.9, 24.0), ("old", "1", 0.9, 24.001)])
    assert column(R.last(df, NOW, "24 HOURS"), "event_id", "event_id") == ["edge", "now"]


def test_certainty_is_not_probability(spark):
    df = spark.createDataFrame([(0.1, 0), (0.9, 1)], "p double, y int")
    both = df.select(risk_score(F.col("p"), F.col("y")).alias("c"), risk_score(F.col("p"), F.col("y"), "probability").alias("q"))
    assert [tuple(r) for r in both.collect()] == [(0.9, 0.1), (0.9, 0.9)]
    with pytest.raises(ValueError):
        risk_score(F.col("p"), F.col("y"), "other")


def test_rounding_is_half_away_from_zero(spark):
    df = spark.createDataFrame([(0.125, -0.125, 1.005)], "a double, b double, c double")
    assert tuple(df.select(*[rounded(F.col(c), 2) for c in "abc"]).first()) == (0.13, -0.13, 1.01)
    assert spark.range(1).select(share(F.lit(1), F.lit(0))).first()[0] is None


def test_rollups_agree_however_they_are_built(spark, events):
    direct = R.rollup_hourly(events)
    attributes = events.select("event_id", "geography", "gender", "age", "tenure", "balance")
    per_customer = R.customer_state(events, R.hour_key(), "event_id").join(attributes, "event_id")
    condensed = R.finish(R.merge_states(per_customer, R.HOUR), R.HOUR)
    assert spark_rows(direct) == spark_rows(condensed)
    assert spark_rows(R.rollup_daily(events)) == spark_rows(
        R.finish(R.rollup_state(events, F.to_date("predicted_at").alias("date")), "date")
    )


def test_rollup_values(events):
    row = R.rollup_hourly(events).where("hour_timestamp = '2024-01-31 11:00:00'").first()
    assert (row["total_predictions"], row["churn_count"], row["churn_rate"], row["high_risk_count"]) == (2, 1, 50.0, 2)
    assert (row["avg_risk_score"], row["avg_age"]) == (0.9, 20.5)
    lonely = R.rollup_hourly(events).where("hour_timestamp = '2024-01-31 10:00:00'").first()
    assert lonely["avg_age"] is None


def test_geography_has_a_row_for_unknown_places(events):
    rows = {r["geography"]: r for r in R.geography_churn(events, NOW).collect()}
    assert set(rows) == {"ASIA", "EUROPE", None} and rows["ASIA"]["total_customers"] == 2


def test_kpis(events):
    row = R.overall_kpis(events).first()
    assert (row["total_predictions"], row["total_churns"], row["unique_customers"], row["geographies_covered"]) == (6, 4, 4, 2)
    empty = R.overall_kpis(events.limit(0)).first()
    assert empty["overall_churn_rate"] is None


def test_top_risk_twice_for_changed_attributes_but_latest_once(spark, events):
    rows = R.top_risk_customers(events, NOW).collect()
    assert [(r["customer_id"], r["age"]) for r in rows] == [("3", 50), ("1", 20), ("1", 21)]
    latest = R.top_risk_customers_latest(events, NOW).collect()
    assert [(r["customer_id"], r["age"], r["max_risk_score"]) for r in latest] == [("3", 50, 0.95), ("1", 20, 0.9)]


def test_recent_and_alerts(events):
    assert column(R.recent_predictions(events, 2), "customer_id") == ["1", "1"]
    doubled = events.unionByName(events)
    assert spark_rows(R.high_risk_alerts(events)) == spark_rows(R.high_risk_alerts(doubled))
    assert R.high_risk_alerts(events).count() == 4


def test_segments_at_the_edges(spark):
    df = scored(spark, [(str(p), "1", p, 0) for p in (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)])
    row = R.risk_segments(df).first()
    assert (row["high_risk_customers"], row["medium_risk_customers"], row["low_risk_customers"]) == (2, 5, 1)
    row = R.risk_segments_tracking(df).first()
    assert (row["high_risk"], row["medium_risk"], row["low_risk"]) == (2, 2, 4)
    row = R.confidence_bands(df).first()
    assert (row["high_confidence_predictions"], row["uncertain_predictions"]) == (1, 3)
    bands = {r[0]: r[1] for r in R.risk_bands(df, "probability", R.BANDS_NOTEBOOK, None).collect()}
    assert bands == {"High": 2, "Moderate": 1, None: 5}
    bands = {r[0]: r[1] for r in R.risk_bands(df, "probability", R.BANDS_DASHBOARD, "Low Risk").collect()}
    assert bands == {"Extreme Risk": 1, "High Risk": 1, "Moderate Risk": 1, "Low Risk": 5}


def test_histogram_includes_its_upper_end(spark):
    df = spark.createDataFrame([(0.0,), (0.05,), (0.999,), (1.0,), (1.5,), (None,)], "x double")
    assert {r["bin"]: r["count"] for r in R.histogram(df, "x", 0.0, 1.0, 20).collect()} == {0: 1, 1: 1, 19: 2}


def test_colours(spark):
    df = spark.createDataFrame([(14.99,), (15.0,), (20.0,), (20.01,), (25.01,)], "r double")
    rows = df.select(R.traffic_light(F.col("r"), 15, 20), R.bar_colour(F.col("r"))).collect()
    assert [tuple(r) for r in rows] == [
        ("Green", "green"), ("Yellow", "green"), ("Red", "green"), ("Red", "orange"), ("Red", "red"),
    ]


def test_risk_level(spark):
    def level(churned, total):
        df = spark.range(total).select(F.when(F.col("id") < churned, 1).otherwise(0).alias("prediction"))
        return R.churn_risk_level(df).first()["churn_risk_level"]

    assert [level(15, 100), level(16, 100), level(25, 100), level(26, 100)] == ["LOW", "MODERATE", "MODERATE", "HIGH"]


def test_distribution_and_top_values(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "c string")
    assert [tuple(r) for r in R.value_distribution(df, "c").collect()] == [("a", 2, 50.0), (None, 1, 25.0), ("b", 1, 25.0)]
    assert column(R.top_values(df, "c", 2), "value") == ["a", "b"]


def test_results_do_not_depend_on_partitioning(events):
    for build in (R.rollup_hourly, R.rollup_daily, R.demographics, R.overall_kpis, R.high_risk_alerts):
        assert spark_rows(build(events)) == spark_rows(build(events.repartition(5)))
