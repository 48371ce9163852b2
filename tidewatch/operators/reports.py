"""Rollups, dashboards, segments and top-k reports over scored events.

Inputs have the columns of ``schemas.PREDICTIONS``.  ``as_of`` is always an
argument, a datetime or a one-row DataFrame, never the wall clock.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.expr import (
    HIGH_RISK, banded, churn_label, count_if, earlier, hour_of, instant, rounded, share,
)
from tidewatch.functions.stats import attach, stat

# Grouping of the top-risk report, and its sizes.
CUSTOMER_VIEW = ["customer_id", "geography", "gender", "age", "balance", "tenure"]
TOP_CUSTOMERS = 100


# --- filters ---------------------------------------------------------------

def time_range(df: DataFrame, column: str, start: Column, end: Column | None = None) -> DataFrame:
    """``start <= column < end``: a range on the raw column, so files can be skipped."""
    kept = df.where(F.col(column) >= start)
    return kept if end is None else kept.where(F.col(column) < end)


def last(df: DataFrame, as_of, interval: str, column: str = "predicted_at") -> DataFrame:
    return time_range(df, column, earlier(as_of, interval))


def previous_hour(df: DataFrame, as_of, column: str = "predicted_at") -> DataFrame:
    """The last full hour before ``as_of``."""
    if isinstance(as_of, DataFrame):
        name = as_of.columns[0]
        hour = as_of.select(hour_of(F.col(name)).alias(name))
        return time_range(df, column, earlier(hour, "1 HOUR"), instant(hour))
    hour = hour_of(instant(as_of))
    return time_range(df, column, hour - F.expr("INTERVAL 1 HOUR"), hour)


def on_date(df: DataFrame, day: Column, column: str = "predicted_at") -> DataFrame:
    """Rows of one calendar day, written as a range."""
    start = day.cast("date").cast("timestamp_ntz")
    return time_range(df, column, start, start + F.expr("INTERVAL 1 DAY"))


def above(df: DataFrame, threshold: float = HIGH_RISK, column: str = "risk_score") -> DataFrame:
    return df.where(F.col(column) >= threshold)


# --- rollups ---------------------------------------------------------------

# A rollup state holds sums and counts.  Unlike averages they can be merged, so
# days come out of hours, and rows can be condensed before they are joined.
_SCORES = ["risk_score", "probability"]
_ATTRIBUTES = ["age", "balance", "tenure"]


def _score_states(threshold: float) -> list[Column]:
    return [
        F.count("*").alias("total_predictions"),
        F.sum(F.col("prediction").cast("bigint")).alias("churn_count"),
        count_if(F.col("risk_score") >= threshold).alias("high_risk_count"),
        F.min("predicted_at").alias("first_prediction"),
        F.max("predicted_at").alias("last_prediction"),
        *[F.sum(c).alias(f"sum_{c}") for c in _SCORES],
        *[F.count(c).alias(f"n_{c}") for c in _SCORES],
    ]


def rollup_state(df: DataFrame, *keys, threshold: float = HIGH_RISK) -> DataFrame:
    """State per ``keys`` of scored rows that carry the customer attributes."""
    return df.groupBy(*keys).agg(
        *_score_states(threshold),
        *[F.sum(F.col(c).cast("double")).alias(f"sum_{c}") for c in _ATTRIBUTES],
        *[F.count(c).alias(f"n_{c}") for c in _ATTRIBUTES],
    )


def customer_state(df: DataFrame, *keys, threshold: float = HIGH_RISK) -> DataFrame:
    """State per ``keys`` and customer, before the attributes are joined.

    Joining these rows instead of the events shuffles one row per customer and
    key; a customer that owns a third of the events is condensed on the map side.
    """
    return df.groupBy(*keys, "customer_id", "user_id").agg(*_score_states(threshold))


def merge_states(states: DataFrame, *keys) -> DataFrame:
    """Merge states; attribute columns that are still per customer are weighted by rows."""
    merged = [
        *[F.sum(c).alias(c) for c in ("total_predictions", "churn_count", "high_risk_count")],
        F.min("first_prediction").alias("first_prediction"),
        F.max("last_prediction").alias("last_prediction"),
        *[F.sum(f"{kind}_{c}").alias(f"{kind}_{c}") for c in _SCORES for kind in ("sum", "n")],
    ]
    rows = F.col("total_predictions")
    for c in _ATTRIBUTES:
        if f"sum_{c}" in states.columns:
            total, n = F.col(f"sum_{c}"), F.col(f"n_{c}")
        else:
            total, n = F.col(c) * rows.cast("double"), F.when(F.col(c).isNotNull(), rows).otherwise(0)
        merged += [F.sum(total).alias(f"sum_{c}"), F.sum(n).alias(f"n_{c}")]
    return states.groupBy(*keys).agg(*merged)


def _mean(c: str, places: int) -> Column:
    return rounded(F.try_divide(F.col(f"sum_{c}"), F.col(f"n_{c}")), places)


def _churn_rate() -> Column:
    return share(F.col("churn_count"), F.col("total_predictions"))


def finish(states: DataFrame, key: str) -> DataFrame:
    """The published metric row of a rollup state."""
    return states.select(
        key,
        "total_predictions",
        "churn_count",
        _churn_rate().alias("churn_rate"),
        _mean("risk_score", 4).alias("avg_risk_score"),
        "high_risk_count",
        _mean("age", 1).alias("avg_age"),
        _mean("balance", 2).alias("avg_balance"),
        _mean("tenure", 1).alias("avg_tenure"),
    )


HOUR = "hour_timestamp"


def hour_key() -> Column:
    return hour_of(F.col("predicted_at")).alias(HOUR)


def rollup_hourly(df: DataFrame, threshold: float = HIGH_RISK) -> DataFrame:
    return finish(rollup_state(df, hour_key(), threshold=threshold), HOUR)


def daily_from_hourly(states: DataFrame) -> DataFrame:
    return finish(merge_states(states, F.to_date(HOUR).alias("date")), "date")


def rollup_daily(df: DataFrame, threshold: float = HIGH_RISK) -> DataFrame:
    """Daily metrics out of the hourly sums: raw rows are read and shuffled once."""
    return daily_from_hourly(rollup_state(df, hour_key(), threshold=threshold))


# --- dashboards ------------------------------------------------------------

def realtime_dashboard(df: DataFrame, as_of) -> DataFrame:
    return (
        last(df, as_of, "24 HOURS")
        .groupBy(hour_of(F.col("predicted_at")).alias("hour"))
        .agg(
            F.count("*").alias("total_predictions"),
            F.sum(F.col("prediction").cast("bigint")).alias("churn_count"),
            share(F.sum("prediction"), F.count("*")).alias("churn_rate"),
            rounded(F.avg("risk_score"), 3).alias("avg_risk_score"),
            count_if(F.col("risk_score") >= HIGH_RISK).alias("high_risk_count"),
            F.max("predicted_at").alias("latest_prediction"),
        )
        .orderBy(F.desc("hour"))
    )


def geography_churn(df: DataFrame, as_of) -> DataFrame:
    return geography_rows(rollup_state(last(df, as_of, "30 DAYS"), "geography"))


def geography_rows(states: DataFrame) -> DataFrame:
    return states.select(
        "geography",
        F.col("total_predictions").alias("total_customers"),
        "churn_count",
        _churn_rate().alias("churn_rate"),
        _mean("risk_score", 3).alias("avg_risk_score"),
        _mean("age", 1).alias("avg_age"),
        _mean("balance", 2).alias("avg_balance"),
    ).orderBy(F.desc("churn_rate"), "geography")


def demographics(df: DataFrame) -> DataFrame:
    return demographic_rows(rollup_state(df, "gender", "geography"))


def demographic_rows(states: DataFrame) -> DataFrame:
    return states.select(
        "gender",
        "geography",
        F.col("total_predictions").alias("count"),
        F.col("churn_count").alias("churns"),
        _churn_rate().alias("churn_rate"),
        _mean("age", 1).alias("avg_age"),
        _mean("balance", 2).alias("avg_balance"),
        _mean("tenure", 1).alias("avg_tenure"),
    ).orderBy(F.desc("churn_rate"), "gender", "geography")


def demographics_pivot(demographic: DataFrame, genders: Sequence[str] = ("Female", "Male")) -> DataFrame:
    """The churn rates of ``demographics`` as a matrix; naming the genders saves a job."""
    return demographic.groupBy("geography").pivot("gender", list(genders)).agg(F.first("churn_rate"))


def overall_kpis(df: DataFrame) -> DataFrame:
    return kpi_row(rollup_state(df, "customer_id", "geography"))


def kpi_row(states: DataFrame, exact_distinct: bool = True) -> DataFrame:
    """One row over states per customer and geography; the distinct counts see those rows only."""
    distinct = F.countDistinct if exact_distinct else F.approx_count_distinct
    total, churns, risky = F.sum("total_predictions"), F.sum("churn_count"), F.sum("high_risk_count")
    return states.agg(
        total.alias("total_predictions"),
        churns.alias("total_churns"),
        share(churns, total).alias("overall_churn_rate"),
        rounded(F.try_divide(F.sum("sum_probability"), F.sum("n_probability")), 3).alias("avg_probability"),
        rounded(F.try_divide(F.sum("sum_risk_score"), F.sum("n_risk_score")), 3).alias("avg_risk_score"),
        risky.alias("high_risk_count"),
        share(risky, total).alias("high_risk_rate"),
        F.min("first_prediction").alias("first_prediction"),
        F.max("last_prediction").alias("last_prediction"),
        distinct("customer_id").alias("unique_customers"),
        distinct("geography").alias("geographies_covered"),
    )


def table_stats(df: DataFrame, name: str, column: str) -> DataFrame:
    """Row count, oldest and newest record of one table."""
    ts = F.col(column).cast("timestamp_ntz")
    return df.agg(
        F.lit(name).alias("table_name"),
        F.count("*").alias("total_rows"),
        F.min(ts).alias("oldest_record"),
        F.max(ts).alias("newest_record"),
    )


def row_count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.lit(name).alias("table_name"), F.count("*").alias("row_count"))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def recent_count(df: DataFrame, as_of, interval: str = "1 HOUR") -> DataFrame:
    return df.agg(
        F.count("*").alias("total_rows"),
        count_if(F.col("predicted_at") >= earlier(as_of, interval)).alias("recent_rows"),
    )


def latest_hours(dashboard: DataFrame, n: int = 24) -> DataFrame:
    return dashboard.orderBy(F.desc("hour")).limit(n)


def dashboard_summary(hours: DataFrame) -> DataFrame:
    """Totals over dashboard rows; the rate is the unweighted mean of the hourly rates."""
    return hours.agg(
        F.sum("total_predictions").alias("total_predictions"),
        F.sum("churn_count").alias("total_churns"),
        rounded(F.avg("churn_rate"), 2).alias("avg_churn_rate"),
        F.sum("high_risk_count").alias("high_risk_customers"),
        F.min("hour").alias("first_hour"),
        F.max("hour").alias("last_hour"),
        F.count("*").alias("hours"),
    )


# --- segments --------------------------------------------------------------

def risk_segments(df: DataFrame, column: str = "probability") -> DataFrame:
    p = F.col(column)
    segments = {"high": p > 0.7, "medium": (p >= 0.3) & (p <= 0.7), "low": p < 0.3}
    return df.agg(
        F.count("*").alias("total_customers"),
        *[count_if(c).alias(f"{name}_risk_customers") for name, c in segments.items()],
        *[share(count_if(c), F.count("*")).alias(f"{name}_risk_percentage") for name, c in segments.items()],
    )


def risk_segments_tracking(df: DataFrame) -> DataFrame:
    p = F.col("probability")
    return df.agg(
        F.count("*").alias("total_predictions"),
        rounded(F.avg(p), 6).alias("avg_probability"),
        count_if(F.col("prediction") == 1).alias("churn_predictions"),
        count_if(F.col("prediction") == 0).alias("retain_predictions"),
        count_if(p > 0.7).alias("high_risk"),
        count_if((p > 0.5) & (p <= 0.7)).alias("medium_risk"),
        count_if(p <= 0.5).alias("low_risk"),
    )


def risk_bands(
    df: DataFrame, column: str, edges: Sequence[tuple[str, float, bool]], default: str | None
) -> DataFrame:
    """Rows per band; an edge is (label, lower bound, bound included), highest first."""
    value = F.col(column)
    bands = [(label, value >= low if closed else value > low) for label, low, closed in edges]
    return (
        df.withColumn("risk_band", banded(value, bands, default))
        .groupBy("risk_band")
        .agg(F.count("*").alias("customers"))
    )


# The two published band definitions.
BANDS_NOTEBOOK = [("Extreme", 0.9, False), ("High", 0.8, True), ("Moderate", 0.7, True)]
BANDS_DASHBOARD = [("Extreme Risk", 0.9, True), ("High Risk", 0.8, True), ("Moderate Risk", 0.7, True)]


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int = 20) -> DataFrame:
    """Equal-width bins over [low, high]; the last bin includes ``high``."""
    position = F.floor((F.col(column) - low) / (high - low) * bins)
    return (
        df.where((F.col(column) >= low) & (F.col(column) <= high))
        .groupBy(F.least(position, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count("*").alias("count"))
        .withColumn("bin_start", rounded(low + F.col("bin") * ((high - low) / bins), 6))
        .withColumn("bin_end", rounded(low + (F.col("bin") + 1) * ((high - low) / bins), 6))
    )


def traffic_light(rate: Column, green_below: float, yellow_below: float) -> Column:
    """Dashboard colour of a churn rate, with exclusive upper limits."""
    return F.when(rate < green_below, "Green").when(rate < yellow_below, "Yellow").otherwise("Red")


def bar_colour(rate: Column, red_above: float = 25, amber_above: float = 20) -> Column:
    """Report colour of a churn rate, with exclusive lower limits."""
    return F.when(rate > red_above, "red").when(rate > amber_above, "orange").otherwise("green")


def confidence_bands(df: DataFrame) -> DataFrame:
    p, predicted = F.col("probability"), F.col("prediction")
    return df.agg(
        rounded(1 - F.avg(F.when(predicted == 0, p)), 6).alias("average_retention_confidence"),
        rounded(F.avg(F.when(predicted == 1, p)), 6).alias("average_churn_confidence"),
        count_if((p > 0.8) | (p < 0.2)).alias("high_confidence_predictions"),
        count_if((p >= 0.4) & (p <= 0.6)).alias("uncertain_predictions"),
    )


def churn_risk_level(df: DataFrame, high: float = 25, moderate: float = 15) -> DataFrame:
    rates = df.agg(
        F.count("*").alias("total_customers"),
        F.try_divide(100.0 * F.sum("prediction"), F.count("*")).alias("rate"),
    )
    return rates.select(
        "total_customers",
        rounded(F.col("rate"), 2).alias("churn_rate"),
        F.when(F.col("rate") > high, "HIGH")
        .when(F.col("rate") > moderate, "MODERATE")
        .otherwise("LOW")
        .alias("churn_risk_level"),
    )


def value_distribution(df: DataFrame, column: str, places: int = 2) -> DataFrame:
    """Count and percentage per value; the total is one constant out of the same counts."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("total"))
    return (
        attach(counts, total)
        .withColumn("percentage", share(F.col("count"), stat("total"), places))
        .select("value", "count", "percentage")
        .orderBy(F.desc("count"), "value")
    )


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    return (
        df.groupBy(F.col(column).alias("value"))
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), F.asc_nulls_last("value"))
        .limit(n)
    )


# --- top-k -----------------------------------------------------------------

def _risky(df: DataFrame, as_of) -> DataFrame:
    return above(last(df, as_of, "7 DAYS"))


def riskiest_per_customer(df: DataFrame, as_of) -> DataFrame:
    """The risky week condensed to one row per customer, before attributes are joined.

    Maxima of maxima: the top reports give the same rows on this as on the events.
    """
    newest = F.max(F.struct("predicted_at", "event_id")).alias("_newest")
    return (
        _risky(df, as_of)
        .groupBy("customer_id", "user_id")
        .agg(F.max("risk_score").alias("risk_score"), newest)
        .select("customer_id", "user_id", "risk_score", "_newest.*")
    )


def top_risk_customers(df: DataFrame, as_of, n: int = TOP_CUSTOMERS) -> DataFrame:
    """Top risks per distinct customer view; changed attributes give a second row."""
    return (
        _risky(df, as_of)
        .groupBy(*CUSTOMER_VIEW)
        .agg(F.max("risk_score").alias("max_risk_score"), F.max("predicted_at").alias("last_prediction"))
        .orderBy(F.desc("max_risk_score"), *CUSTOMER_VIEW)
        .limit(n)
    )


def top_risk_customers_latest(df: DataFrame, as_of, n: int = TOP_CUSTOMERS) -> DataFrame:
    """One row per customer, with the attributes of the newest event."""
    attributes = [c for c in CUSTOMER_VIEW if c != "customer_id"]
    newest = F.max(F.struct("predicted_at", "event_id", *attributes)).alias("newest")
    return (
        _risky(df, as_of)
        .groupBy("customer_id")
        .agg(F.max("risk_score").alias("max_risk_score"), newest)
        .select(
            "customer_id",
            "max_risk_score",
            F.col("newest.predicted_at").alias("last_prediction"),
            *[F.col(f"newest.{c}").alias(c) for c in attributes],
        )
        .orderBy(F.desc("max_risk_score"), "customer_id")
        .limit(n)
    )


def recent_predictions(df: DataFrame, n: int = 50) -> DataFrame:
    return (
        df.orderBy(F.desc("predicted_at"), F.desc("event_id"))
        .limit(n)
        .select(
            "customer_id",
            churn_label(F.col("prediction")).alias("prediction_label"),
            rounded(F.col("probability"), 3).alias("probability"),
            rounded(F.col("risk_score"), 3).alias("risk_score"),
            "geography", "gender", "age", "balance", "tenure", "predicted_at",
        )
    )


def high_risk_alerts(df: DataFrame, threshold: float = HIGH_RISK) -> DataFrame:
    """One alert per customer and instant; the event time dates it, so replays agree."""
    return (
        above(df, threshold)
        .groupBy("customer_id", F.col("predicted_at").alias("detected_at"))
        .agg(F.max(F.struct("event_id", "risk_score", "geography", "gender", "age", "balance")).alias("last"))
        .select(
            "customer_id",
            *[F.col(f"last.{c}").alias(c) for c in ["risk_score", "geography", "gender", "age", "balance"]],
            "detected_at",
            F.lit(False).alias("alert_sent"),
            F.lit(None).cast("timestamp_ntz").alias("alert_sent_at"),
        )
    )
