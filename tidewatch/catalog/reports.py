"""Rollups, dashboards, segments and top-k reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.catalog.registry import query
from tidewatch.catalog.sqltext import count_if, on_pairs, on_predictions, rnd, share
from tidewatch.functions.expr import churn_label, rounded
from tidewatch.operators import reports as R
from tidewatch.operators.evaluation import prediction_summary as prediction_totals
from tidewatch.plans.fixtures import (
    latest_instant, outcome_counts, predictions, score_facts, with_attributes,
)

CHURN_RATE = share("sum(prediction)", "count(*)")
HIGH = count_if("risk_score >= 0.7")
METRICS = f"""count(*) AS total_predictions, CAST(sum(prediction) AS BIGINT) AS churn_count,
  {CHURN_RATE} AS churn_rate, {rnd('avg(risk_score)', 4)} AS avg_risk_score, {HIGH} AS high_risk_count,
  {rnd('avg(age)', 1)} AS avg_age, {rnd('avg(balance)', 2)} AS avg_balance, {rnd('avg(tenure)', 1)} AS avg_tenure"""

HOURLY = f"""hourly AS (SELECT date_trunc('hour', predicted_at) AS hour_timestamp, {METRICS}
  FROM predictions GROUP BY 1)"""
DAILY = f"""daily AS (SELECT CAST(predicted_at AS DATE) AS date, {METRICS} FROM predictions GROUP BY 1)"""
ALERTS = """alerts AS (SELECT customer_id, risk_score, geography, gender, age, balance,
    predicted_at AS detected_at, false AS alert_sent, CAST(NULL AS TIMESTAMP) AS alert_sent_at
  FROM predictions WHERE risk_score >= 0.7
  QUALIFY row_number() OVER (PARTITION BY customer_id, predicted_at ORDER BY event_id DESC) = 1)"""
DASHBOARD = f"""dashboard AS (SELECT date_trunc('hour', predicted_at) AS hour, count(*) AS total_predictions,
    CAST(sum(prediction) AS BIGINT) AS churn_count, {CHURN_RATE} AS churn_rate,
    {rnd('avg(risk_score)', 3)} AS avg_risk_score, {HIGH} AS high_risk_count, max(predicted_at) AS latest_prediction
  FROM predictions, clock WHERE predicted_at >= as_of - INTERVAL 24 HOUR GROUP BY 1)"""
GEOGRAPHY = f"""by_geography AS (SELECT geography, count(*) AS total_customers,
    CAST(sum(prediction) AS BIGINT) AS churn_count, {CHURN_RATE} AS churn_rate,
    {rnd('avg(risk_score)', 3)} AS avg_risk_score, {rnd('avg(age)', 1)} AS avg_age, {rnd('avg(balance)', 2)} AS avg_balance
  FROM predictions, clock WHERE predicted_at >= as_of - INTERVAL 30 DAY GROUP BY geography)"""
TOP_RISK = """top_risk AS (SELECT customer_id, geography, gender, age, balance, tenure,
    max(risk_score) AS max_risk_score, max(predicted_at) AS last_prediction
  FROM predictions, clock WHERE predicted_at >= as_of - INTERVAL 7 DAY AND risk_score >= 0.7
  GROUP BY customer_id, geography, gender, age, balance, tenure
  ORDER BY max_risk_score DESC, customer_id, geography, gender, age, balance, tenure LIMIT 100)"""


@query("rollup_hourly", on_predictions("SELECT * FROM hourly", HOURLY))
def rollup_hourly(spark, folder):
    return R.finish(_hours(spark, folder, score_facts(spark, folder)), R.HOUR)


def _hours(spark, folder, facts):
    """Hourly states; events are condensed per hour and customer before the join."""
    states = R.customer_state(facts, R.hour_key())
    return R.merge_states(with_attributes(spark, folder, states), R.HOUR)


@query("rollup_daily", on_predictions("SELECT * FROM daily", DAILY))
def rollup_daily(spark, folder):
    return R.daily_from_hourly(_hours(spark, folder, score_facts(spark, folder)))


@query(
    "rollup_previous_hour",
    on_predictions(
        """SELECT h.* FROM hourly h, clock
        WHERE hour_timestamp = date_trunc('hour', as_of) - INTERVAL 1 HOUR""", HOURLY,
    ),
)
def rollup_previous_hour(spark, folder):
    as_of = latest_instant(spark, folder)
    facts = R.previous_hour(score_facts(spark, folder), as_of)
    return R.finish(_hours(spark, folder, facts), R.HOUR)


@query("realtime_dashboard", on_predictions("SELECT * FROM dashboard", DASHBOARD))
def realtime_dashboard(spark, folder):
    return R.realtime_dashboard(score_facts(spark, folder), latest_instant(spark, folder))


def geography_report(spark, folder):
    month = R.last(score_facts(spark, folder), latest_instant(spark, folder), "30 DAYS")
    states = with_attributes(spark, folder, R.customer_state(month))
    return R.geography_rows(R.merge_states(states, "geography"))


def _demographics(spark, folder):
    states = with_attributes(spark, folder, R.customer_state(score_facts(spark, folder)))
    return R.demographic_rows(R.merge_states(states, "gender", "geography"))


def _risky_customers(spark, folder):
    as_of = latest_instant(spark, folder)
    return with_attributes(spark, folder, R.riskiest_per_customer(score_facts(spark, folder), as_of)), as_of


@query("geography_churn", on_predictions("SELECT * FROM by_geography", GEOGRAPHY))
def geography_churn(spark, folder):
    return geography_report(spark, folder)


@query(
    "demographics",
    on_predictions(
        f"""SELECT gender, geography, count(*) AS count, CAST(sum(prediction) AS BIGINT) AS churns,
          {CHURN_RATE} AS churn_rate, {rnd('avg(age)', 1)} AS avg_age, {rnd('avg(balance)', 2)} AS avg_balance,
          {rnd('avg(tenure)', 1)} AS avg_tenure FROM predictions GROUP BY gender, geography"""
    ),
)
def demographics(spark, folder):
    return _demographics(spark, folder)


def _rate_where(condition: str) -> str:
    return share(f"sum(prediction) FILTER (WHERE {condition})", f"count(*) FILTER (WHERE {condition})")


_FEMALE, _MALE = "gender = 'Female'", "gender = 'Male'"


@query(
    "demographics_pivot",
    on_predictions(
        f"""SELECT geography, {_rate_where(_FEMALE)} AS "Female", {_rate_where(_MALE)} AS "Male"
        FROM predictions GROUP BY geography"""
    ),
)
def demographics_pivot(spark, folder):
    return R.demographics_pivot(_demographics(spark, folder))


@query(
    "overall_kpis",
    on_predictions(
        f"""SELECT count(*) AS total_predictions, CAST(sum(prediction) AS BIGINT) AS total_churns,
          {CHURN_RATE} AS overall_churn_rate, {rnd('avg(probability)', 3)} AS avg_probability,
          {rnd('avg(risk_score)', 3)} AS avg_risk_score, {HIGH} AS high_risk_count,
          {share(HIGH, 'count(*)')} AS high_risk_rate, min(predicted_at) AS first_prediction,
          max(predicted_at) AS last_prediction, count(DISTINCT customer_id) AS unique_customers,
          count(DISTINCT geography) AS geographies_covered FROM predictions"""
    ),
)
def overall_kpis(spark, folder):
    return R.kpi_row(with_attributes(spark, folder, R.customer_state(score_facts(spark, folder))))


_TABLES = [
    ("churn_predictions", "predictions", "predicted_at"),
    ("churn_metrics_hourly", "hourly", "hour_timestamp"),
    ("churn_metrics_daily", "daily", "date"),
    ("high_risk_customers", "alerts", "detected_at"),
]


def _four_tables(spark, folder):
    """The reporting tables.  Counts and times need no customer attributes."""
    facts = score_facts(spark, folder)
    bare = facts.withColumns({c: F.lit(None).cast("double") for c in ("age", "balance", "tenure")})
    alerts = R.above(facts).select("customer_id", F.col("predicted_at").alias("detected_at")).distinct()
    return {
        "churn_predictions": facts,
        "churn_metrics_hourly": R.rollup_hourly(bare),
        "churn_metrics_daily": R.rollup_daily(bare),
        "high_risk_customers": alerts,
    }


@query(
    "table_stats",
    on_predictions(
        " UNION ALL ".join(
            f"""SELECT '{name}' AS table_name, count(*) AS total_rows,
              CAST(min({c}) AS TIMESTAMP) AS oldest_record, CAST(max({c}) AS TIMESTAMP) AS newest_record FROM {t}"""
            for name, t, c in _TABLES
        ),
        HOURLY, DAILY, ALERTS,
    ),
)
def table_stats(spark, folder):
    tables = _four_tables(spark, folder)
    return R.union_all([R.table_stats(tables[name], name, c) for name, _, c in _TABLES])


_ROW_COUNTS = on_predictions(
    " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {t}" for n, t, _ in _TABLES),
    HOURLY, DAILY, ALERTS,
)


@query("table_row_counts", _ROW_COUNTS)
def table_row_counts(spark, folder):
    tables = _four_tables(spark, folder)
    return R.union_all([R.row_count(tables[name], name) for name, _, _ in _TABLES])


@query(
    "union_all",
    on_predictions(
        """SELECT 'alert' AS source, customer_id, detected_at AS at FROM alerts
        UNION ALL SELECT 'prediction', customer_id, predicted_at FROM predictions""", ALERTS,
    ),
)
def union_all(spark, folder):
    facts = score_facts(spark, folder)
    alerts = R.above(facts).select("customer_id", F.col("predicted_at").alias("at")).distinct()
    return R.union_all(
        [
            alerts.select(F.lit("alert").alias("source"), "customer_id", "at"),
            facts.select(F.lit("prediction").alias("source"), "customer_id", F.col("predicted_at").alias("at")),
        ]
    )


@query(
    "recent_count",
    on_predictions(
        f"""SELECT count(*) AS total_rows, {count_if("predicted_at >= as_of - INTERVAL 1 HOUR")} AS recent_rows
        FROM predictions, clock"""
    ),
)
def recent_count(spark, folder):
    return R.recent_count(score_facts(spark, folder), latest_instant(spark, folder))


@query(
    "dashboard_summary",
    on_predictions(
        f"""SELECT CAST(sum(total_predictions) AS BIGINT) AS total_predictions,
          CAST(sum(churn_count) AS BIGINT) AS total_churns, {rnd('avg(churn_rate)', 2)} AS avg_churn_rate,
          CAST(sum(high_risk_count) AS BIGINT) AS high_risk_customers, min(hour) AS first_hour, max(hour) AS last_hour,
          count(*) AS hours FROM (SELECT * FROM dashboard ORDER BY hour DESC LIMIT 24)""", DASHBOARD,
    ),
)
def dashboard_summary(spark, folder):
    hours = R.realtime_dashboard(score_facts(spark, folder), latest_instant(spark, folder))
    return R.dashboard_summary(R.latest_hours(hours))


_SEGMENTS = {
    "high": "probability > 0.7", "medium": "probability >= 0.3 AND probability <= 0.7", "low": "probability < 0.3",
}


@query(
    "risk_segments",
    on_predictions(
        "SELECT count(*) AS total_customers, "
        + ", ".join(f"{count_if(c)} AS {n}_risk_customers" for n, c in _SEGMENTS.items()) + ", "
        + ", ".join(f"{share(count_if(c), 'count(*)')} AS {n}_risk_percentage" for n, c in _SEGMENTS.items())
        + " FROM predictions"
    ),
)
def risk_segments(spark, folder):
    return R.risk_segments(score_facts(spark, folder))


@query(
    "risk_segments_tracking",
    on_predictions(
        f"""SELECT count(*) AS total_predictions, {rnd('avg(probability)', 6)} AS avg_probability,
          {count_if('prediction = 1')} AS churn_predictions, {count_if('prediction = 0')} AS retain_predictions,
          {count_if('probability > 0.7')} AS high_risk,
          {count_if('probability > 0.5 AND probability <= 0.7')} AS medium_risk,
          {count_if('probability <= 0.5')} AS low_risk FROM predictions"""
    ),
)
def risk_segments_tracking(spark, folder):
    return R.risk_segments_tracking(score_facts(spark, folder))


@query(
    "risk_bands",
    on_predictions(
        """SELECT CASE WHEN max_risk_score > 0.9 THEN 'Extreme' WHEN max_risk_score >= 0.8 THEN 'High'
          WHEN max_risk_score >= 0.7 THEN 'Moderate' END AS risk_band, count(*) AS customers
        FROM top_risk GROUP BY 1""", TOP_RISK,
    ),
)
def risk_bands(spark, folder):
    top = R.top_risk_customers(*_risky_customers(spark, folder))
    return R.risk_bands(top, "max_risk_score", R.BANDS_NOTEBOOK, None)


@query(
    "risk_bands_dashboard",
    on_predictions(
        """SELECT CASE WHEN risk_score >= 0.9 THEN 'Extreme Risk' WHEN risk_score >= 0.8 THEN 'High Risk'
          WHEN risk_score >= 0.7 THEN 'Moderate Risk' ELSE 'Low Risk' END AS risk_band, count(*) AS customers
        FROM predictions GROUP BY 1"""
    ),
)
def risk_bands_dashboard(spark, folder):
    return R.risk_bands(score_facts(spark, folder), "risk_score", R.BANDS_DASHBOARD, "Low Risk")


@query(
    "risk_histogram",
    on_predictions(
        f"""SELECT bin, count(*) AS count, {rnd('(0.7e0 + bin * (0.3e0 / 20))', 6)} AS bin_start,
          {rnd('(0.7e0 + (bin + 1) * (0.3e0 / 20))', 6)} AS bin_end
        FROM (SELECT CAST(least(floor((max_risk_score - 0.7e0) / (1e0 - 0.7e0) * 20), 19) AS INTEGER) AS bin
              FROM top_risk WHERE max_risk_score >= 0.7 AND max_risk_score <= 1) GROUP BY bin""", TOP_RISK,
    ),
)
def risk_histogram(spark, folder):
    top = R.top_risk_customers(*_risky_customers(spark, folder))
    return R.histogram(top, "max_risk_score", 0.7, 1.0, 20)


@query(
    "risk_histogram_all",
    on_predictions(
        f"""SELECT bin, count(*) AS count, {rnd('(bin * 0.05e0)', 6)} AS bin_start,
          {rnd('((bin + 1) * 0.05e0)', 6)} AS bin_end
        FROM (SELECT CAST(least(floor(risk_score * 20), 19) AS INTEGER) AS bin FROM predictions
              WHERE risk_score >= 0 AND risk_score <= 1) GROUP BY bin"""
    ),
)
def risk_histogram_all(spark, folder):
    return R.histogram(score_facts(spark, folder), "risk_score", 0.0, 1.0, 20)


@query(
    "rate_traffic_light",
    on_predictions(
        """SELECT geography, churn_rate,
          CASE WHEN churn_rate < 15 THEN 'Green' WHEN churn_rate < 20 THEN 'Yellow' ELSE 'Red' END AS overall_colour,
          CASE WHEN churn_rate < 18 THEN 'Green' WHEN churn_rate < 22 THEN 'Yellow' ELSE 'Red' END AS regional_colour,
          CASE WHEN churn_rate > 25 THEN 'red' WHEN churn_rate > 20 THEN 'orange' ELSE 'green' END AS bar_colour
        FROM by_geography""", GEOGRAPHY,
    ),
)
def rate_traffic_light(spark, folder):
    rate = F.col("churn_rate")
    return geography_report(spark, folder).select(
        "geography",
        "churn_rate",
        R.traffic_light(rate, 15, 20).alias("overall_colour"),
        R.traffic_light(rate, 18, 22).alias("regional_colour"),
        R.bar_colour(rate).alias("bar_colour"),
    )


@query(
    "confidence_bands",
    on_predictions(
        f"""SELECT {rnd('(1 - avg(CASE WHEN prediction = 0 THEN probability END))', 6)} AS average_retention_confidence,
          {rnd('avg(CASE WHEN prediction = 1 THEN probability END)', 6)} AS average_churn_confidence,
          {count_if('probability > 0.8 OR probability < 0.2')} AS high_confidence_predictions,
          {count_if('probability >= 0.4 AND probability <= 0.6')} AS uncertain_predictions FROM predictions"""
    ),
)
def confidence_bands(spark, folder):
    return R.confidence_bands(score_facts(spark, folder))


@query(
    "churn_risk_level",
    on_predictions(
        f"""SELECT count(*) AS total_customers, {CHURN_RATE} AS churn_rate,
          CASE WHEN 100e0 * sum(prediction) / count(*) > 25 THEN 'HIGH'
            WHEN 100e0 * sum(prediction) / count(*) > 15 THEN 'MODERATE' ELSE 'LOW' END AS churn_risk_level
        FROM predictions"""
    ),
)
def churn_risk_level(spark, folder):
    return R.churn_risk_level(score_facts(spark, folder))


@query(
    "prediction_summary",
    on_pairs(
        f"""SELECT count(*) AS total_predictions, {count_if('predicted_label = 1')} AS predicted_churn,
          {count_if('predicted_label = 0')} AS predicted_stay, {count_if('true_label = 1')} AS true_churn,
          {count_if('true_label = 0')} AS true_stay,
          {rnd(f"({count_if('true_label = predicted_label')} * 1e0 / count(*))", 6)} AS accuracy FROM pairs"""
    ),
)
def prediction_summary(spark, folder):
    return prediction_totals(outcome_counts(spark, folder), weight="n")


@query("top_risk_customers", on_predictions("SELECT * FROM top_risk", TOP_RISK))
def top_risk_customers(spark, folder):
    return R.top_risk_customers(*_risky_customers(spark, folder))


@query(
    "top_risk_customers_latest",
    on_predictions(
        """SELECT customer_id, max_risk_score, last_prediction, geography, gender, age, balance, tenure FROM (
          SELECT customer_id, geography, gender, age, balance, tenure, predicted_at AS last_prediction,
            max(risk_score) OVER (PARTITION BY customer_id) AS max_risk_score,
            row_number() OVER (PARTITION BY customer_id ORDER BY predicted_at DESC, event_id DESC) AS r
          FROM predictions, clock WHERE predicted_at >= as_of - INTERVAL 7 DAY AND risk_score >= 0.7)
        WHERE r = 1 ORDER BY max_risk_score DESC, customer_id LIMIT 100"""
    ),
)
def top_risk_customers_latest(spark, folder):
    return R.top_risk_customers_latest(*_risky_customers(spark, folder))


@query(
    "top_risk_20",
    on_predictions(
        """SELECT * FROM top_risk
        ORDER BY max_risk_score DESC, customer_id, geography, gender, age, balance, tenure LIMIT 20""", TOP_RISK,
    ),
)
def top_risk_20(spark, folder):
    return R.top_risk_customers(*_risky_customers(spark, folder), 20)


@query(
    "recent_predictions",
    on_predictions(
        f"""SELECT customer_id, CASE WHEN prediction = 1 THEN 'CHURN' ELSE 'RETAIN' END AS prediction_label,
          {rnd('probability', 3)} AS probability, {rnd('risk_score', 3)} AS risk_score,
          geography, gender, age, balance, tenure, predicted_at
        FROM predictions ORDER BY predicted_at DESC, event_id DESC LIMIT 50"""
    ),
)
def recent_predictions(spark, folder):
    # The newest rows are picked before they get their attributes: 50 rows join, not all.
    newest = score_facts(spark, folder).orderBy(F.desc("predicted_at"), F.desc("event_id")).limit(50)
    return R.recent_predictions(with_attributes(spark, folder, newest))


@query("latest_hours", on_predictions("SELECT * FROM dashboard ORDER BY hour DESC LIMIT 24", DASHBOARD))
def latest_hours(spark, folder):
    return R.latest_hours(R.realtime_dashboard(score_facts(spark, folder), latest_instant(spark, folder)))


@query("high_risk_alerts", on_predictions("SELECT * FROM alerts", ALERTS))
def high_risk_alerts(spark, folder):
    return R.high_risk_alerts(predictions(spark, folder))


@query(
    "time_range_filter",
    on_predictions(
        """SELECT 'last_hour' AS span, event_id, predicted_at FROM predictions, clock
          WHERE predicted_at >= as_of - INTERVAL 1 HOUR
        UNION ALL SELECT 'last_24_hours', event_id, predicted_at FROM predictions, clock
          WHERE predicted_at >= as_of - INTERVAL 24 HOUR
        UNION ALL SELECT 'last_7_days', event_id, predicted_at FROM predictions, clock
          WHERE predicted_at >= as_of - INTERVAL 7 DAY
        UNION ALL SELECT 'last_30_days', event_id, predicted_at FROM predictions, clock
          WHERE predicted_at >= as_of - INTERVAL 30 DAY
        UNION ALL SELECT 'previous_hour', event_id, predicted_at FROM predictions, clock
          WHERE predicted_at >= date_trunc('hour', as_of) - INTERVAL 1 HOUR AND predicted_at < date_trunc('hour', as_of)
        UNION ALL SELECT 'one_day', event_id, predicted_at FROM predictions
          WHERE CAST(predicted_at AS DATE) = DATE '2024-01-15'"""
    ),
)
def time_range_filter(spark, folder):
    facts, as_of = score_facts(spark, folder), latest_instant(spark, folder)
    spans = {
        "last_hour": R.last(facts, as_of, "1 HOUR"),
        "last_24_hours": R.last(facts, as_of, "24 HOURS"),
        "last_7_days": R.last(facts, as_of, "7 DAYS"),
        "last_30_days": R.last(facts, as_of, "30 DAYS"),
        "previous_hour": R.previous_hour(facts, as_of),
        "one_day": R.on_date(facts, F.lit("2024-01-15")),
    }
    return R.union_all(
        [df.select(F.lit(name).alias("span"), "event_id", "predicted_at") for name, df in spans.items()]
    )


@query("threshold_filter", on_predictions("SELECT event_id, customer_id, risk_score FROM predictions WHERE risk_score >= 0.7"))
def threshold_filter(spark, folder):
    return R.above(score_facts(spark, folder)).select("event_id", "customer_id", "risk_score")


@query(
    "case_label",
    on_predictions(
        """SELECT event_id, CASE WHEN prediction = 1 THEN 'CHURN' ELSE 'RETAIN' END AS prediction_label,
          CASE WHEN prediction = 1 THEN 'Churn' ELSE 'Retain' END AS status FROM predictions"""
    ),
)
def case_label(spark, folder):
    return score_facts(spark, folder).select(
        "event_id",
        churn_label(F.col("prediction")).alias("prediction_label"),
        churn_label(F.col("prediction"), "Churn", "Retain").alias("status"),
    )


@query(
    "risk_score",
    on_predictions(
        f"""SELECT event_id, {rnd('risk_score', 6)} AS risk_certainty, {rnd('probability', 6)} AS risk_probability
        FROM predictions"""
    ),
)
def risk_score(spark, folder):
    by_probability = score_facts(spark, folder, "probability")
    return by_probability.select(
        "event_id",
        rounded(F.when(F.col("prediction") == 1, F.col("probability")).otherwise(1 - F.col("probability")), 6).alias(
            "risk_certainty"
        ),
        rounded(F.col("risk_score"), 6).alias("risk_probability"),
    )
