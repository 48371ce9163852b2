"""Table schemas.  Readers take these; inference is opt-in."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names and order of the raw customer table, the model
# matrix and the reporting tables.
CUSTOMER = T.StructType(
    [
        T.StructField("RowNumber", T.LongType()),
        T.StructField("CustomerId", T.LongType()),
        T.StructField("Firstname", T.StringType()),
        T.StructField("Lastname", T.StringType()),
        T.StructField("CreditScore", T.IntegerType()),
        T.StructField("Geography", T.StringType()),
        T.StructField("Gender", T.StringType()),
        T.StructField("Age", T.IntegerType()),
        T.StructField("Tenure", T.IntegerType()),
        T.StructField("Balance", T.DoubleType()),
        T.StructField("NumOfProducts", T.IntegerType()),
        T.StructField("HasCrCard", T.IntegerType()),
        T.StructField("IsActiveMember", T.IntegerType()),
        T.StructField("EstimatedSalary", T.DoubleType()),
        T.StructField("Exited", T.IntegerType()),
    ]
)

IDENTIFIERS = ["RowNumber", "CustomerId", "Firstname", "Lastname"]
TARGET = "Exited"
NUMERIC = [
    "CreditScore", "Age", "Tenure", "Balance", "NumOfProducts", "HasCrCard",
    "IsActiveMember", "EstimatedSalary",
]
CATEGORICAL = ["Geography", "Gender"]
REQUIRED = [
    "CreditScore", "Geography", "Gender", "Age", "Tenure", "Balance", "NumOfProducts",
    "HasCrCard", "IsActiveMember", "EstimatedSalary", "Exited",
]

PREDICTIONS = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("customer_id", T.StringType(), False),
        T.StructField("prediction", T.IntegerType(), False),
        T.StructField("probability", T.DoubleType(), False),
        T.StructField("risk_score", T.DoubleType(), False),
        T.StructField("predicted_at", T.TimestampNTZType(), False),
        T.StructField("model_version", T.StringType()),
        T.StructField("geography", T.StringType()),
        T.StructField("gender", T.StringType()),
        T.StructField("age", T.IntegerType()),
        T.StructField("tenure", T.IntegerType()),
        T.StructField("balance", T.DoubleType()),
        T.StructField("num_of_products", T.IntegerType()),
        T.StructField("has_cr_card", T.IntegerType()),
        T.StructField("is_active_member", T.IntegerType()),
        T.StructField("estimated_salary", T.DoubleType()),
    ]
)

_METRICS = [
    T.StructField("total_predictions", T.LongType(), False),
    T.StructField("churn_count", T.LongType(), False),
    T.StructField("churn_rate", T.DoubleType(), False),
    T.StructField("avg_risk_score", T.DoubleType(), False),
    T.StructField("high_risk_count", T.LongType(), False),
    T.StructField("avg_age", T.DoubleType()),
    T.StructField("avg_balance", T.DoubleType()),
    T.StructField("avg_tenure", T.DoubleType()),
]
HOURLY = T.StructType([T.StructField("hour_timestamp", T.TimestampNTZType(), False), *_METRICS])
DAILY = T.StructType([T.StructField("date", T.DateType(), False), *_METRICS])

ALERTS = T.StructType(
    [
        T.StructField("customer_id", T.StringType(), False),
        T.StructField("risk_score", T.DoubleType(), False),
        T.StructField("geography", T.StringType()),
        T.StructField("gender", T.StringType()),
        T.StructField("age", T.IntegerType()),
        T.StructField("balance", T.DoubleType()),
        T.StructField("detected_at", T.TimestampNTZType(), False),
        T.StructField("alert_sent", T.BooleanType()),
        T.StructField("alert_sent_at", T.TimestampNTZType()),
    ]
)

# The same record shape a Kafka source yields, with text instead of binary.
MESSAGE = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)

# Columns of the star-schema tables the fixtures come from.
SOURCES = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}
