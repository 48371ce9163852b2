"""The two domain tables, derived from the star-schema tables of a folder.

``predictions`` looks like the scored-event table, ``customers`` like the raw
customer table.  Joins carry no hints: Catalyst broadcasts a side whose file
statistics are below its threshold and otherwise lets adaptive execution split
skewed keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.functions.expr import risk_score, rounded
from tidewatch.schemas import SOURCES


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A source table; the declared schema saves the job that reads file footers."""
    return spark.read.schema(SOURCES[name]).parquet(f"{folder}/{name}.parquet")


def score_facts(spark: SparkSession, folder: str, mode: str = "certainty") -> DataFrame:
    """Scored events without customer attributes; no join at all."""
    probability = F.least(F.col("value") / 200, F.lit(1.0))
    prediction = F.when(F.col("value") >= 100, 1).otherwise(0)
    return table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("user_id").cast("string").alias("customer_id"),
        prediction.alias("prediction"),
        probability.alias("probability"),
        risk_score(probability, prediction, mode).alias("risk_score"),
        F.col("ts").cast("timestamp_ntz").alias("predicted_at"),
        F.lit("rule_v1").alias("model_version"),
        F.col("user_id"),
    )


def customer_attributes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per customer: the attributes a scored event carries."""
    key = F.col("c_custkey")
    return (
        table(spark, folder, "customer")
        .join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select(
            "c_custkey",
            F.col("r_name").alias("geography"),
            F.when(key % 2 == 0, "Female").otherwise("Male").alias("gender"),
            (18 + (31 * key) % 75).cast("int").alias("age"),
            (key % 11).cast("int").alias("tenure"),
            F.col("c_acctbal").alias("balance"),
            (1 + key % 4).cast("int").alias("num_of_products"),
            F.when(key % 3 != 0, 1).otherwise(0).alias("has_cr_card"),
            F.when(key % 5 < 3, 1).otherwise(0).alias("is_active_member"),
        )
    )


def with_attributes(spark: SparkSession, folder: str, facts: DataFrame) -> DataFrame:
    return facts.join(
        customer_attributes(spark, folder), F.col("user_id") == F.col("c_custkey"), "left"
    ).drop("c_custkey", "user_id")


def predictions(spark: SparkSession, folder: str, mode: str = "certainty") -> DataFrame:
    """Scored events with customer attributes."""
    return with_attributes(spark, folder, score_facts(spark, folder, mode))


def latest_instant(spark: SparkSession, folder: str) -> DataFrame:
    """One row: the newest event time, the reference instant of every report."""
    return table(spark, folder, "events").agg(F.max(F.col("ts").cast("timestamp_ntz")).alias("as_of"))


def customers(spark: SparkSession, folder: str) -> DataFrame:
    """The raw customer table, with missing values and a target."""
    orders = table(spark, folder, "orders")
    per_customer = orders.groupBy("o_custkey").agg(
        F.count("*").alias("n_orders"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("spent"),
        F.max("o_orderdate").alias("newest"),
    )
    stale = orders.agg(F.expr("max(o_orderdate) - INTERVAL 365 DAYS").alias("stale")).scalar()
    key = F.col("c_custkey")
    return (
        table(spark, folder, "customer")
        .join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .join(per_customer, key == F.col("o_custkey"), "left")
        .select(
            (key + 1).alias("RowNumber"),
            key.alias("CustomerId"),
            F.when(key % 89 != 0, F.col("c_mktsegment")).alias("Firstname"),
            F.col("n_name").alias("Lastname"),
            (350 + (7919 * key) % 501).cast("int").alias("CreditScore"),
            F.col("r_name").alias("Geography"),
            F.when(key % 97 == 0, None).when(key % 2 == 0, "Female").otherwise("Male").alias("Gender"),
            F.when(key % 17 != 0, 18 + (31 * key) % 75).cast("int").alias("Age"),
            (key % 11).cast("int").alias("Tenure"),
            F.col("c_acctbal").alias("Balance"),
            F.least(F.lit(4), 1 + F.floor(F.coalesce("n_orders", F.lit(0)) / 6)).cast("int").alias("NumOfProducts"),
            F.when(key % 3 != 0, 1).otherwise(0).alias("HasCrCard"),
            F.when(key % 5 < 3, 1).otherwise(0).alias("IsActiveMember"),
            rounded(F.try_divide(F.col("spent").cast("double"), F.col("n_orders")), 2).alias("EstimatedSalary"),
            F.when(F.col("newest").isNull() | (F.col("newest") < stale), 1).otherwise(0).alias("Exited"),
        )
    )


def _outcomes(spark: SparkSession, folder: str, scored: DataFrame) -> DataFrame:
    truth = customers(spark, folder).select(
        F.col("CustomerId").alias("user_id"), F.col("Exited").alias("true_label")
    )
    return scored.join(truth, "user_id").drop("user_id")


def outcome_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Scored events next to what the customer really did."""
    scored = score_facts(spark, folder).select(
        "user_id",
        "event_id",
        F.col("prediction").alias("predicted_label"),
        F.col("probability").alias("prediction_probability"),
    )
    return _outcomes(spark, folder, scored)


def outcome_counts(spark: SparkSession, folder: str, *keys) -> DataFrame:
    """The same pairs counted (``n``) per customer, class and ``keys`` before the join."""
    scored = score_facts(spark, folder).groupBy("user_id", F.col("prediction").alias("predicted_label"), *keys)
    return _outcomes(spark, folder, scored.agg(F.count("*").alias("n")))
