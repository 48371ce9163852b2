import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import quality as Q


def brute_force_ks(a, b):
    points = sorted(set(a) | set(b))
    return max(abs(sum(x <= p for x in a) / len(a) - sum(x <= p for x in b) / len(b)) for p in points)


@pytest.mark.parametrize("kind", ["same", "shifted", "ties", "hot"])
def test_drift_statistic_equals_brute_force(spark, kind):
    rng = random.Random(5)
    a = [rng.gauss(0, 1) for _ in range(300)]
    b = {
        "same": [rng.gauss(0, 1) for _ in range(200)],
        "shifted": [rng.gauss(0.8, 1) for _ in range(200)],
        "ties": [round(v) * 1.0 for v in a[:150]],
        "hot": [0.5] * 100 + a[:100],
    }[kind]
    left, right = (spark.createDataFrame([(v,) for v in x], "x double") for x in (b, a))
    row = Q.drift_ks(left, right, ["x"]).first()
    assert row["statistic"] == pytest.approx(brute_force_ks(a, b), abs=1e-9)
    assert (row["severity"] == "HIGH") == (kind in ("shifted", "ties", "hot")) or kind == "ties"


def test_drift_of_identical_and_of_empty_samples(spark):
    df = spark.createDataFrame([(float(i), None) for i in range(50)], "x double, y double")
    rows = Q.drift_ks(df, df, ["x", "y"]).collect()
    assert [(r["column"], r["statistic"], r["p_value"], r["passed"]) for r in rows] == [("x", 0.0, 1.0, True)]


def test_kolmogorov_tail(spark):
    known = {0.5: 0.963945, 0.8276: 0.499950, 1.0: 0.270000, 1.3581: 0.050000, 1.6276: 0.010000, 3.0: 0.0}
    for x, p in known.items():
        assert spark.range(1).select(Q.kolmogorov_tail(F.lit(x))).first()[0] == pytest.approx(p, abs=2e-4)


@pytest.fixture
def good(spark):
    return spark.range(6000).select(
        F.col("id").alias("CustomerId"),
        (F.lit(300) + F.col("id") % 600).cast("int").alias("CreditScore"),
        F.element_at(F.array(F.lit("France"), F.lit("Spain"), F.lit("Germany")), (F.col("id") % 3 + 1).cast("int")).alias("Geography"),
        F.when(F.col("id") % 2 == 0, "Male").otherwise("Female").alias("Gender"),
        (F.lit(18) + F.col("id") % 80).cast("int").alias("Age"),
        (F.col("id") % 11).cast("int").alias("Tenure"),
        F.col("id").cast("double").alias("Balance"),
        (F.lit(1) + F.col("id") % 4).cast("int").alias("NumOfProducts"),
        F.lit(1).alias("HasCrCard"),
        F.lit(0).alias("IsActiveMember"),
        F.col("id").cast("double").alias("EstimatedSalary"),
        F.when(F.col("id") % 4 == 0, 1).otherwise(0).alias("Exited"),
    )


def failing(report):
    return {r["name"] for r in report.where("status = 'FAIL'").collect()} - {"Total"}


def test_clean_table_passes(good):
    assert failing(Q.validation_report(good)) == set()
    rows = Q.validation_report(good).collect()
    assert {r["name"] for r in rows} == set(Q.REPORT_LINES) - {"Data Drift"} | {"Total"}


@pytest.mark.parametrize(
    "line, change",
    [
        ("Shape", lambda df: df.limit(4999)),
        ("Required Columns", lambda df: df.drop("Tenure")),
        ("Data Types", lambda df: df.withColumn("Tenure", F.col("Tenure").cast("string"))),
        ("Value Ranges", lambda df: df.withColumn("Age", F.when(F.col("CustomerId") == 5, 17).otherwise(F.col("Age")))),
        ("Categorical Values", lambda df: df.withColumn("Gender", F.when(F.col("CustomerId") != 7, F.col("Gender")))),
        ("Missing Values", lambda df: df.withColumn("Age", F.when(F.col("CustomerId") >= 481, F.col("Age")))),
        ("Duplicates", lambda df: df.unionByName(df.limit(61))),
        ("Class Balance", lambda df: df.withColumn("Exited", F.when(F.col("CustomerId") % 6 == 0, 1).otherwise(0))),
    ],
)
def test_each_check_finds_its_fault(good, line, change):
    found = failing(Q.validation_report(change(good)))
    assert line in found
    assert found <= {line, "Shape", "Value Ranges"} if line == "Data Types" else found <= {line, "Shape"}


def test_limits_are_inclusive(good):
    # 480 of 6000 is exactly 8 %.
    df = good.withColumn("Age", F.when(F.col("CustomerId") >= 480, F.col("Age")))
    assert failing(Q.validation_report(df)) == set()


def test_only_high_drift_fails(good):
    drift = good.select(F.lit("x").alias("column"), F.lit(False).alias("passed")).limit(1)
    assert failing(Q.validation_report(good, drift)) == {"Data Drift"}


def test_outlier_share(good):
    assert all(r["passed"] for r in Q.check_outlier_share(good).collect())


def test_unexpected_values(good):
    df = good.withColumn("Gender", F.when(F.col("CustomerId") > 1, F.col("Gender")))
    assert [tuple(r) for r in Q.unexpected_values(df, "Gender", ["Male", "Female"]).collect()] == [("Gender", None, 2)]
