import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import stats as S


def _values(spark, values, column="x"):
    return spark.createDataFrame([(v,) for v in values], f"{column} double")


@pytest.mark.parametrize("buckets", [2, 3, 16, 1024])
@pytest.mark.parametrize("kind", ["spread", "one hot value", "few values", "single"])
def test_quantiles_equal_numpy(spark, kind, buckets):
    rng = random.Random(7)
    values = {
        "spread": [rng.gauss(0, 10) for _ in range(999)],
        "one hot value": [5.0] * 400 + [rng.random() * 100 for _ in range(700)],
        "few values": [float(rng.randint(0, 3)) for _ in range(500)],
        "single": [4.25],
    }[kind]
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    row = S.exact_quantiles(_values(spark, values), ["x"], probs, buckets).collect()[0]
    assert row["n"] == len(values)
    expected = np.quantile(values, probs)
    assert [row[f"q{i}"] for i in range(5)] == pytest.approx(expected)


def test_quantiles_skip_null_and_nan_and_keep_columns_apart(spark):
    df = spark.createDataFrame(
        [(1.0, 10), (2.0, None), (float("nan"), 30), (None, 40)], "a double, b int"
    )
    got = {r["feature"]: (r["n"], r["q0"]) for r in S.exact_quantiles(df, ["a", "b"], [0.5]).collect()}
    assert got == {"a": (2, 1.5), "b": (3, 30.0)}


def test_quantiles_of_nothing(spark):
    assert S.exact_quantiles(_values(spark, []), ["x"], [0.5]).collect() == []


def test_approx_quantiles_are_close(spark):
    df = spark.range(10001).select(F.col("id").cast("double").alias("x"))
    row = S.quantiles(df, ["x"], [0.5], "approx").collect()[0]
    assert abs(row["q0"] - 5000) <= 5


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        S.quantiles(_values(spark, [1.0]), ["x"], [0.5], "guess")


@pytest.mark.parametrize("buckets", [2, 5, 1024])
def test_running_counts(spark, buckets):
    rng = random.Random(3)
    data = [(f"f{i % 2}", float(v), rng.randint(0, 5)) for i, v in enumerate(rng.sample(range(10000), 600))]
    df = spark.createDataFrame(data, "feature string, value double, n long").repartition(5)
    got = {(r["feature"], r["value"]): r["upto_n"] for r in S.running_counts(df, ["n"], ["feature"], buckets).collect()}
    for f, v, _ in data:
        assert got[f, v] == sum(n for g, w, n in data if g == f and w <= v)


@pytest.mark.parametrize("buckets", [2, 7, 1024])
def test_numbered_is_a_global_row_number(spark, buckets):
    words = [f"w{i:05d}" for i in range(700)]
    shuffled = words[:]
    random.Random(1).shuffle(shuffled)
    df = spark.createDataFrame([(w, len(w)) for w in shuffled], "w string, n int").repartition(7)
    got = S.numbered(df, F.col("w"), buckets=buckets).collect()
    assert sorted((r["position"], r["w"]) for r in got) == list(enumerate(words))


@pytest.mark.parametrize("limit", [2, 3, 8, 9, 1024])
def test_count_below(spark, limit):
    rng = random.Random(limit)
    edges = sorted(rng.sample(range(5000), limit - 1))
    df = spark.createDataFrame([(float(v),) for v in range(0, 5000, 37)], "v double").withColumn(
        "edges", F.array(*[F.lit(float(e)) for e in edges])
    )
    for r in S.count_below(df, "edges", "v", "k", limit).collect():
        assert r["k"] == sum(e < r["v"] for e in edges)


def test_attach_uses_a_subquery_not_a_join(spark):
    df = spark.range(10)
    plan = S.attach(df, df.agg(F.max("id").alias("m")))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "scalar-subquery" in plan


def test_quantiles_shuffle_only_what_lies_near(spark):
    n = 300_000
    df = spark.range(n).selectExpr("CAST(hash(id) AS DOUBLE) * 0.5 AS a", "CAST(id % 7 AS DOUBLE) AS b", "IF(id % 3 = 0, NULL, CAST(pow(id, 3) AS DOUBLE)) AS c")
    probs = [0.0, 0.25, 0.5, 0.999, 1.0]
    counts = S.bracketed_counts(S.unpivoted(df, ["a", "b", "c"]), probs)
    near = counts.where("value IS NOT NULL").groupBy("feature", "i").count().collect()
    # Four times the error of the sketch to either side, and the error itself.
    assert max(r["count"] for r in near) <= n * 10 / S.SKETCH + 2
    values = {c: np.array([r[0] for r in df.where(f"{c} IS NOT NULL").select(c).collect()]) for c in "abc"}
    for row in S.exact_quantiles(df, ["a", "b", "c"], probs).collect():
        for i, p in enumerate(probs):
            assert row[f"q{i}"] == pytest.approx(np.quantile(values[row["feature"]], p), rel=1e-12)
        assert row["n"] == len(values[row["feature"]])
