import pytest
from pyspark.sql import functions as F

from tests.util import column, spark_rows
from tidewatch.operators import missing as M
from tidewatch.operators import profile as P
from tidewatch.operators.projections import null_or_empty


@pytest.fixture
def people(spark):
    return spark.createDataFrame(
        [
            (1, "Ann", "Lee", "Female", 30.0),
            (2, "Ann", "Lee", None, None),
            (3, "Bob", "Ray", "Male", 40.0),
            (4, "Bob", "Ray", None, 50.0),
            (5, None, "Kim", "Male", 20.0),
            (6, "Zed", "Fox", "", None),
        ],
        "id long, Firstname string, Lastname string, Gender string, Age double",
    )


def test_drop_missing(people):
    assert column(M.drop_missing(people, ["Firstname"]), "id", "id") == [1, 2, 3, 4, 6]
    assert column(M.drop_missing(people), "id", "id") == [1, 3]


def test_fills(people):
    assert column(M.fill_mean(people, "Age"), "Age", "id") == [30.0, 35.0, 40.0, 50.0, 20.0, 35.0]
    assert column(M.fill_median(people, "Age"), "Age", "id") == [30.0, 35.0, 40.0, 50.0, 20.0, 35.0]
    assert column(M.fill_mode(people, "Gender"), "Gender", "id") == ["Female", "Male", "Male", "Male", "Male", ""]
    assert column(M.fill_constant(people, "Gender", "?"), "Gender", "id")[1] == "?"
    everything = M.fill_constant_all(people, "x")
    assert column(everything, "Firstname", "id")[4] == "x" and column(everything, "Age", "id")[1] is None


def test_mode_ignores_nulls_and_breaks_ties_by_value(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), (None,), (None,)], "c string")
    assert sorted(column(M.fill_mode(df, "c"), "c")) == ["a", "a", "a", "a", "b"]


def test_statistics_of_an_empty_or_all_null_column(spark):
    df = spark.createDataFrame([(None, None)], "x double, c string")
    assert M.fill_mean(df, "x").collect()[0]["x"] is None
    assert M.fill_median(df, "x").collect()[0]["x"] is None
    assert M.fill_mode(df, "c").collect()[0]["c"] is None
    assert M.fill_from(df, M.mode_stats(df, "c", "Unknown"), ["c"]).collect()[0]["c"] == "Unknown"
    assert M.fill_mean(df.limit(0), "x").collect() == []


def test_lookup_never_multiplies_rows(people):
    lookup = people.select("Firstname", "Lastname", "Gender").unionByName(
        people.select("Firstname", "Lastname", F.lit("Other").alias("Gender"))
    )
    filled = M.coalesce_from_lookup(people, lookup, ["Firstname", "Lastname"], "Gender")
    assert filled.count() == 6
    assert column(filled, "Gender", "id") == ["Female", "Female", "Male", "Male", "Male", ""]


def test_lookup_treats_empty_as_missing_when_told(people):
    lookup = people.sparkSession.createDataFrame([("Zed", "Fox", "Male")], "Firstname string, Lastname string, Gender string")
    filled = M.coalesce_from_lookup(
        people, lookup, ["Firstname", "Lastname"], "Gender", null_or_empty(people, "Gender")
    )
    assert column(filled, "Gender", "id") == ["Female", None, "Male", None, "Male", "Male"]


def test_majority_lookup(spark):
    df = spark.createDataFrame([("k", "a"), ("k", "b"), ("k", "b"), ("t", "y"), ("t", "x"), ("n", None)], "k string, v string")
    assert spark_rows(M.majority_lookup(df, ["k"], "v")) == [("k", "b"), ("t", "x")]


def test_random_draw_is_repeatable_and_valid(people):
    once = M.impute_random_valid(people, "Gender", ["id"])
    again = M.impute_random_valid(people.repartition(4), "Gender", ["id"])
    assert spark_rows(once) == spark_rows(again)
    assert set(column(once, "Gender")) <= {"", "Female", "Male"}


def test_random_draw_from_very_many_values(spark):
    df = spark.range(200_000).select("id", F.when(F.col("id") < 100_000, F.concat(F.lit("v"), F.col("id"))).alias("c"))
    filled = M.impute_random_valid(df, "c", ["id"])
    assert filled.count() == 200_000 and filled.where("c IS NULL").count() == 0
    drawn = filled.where("id >= 100000").select("c").distinct().count()
    assert 62_000 < drawn < 64_500  # 100,000 draws from as many values meet 1 - 1/e of them


def test_random_draw_without_values(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id int, c string")
    assert [r["c"] for r in M.impute_random_valid(df, "c", ["id"]).collect()] == [None, None]


def test_random_draw_covers_the_values(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") < 4, F.col("id").cast("string")).alias("c"))
    counts = [r["count"] for r in M.impute_random_valid(df, "c", ["id"]).groupBy("c").count().collect()]
    assert len(counts) == 4 and min(counts) > 850


def test_policies(people):
    strict = M.missing_policy_pandas(people, skip=["id", "Firstname", "Lastname"])
    assert column(strict, "id", "id") == [1, 3, 5, 6]
    assert column(strict, "Age", "id") == [30.0, 40.0, 20.0, 35.0]
    lenient = M.missing_policy_spark(people)
    assert column(lenient, "Gender", "id") == ["Female", "Unknown", "Male", "Unknown", ""]
    assert column(lenient, "Age", "id") == [30.0, 40.0, 40.0, 50.0, 40.0]


def test_profiles(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "a")], "x double, c string")
    assert spark_rows(P.missing_profile(df)) == [("c", "1.0", "33.33"), ("x", "2.0", "66.67")]
    assert spark_rows(P.duplicate_count(df, ["c"])) == [("33.33", "1.0", "3.0")]
    empty = P.duplicate_count(df.limit(0)).collect()[0]
    assert (empty["total_rows"], empty["duplicate_rows"], empty["duplicate_percentage"]) == (0, 0, None)


def test_duplicates_count_nulls_as_equal(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), (2, None), (2, None), (2, 3)], "a int, b int")
    assert P.duplicate_count(df).collect()[0]["duplicate_rows"] == 2


def test_null_or_empty_knows_types(spark):
    df = spark.createDataFrame([(1, "", float("nan")), (2, "x", 1.0), (None, None, None)], "i int, s string, d double")
    assert [df.where(null_or_empty(df, c)).count() for c in ("i", "s", "d")] == [1, 2, 2]


@pytest.mark.parametrize("unit", [1e-11, 1.0, 1e20])
def test_statistics_keep_their_precision(spark, unit):
    from tidewatch.operators import outliers as O
    from tidewatch.operators import scaling as S

    values = [1.0, 2.0, 3.0, 6.0]
    df = spark.createDataFrame([(v * unit, v * unit) for v in values], "x double, y double")
    holes = df.select("x").unionByName(spark.createDataFrame([(None,), (float("nan"),)], "x double"))
    filled = [r.x / unit for r in M.fill_mean(holes, "x").collect()]
    assert sorted(round(v, 9) for v in filled) == [1.0, 2.0, 3.0, 3.0, 3.0, 6.0]
    assert O.outlier_remove(df, ["x", "y"]).count() == 4
    scaled = [r.x for r in S.scale_standard(df, ["x"]).collect()]
    assert abs(sum(scaled)) < 1e-9 and abs(sum(v * v for v in scaled) - 3) < 1e-9
