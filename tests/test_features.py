import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.util import column, spark_rows
from tidewatch.operators import binning as B
from tidewatch.operators import encoding as E
from tidewatch.operators import outliers as O
from tidewatch.operators import projections as P
from tidewatch.operators import scaling as S
from tidewatch.operators import split as SP


@pytest.fixture
def scores(spark):
    values = [299, 300, 580, 581, 670, 740, 800, 850, 851, None]
    return spark.createDataFrame(list(enumerate(values)), "id long, CreditScore int")


def test_named_ranges(scores):
    binned = B.bin_named_ranges(scores, "CreditScore", B.CREDIT_RANGES, first={850: "Excellent"})
    assert column(binned, "CreditScoreBins", "id") == [
        "Invalid", "Poor", "Poor", "Fair", "Fair", "Good", "Very Good", "Excellent", "Invalid", "Invalid",
    ]
    assert "CreditScore" not in binned.columns
    open_top = B.bin_named_ranges(scores, "CreditScore", {"low": [0, 700], "high": [700]})
    assert column(open_top, "CreditScoreBins", "id")[-3:] == ["high", "high", "Invalid"]


def test_splits(spark):
    df = spark.createDataFrame(
        [(0, 0.0), (1, 9.9), (2, 10.0), (3, 20.0), (4, -1.0), (5, 21.0), (6, float("nan")), (7, None)], "id int, v double"
    )
    labelled = B.bin_splits(df, "v", [0, 10, 20], ["a", "b"])
    assert column(labelled, "vBins", "id") == ["a", "a", "b", "b"] + ["Unknown"] * 4
    numbered = B.bin_splits(df, "v", [0, 10, 20])
    assert column(numbered, "vBins", "id") == [0.0, 0.0, 1.0, 1.0, None, None, None, None]
    unbounded = B.bin_splits(df, "v", [0, 10, math.inf], ["a", "b"])
    assert column(unbounded, "vBins", "id")[5] == "b"


def test_credit_presets(scores):
    assert column(B.bin_credit_preset(scores), "CreditScoreBins", "id") == [
        "Poor", "Poor", "Good", "Good", "Good", "Very Good", "Excellent", "Excellent", "Excellent", "Unknown",
    ]
    assert column(B.bin_ordinal(scores), "CreditScoreBins", "id") == [0, 0, 0, 1, 1, 2, 3, 4, 4, 4]
    assert column(B.bin_ordinal(scores, null_code=2), "CreditScoreBins", "id")[-1] == 2


@pytest.fixture
def places(spark):
    return spark.createDataFrame(
        [(0, "b"), (1, "b"), (2, "a"), (3, "c"), (4, None), (5, "a"), (6, "b")], "id int, c string"
    )


def test_frequency_codes(places):
    assert column(E.index_by_frequency(places, ["c"]), "c", "id") == [0, 0, 1, 3, 2, 1, 0]


def test_frequency_codes_of_unseen_values(places, spark):
    other = spark.createDataFrame([(0, "a"), (1, "new"), (2, None)], "id int, c string")
    assert column(E.index_by_frequency(other, ["c"], fit_on=places), "c", "id") == [1, 4, 2]


def test_alphabetical_codes(places):
    assert column(E.label_encode_alpha(places, ["c"]), "c", "id") == [1, 1, 0, 2, 3, 0, 1]


def test_categories_of_several_columns_are_numbered_on_the_executors(spark):
    many = spark.range(30_000).select(
        F.concat(F.lit("é"), (F.col("id") % 7777).cast("string")).alias("c"), F.when(F.col("id") % 3 > 0, (F.col("id") % 11).cast("string")).alias("a")
    )
    rows = [tuple(r) for r in many.select("a", "c").collect()]
    for fit, null, by_frequency in ((E.frequency_encoder, "MISSING", True), (E.alphabetical_encoder, "nan", False), (E.encoder_table, None, False)):
        expected = {}
        for i, name in enumerate(("a", "c")):
            counts = Counter(null if r[i] is None else r[i] for r in rows)
            counts.pop(None, None)
            ordered = sorted(counts, key=lambda v: (-counts[v] if by_frequency else 0, v.encode()))
            expected |= {(name, v): at for at, v in enumerate(ordered)}
        found = fit(many, ["c", "a"])
        assert {(r["column"], r["category"]): r["code"] for r in found.collect()} == expected


def test_vectors_fitted_on_other_rows(spark, places):
    other = spark.createDataFrame([(0, "a"), (1, "new"), (2, None)], "id int, c string")
    rows = E.one_hot_vector(other, ["c"], fit_on=places).orderBy("id").collect()
    assert [(r["c_vec"].size, list(r["c_vec"].indices)) for r in rows] == [(4, [1]), (4, []), (4, [2])]


def test_ordinal(places):
    assert column(E.ordinal_encode(places, {"c": {"a": 10, "b": 20}}), "c", "id") == [20, 20, 10, -1, None, 10, 20]


def test_one_hot_columns(places, spark):
    hot = E.one_hot_columns(places, ["c"])
    assert hot.columns == ["id", "c_a", "c_b", "c_c"]
    assert [tuple(r) for r in hot.orderBy("id").collect()][3:5] == [(3, 0, 0, 1), (4, 0, 0, 0)]
    unseen = E.one_hot_columns(spark.createDataFrame([(9, "zzz")], "id int, c string"), ["c"], fit_on=places)
    assert [tuple(r) for r in unseen.collect()] == [(9, 0, 0, 0)]


def test_one_hot_refuses_to_make_too_many_columns(spark):
    df = spark.range(20).select(F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError):
        E.categories(df, ["c"], max_categories=10)


def test_one_hot_vector_drops_the_extra_slot(places):
    vectors = E.one_hot_vector(places, ["c"])
    assert vectors.columns == ["id", "c_vec"]
    first = vectors.orderBy("id").first()["c_vec"]
    assert first.size == 4 and list(first.toArray()) == [1, 0, 0, 0]
    assert E.one_hot_capped(places, ["c"], 3).columns == ["id", "c"]


def test_encoder_table(places):
    assert spark_rows(E.encoder_table(places, ["c"])) == [("a", "0.0", "c"), ("b", "1.0", "c"), ("c", "2.0", "c")]


@pytest.fixture
def numbers(spark):
    rows = [(i, float(i), 10.0 * i, 100.0 * i, 7.0) for i in range(1, 6)]
    return spark.createDataFrame(rows, "id int, feature1 double, feature2 double, feature3 double, flat double")


def test_minmax(numbers):
    scaled = S.scale_minmax(numbers, ["feature1", "feature2", "flat"])
    assert column(scaled, "feature1", "id") == [0, 0.25, 0.5, 0.75, 1]
    assert column(scaled, "feature3", "id") == [100, 200, 300, 400, 500]
    assert set(column(scaled, "flat")) == {0.5}
    assert set(column(S.scale_minmax(numbers, ["flat"], constant=0.0), "flat")) == {0.0}


def test_minmax_of_nulls_and_of_nothing(spark):
    df = spark.createDataFrame([(None,), (1.0,), (3.0,)], "x double")
    assert sorted(str(v) for v in column(S.scale_minmax(df, ["x"]), "x")) == ["0.0", "1.0", "None"]
    assert S.scale_minmax(df.limit(0), ["x"]).collect() == []


def test_standard(numbers):
    sample = column(S.scale_standard(numbers, ["feature1"]), "feature1", "id")
    assert sample[0] == pytest.approx(-2 / 1.5811388301)
    population = column(S.scale_standard(numbers, ["feature1"], ddof=0), "feature1", "id")
    assert sum(v * v for v in population) / 5 == pytest.approx(1)
    assert sum(population) == pytest.approx(0)
    assert set(column(S.scale_standard(numbers, ["flat"]), "flat")) == {0.0}
    assert column(S.scale_standard(numbers, ["feature1"], with_std=False), "feature1", "id") == [-2, -1, 0, 1, 2]
    assert column(S.scale_standard(numbers, ["feature1"], with_mean=False), "feature1", "id")[4] == pytest.approx(5 / 1.5811388301)


def test_scaler_is_fitted_on_the_training_side_only(numbers):
    train = numbers.where("id <= 3")
    scaled = S.scale_minmax(numbers, ["feature1"], fit_on=train)
    assert column(scaled, "feature1", "id") == [0, 0.5, 1, 1.5, 2]
    changed = numbers.withColumn("feature1", F.when(F.col("id") > 3, 1e9).otherwise(F.col("feature1")))
    again = S.scale_minmax(changed, ["feature1"], fit_on=changed.where("id <= 3"))
    assert column(again, "feature1", "id")[:3] == [0, 0.5, 1]


def test_stored_scaler(numbers):
    scaled = S.scale_apply(numbers, {"feature1": (1.0, 3.0), "absent": (0, 1)})
    assert column(scaled, "feature1", "id") == [0, 0.5, 1, 1.5, 2]


def test_vector_scaler(numbers):
    rows = S.scale_vector(numbers, ["feature1", "feature2"], "standard").orderBy("id").collect()
    assert list(rows[0]["scaled_features"]) == pytest.approx([1 / 1.5811388301, 10 / 15.811388301])
    with pytest.raises(ValueError):
        S.scale_vector(numbers, ["feature1"], "log")


# --- outliers ------------------------------------------------------------------

@pytest.fixture
def spread(spark):
    rows = [(i, float(i), float(i)) for i in range(1, 10)] + [(10, 1000.0, 1000.0), (11, None, 5.0), (12, -900.0, 5.0)]
    return spark.createDataFrame(rows, "id int, x double, y double")


def test_flags_and_removal(spread):
    flags = O.iqr_flag(spread, ["x", "y"]).orderBy("id").collect()
    assert [r["x_outlier"] for r in flags][8:] == [False, True, None, True]
    assert column(O.outlier_remove(spread, ["x", "y"]), "id", "id") == [1, 2, 3, 4, 5, 6, 7, 8, 9, 12]
    assert 11 in column(O.outlier_remove(spread, ["x", "y"], nulls="keep"), "id")
    assert 12 not in column(O.outlier_remove(spread, ["x", "y"], min_outliers=1), "id")
    with pytest.raises(ValueError):
        O.outlier_remove(spread, ["x"], nulls="maybe")


def test_capping_keeps_nulls(spread):
    bounds = O.iqr_bounds(spread, ["x"]).collect()[0]
    capped = column(O.outlier_cap(spread, ["x"]), "x", "id")
    assert capped[9] == bounds["upper_bound"] and capped[11] == bounds["lower_bound"] and capped[10] is None


def test_zscore(spark):
    df = spark.createDataFrame([(i, 0.0 if i else 100.0) for i in range(50)], "id int, x double")
    assert O.zscore_flag(df, ["x"]).where("x_outlier").count() == 1


# --- splits --------------------------------------------------------------------

@pytest.fixture
def classes(spark):
    return spark.range(2000).select("id", F.when(F.col("id") % 5 == 0, 1).otherwise(0).alias("y"))


def _sides(df):
    return {r["id"]: r["split"] for r in df.collect()}


def test_random_split_ignores_partitioning(classes):
    one = _sides(SP.split_random(classes, ["id"]))
    assert one == _sides(SP.split_random(classes.repartition(13), ["id"]))
    assert 0.17 < sum(s == "test" for s in one.values()) / 2000 < 0.23
    assert one != _sides(SP.split_random(classes, ["id"], seed=43))


@pytest.mark.parametrize("cells", [1, 16, 65536])
def test_exact_stratified_split(classes, cells):
    df = SP.split_stratified(classes.repartition(9), ["id"], "y", exact=True, cells=cells)
    counts = {(r["split"], r["y"]): r["count"] for r in df.groupBy("split", "y").count().collect()}
    assert counts == {("train", 0): 1280, ("test", 0): 320, ("train", 1): 320, ("test", 1): 80}
    if cells > 1:
        assert _sides(df) == _sides(SP.split_stratified(classes, ["id"], "y", exact=True, cells=1))


def test_exact_split_uses_largest_remainders(spark):
    df = spark.range(11).select("id", F.when(F.col("id") < 3, "a").when(F.col("id") < 7, "b").otherwise("c").alias("y"))
    split = SP.split_stratified(df, ["id"], "y", test_size=0.5, exact=True)
    counts = {(r["split"], r["y"]): r["count"] for r in split.groupBy("split", "y").count().collect()}
    # 5 training rows of 11: wanted 1.36, 1.82, 1.82; both remaining rows go to b and c.
    assert counts == {("train", "a"): 1, ("test", "a"): 2, ("train", "b"): 2, ("test", "b"): 2, ("train", "c"): 2, ("test", "c"): 2}


def test_exact_split_keeps_null_class_and_tiny_classes(spark):
    df = spark.createDataFrame([(i, 0) for i in range(20)] + [(100, 1), (200, None)], "id long, y int")
    split = SP.split_stratified(df, ["id"], "y", exact=True)
    assert split.count() == 22 and split.where("split = 'test'").count() == 5


def test_samples(classes):
    ids = column(SP.sample_n(classes, 50, ["id"]), "id")
    assert len(set(ids)) == 50 and sorted(ids) == sorted(column(SP.sample_n(classes.repartition(7), 50, ["id"]), "id"))
    assert SP.sample_n(classes, 5000, ["id"]).count() == 2000
    assert 140 < SP.sample_fraction(classes, 0.1, ["id"]).count() < 260


# --- projections ---------------------------------------------------------------

def test_align_features(spark):
    df = spark.createDataFrame([(1, 5.0, "x")], "Age int, Balance double, extra string")
    aligned = P.align_features(df)
    assert aligned.columns == P.MODEL_COLUMNS
    row = aligned.first()
    assert row["Age"] == 1 and row["Gender_Male"] == 0


def test_cast_columns(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "a string")
    assert column(P.cast_columns(df, {"a": "int", "absent": "int"}), "a") == [1, None, None]


def test_feature_target(spark):
    x, y = P.feature_target(spark.createDataFrame([(1, 0)], "a int, Exited int"))
    assert (x.columns, y.columns) == (["a"], ["Exited"])
