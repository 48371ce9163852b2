import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import evaluation as V
from tidewatch.operators import learning as L


def pairs(spark, rows):
    return spark.createDataFrame(rows, "true_label int, predicted_label int, prediction_probability double")


@pytest.fixture
def some(spark):
    counts = {(0, 0): 50, (0, 1): 10, (1, 0): 5, (1, 1): 35}
    return pairs(spark, [(t, p, 0.5) for (t, p), n in counts.items() for _ in range(n)])


def test_confusion_and_metrics(some):
    row = V.confusion_matrix(some).first()
    assert (row["tn"], row["fp"], row["fn"], row["tp"]) == (50, 10, 5, 35)
    assert (row["false_alert_percentage"], row["missed_percentage"]) == (10.0, 5.0)
    row = V.classification_metrics(some).first()
    assert row["accuracy"] == 0.85
    assert row["precision"] == pytest.approx(35 / 45, abs=1e-6)
    assert row["recall"] == pytest.approx(35 / 40, abs=1e-6)
    assert row["f1_score"] == pytest.approx(70 / 85, abs=1e-6)
    weighted = V.classification_metrics(some, "weighted").first()
    assert weighted["precision"] == pytest.approx((50 / 55 * 60 + 35 / 45 * 40) / 100, abs=1e-6)
    assert weighted["recall"] == weighted["accuracy"]
    with pytest.raises(ValueError):
        V.classification_metrics(some, "micro")


def test_weights_stand_for_rows(some):
    counted = some.groupBy("true_label", "predicted_label").agg(F.count("*").alias("n"))
    for build in (V.confusion_matrix, V.prediction_summary, V.classification_report, V.classification_metrics):
        assert sorted(map(tuple, build(some).collect())) == sorted(map(tuple, build(counted, weight="n").collect()))


def test_zero_denominators_give_zero(spark):
    row = V.classification_metrics(pairs(spark, [(0, 0, 0.1), (1, 0, 0.2)])).first()
    assert (row["precision"], row["recall"], row["f1_score"]) == (0, 0, 0)
    empty = V.classification_metrics(pairs(spark, [])).first()
    assert empty["accuracy"] == 0


def test_report_and_gate(some):
    rows = {r["class"]: r for r in V.classification_report(some).collect()}
    assert set(rows) == {"0", "1", "macro avg", "weighted avg"}
    assert rows["macro avg"]["recall"] == pytest.approx((50 / 60 + 35 / 40) / 2, abs=1e-6)
    gate = {r["metric"]: r for r in V.model_gate(V.classification_metrics(some)).collect()}
    assert gate["accuracy"]["passed"] and not gate["recall"]["enforced"]
    strict = V.model_gate(V.classification_metrics(some), {"accuracy": 0.9})
    assert not strict.where("metric = 'accuracy'").first()["passed"]


@pytest.mark.parametrize("digits", [1, 9])
def test_auc_equals_counting_pairs(spark, digits):
    rng = random.Random(2)
    rows = [(rng.randint(0, 1), 0, round(rng.random(), digits)) for _ in range(250)]
    up, down = [p for t, _, p in rows if t], [p for t, _, p in rows if not t]
    expected = sum((a > b) + 0.5 * (a == b) for a in up for b in down) / (len(up) * len(down))
    assert V.roc_auc(pairs(spark, rows).repartition(6)).first()["roc_auc"] == pytest.approx(expected, abs=1e-9)


def test_auc_without_one_class(spark):
    assert V.roc_auc(pairs(spark, [(1, 1, 0.3), (1, 1, 0.4)])).first()["roc_auc"] is None


def test_overfit_gap(spark, some):
    perfect = pairs(spark, [(0, 0, 0.1), (1, 1, 0.9)])
    gaps = {r["metric"]: r for r in V.overfit_gap(perfect, some).collect()}
    assert gaps["accuracy"]["gap"] == 0.15 and not gaps["accuracy"]["passed"]


# --- models --------------------------------------------------------------------

@pytest.fixture(scope="module")
def separable(spark):
    return spark.range(600).select(
        "id", (F.col("id") % 2).cast("int").alias("y"), ((F.col("id") % 2) * 3 + F.col("id") % 5 / 10).alias("signal"),
        (F.col("id") % 7).cast("double").alias("noise"),
    )


@pytest.mark.parametrize(
    "build", [lambda: L.random_forest(trees=5, depth=3), lambda: L.gradient_boosting(iterations=3), lambda: L.logistic(50)]
)
def test_models_learn_score_and_explain(spark, separable, build):
    model = L.train(separable, build(), ["signal", "noise"], "y")
    scored = L.batch_score(model, separable, ["id", "y"], "b7", dt.datetime(2024, 1, 1))
    assert scored.where("prediction = y").count() == 600
    assert scored.where("probability < 0 OR probability > 1").count() == 0
    row = scored.orderBy("id").first()
    assert (row["status"], row["batch_id"], row["scored_at"]) == ("Retain", "b7", dt.datetime(2024, 1, 1))
    importance = L.feature_importance(spark, model)
    assert L.top_features(importance, 1).first()["feature"] == "signal" and importance.count() == 2


def test_assembling_skips_incomplete_rows(spark):
    df = spark.createDataFrame([(1, 1.0, 0), (2, None, 1), (3, float("nan"), 1)], "id int, x double, y int")
    assert [r["id"] for r in L.assemble_features(df, ["x"], "y", keep=["id"]).collect()] == [1]


def test_model_versions(spark, separable, tmp_path):
    root = str(tmp_path)
    for version, iterations in (("20240101000000", 1), ("20240201000000", 50)):
        L.save_model(L.train(separable, L.logistic(iterations), ["signal", "noise"], "y"), root, version)
    newest = L.batch_score(L.load_model(spark, root), separable, ["y"], "b", dt.datetime(2024, 1, 1))
    assert newest.where("prediction = y").count() == 600
    assert len(L.load_model(spark, root, "20240101000000").stages) == 2
    with pytest.raises(FileNotFoundError):
        L.load_model(spark, root + "/nothing")


def test_own_model_in_arrow_batches(spark, separable):
    def predict(batches):
        for b in batches:
            yield b[["id"]].assign(probability=(b["signal"] > 1).astype(float))

    scored = L.score_with(separable.select("id", "signal"), predict, "id long, probability double")
    assert scored.where("probability = 1").count() == 300


def test_rows_with_a_missing_feature_come_out_unscored(spark):
    from tidewatch.operators import learning as L

    rows = [(i, float(i % 2), float(i), i % 2) for i in range(40)]
    train = spark.createDataFrame(rows, "id long, a double, b double, y int")
    for learner in (L.logistic(50), L.random_forest(5, 3)):
        model = L.train(train, learner, ["a", "b"], "y")
        asked = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 2.0), (3, 1.0, float("nan"))], "id long, a double, b double")
        found = {r.id: r for r in L.batch_score(model, asked, ["id"], "b", dt.datetime(2024, 1, 1)).collect()}
        assert sorted(found) == [1, 2, 3] and found[1].prediction == 1
        assert all(found[i][c] is None for i in (2, 3) for c in ("prediction", "probability", "status", "confidence"))
