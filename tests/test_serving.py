"""Preprocessing and models that are stored once and serve without fitting."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tests.test_streams import Topic, message
from tests.util import spark_rows
from tidewatch import schemas
from tidewatch.operators import learning as L
from tidewatch.operators import serving as V
from tidewatch.sources import keyed as K
from tidewatch.streaming import jobs as J

NOMINAL, SCALED = ["Geography", "Gender"], ["Balance", "EstimatedSalary", "Age"]


def customers(spark, n=200, shift=0):
    rows = [
        (i, 400 + 7 * i % 450, ["ASIA", "EUROPE"][i % 2], ["Male", "Female"][i // 2 % 2], 20 + i % 50, i % 11, float(i), 1 + i % 4, i % 2, i % 3 % 2,
         10.0 * i, int((i + shift) % 5 == 0))
        for i in range(n)
    ]
    return spark.createDataFrame(
        rows, "CustomerId bigint, CreditScore int, Geography string, Gender string, Age int, Tenure int, Balance double, "
        "NumOfProducts int, HasCrCard int, IsActiveMember int, EstimatedSalary double, Exited int"
    )


def test_nothing_is_fitted_when_serving(spark, tmp_path):
    L.save_model(V.fit_preprocessing(customers(spark), NOMINAL, SCALED), str(tmp_path), "20240101000000", "20231231000000", 200)
    model = L.load_model(spark, str(tmp_path))
    one = customers(spark).where("CustomerId = 3").drop("Exited")
    alone, among = V.preprocess(model, one, ["CustomerId"]), V.preprocess(model, customers(spark), ["CustomerId"]).where("CustomerId = 3")
    assert spark_rows(alone) == spark_rows(among)
    row = alone.first()
    assert (row["Balance"], row["Geography_EUROPE"], row["Geography_ASIA"]) == (3 / 199, 1, 0)
    (kept,) = L.lineage(spark, str(tmp_path)).collect()
    assert tuple(kept) == ("20240101000000", "20231231000000", 5, "Aligned", 200)


def test_rows_unlike_the_training_rows(spark):
    model = V.fit_preprocessing(customers(spark), NOMINAL, SCALED)
    base = customers(spark).where("CustomerId = 3").drop("Exited", "Tenure")
    odd = base.withColumns({"CreditScore": F.lit(None).cast("int"), "Geography": F.lit("MARS"), "Gender": F.lit(None).cast("string"), "Extra": F.lit(1)})
    row = V.preprocess(model, odd, ["Extra"]).first()
    assert (row["CreditScoreBins"], row["CreditScore"], row["Tenure"], row["Extra"]) == (2, None, 0, 1)
    assert [row[c] for c in ("Geography_ASIA", "Geography_EUROPE", "Gender_Female", "Gender_Male")] == [0, 0, 0, 0]


@pytest.mark.parametrize("build", [lambda: L.logistic(iterations=20), lambda: L.random_forest(trees=5, depth=4)])
def test_model_and_preprocessing_are_one(spark, tmp_path, build):
    model = V.fit_serving(customers(spark), build(), "Exited", NOMINAL, SCALED)
    L.save_model(model, str(tmp_path), "20240101000000")
    again = L.load_model(spark, str(tmp_path))
    rows = customers(spark, 300).drop("Exited").withColumn("Age", F.when(F.col("CustomerId") != 5, F.col("Age")))
    found = V.serve(again, rows)
    assert found.columns == [*rows.columns, "probability", "prediction"]
    assert spark_rows(found) == spark_rows(V.serve(model, rows))
    by_key = {r["CustomerId"]: r for r in found.collect()}
    assert by_key[5]["probability"] is None and by_key[5]["prediction"] is None and len(by_key) == 300
    assert all(0 <= r["probability"] <= 1 and r["prediction"] == int(r["probability"] > 0.5) for k, r in by_key.items() if k != 5)


def test_a_version_saved_meanwhile_scores_the_next_batch(spark, tmp_path):
    topic, models = Topic(spark, tmp_path), str(tmp_path / "store")
    scorer = J.StoredModel(spark, models)
    with pytest.raises(FileNotFoundError):
        scorer.refresh()

    def save(version, shift):
        train = customers(spark, shift=shift)
        L.save_model(V.fit_serving(train, L.logistic(iterations=20), "Exited", NOMINAL, SCALED), models, version)

    def run():
        events = topic.events()
        J.run_available(J.scoring_job(events, scorer, f"{tmp_path}/table", f"{tmp_path}/out", f"{tmp_path}/scoring"))
        rows = K.read_table(spark, f"{tmp_path}/table", spark.createDataFrame([], schemas.PREDICTIONS)).collect()
        return {r["event_id"]: r for r in rows}

    save("20240101000000", 0)
    topic.put(*[message(f"a{i}", 1, customer=i, CreditScore=500 + i, Balance=float(i)) for i in range(20)])
    first = run()
    assert {r["model_version"] for r in first.values()} == {"20240101000000"}
    save("20240201000000", 2)
    topic.put(*[message(f"b{i}", 2, customer=i, CreditScore=500 + i, Balance=float(i)) for i in range(20)], message("a1", 1, customer=1, CreditScore=501, Balance=1.0))
    second = run()
    assert {k: r["model_version"] for k, r in second.items()} == {
        **{f"a{i}": "20240101000000" for i in range(20)}, **{f"b{i}": "20240201000000" for i in range(20)}
    }
    # The same events in batch, by the same stored models.
    parsed = J.events(J.parse(spark.read.schema(schemas.MESSAGE).json(f"{tmp_path}/topic")))
    for version, prefix in (("20240101000000", "a"), ("20240201000000", "b")):
        batch = V.serve(L.load_model(spark, models, version), parsed.where(F.col("event_id").startswith(prefix)).dropDuplicates(["event_id"]))
        for r in batch.collect():
            assert second[r["event_id"]]["probability"] == pytest.approx(r["probability"], abs=1e-12)
    assert isinstance(second["a1"]["predicted_at"], dt.datetime) and json.dumps(sorted(second))
