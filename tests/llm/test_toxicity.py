"""The chain: held-out quality, out-of-fold training, order of categories, edge rows."""

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import toxicity
from tidewatch.llm.queries import QUERIES
from tidewatch.llm.settings import CATEGORIES


@pytest.fixture(scope="module")
def tables(spark):
    data = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    return docs, spark.read.parquet(f"{data}/labels.parquet")


def test_held_out_labels(spark, tables):
    docs, labels = tables
    held = F.expr("pmod(xxhash64(doc_id, 5), 4) = 0")
    chain = toxicity.train(
        toxicity.training_rows(docs, labels.where(~held), CATEGORIES, "doc_id", "text"), CATEGORIES
    )
    found = chain.score(docs.join(labels.where(held), "doc_id")).groupBy("toxic", "is_toxic").count().collect()
    counts = {(r.toxic, r.is_toxic): r["count"] for r in found}
    hit, missed, wrong = (counts.get(k, 0) for k in ((1, True), (1, False), (0, True)))
    assert hit / (hit + missed) > 0.85 and hit / (hit + wrong) > 0.85
    assert chain.models[1].numFeatures == chain.models[0].numFeatures + 1


def test_query_has_every_document(spark, folder):
    found = QUERIES["op7_toxicity"](spark, folder)
    assert found.columns == ["doc_id", "p_quality", "p_toxic", "is_quality", "is_toxic"]
    assert found.count() == spark.read.parquet(f"{folder}/documents.parquet").count()


def sample(spark, n=60):
    rows = [(i, f"{'vile' if i % 3 == 0 else ''} w{i % 7} {'loud' if i % 2 else 'calm'}", i % 2, int(i % 3 == 0)) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, loud int, vile int")


def test_later_category_uses_out_of_fold_probabilities(spark):
    rows = sample(spark).withColumn("both", (F.col("loud") * F.col("vile")).cast("int"))
    chain = toxicity.train(rows, ["loud", "vile", "both"], penalty=0.01)
    assert [m.numFeatures - chain.models[0].numFeatures for m in chain.models] == [0, 1, 2]
    docs = spark.createDataFrame([(1, "vile words, loud"), (2, "kind and calm")], "doc_id long, text string")
    found = {r.doc_id: r for r in chain.score(docs).collect()}
    assert found[1].is_loud and found[1].is_vile and not found[2].is_loud and not found[2].is_vile
    assert found[1].p_both > found[2].p_both


def test_edge_rows(spark):
    chain = toxicity.train(sample(spark), ["loud", "vile"], penalty=0.01)
    texts = [None, "", "  ", "vile " * 50_000, "é漢字", "VILE"]
    docs = spark.createDataFrame([(i, t, 0.5, "x") for i, t in enumerate(texts)] + [(None, "vile", 0.5, "x")] * 2,
                                 "doc_id long, text string, p_other double, words string")
    found = chain.score(docs)
    assert found.columns[:4] == docs.columns and found.count() == 8
    assert {r.doc_id for r in found.where("is_vile").collect()} == {3, 5, None}
    assert chain.score(docs.limit(0)).count() == 0


def test_labels_without_use(spark):
    docs = sample(spark).select("doc_id", "text")
    labels = spark.createDataFrame(
        [(1, None, 1), (None, 1, 1), (2, 7, 0), (3, 0, 1), (3, 1, 0), (999, 1, 1)], "doc_id long, loud int, vile int"
    )
    rows = toxicity.training_rows(docs, labels, ["loud", "vile"], "doc_id", "text")
    assert [(r.doc_id, r.loud, r.vile) for r in rows.collect()] == [(3, 1, 1)]
    chain = toxicity.train(rows, ["loud", "vile"])
    assert chain.score(docs).where("is_loud OR is_vile").count() == 0
    none = toxicity.train(rows.limit(0), ["loud", "vile"])
    assert none.score(docs).where("is_loud OR is_vile").count() == 0
    many = toxicity.training_rows(docs.unionAll(docs), sample(spark).drop("text"), ["loud"], "doc_id", "text", sample=10)
    assert many.count() == 10
