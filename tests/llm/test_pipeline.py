"""Each stage against a plain version on its own input; the run against its stages."""

from types import SimpleNamespace

import pytest

import corpus_pipeline as P
from tests.llm import test_decontaminate, test_ngram_join, test_packing, test_secrets


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    """The rows that enter the first stage, and those that each stage returns."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    extra = docs.limit(2).selectExpr("doc_id + 900000 AS doc_id", "concat(text, ' Idiot') AS text", "lang", "source", "n_chars")
    none = docs.limit(1).selectExpr("900100L AS doc_id", "CAST(null AS STRING) AS text", "lang", "source", "n_chars")
    docs = docs.unionByName(extra).unionByName(none)
    found = [docs.collect()]
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        result = stage(spark, docs, folder)
        assert name == "packing" or result.columns == P.COLUMNS
        result.write.parquet(path)
        docs = spark.read.parquet(path)
        found.append(docs.collect())
    return found


def pairs(rows):
    return [(r.doc_id, r.text) for r in rows]


def test_toxic_documents_go_and_others_stay(spark, folder, stages):
    before, after = {r.doc_id: r for r in stages[0]}, {r.doc_id: r for r in stages[1]}
    assert all(after[k] == before[k] for k in after)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    clean = [k for k, toxic in labels.items() if not toxic]
    assert sum(k in after for k in clean) >= 0.95 * len(clean)


def test_one_of_each_group_stays(stages):
    rows = pairs(stages[1])
    kept = {(key, text) for (key, text), mark in zip(rows, test_ngram_join.brute(rows), strict=True) if mark[-1]}
    assert set(pairs(stages[2])) == kept


def test_contaminated_documents_go(spark, folder, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    clean = [r for r in pairs(stages[2]) if not test_decontaminate.brute(r[1], items, 10)[-1]]
    assert sorted(pairs(stages[3])) == sorted(clean) and len(clean) < len(stages[2])


def test_secrets_are_replaced(stages):
    after = {r.doc_id: r for r in stages[4]}
    assert len(after) == len(stages[3])
    for r in stages[3]:
        found = sorted(test_secrets.base(r.text) + test_secrets.linked(r.text))
        out, at = [], 0
        for start, _, _, end in found:
            if start >= at:
                out += [r.text[at:start], "[SECRET]"]
            at = max(at, end)
        text = "".join(out) + r.text[at:] if found else r.text
        assert (after[r.doc_id].text, after[r.doc_id].n_chars) == (text, len(text) if found else r.n_chars)


def test_all_is_packed(stages):
    test_packing.check(stages[5], dict(pairs(stages[4])))


def test_run_and_empty_table(spark, folder, tmp_path):
    found = P.run(spark, folder)
    assert found.count() > 0 and "sequence_id" in found.columns
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


def test_names():
    assert [n for n, _ in P.STAGES] == ["toxicity", "ngram_join", "decontaminate", "secrets", "packing"]
    assert SimpleNamespace(sql=P.ORACLE_SQL).sql is None
