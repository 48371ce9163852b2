import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from tests.util import column, spark_rows
from tidewatch import schemas
from tidewatch.sources import keyed as K
from tidewatch.sources import keyfilter
from tidewatch.sources import readers as RD
from tidewatch.sources import views as VW
from tidewatch.sources import writers as WR


# --- files ---------------------------------------------------------------------

def test_csv_conventions(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id, name ,x\n1, Ann ,1.5\n2,"Lee, ""Bo""",NaN\n3,,\n')
    rows = RD.read_csv(spark, str(path), "id int, name string, x double").orderBy("id").collect()
    assert [r["name"] for r in rows] == ["Ann", 'Lee, "Bo"', None]
    assert rows[0]["x"] == 1.5 and rows[1]["x"] != rows[1]["x"] and rows[2]["x"] is None


def test_csv_inference_is_opt_in(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("id,x\n1,2.5\n")
    assert [f.dataType.simpleString() for f in RD.read_csv(spark, str(path), None).schema] == ["int", "double"]


def test_bad_paths_and_extensions(spark, tmp_path):
    with pytest.raises(Exception):
        RD.read_csv(spark, str(tmp_path / "missing.csv"), "id int").collect()
    with pytest.raises(ValueError):
        RD.scan_by_extension(spark, "table.xlsx")
    assert RD.spark_path("s3://bucket/key") == "s3a://bucket/key"


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,\"b\"", 1.5), (2, None, None)], "id int, s string, x double")
    for fmt in ("csv", "json", "parquet", "orc"):
        WR.save_table(df, f"{tmp_path}/t.{fmt}", fmt)
        assert spark_rows(RD.load_table(spark, f"{tmp_path}/t.{fmt}", fmt, df.schema)) == spark_rows(df)


def test_json_arrays(spark, tmp_path):
    (tmp_path / "whole.json").write_text('[\n {"id": 1},\n {"id": 2, "s": "x"}\n]')
    whole = RD.read_json_records(spark, str(tmp_path / "whole.json"), "id int, s string", whole_file=True)
    assert spark_rows(whole) == [("1.0", "null"), ("2.0", "x")]
    WR.write_json_arrays(whole, f"{tmp_path}/lines", F.lit(0))
    assert spark_rows(RD.read_json_records(spark, f"{tmp_path}/lines", "id int, s string")) == spark_rows(whole)


def test_json_arrays_stay_small(spark, tmp_path):
    rows = spark.range(3000).select(F.lit(1).alias("id"), F.lit("same").alias("s"))
    WR.write_json_arrays(rows, f"{tmp_path}/lines", F.lit(None).cast("int"), most=100)
    lines = [json.loads(r["value"]) for r in spark.read.text(f"{tmp_path}/lines").collect()]
    assert sum(map(len, lines)) == 3000 and max(map(len, lines)) < 200


def test_database_options():
    assert RD.jdbc_options("jdbc:x", table="t") == {"url": "jdbc:x", "dbtable": "t", "fetchsize": "10000"}
    assert RD.jdbc_options("jdbc:x", query="SELECT 1", user="u")["query"] == "SELECT 1"
    split = RD.jdbc_options("jdbc:x", query="SELECT * FROM t", partition_column="day", bounds=(dt.date(2024, 1, 1), dt.date(2024, 2, 1)), partitions=8)
    assert split["dbtable"] == "(SELECT * FROM t) AS source" and "query" not in split
    assert (split["lowerBound"], split["upperBound"], split["numPartitions"]) == ("2024-01-01", "2024-02-01", "8")
    for wrong in ({}, {"table": "t", "query": "q"}, {"table": "t", "partitions": 4}, {"table": "t", "partition_column": "a", "bounds": (5, 5), "partitions": 2}):
        with pytest.raises(ValueError):
            RD.jdbc_options("jdbc:x", **wrong)


def test_day_predicates_cut_without_loss(spark):
    parts = RD.day_predicates("day", [dt.date(2024, 1, 1), dt.date(2024, 1, 5)])
    days = [None, "2023-12-31", "2024-01-01", "2024-01-04", "2024-01-05", "2025-01-01"]
    rows = spark.createDataFrame([(d,) for d in days], "d string").select(F.col("d").cast("date").alias("day"))
    assert [rows.where(p).count() for p in parts] == [2, 2, 2]
    with pytest.raises(ValueError):
        RD.day_predicates("day", [dt.date(2024, 1, 5), dt.date(2024, 1, 1)])


def test_prefer_parquet(spark, tmp_path):
    one, two = (spark.createDataFrame([(i,)], "id int") for i in (1, 2))
    WR.save_table(one, f"{tmp_path}/t.csv", "csv")
    assert column(RD.read_prefer_parquet(spark, f"{tmp_path}/t", "id int"), "id") == [1]
    WR.save_table(two, f"{tmp_path}/t.parquet", "parquet")
    assert column(RD.read_prefer_parquet(spark, f"{tmp_path}/t", "id int"), "id") == [2]


def test_versions(spark, tmp_path):
    root, df = str(tmp_path), spark.createDataFrame([(1,)], "id int")
    assert RD.list_versions(spark, root, "d") == []
    for v in ("20240201000000", "20231231235959"):
        WR.write_version(df.withColumn("v", F.lit(v)), root, "d", v)
    (tmp_path / "d" / "run_ts=scratch").mkdir()
    assert RD.list_versions(spark, root, "d") == ["20231231235959", "20240201000000"]
    latest = RD.read_latest(spark, root, ["d", "absent"])
    assert set(latest) == {"d"} and column(latest["d"], "v") == ["20240201000000"]
    with pytest.raises(ValueError):
        WR.write_version(df, root, "d", "today")
    with pytest.raises(Exception):
        WR.write_version(df, root, "d", "20240201000000")


def test_reports_skip_empty_ones(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "id int")
    paths = WR.export_reports({"full": df, "empty": df.limit(0)}, str(tmp_path), "s")
    assert [p.rsplit("/", 1)[1] for p in paths] == ["full_s"]


def test_sql_source_raises(spark):
    with pytest.raises(Exception):
        RD.sql_source(spark, "SELECT * FROM no_such_table").collect()


# --- keyed writes --------------------------------------------------------------

def rows_of(spark, rows):
    return spark.createDataFrame([(k, dt.datetime(2024, 1, d, h), v) for k, d, h, v in rows], "k string, at timestamp_ntz, v int")


def test_insert_keeps_the_first(spark):
    table = rows_of(spark, [("a", 1, 0, 1)])
    batch = rows_of(spark, [("a", 1, 1, 9), ("b", 1, 5, 3), ("b", 1, 4, 2), (None, 1, 0, 7), (None, 1, 0, 8)])
    got = K.insert_if_absent(table, batch, ["k"], ["at"])
    assert sorted((str(r["k"]), r["v"]) for r in got.collect()) == [("None", 7), ("None", 8), ("a", 1), ("b", 2)]


def test_upsert_keeps_the_last(spark):
    table = rows_of(spark, [("a", 1, 0, 1), ("c", 1, 0, 4), (None, 1, 0, 5)])
    batch = rows_of(spark, [("a", 1, 1, 2), ("a", 1, 2, 3), ("b", 1, 0, 6), (None, 1, 0, 7)])
    got = K.upsert(table, batch, ["k"], ["at"])
    assert sorted((str(r["k"]), r["v"]) for r in got.collect()) == [("None", 5), ("None", 7), ("a", 3), ("b", 6), ("c", 4)]


def test_insert_table_is_idempotent(spark, tmp_path):
    path = f"{tmp_path}/t"
    for batch in ([("a", 1, 0, 1), ("b", 2, 0, 2)], [("b", 2, 0, 2), ("c", 2, 1, 3)], [("c", 2, 1, 3)]):
        K.insert_table(spark, path, rows_of(spark, batch), ["k"], ["at"], "at")
    like = rows_of(spark, [])
    assert column(K.read_table(spark, path, like), "k", "k") == ["a", "b", "c"]


def timed(spark, rows):
    return spark.createDataFrame(rows, "k string, at timestamp_ntz, v int")


def test_a_key_is_known_on_any_day_and_without_one(spark, tmp_path):
    path = f"{tmp_path}/t"
    late, early = dt.datetime(2024, 1, 1, 23, 59), dt.datetime(2024, 1, 2, 0, 1)
    for batch in ([("a", late, 1), (None, late, 5)], [("a", early, 2), ("b", None, 3)], [("b", None, 4)], [("b", late, 6), ("a", None, 7)]):
        K.insert_table(spark, path, timed(spark, batch), ["k"], ["at"], "at")
    got = K.read_table(spark, path, timed(spark, [])).collect()
    assert sorted((str(r["k"]), r["v"]) for r in got) == [("None", 5), ("a", 1), ("b", 3)]


def test_upsert_table_replaces_rows_without_a_time(spark, tmp_path):
    path = f"{tmp_path}/t"
    for value in (1, 1, 2):
        K.upsert_table(spark, path, timed(spark, [("a", None, value)]), ["k"], ["at"], "at")
    assert [tuple(r) for r in K.read_table(spark, path, timed(spark, [])).collect()] == [("a", None, 2)]
    K.insert_table(spark, path, timed(spark, [("a", dt.datetime(2024, 1, 1), 9)]), ["k"], ["at"], "at")
    assert K.read_table(spark, path, timed(spark, [])).count() == 1


def test_days_that_cannot_hold_a_key_stay_unread(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = [(f"{d}-{i}", dt.datetime(2024, 1, d, i % 24), i) for d in range(1, 11) for i in range(300)]
    K.append_table(timed(spark, rows), path, "at")  # before there are filters: the first insert builds them
    K.insert_table(spark, path, timed(spark, [("new", dt.datetime(2024, 1, 11), 1)]), ["k"], ["at"], "at")
    batch = timed(spark, [("3-7", dt.datetime(2024, 2, 1), 1), ("7-299", None, 1), ("new", dt.datetime(2024, 1, 1), 1)])
    days = set(map(str, keyfilter.days_with(spark, path, batch, ["k"])))
    assert {"2024-01-03", "2024-01-07", "2024-01-11"} <= days and len(days) <= 5
    # The scan's partition filter names these days and no other; the rest of a row stays unread too.
    plan = K.known_rows(spark, path, batch, ["k"], "at")._jdf.queryExecution().executedPlan().toString()
    (filters,) = re.findall(r"PartitionFilters: \[(.*)\], PushedFilters", plan)
    assert set(re.findall(r"2024-\d\d-\d\d", filters)) == days and "ReadSchema: struct<k:string>" in plan
    K.insert_table(spark, path, batch, ["k"], ["at"], "at")
    assert K.read_table(spark, path, timed(spark, [])).count() == 3001
    none = timed(spark, [("absent", dt.datetime(2024, 1, 1), 1)])
    assert len(keyfilter.days_with(spark, path, none, ["k"])) <= 2


def test_filters_learn_from_every_write(spark, tmp_path):
    path, day = f"{tmp_path}/t", dt.datetime(2024, 1, 3)
    K.insert_table(spark, path, timed(spark, [("a", day, 1)]), ["k"], ["at"], "at")
    K.append_table(timed(spark, [("b", day, 1)]), path, "at")
    K.upsert_table(spark, path, timed(spark, [("c", day, 1)]), ["k"], ["at"], "at", compare=False)
    K.upsert_table(spark, path, timed(spark, [("d", None, 1)]), ["k"], ["at"], "at")
    K.insert_table(spark, path, timed(spark, [(k, None, 2) for k in "abcde"]), ["k"], ["at"], "at")
    got = K.read_table(spark, path, timed(spark, [])).orderBy("k").collect()
    assert [(r["k"], r["v"]) for r in got] == [("a", 1), ("b", 1), ("c", 1), ("d", 1), ("e", 2)]


def test_keys_of_a_hot_day_and_of_two_columns(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = spark.range(20000).selectExpr("CAST(id % 100 AS STRING) AS k", "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS at", "CAST(id AS INT) AS v")
    for _ in range(2):
        K.insert_table(spark, path, rows, ["k", "v"], ["at"], "at")
    assert K.read_table(spark, path, rows).count() == 20000


def test_no_work_copies_stay(spark, tmp_path, monkeypatch):
    from tidewatch import session

    monkeypatch.setattr(session, "work_folder", lambda spark, purpose: f"{tmp_path}/work/{purpose}")
    path = f"{tmp_path}/t"
    K.insert_table(spark, path, rows_of(spark, [("a", 1, 0, 1)]), ["k"], ["at"], "at")
    K.upsert_table(spark, path, rows_of(spark, [("a", 1, 0, 2)]), ["k"], ["at"], "at")
    K.archive_table(spark, path, f"{tmp_path}/old", dt.datetime(2024, 1, 5), ["k"], "at", rows_of(spark, []))
    assert not list((tmp_path / "work").iterdir())
    assert not (tmp_path / "t_kept").exists()


def test_upsert_table_touches_only_its_days(spark, tmp_path):
    path = f"{tmp_path}/t"
    K.append_table(rows_of(spark, [("a", 1, 0, 1), ("b", 2, 0, 2), ("c", 2, 3, 3)]), path, "at")
    untouched = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "t" / "predicted_date=2024-01-01").iterdir()}
    for _ in range(2):
        K.upsert_table(spark, path, rows_of(spark, [("b", 2, 0, 20), ("d", 3, 0, 4)]), ["k"], ["at"], "at")
        got = K.read_table(spark, path, rows_of(spark, []))
        assert [(r["k"], r["v"]) for r in got.orderBy("k").collect()] == [("a", 1), ("b", 20), ("c", 3), ("d", 4)]
    assert untouched == {p.name: p.stat().st_mtime_ns for p in (tmp_path / "t" / "predicted_date=2024-01-01").iterdir()}
    K.upsert_table(spark, path, rows_of(spark, []), ["k"], ["at"], "at")
    assert K.read_table(spark, path, rows_of(spark, [])).count() == 4


def test_upsert_table_writes_only_what_changes(spark, tmp_path):
    path, like = f"{tmp_path}/t", rows_of(spark, [])

    def files(day):
        folder = tmp_path / "t" / f"predicted_date=2024-01-0{day}"
        return {p.name for p in folder.iterdir() if p.suffix == ".parquet"}

    batch = [("a", 1, 0, 1), ("b", 2, 0, 2)]
    K.upsert_table(spark, path, rows_of(spark, batch), ["k"], ["at"], "at")
    first = files(1), files(2)
    K.upsert_table(spark, path, rows_of(spark, batch), ["k"], ["at"], "at")
    assert (files(1), files(2)) == first
    K.upsert_table(spark, path, rows_of(spark, [("c", 1, 5, 3), ("b", 2, 0, 9)]), ["k"], ["at"], "at")
    assert files(1) > first[0] and not files(2) & first[1]
    assert [(r["k"], r["v"]) for r in K.read_table(spark, path, like).orderBy("k").collect()] == [("a", 1), ("b", 9), ("c", 3)]
    K.upsert_table(spark, path, rows_of(spark, [("b", 2, 0, None)]), ["k"], ["at"], "at")
    assert K.read_table(spark, path, like).where("k = 'b'").first()["v"] is None


def test_archive(spark, tmp_path):
    live, old, like = f"{tmp_path}/live", f"{tmp_path}/old", rows_of(spark, [])
    K.append_table(rows_of(spark, [("a", 1, 0, 1), ("b", 2, 5, 2), ("c", 2, 6, 3), ("d", 3, 0, 4)]), live, "at")
    cutoff = dt.datetime(2024, 1, 2, 6)
    for _ in range(2):
        K.archive_table(spark, live, old, cutoff, ["k"], "at", like)
        assert column(K.read_table(spark, live, like), "k", "k") == ["c", "d"]
        assert column(K.read_table(spark, old, like), "k", "k") == ["a", "b"]


def test_archive_completes_an_interrupted_run(spark, tmp_path):
    live, old, like = f"{tmp_path}/live", f"{tmp_path}/old", rows_of(spark, [])
    K.append_table(rows_of(spark, [("a", 1, 0, 1), ("b", 1, 1, 2), ("c", 3, 0, 3)]), live, "at")
    K.append_table(rows_of(spark, [("a", 1, 0, 1)]), old, "at")  # copied, not yet deleted
    K.archive_table(spark, live, old, dt.datetime(2024, 1, 2), ["k"], "at", like)
    assert column(K.read_table(spark, live, like), "k") == ["c"]
    assert column(K.read_table(spark, old, like), "k", "k") == ["a", "b"]


def test_archive_keeps_what_arrives_meanwhile(spark, tmp_path, monkeypatch):
    live, old, like = f"{tmp_path}/live", f"{tmp_path}/old", rows_of(spark, [])
    K.append_table(rows_of(spark, [("a", 1, 0, 1), ("b", 2, 5, 2), ("c", 2, 9, 3)]), live, "at")
    real = K.insert_table

    def late(*args):
        real(*args)
        K.append_table(rows_of(spark, [("x", 1, 3, 1), ("y", 2, 4, 2)]), live, "at")

    monkeypatch.setattr(K, "insert_table", late)
    K.archive_table(spark, live, old, dt.datetime(2024, 1, 2, 6), ["k"], "at", like)
    monkeypatch.undo()
    assert column(K.read_table(spark, live, like), "k", "k") == ["c", "x", "y"]
    K.archive_table(spark, live, old, dt.datetime(2024, 1, 2, 6), ["k"], "at", like)
    assert column(K.read_table(spark, live, like), "k", "k") == ["c"]
    assert column(K.read_table(spark, old, like), "k", "k") == ["a", "b", "x", "y"]


@pytest.mark.parametrize("steps", [0, 1, 2])
def test_archive_killed_in_the_swap(spark, tmp_path, monkeypatch, steps):
    live, old, like = f"{tmp_path}/live table", f"{tmp_path}/old", rows_of(spark, [])
    K.append_table(rows_of(spark, [("a", 1, 0, 1), ("b", 2, 5, 2), ("c", 2, 9, 3)]), live, "at")
    real, calls = K._finish_swap, []

    def killed(*args):
        calls.append(1)
        if len(calls) == 2:
            if steps:  # some files are gone, some came back
                plan = json.loads((tmp_path / "live table" / K.SWAP).read_text())
                for name in plan["old"][:steps]:
                    _, fs = K._file_system(spark, name)
                    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(name), False)
            raise RuntimeError("killed")
        real(*args)

    monkeypatch.setattr(K, "_finish_swap", killed)
    with pytest.raises(RuntimeError):
        K.archive_table(spark, live, old, dt.datetime(2024, 1, 2, 6), ["k"], "at", like)
    monkeypatch.undo()
    K.archive_table(spark, live, old, dt.datetime(2024, 1, 2, 6), ["k"], "at", like)
    assert column(K.read_table(spark, live, like), "k", "k") == ["c"]
    assert column(K.read_table(spark, old, like), "k", "k") == ["a", "b"]


def test_tables_and_layout(spark, tmp_path):
    tables = VW.create_tables(spark, str(tmp_path))
    assert {n: len(t.schema.fields) for n, t in tables.items()} == {
        "churn_predictions": 16, "churn_metrics_hourly": 9, "churn_metrics_daily": 9, "high_risk_customers": 9,
        "churn_predictions_archive": 16,
    }
    alert = spark.createDataFrame([("7", 0.9, dt.datetime(2024, 1, 5, 3))], "customer_id string, risk_score double, detected_at timestamp_ntz")
    for c in schemas.ALERTS.fieldNames():
        if c not in alert.columns:
            alert = alert.withColumn(c, F.lit(None))
    VW.load(alert, tables["high_risk_customers"])
    assert VW.read(spark, tables["high_risk_customers"]).count() == 1
    assert (tmp_path / "high_risk_customers" / "predicted_date=2024-01-05").exists()
