import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tests.util import spark_rows
from tidewatch import schemas
from tidewatch.functions.expr import naive, utc_clock, utc_instant
from tidewatch.catalog import streams as C
from tidewatch.operators import reports as R
from tidewatch.plans.fixtures import predictions
from tidewatch.sources import keyed as K
from tidewatch.streaming import jobs as J
from tidewatch.streaming import messages as MSG
from tidewatch.streaming import outbox as OUT
from tidewatch.streaming import progress as PROGRESS
from tidewatch.streaming import rolluplog as LOG


def message(event_id, hour, customer=1, amount=20.0, minute=0, **extra):
    at = dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour, minutes=minute)
    data = {"CustomerId": customer, "EstimatedSalary": amount, "Geography": "ASIA", "Age": 30, **extra}
    if event_id is not None:
        data["event_id"] = event_id
    return json.dumps({"timestamp": at.isoformat(), "data": data})


class Topic:
    """A topic folder; each ``put`` is a new file."""

    def __init__(self, spark, root):
        self.spark, self.root, self.n = spark, str(root), 0
        (root / "topic").mkdir()

    def put(self, *values):
        self.n += 1
        with open(f"{self.root}/topic/{self.n:04d}.json", "w") as f:
            for i, v in enumerate(values):
                f.write(json.dumps({"topic": "t", "partition": 0, "offset": self.n * 100 + i, "value": v}) + "\n")

    def messages(self, **options):
        return MSG.file_messages(self.spark, f"{self.root}/topic", **options)

    def events(self, **options):
        return J.events(J.parse(self.messages(**options)))


@pytest.fixture
def topic(spark, tmp_path):
    return Topic(spark, tmp_path)


def batch_events(spark, values):
    return J.events(J.parse(spark.createDataFrame([(v,) for v in values], "value string")))


def test_defaults_and_envelopes(spark):
    flat = json.dumps({"CustomerId": 5, "Age": None, "event_id": "f", "timestamp": "2024-01-01T10:00:00"})
    rows = {r["event_id"]: r for r in batch_events(spark, [message("a", 1), flat, message(None, 2, customer=9)]).collect()}
    assert rows["a"]["CreditScore"] == 600 and rows["a"]["Gender"] == "Unknown" and rows["a"]["Age"] == 30
    assert rows["f"]["Age"] == 0 and rows["f"]["NumOfProducts"] == 1 and rows["f"]["CustomerId"] == 5
    seconds = int(dt.datetime(2024, 1, 1, 2, tzinfo=dt.timezone.utc).timestamp())
    assert rows[f"evt_9_{seconds}"]["CustomerId"] == 9


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_times_are_utc_in_any_session(spark, conf, zone):
    conf(**{"spark.sql.session.timeZone": zone})
    stamps = ["2024-01-01T10:00:00", "2024-01-01T10:00:00Z", "2024-01-01T15:30:00+05:30", "2024-01-01 10:00:00.000000", "soon", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(stamps)], "i int, s string")
    clocks = [r[1] for r in df.select("i", utc_clock(utc_instant(F.col("s")))).orderBy("i").collect()]
    assert clocks == [dt.datetime(2024, 1, 1, 10)] * 4 + [None, None]
    assert spark.range(1).select(naive(dt.datetime(2024, 1, 1, 10))).first()[0] == dt.datetime(2024, 1, 1, 10)


def test_top_level_id_wins(spark):
    value = json.loads(message("inner", 1))
    value["event_id"] = "outer"
    assert batch_events(spark, [json.dumps(value)]).first()["event_id"] == "outer"


@pytest.mark.parametrize("bad", ['{"timestamp": "2024', "no json", '{"data": {"Age": "old"}}', None])
def test_malformed_messages_go_to_the_dead_letters(spark, bad):
    parsed = J.parse(spark.createDataFrame([(bad,), (message("a", 1),)], "value string"))
    assert J.events(parsed).count() == 1
    assert [r["value"] for r in J.dead_letters(parsed).collect()] == [bad]


def test_score_row(spark):
    rows = C.by_rule(batch_events(spark, [message("a", 1, amount=20.0), message("b", 1, amount=500.0)])).collect()
    assert [(r["prediction"], r["probability"], r["risk_score"]) for r in rows] == [(0, 0.1, 0.9), (1, 1.0, 1.0)]
    assert list(rows[0].asDict()) == schemas.PREDICTIONS.fieldNames()


def test_scoring_survives_restarts_and_duplicates(topic, spark):
    root = topic.root

    def run(checkpoint="checkpoint"):
        J.run_available(J.scoring_job(topic.events(), C.by_rule, f"{root}/table", f"{root}/out", f"{root}/{checkpoint}"))
        like = spark.createDataFrame([], schemas.PREDICTIONS)
        return sorted(r["event_id"] for r in K.read_table(spark, f"{root}/table", like).collect())

    topic.put(message("a", 1), message("a", 1), "broken")
    assert run() == ["a"]
    assert run() == ["a"]
    topic.put(message("a", 1), message("b", 30))
    assert run() == ["a", "b"]
    # A lost checkpoint replays everything; the table does not change.
    assert run("another") == ["a", "b"]
    # Handed over once each, also by the replay.
    sent = spark.read.schema("key string, value string").json(f"{root}/out")
    assert sorted(json.loads(r["value"])["event_id"] for r in sent.collect()) == ["a", "b"]


def hourly(spark, root):
    table = J.rollup_table(spark, f"{root}/hours")
    return {r["hour_timestamp"].hour + 24 * (r["hour_timestamp"].day - 1): r["total_predictions"] for r in table.collect()}


def test_late_rows_revise_an_hour_until_the_watermark(topic, spark):
    root = topic.root

    def run():
        J.run_available(J.rollup_job(C.by_rule(topic.events()), f"{root}/hours", f"{root}/checkpoint"))
        return hourly(spark, root)

    topic.put(message("a", 1), message("b", 3))
    assert run() == {1: 1, 3: 1}
    topic.put(message("c", 2, minute=30))  # late, inside two hours
    assert run() == {1: 1, 2: 1, 3: 1}
    topic.put(message("d", 20))
    assert run() == {1: 1, 2: 1, 3: 1, 20: 1}
    topic.put(message("e", 1), message("f", 20, minute=10))  # e is beyond the watermark
    assert run() == {1: 1, 2: 1, 3: 1, 20: 2}


def test_duplicates_within_the_watermark(topic, spark):
    root = topic.root

    def run():
        unique = J.deduplicate(topic.events(), "2 hours").select("event_id", "CustomerId")
        J.run_available(
            unique.writeStream.format("parquet").option("path", f"{root}/table").option("checkpointLocation", f"{root}/c")
        )
        return sorted(r["event_id"] for r in spark.read.parquet(f"{root}/table").collect())

    topic.put(message("a", 1), message("a", 1, minute=5), message("b", 1))
    assert run() == ["a", "b"]
    topic.put(message("a", 1), message("c", 2))
    assert run() == ["a", "b", "c"]


def test_alerts_do_not_repeat(topic, spark):
    root = topic.root
    topic.put(message("a", 1, amount=190.0), message("b", 2, amount=120.0))
    for checkpoint in ("c1", "c2"):
        J.run_available(J.alert_job(C.by_rule(topic.events()), f"{root}/alerts", f"{root}/{checkpoint}"))
    table = K.read_table(spark, f"{root}/alerts", spark.createDataFrame([], schemas.ALERTS))
    assert [(r["customer_id"], r["risk_score"], r["alert_sent"]) for r in table.collect()] == [("1", 0.95, False)]


def test_progress_of_more_batches_than_a_query_remembers(topic, spark):
    for i in range(105):
        topic.put(message(f"m{i}", 0))
    listener = PROGRESS.ProgressLog(spark, f"{topic.root}/progress")
    spark.streams.addListener(listener)
    try:
        writer = topic.messages(max_files=1).writeStream.format("noop").option("checkpointLocation", f"{topic.root}/c")
        query = J.run_available(writer)
        PROGRESS.flush(spark)
    finally:
        spark.streams.removeListener(listener)
    rows = PROGRESS.progress_rows(spark, f"{topic.root}/progress", query).where("input_rows > 0").orderBy("batch_id").collect()
    assert len(rows) == 105 and sum(r["input_rows"] for r in rows) == 105
    assert rows[0]["start_offsets"] == [None] and json.loads(rows[1]["start_offsets"][0]) == json.loads(rows[0]["end_offsets"][0])
    assert rows[-1]["lag"] == 0
    assert PROGRESS.progress_rows(spark, f"{topic.root}/nothing").count() == 0


def test_lag_of_a_topic(spark, tmp_path):
    log = PROGRESS.ProgressLog(spark, str(tmp_path / "p"))
    source = {"description": "KafkaV2[t]", "startOffset": {"t": {"0": 5}}, "endOffset": {"t": {"0": 9}}, "latestOffset": {"t": {"0": 30}},
              "numInputRows": 4, "metrics": {"maxOffsetsBehindLatest": "21", "avgOffsetsBehindLatest": "21.0"}}
    for _ in range(2):  # a repeated batch replaces its note
        log.note("q", 3, json.dumps({"id": "q", "batchId": 3, "numInputRows": 4, "sources": [source]}, indent=1))
    (row,) = PROGRESS.progress_rows(spark, str(tmp_path / "p")).collect()
    assert (row["lag"], row["input_rows"]) == (21, 4) and json.loads(row["end_offsets"][0]) == {"t": {"0": 9}}


# --- the two steps -------------------------------------------------------------

def chain(topic, spark, alerts=True):
    """Alerts and rollups of what has been handed over, as of now."""
    root = topic.root
    read = lambda: J.predictions(J.parse_predictions(OUT.topic(spark, f"{root}/out")))
    J.run_available(J.rollup_job(read(), f"{root}/hours", f"{root}/rollup"))
    J.run_available(J.alert_job(read(), f"{root}/alerts", f"{root}/alerting"))
    table = K.read_table(spark, f"{root}/alerts", spark.createDataFrame([], schemas.ALERTS))
    return hourly(spark, root), sorted((r["customer_id"], r["risk_score"]) for r in table.collect())


def scoring(topic, checkpoint="scoring", scorer=C.by_rule, **options):
    root = topic.root
    return J.run_available(J.scoring_job(topic.events(), scorer, f"{root}/table", f"{root}/out", f"{root}/{checkpoint}", **options))


def test_duplicates_change_nothing_downstream(topic, spark):
    topic.put(message("a", 1, amount=190.0), message("b", 1, amount=70.0), message("a", 1, amount=190.0))
    scoring(topic)
    topic.put(message("a", 2, amount=190.0), message("c", 2, customer=2, amount=10.0))
    scoring(topic)
    expected = {1: 2, 2: 1}, [("1", 0.95), ("2", 0.95)]
    assert chain(topic, spark) == expected
    scoring(topic, "lost")  # everything again under another checkpoint
    assert chain(topic, spark) == expected


@pytest.mark.parametrize("where", ["staged", "moved", "marked", "stored"])
def test_a_killed_batch_changes_nothing_downstream(topic, spark, monkeypatch, where):
    """Killed while writing aside, while moving files, before the table, and after it."""
    topic.put(message("a", 1, amount=190.0), message("b", 1, amount=70.0))
    scoring(topic)
    topic.put(message("b", 1, amount=70.0), message("c", 2, amount=195.0), message("d", 5, amount=1.0))

    def killed(*_, **__):
        raise RuntimeError("killed")

    if where == "staged":
        monkeypatch.setattr(OUT, "hand_over", killed)
    elif where == "moved":
        real = OUT.hand_over

        def partly(spark, outbox, query, batch, messages):
            staged, fs = OUT._file_system(spark, f"{outbox}/_staged/{query}-{batch}")
            messages().write.mode("overwrite").json(staged.toString())
            target = spark._jvm.org.apache.hadoop.fs.Path(OUT.folder(outbox, query, batch))
            fs.mkdirs(target)
            first = next(s.getPath() for s in fs.listStatus(staged) if s.getPath().getName().startswith("part-"))
            fs.rename(first, spark._jvm.org.apache.hadoop.fs.Path(target, first.getName()))
            raise RuntimeError("killed")

        monkeypatch.setattr(OUT, "hand_over", partly)
        assert real
    elif where == "marked":
        monkeypatch.setattr(K, "insert_table", killed)
    with pytest.raises(Exception, match="killed"):
        scoring(topic, **({"publish": killed} if where == "stored" else {}))
    chain(topic, spark)  # the second step meanwhile
    monkeypatch.undo()
    scoring(topic)
    assert chain(topic, spark) == ({1: 2, 2: 1, 5: 1}, [("1", 0.95), ("1", 0.975), ("1", 0.995)])
    like = spark.createDataFrame([], schemas.PREDICTIONS)
    assert sorted(r["event_id"] for r in K.read_table(spark, f"{topic.root}/table", like).collect()) == ["a", "b", "c", "d"]
    sent = spark.read.schema("event_id string, batch string").json(f"{topic.root}/out/query=*/batch=*")
    assert sorted(r["event_id"] for r in sent.collect()) == ["a", "b", "c", "d"]
    assert all(r["batch"].rsplit("-", 1)[1] in "01" for r in sent.collect())


def test_the_run_that_wrote_the_messages_does_not_parse_them(topic, spark, monkeypatch):
    def parsed(_):
        raise RuntimeError("parsed")

    monkeypatch.setattr(J, "parse_predictions", parsed)
    topic.put(message("a", 1), message("b", 1, customer=2), message("a", 1))
    unsure = lambda df: J.score(df, lambda _: F.when(F.col("CustomerId") == 1, F.lit(0.9)))
    scoring(topic, scorer=unsure)
    scoring(topic, "lost", scorer=unsure)
    table = K.read_table(spark, f"{topic.root}/table", spark.createDataFrame([], schemas.PREDICTIONS))
    assert [(r["event_id"], r["probability"]) for r in table.collect()] == [("a", 0.9)]
    sent = spark.read.schema("event_id string").json(f"{topic.root}/out/query=*/batch=0")
    # A prediction without a score is no prediction: handed over (and again by a replay), not stored.
    assert sorted(r["event_id"] for r in sent.collect()) == ["a", "b", "b"]


def test_handed_over_files_are_compressed_and_bounded(topic, spark, monkeypatch):
    monkeypatch.setitem(MSG.PACKED, "maxRecordsPerFile", "3")
    topic.put(*[message(f"e{i}", 1) for i in range(10)])
    scoring(topic)
    MSG.publish_files(topic.spark.read.schema(schemas.MESSAGE).json(f"{topic.root}/topic"), f"{topic.root}/again", packed=True)
    for folder in (f"{topic.root}/out/query=*/batch=*", f"{topic.root}/again"):
        rows = spark.read.schema("value string").json(folder).select("value", F.input_file_name().alias("file")).collect()
        files = [r["file"] for r in rows]
        assert len(files) == 10 and all(f.endswith(".snappy") for f in files) and max(map(files.count, files)) <= 3


def test_fits_and_batch_scoring_read_work_copies(spark, folder, monkeypatch):
    read = {"fit_serving": [], "serve": []}
    for name, place in (("fit_serving", 0), ("serve", 1)):
        real = getattr(C, name)
        monkeypatch.setattr(C, name, lambda *a, _n=name, _p=place, _r=real, **kw: read[_n].extend(a[_p].inputFiles()) or _r(*a, **kw))
    assert sum(r["scored"] for r in C.stream_score_model(spark, folder).collect()) == predictions(spark, folder).count()
    assert read["fit_serving"] and read["serve"]
    assert not [f for files in read.values() for f in files if "orders.parquet" in f or "events.parquet" in f]


def test_published_elsewhere(topic, spark):
    got = []
    topic.put(message("a", 1), message("b", 1))
    scoring(topic, publish=lambda rows: got.extend(r["key"] for r in rows.collect()))
    assert got == ["1", "1"]


def test_unreadable_predictions(spark):
    good = {"event_id": "e", "customer_id": "7", "prediction": 1, "probability": 0.8, "risk_score": 0.8, "predicted_at": "2024-01-01T00:00:00.123456", "age": 3}
    bad = [{**good, "probability": "high"}, {**good, "event_id": None}, {**good, "predicted_at": "soon"}, {"x": 1}]
    values = [json.dumps(good), *map(json.dumps, bad), "nothing", None]
    parsed = J.parse_predictions(spark.createDataFrame([(v,) for v in values], "value string"))
    (row,) = J.stored(J.predictions(parsed)).collect()
    assert row["predicted_at"] == dt.datetime(2024, 1, 1, 0, 0, 0, 123456) and row["age"] == 3 and row["tenure"] is None
    assert J.dead_letters(parsed).count() == 6


def test_rollup_log_generations_and_compaction(topic, spark):
    root = topic.root
    topic.put(message("a", 1), message("b", 3))
    run = lambda c: J.run_available(J.rollup_job(C.by_rule(topic.events()), f"{root}/hours", f"{root}/{c}"))
    run("c1")
    topic.put(message("c", 2, minute=30), message("d", 4))
    run("c1")
    before = hourly(spark, root)
    assert before == {1: 1, 2: 1, 3: 1, 4: 1}
    LOG.compact(spark, f"{root}/hours", J.state_columns(spark))
    parts = [p for g in LOG._names(spark, f"{root}/hours") if g.startswith("generation") for p in LOG._names(spark, f"{root}/hours/{g}")]
    assert len(parts) == 1 and hourly(spark, root) == before
    LOG.compact(spark, f"{root}/hours", J.state_columns(spark))
    assert hourly(spark, root) == before
    topic.put(message("e", 4, minute=5))
    run("c1")
    assert hourly(spark, root) == before | {4: 2}
    run("c2")  # the checkpoint is lost: all again in a new generation
    assert hourly(spark, root) == before | {4: 2}
    assert J.rollup_table(spark, f"{root}/none").count() == 0


def test_a_message_is_parsed_once(spark):
    parsed = J.parse(spark.createDataFrame([(message("a", 1), 1, 2, None)], "value string, partition int, offset long, timestamp string"))
    plan = J.events(parsed)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_events_without_a_time(spark):
    flat = json.dumps({"CustomerId": 5})
    rows = [(flat, 0, 1, "2024-01-01T03:00:00"), (flat, 0, 2, None), (flat, 1, 2, None), (flat, None, None, None), ('{"CustomerId": 5, "Age": 3}', None, None, None)]
    got = J.events(J.parse(spark.createDataFrame(rows, "value string, partition int, offset long, timestamp string"))).collect()
    ids = [r["event_id"] for r in got]
    assert len(set(ids)) == 5 and "evt_5_0-2" in ids and "evt_5_1-2" in ids
    assert [utc for utc in (r["event_time"] for r in got) if utc] and sum(r["event_time"] is None for r in got) == 4


def test_stream_equals_batch(spark, folder):
    batch = R.rollup_hourly(predictions(spark, folder))
    assert spark_rows(C.stream_rollup_hourly(spark, folder)) == spark_rows(batch)


def test_messages_keep_a_key_in_one_partition(spark, folder):
    parts = C.event_messages(spark, folder).groupBy("key").agg(F.countDistinct("partition").alias("n"))
    assert parts.where("n > 1").count() == 0


def test_kafka_options():
    options = MSG.kafka_options("host:9092", "events")
    assert options["startingOffsets"] == "latest" and options["minOffsetsPerTrigger"] == "1000"
    assert "maxOffsetsPerTrigger" not in options
    assert MSG.kafka_options("host:9092", "events", max_messages=1000)["maxOffsetsPerTrigger"] == "1000"
    assert options["maxTriggerDelay"] == "30 seconds"
    assert MSG.kafka_options("host:9092", "events", from_start=True)["startingOffsets"] == "earliest"


def test_numbers_in_other_forms_and_bad_times(spark):
    from tidewatch.streaming import jobs

    values = [
        '{"timestamp": "2024-01-01T00:00:00", "data": {"CustomerId": 7, "Age": 42.0, "EstimatedSalary": "12.5"}}',
        '{"timestamp": "2024-01-01T00:00:00", "data": {"CustomerId": "8", "Age": "42", "EstimatedSalary": null}}',
        '{"timestamp": "oops", "data": {"CustomerId": 9}}',
        "not json",
    ]
    parsed = jobs.parse(spark.createDataFrame([(v,) for v in values], "value string"))
    found = {r.CustomerId: r for r in jobs.events(parsed).collect()}
    assert sorted(found) == [7, 8] and found[7].Age == found[8].Age == 42 and found[7].EstimatedSalary == 12.5
    assert [r.value for r in jobs.dead_letters(parsed).collect()] == values[2:]
