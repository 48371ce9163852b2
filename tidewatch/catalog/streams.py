"""Events as messages, and the streaming jobs run over the whole event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.catalog.registry import query
from tidewatch.catalog.reports import ALERTS, DAILY, HOURLY
from tidewatch.catalog.sqltext import hash32, on_customers, on_predictions, rnd
from tidewatch.functions.expr import churn_label, hash32 as hash_of, rounded, utc_clock, utc_instant
from tidewatch.operators import projections as P
from tidewatch.operators.learning import load_model, logistic, save_model
from tidewatch.operators.reports import union_all
from tidewatch.operators.serving import fit_serving, serve
from tidewatch.plans.features import SCALED
from tidewatch.plans.fixtures import customer_attributes, customers, predictions, table
from tidewatch.schemas import ALERTS as ALERT_SCHEMA
from tidewatch.schemas import CUSTOMER, TARGET
from tidewatch.schemas import PREDICTIONS as PREDICTION_SCHEMA
from tidewatch.session import materialize, work_folder
from tidewatch.sources import keyed
from tidewatch.streaming import jobs as J
from tidewatch.streaming import messages as MSG
from tidewatch.streaming import outbox as OUT
from tidewatch.streaming import progress as PROGRESS

TOPIC = "customer-events"


def message_rows(df, topic, key, value, offset, timestamp, partitions: int = 3):
    """Rows as a broker would deliver them: a key always comes from the same partition."""
    key = key.cast("string")
    return df.select(
        F.lit(topic).alias("topic"), (hash_of(0, key) % partitions).cast("int").alias("partition"), offset.cast("bigint").alias("offset"),
        MSG.iso(timestamp).alias("timestamp"), key.alias("key"), value.alias("value"),
    )


def score_rule(df):
    """The churn probability of the fixtures: the event amount over 200, at most 1."""
    return F.least(F.col("EstimatedSalary") / 200, F.lit(1.0))


def by_rule(df):
    return J.score(df, score_rule)


def event_messages(spark, folder, damaged: bool = False):
    """Every event as a message.

    Every seventh comes without an envelope, every thirteenth without a credit
    score; with ``damaged`` every fiftieth is cut short.
    """
    rows = table(spark, folder, "events").join(
        customer_attributes(spark, folder), F.col("user_id") == F.col("c_custkey"), "left"
    )
    stamp = MSG.iso(F.col("ts"))
    fields = [
        F.col("user_id").alias("CustomerId"),
        F.col("geography").alias("Geography"),
        F.col("gender").alias("Gender"),
        F.col("age").alias("Age"),
        F.when(F.col("event_id") % 13 != 0, 350 + F.col("event_id") % 500).cast("int").alias("CreditScore"),
        F.col("balance").alias("Balance"),
        F.col("value").alias("EstimatedSalary"),
        F.col("tenure").alias("Tenure"),
        F.col("num_of_products").alias("NumOfProducts"),
        F.col("has_cr_card").alias("HasCrCard"),
        F.col("is_active_member").alias("IsActiveMember"),
        F.col("event_id").cast("string").alias("event_id"),
        stamp.alias("event_timestamp"),
    ]
    value = F.when(F.col("event_id") % 7 == 0, F.to_json(F.struct(*fields))).otherwise(
        P.enveloped(F.struct(*fields), stamp)
    )
    if damaged:
        value = F.when(F.col("event_id") % 50 == 0, F.substring(value, 1, 40)).otherwise(value)
    return message_rows(rows, TOPIC, F.col("user_id"), value, F.col("event_id"), F.col("ts"))


def _publish(spark, folder, purpose: str, damaged: bool = False) -> str:
    root = work_folder(spark, purpose)
    MSG.publish_files(event_messages(spark, folder, damaged), f"{root}/topic")
    return root


# Arrival in three parts; the cuts lie inside an hour, so a window is revised.
_CUTS = ["2024-01-11T06:30", "2024-01-21T18:10"]


def _in_parts(spark, folder, purpose: str, run) -> str:
    """Publish a part, run the job on what is new, and so on with one checkpoint."""
    root = work_folder(spark, purpose)
    messages = event_messages(spark, folder)
    at = F.col("timestamp")
    for part in (at < _CUTS[0], (at >= _CUTS[0]) & (at < _CUTS[1]), at >= _CUTS[1]):
        MSG.publish_files(messages.where(part), f"{root}/topic")
        run(root)
    return root


def _events(spark, root: str):
    return J.events(J.parse(MSG.file_messages(spark, f"{root}/topic")))


_EXPECTED = """expected AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(customer_id AS BIGINT) AS "CustomerId",
    coalesce(geography, 'Unknown') AS "Geography", coalesce(gender, 'Unknown') AS "Gender",
    coalesce(age, 0) AS "Age",
    CAST(CASE WHEN CAST(event_id AS BIGINT) % 13 <> 0 THEN 350 + CAST(event_id AS BIGINT) % 500 ELSE 600 END AS INTEGER) AS "CreditScore",
    coalesce(balance, 0) AS "Balance", coalesce((SELECT value FROM events e WHERE e.event_id = CAST(predictions.event_id AS BIGINT)), 0) AS "EstimatedSalary", coalesce(tenure, 0) AS "Tenure", coalesce(num_of_products, 1) AS "NumOfProducts",
    coalesce(has_cr_card, 0) AS "HasCrCard", coalesce(is_active_member, 0) AS "IsActiveMember",
    predicted_at AS event_time FROM predictions)"""
_EVENT_COLUMNS = [
    "event_id", "CustomerId", "Geography", "Gender", "Age", "CreditScore", "Balance", "EstimatedSalary", "Tenure", "NumOfProducts",
    "HasCrCard", "IsActiveMember",
]


def _event_view(df):
    return df.select(*_EVENT_COLUMNS, utc_clock(F.col("event_time")).alias("event_time"))


# --- payloads ----------------------------------------------------------------

@query("event_defaults", on_predictions("SELECT * FROM expected", _EXPECTED))
def event_defaults(spark, folder):
    return _event_view(J.events(J.parse(event_messages(spark, folder))))


# Every raw field but the target.  Amounts are doubles, which the two engines may write in
# other digits; they are read back and compared as numbers.
_PAYLOAD = [f.name for f in CUSTOMER.fields if f.name != TARGET]


@query(
    "event_payload",
    on_customers(
        "SELECT " + ", ".join(f'"{c}"' for c in _PAYLOAD)
        + f""", '{",".join(_PAYLOAD)}' AS fields FROM customers"""
    ),
)
def event_payload(spark, folder):
    """Payloads read back: each field keeps its name, order and value, nulls are written out."""
    df = customers(spark, folder)
    payload = df.select(P.event_payload(df, _PAYLOAD).alias("payload"))
    names = F.array_join(F.json_object_keys("payload"), ",").alias("fields")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CUSTOMER.fields if f.name != TARGET)
    return payload.select(F.from_json("payload", kinds).alias("p"), names).select("p.*", "fields")


@query(
    "score_event_row",
    on_predictions(
        f"""SELECT event_id, customer_id, prediction, probability, {rnd('risk_score', 6)} AS risk_score,
          CASE WHEN prediction = 1 THEN 'Churn' ELSE 'Retain' END AS status, {rnd('(100 * probability)', 2)} AS confidence,
          geography, gender, age, balance, predicted_at AS processed_at, model_version FROM predictions"""
    ),
)
def score_event_row(spark, folder):
    scored = predictions(spark, folder)
    return scored.select(
        "event_id", "customer_id", "prediction", "probability", rounded(F.col("risk_score"), 6).alias("risk_score"),
        churn_label(F.col("prediction"), "Churn", "Retain").alias("status"),
        rounded(100 * F.col("probability"), 2).alias("confidence"),
        "geography", "gender", "age", "balance", F.col("predicted_at").alias("processed_at"), "model_version",
    )


# --- source and sink ---------------------------------------------------------

@query(
    "event_stream_source",
    f"""SELECT '{TOPIC}' AS topic, CAST({hash32(0, 'user_id')} % 3 AS INTEGER) AS partition, event_id AS "offset",
      CAST(user_id AS VARCHAR) AS key, CAST(ts AS TIMESTAMP) AS message_time FROM events""",
)
def event_stream_source(spark, folder):
    root = _publish(spark, folder, "source")
    rows = MSG.file_messages(spark, f"{root}/topic").select(
        "topic", "partition", "offset", "key", utc_instant(F.col("timestamp")).alias("message_time")
    )
    writer = rows.writeStream.format("parquet").option("path", f"{root}/table")
    J.run_available(writer.option("checkpointLocation", f"{root}/checkpoint"))
    return spark.read.schema(rows.schema).parquet(f"{root}/table").withColumn(
        "message_time", utc_clock(F.col("message_time"))
    )


@query(
    "event_stream_sink",
    on_predictions("SELECT customer_id AS key, event_id, prediction, geography FROM predictions"),
)
def event_stream_sink(spark, folder):
    root = _publish(spark, folder, "outbox")
    scored = by_rule(_events(spark, root))
    result = F.to_json(F.struct("event_id", "prediction", "geography"))
    outgoing = message_rows(
        scored, "churn-predictions", F.col("customer_id"), result, F.col("event_id"),
        utc_clock(F.col("predicted_at")),
    )
    J.run_available(MSG.file_sink(outgoing, f"{root}/out", f"{root}/checkpoint"))
    sent = spark.read.schema(MSG.MESSAGE).json(f"{root}/out")
    return sent.select("key", F.from_json("value", "event_id string, prediction int, geography string").alias("v")).select(
        "key", "v.*"
    )


# --- jobs --------------------------------------------------------------------

@query(
    "stream_parse",
    on_predictions(
        """SELECT 'event' AS kind, event_id, "CustomerId", "CreditScore" FROM expected WHERE CAST(event_id AS BIGINT) % 50 <> 0
        UNION ALL SELECT 'dead_letter', event_id, NULL, NULL FROM expected WHERE CAST(event_id AS BIGINT) % 50 = 0""",
        _EXPECTED,
    ),
)
def stream_parse(spark, folder):
    root = _publish(spark, folder, "parse", damaged=True)
    parsed = J.parse(MSG.file_messages(spark, f"{root}/topic"))
    good = J.events(parsed).select("event_id", "CustomerId", "CreditScore")
    bad = J.dead_letters(parsed).select(F.col("offset").cast("string").alias("event_id"))
    for name, rows in (("event", good), ("dead_letter", bad)):
        writer = rows.writeStream.format("parquet").option("path", f"{root}/{name}")
        J.run_available(writer.option("checkpointLocation", f"{root}/checkpoint_{name}"))
    none = F.lit(None)
    return union_all(
        [
            spark.read.schema(good.schema).parquet(f"{root}/event").select(F.lit("event").alias("kind"), "*"),
            spark.read.schema(bad.schema).parquet(f"{root}/dead_letter").select(
                F.lit("dead_letter").alias("kind"), "event_id",
                none.cast("bigint").alias("CustomerId"), none.cast("int").alias("CreditScore"),
            ),
        ]
    )


@query("stream_micro_batch", "SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS key FROM events")
def stream_micro_batch(spark, folder):
    """Batches of a limited number of files, each written under its own number."""
    root = work_folder(spark, "batches")
    parts = spark.sparkContext.defaultParallelism
    MSG.publish_files(event_messages(spark, folder).repartition(parts), f"{root}/topic")
    stream = MSG.file_messages(spark, f"{root}/topic", max_files=max(1, parts // 4))

    def write(batch, batch_id):
        rows = batch.select(F.col("offset").cast("string").alias("event_id"), "key")
        rows.write.mode("overwrite").parquet(f"{root}/table/batch={batch_id}")

    J.run_available(J.each_batch(stream, write, f"{root}/checkpoint"))
    return spark.read.schema("event_id string, key string, batch int").parquet(f"{root}/table").drop("batch")


@query(
    "stream_score",
    on_predictions(
        f"""SELECT event_id, customer_id, prediction, {rnd('probability', 6)} AS probability,
          {rnd('risk_score', 6)} AS risk_score, predicted_at, geography, gender, age, tenure, balance FROM predictions"""
    ),
)
def stream_score(spark, folder):
    root = _publish(spark, folder, "score")
    J.run_available(J.scoring_job(_events(spark, root), by_rule, f"{root}/table", f"{root}/outbox", f"{root}/checkpoint"))
    like = spark.createDataFrame([], PREDICTION_SCHEMA)
    return keyed.read_table(spark, f"{root}/table", like).select(
        "event_id", "customer_id", "prediction", rounded(F.col("probability"), 6).alias("probability"),
        rounded(F.col("risk_score"), 6).alias("risk_score"), "predicted_at", "geography", "gender", "age", "tenure", "balance",
    )


@query("stream_dedup", "SELECT CAST(event_id AS VARCHAR) AS event_id, user_id AS \"CustomerId\" FROM events")
def stream_dedup(spark, folder):
    root = work_folder(spark, "dedup")
    messages = event_messages(spark, folder)
    MSG.publish_files(messages.unionByName(messages), f"{root}/topic")
    unique = J.deduplicate(_events(spark, root)).select("event_id", "CustomerId")
    writer = unique.writeStream.format("parquet").option("path", f"{root}/table")
    J.run_available(writer.option("checkpointLocation", f"{root}/checkpoint"))
    return spark.read.schema(unique.schema).parquet(f"{root}/table")


def _rollup(spark, folder, width: str):
    def run(root):
        J.run_available(J.rollup_job(by_rule(_events(spark, root)), f"{root}/log", f"{root}/checkpoint", width))

    return J.rollup_table(spark, f"{_in_parts(spark, folder, 'rollup', run)}/log", width)


@query("stream_rollup_hourly", on_predictions("SELECT * FROM hourly", HOURLY))
def stream_rollup_hourly(spark, folder):
    return _rollup(spark, folder, "1 hour")


@query("stream_rollup_daily", on_predictions("SELECT * FROM daily", DAILY))
def stream_rollup_daily(spark, folder):
    return _rollup(spark, folder, "1 day")


@query("stream_high_risk_alerts", on_predictions("SELECT * FROM alerts", ALERTS))
def stream_high_risk_alerts(spark, folder):
    def run(root):
        J.run_available(J.alert_job(by_rule(_events(spark, root)), f"{root}/alerts", f"{root}/checkpoint"))

    root = _in_parts(spark, folder, "alerts", run)
    return keyed.read_table(spark, f"{root}/alerts", spark.createDataFrame([], ALERT_SCHEMA))


@query(
    "stream_bounded_run",
    f"""SELECT CASE WHEN ts < TIMESTAMP '2024-01-11 06:30:00' THEN 0 WHEN ts < TIMESTAMP '2024-01-21 18:10:00' THEN 1
      ELSE 2 END AS run, count(*) AS events FROM events GROUP BY 1""",
)
def stream_bounded_run(spark, folder):
    """Each run handles exactly what arrived since the one before."""
    runs = iter(range(len(_CUTS) + 1))

    def run(root):
        number = next(runs)
        rows = MSG.file_messages(spark, f"{root}/topic").select("offset", F.lit(number).alias("run"))
        J.run_available(
            rows.writeStream.format("parquet").option("path", f"{root}/table").option("checkpointLocation", f"{root}/checkpoint")
        )

    root = _in_parts(spark, folder, "runs", run)
    stored = spark.read.schema("offset bigint, run int").parquet(f"{root}/table")
    return stored.groupBy("run").agg(F.count("*").alias("events"))


@query("stream_progress", "SELECT count(*) AS input_rows, 0 AS waiting, CAST(0 AS BIGINT) AS batches_without_offsets FROM events")
def stream_progress(spark, folder):
    root = _publish(spark, folder, "progress")
    listener = PROGRESS.ProgressLog(spark, f"{root}/progress")
    spark.streams.addListener(listener)
    try:
        stream = MSG.file_messages(spark, f"{root}/topic", max_files=2).select("offset")
        query = J.run_available(stream.writeStream.format("noop").option("checkpointLocation", f"{root}/checkpoint"))
        PROGRESS.flush(spark)
    finally:
        spark.streams.removeListener(listener)
    rows = PROGRESS.progress_rows(spark, f"{root}/progress", query)
    return rows.agg(
        F.sum("input_rows").alias("input_rows"), F.min("lag").cast("int").alias("waiting"),
        F.count(F.when(F.expr("size(filter(end_offsets, o -> o IS NULL)) > 0"), 1)).alias("batches_without_offsets"),
    )


# --- the two steps ---------------------------------------------------------------

def _scored_topic(spark, folder) -> str:
    """Events published twice, scored in two runs and handed over; each prediction is there once."""
    root = work_folder(spark, "chain")
    messages = event_messages(spark, folder)
    for _ in range(2):
        MSG.publish_files(messages, f"{root}/topic", packed=True)
        J.run_available(J.scoring_job(_events(spark, root), by_rule, f"{root}/table", f"{root}/outbox", f"{root}/scoring"))
    return root


def _parsed_topic(spark, root: str):
    """The predictions topic parsed once, by a job of its own, and the columns of its table."""
    parsed = J.parse_predictions(OUT.topic(spark, f"{root}/outbox"))
    rows = parsed.select(*PREDICTION_SCHEMA.fieldNames(), "malformed")
    writer = rows.writeStream.format("parquet").option("path", f"{root}/parsed")
    J.run_available(writer.option("checkpointLocation", f"{root}/parsing"))
    return rows.schema


@query(
    "stream_predictions_parse",
    on_predictions(
        f"""SELECT event_id, customer_id, prediction, {rnd('probability', 6)} AS probability, {rnd('risk_score', 6)} AS risk_score,
          predicted_at, model_version, geography, gender, age, tenure, balance, false AS malformed FROM predictions"""
    ),
)
def stream_predictions_parse(spark, folder):
    """The predictions topic as rows: what the second step reads."""
    root = _scored_topic(spark, folder)
    return spark.read.schema(_parsed_topic(spark, root)).parquet(f"{root}/parsed").select(
        "event_id", "customer_id", "prediction", rounded(F.col("probability"), 6).alias("probability"),
        rounded(F.col("risk_score"), 6).alias("risk_score"), utc_clock(F.col("predicted_at")).alias("predicted_at"),
        "model_version", "geography", "gender", "age", "tenure", "balance", "malformed",
    )


@query(
    "stream_chain",
    on_predictions(
        """SELECT 'hour' AS kind, CAST(hour_timestamp AS VARCHAR) AS label, total_predictions AS n, avg_risk_score AS value FROM hourly
        UNION ALL SELECT 'alert', customer_id || ' ' || CAST(detected_at AS VARCHAR), 1, risk_score FROM alerts""",
        HOURLY, ALERTS,
    ),
)
def stream_chain(spark, folder):
    """Events to predictions, predictions to rollups and alerts, with every event sent twice."""
    root = _scored_topic(spark, folder)
    schema = _parsed_topic(spark, root)
    topic = lambda: J.predictions(spark.readStream.schema(schema).parquet(f"{root}/parsed"))
    J.run_available(J.rollup_job(topic(), f"{root}/log", f"{root}/rollup"))
    J.run_available(J.alert_job(topic(), f"{root}/alerts", f"{root}/alerting"))
    hours = J.rollup_table(spark, f"{root}/log").select(
        F.lit("hour").alias("kind"), F.col("hour_timestamp").cast("string").alias("label"),
        F.col("total_predictions").alias("n"), F.col("avg_risk_score").alias("value"),
    )
    alerts = keyed.read_table(spark, f"{root}/alerts", spark.createDataFrame([], ALERT_SCHEMA)).select(
        F.lit("alert").alias("kind"), F.concat_ws(" ", "customer_id", F.col("detected_at").cast("string")).alias("label"),
        F.lit(1).cast("bigint").alias("n"), F.col("risk_score").alias("value"),
    )
    return union_all([hours, alerts])


# --- scoring by a stored model -----------------------------------------------------

_VERSIONS = ["20240101000000", "20240201000000"]


@query(
    "stream_score_model",
    f"""SELECT CASE WHEN ts < TIMESTAMP '2024-01-11 06:30:00' THEN '{_VERSIONS[0]}' ELSE '{_VERSIONS[1]}' END AS model_version,
      count(*) AS scored, count(*) AS as_in_batch FROM events GROUP BY 1""",
)
def stream_score_model(spark, folder):
    """Events scored by the newest stored pipeline: one that is saved between two runs scores the second.

    Every event is scored once, and as the same version scores it in batch.
    """
    # Every fit goes over its rows several times.
    train = materialize(customers(spark, folder).dropna(subset=["Age", "Gender"]), "train")
    root = work_folder(spark, "model-stream")
    scorer, messages = J.StoredModel(spark, root), event_messages(spark, folder)
    at = F.col("timestamp")
    for version, iterations, part in zip(_VERSIONS, (5, 50), (at < _CUTS[0], at >= _CUTS[0]), strict=True):
        save_model(fit_serving(train, logistic(iterations), TARGET, ["Geography", "Gender"], SCALED), root, version)
        MSG.publish_files(messages.where(part), f"{root}/topic", packed=True)
        J.run_available(J.scoring_job(_events(spark, root), scorer, f"{root}/table", f"{root}/outbox", f"{root}/checkpoint"))
    streamed = keyed.read_table(spark, f"{root}/table", spark.createDataFrame([], PREDICTION_SCHEMA))
    events = materialize(J.events(J.parse(messages)).drop("topic", "partition", "offset", "timestamp", "key"), "events")
    batch = union_all([
        J.score(serve(load_model(spark, root, v), events), lambda df: F.col("probability"), version=v) for v in _VERSIONS
    ])
    same = batch.select("event_id", "model_version", F.col("probability").alias("_p"))
    return streamed.join(same, ["event_id", "model_version"]).groupBy("model_version").agg(
        F.count("*").alias("scored"), F.count(F.when(F.abs(F.col("probability") - F.col("_p")) < 1e-9, 1)).alias("as_in_batch")
    )
