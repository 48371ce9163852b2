"""The streaming jobs: parse, de-duplicate, score, hand over, roll up, alert.

Scoring and what follows are two steps, joined by a topic of predictions: the scoring job
stores each prediction once and hands it over once; alerts and rollups read that topic.
All jobs share their column expressions with the batch operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.functions.expr import HIGH_RISK, risk_score, utc_clock, utc_instant
from tidewatch.operators import reports as R
from tidewatch.operators.learning import load_model
from tidewatch.operators.projections import CORRUPT, event_records
from tidewatch.operators.serving import serve
from tidewatch.schemas import PREDICTIONS
from tidewatch.session import scratch
from tidewatch.sources import keyed
from tidewatch.sources.readers import list_versions
from tidewatch.streaming import outbox as OUT
from tidewatch.streaming import rolluplog as LOG
from tidewatch.streaming.messages import iso

PREDICTION_TOPIC = "churn-predictions"
NEEDED = ["event_id", "customer_id", "prediction", "probability", "risk_score"]  # without them a prediction is malformed


# --- parsing -----------------------------------------------------------------

def _origin(messages: DataFrame) -> Column:
    """What tells a message from all others: its place in the topic, else its text."""
    if {"partition", "offset"} <= set(messages.columns):
        place = F.concat_ws("-", "partition", "offset")
        return F.coalesce(F.nullif(place, F.lit("")), F.xxhash64("value").cast("string"))
    return F.xxhash64("value").cast("string")


def parse(messages: DataFrame) -> DataFrame:
    """Messages with the fields of their event, and ``malformed``: not JSON, or with a value
    or a time that cannot be read.  Each message is parsed once."""
    arrived = utc_instant(F.col("timestamp")) if "timestamp" in messages.columns else None
    return messages.select("*", F.inline(event_records(F.col("value"), _origin(messages), arrived)))


def events(parsed: DataFrame) -> DataFrame:
    """The readable messages as events with defaults."""
    return parsed.where(~F.col("malformed")).drop("malformed", "value")


def dead_letters(parsed: DataFrame) -> DataFrame:
    """The unreadable messages, kept for inspection."""
    kept = [c for c in ("topic", "partition", "offset", "timestamp", "key", "value") if c in parsed.columns]
    return parsed.where(F.col("malformed")).select(*kept)


def deduplicate(stream: DataFrame, delay: str = "2 hours", time: str = "event_time") -> DataFrame:
    """First row per event id; the state of an id is dropped ``delay`` after its time.

    Rows without a time have no place on the time axis and pass only batch jobs.
    """
    return stream.where(F.col(time).isNotNull()).withWatermark(time, delay).dropDuplicatesWithinWatermark(["event_id"])


# --- scoring -----------------------------------------------------------------

_FROM_EVENT = {
    "geography": "Geography", "gender": "Gender", "age": "Age", "tenure": "Tenure", "balance": "Balance",
    "num_of_products": "NumOfProducts", "has_cr_card": "HasCrCard", "is_active_member": "IsActiveMember",
    "estimated_salary": "EstimatedSalary",
}

Scorer = Callable[[DataFrame], DataFrame]


def score(df: DataFrame, probability: Callable[[DataFrame], Column], mode: str = "certainty", version: str = "rule_v1") -> DataFrame:
    """Events as prediction rows.  ``probability`` may also read columns a model added."""
    scored = df.withColumn("probability", probability(df)).withColumn(
        "prediction", F.when(F.col("probability") >= 0.5, 1).otherwise(0)
    )
    values = {
        "event_id": F.col("event_id"),
        "customer_id": F.col("CustomerId").cast("string"),
        "prediction": F.col("prediction"),
        "probability": F.col("probability"),
        "risk_score": risk_score(F.col("probability"), F.col("prediction"), mode),
        "predicted_at": F.col("event_time"),
        "model_version": F.lit(version),
        **{k: F.col(v) for k, v in _FROM_EVENT.items()},
    }
    return scored.select(*[values[f.name].alias(f.name) for f in PREDICTIONS.fields])


class StoredModel:
    """The newest saved pipeline below a folder, looked up for every batch it scores.

    A version that is saved while a stream runs is used from the next batch on.
    """

    def __init__(self, spark: SparkSession, root: str, mode: str = "certainty"):
        self.spark, self.root, self.mode = spark, root, mode
        self.version: str | None = None
        self.model: PipelineModel | None = None

    def refresh(self) -> str:
        versions = list_versions(self.spark, self.root, "models")
        if not versions:
            raise FileNotFoundError(f"no model below {self.root}")
        if versions[-1] != self.version:
            self.model, self.version = load_model(self.spark, self.root, versions[-1]), versions[-1]
        return self.version

    def __call__(self, events: DataFrame) -> DataFrame:
        version = self.refresh()
        return score(serve(self.model, events), lambda df: F.col("probability"), self.mode, version)


def stored(df: DataFrame) -> DataFrame:
    """Prediction rows in the types of the prediction table."""
    clock = {"predicted_at": utc_clock(F.col("predicted_at"))}
    return df.select(*[clock.get(f.name, F.col(f.name).cast(f.dataType)).alias(f.name) for f in PREDICTIONS.fields])


# --- running -----------------------------------------------------------------

def run_available(writer) -> StreamingQuery:
    """Process what is there and stop; the checkpoint remembers how far."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_forever(writer, interval: str = "30 seconds") -> StreamingQuery:
    return writer.trigger(processingTime=interval).start()


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"):
    return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)


def query_id(spark: SparkSession) -> str:
    """The identity that a query keeps with its checkpoint; known inside a batch."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId")


# --- jobs --------------------------------------------------------------------

def prediction_messages(rows: DataFrame, batch: str) -> DataFrame:
    """Predictions as messages of their topic; the broker gives partition and offset."""
    form = {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    value = F.to_json(F.struct(*rows.columns), form)
    return rows.select(
        F.lit(PREDICTION_TOPIC).alias("topic"), F.lit(None).cast("int").alias("partition"), F.lit(None).cast("bigint").alias("offset"),
        iso(F.col("predicted_at")).alias("timestamp"), F.col("customer_id").alias("key"), value.alias("value"),
        "event_id", F.lit(batch).alias("batch"),
    )


def scoring_job(
    events: DataFrame, scorer: Scorer, table: str, outbox: str, checkpoint: str, publish: Callable[[DataFrame], None] | None = None
):
    """Score events into the prediction table and hand each new prediction over once.

    What is new is decided before anything is stored, and written down in the outbox:
    a batch that is repeated, wherever it was killed, stores and hands over the same rows.
    A replay under a new checkpoint finds every event known.  The messages are read back
    only by a run that repeats a batch; the run that wrote them still has the rows.
    ``publish`` also sends the handed-over messages elsewhere, to a broker for instance,
    at least once.
    """
    spark = events.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        query = query_id(spark)
        decided: list[DataFrame] = []
        with scratch(spark) as keep:
            def messages() -> DataFrame:
                rows = keep(stored(scorer(batch)), "scored")
                known = keyed.known_rows(spark, table, rows, ["event_id"], "predicted_at")
                decided.append(keep(keyed.new_rows(known, rows, ["event_id"], ["predicted_at"]), "new"))
                return prediction_messages(decided[0], f"{query}-{batch_id}")

            OUT.hand_over(spark, outbox, query, batch_id, messages)
            sent = OUT.handed_over(spark, outbox, query, batch_id)
            rows = decided[0].dropna(subset=NEEDED) if decided else stored(predictions(parse_predictions(sent)))
            keyed.insert_table(spark, table, rows, ["event_id"], ["predicted_at"], "predicted_at", decided=bool(decided))
            if publish is not None:
                publish(sent.select("topic", "key", "value"))

    return each_batch(events, write, checkpoint)


def parse_predictions(messages: DataFrame) -> DataFrame:
    """Messages of the predictions topic with the prediction's fields and ``malformed``.

    Malformed is what is no JSON, lacks an event, a customer or a score, or has a value
    that its field cannot take.
    """
    texts = ", ".join(f"{f.name} string" for f in PREDICTIONS.fields) + f", {CORRUPT} string"
    parsed = F.from_json("value", texts, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    kinds = {f.name: f.dataType.simpleString() for f in PREDICTIONS.fields}

    def read(m: Column) -> Column:
        fields, bad = [], m.isNull() | m[CORRUPT].isNotNull()
        for name, kind in kinds.items():
            typed = utc_instant(m[name]) if name == "predicted_at" else m[name].try_cast(kind)
            bad = bad | (m[name].isNotNull() & typed.isNull())
            if name in NEEDED:
                bad = bad | typed.isNull()
            fields.append(typed.alias(name))
        return F.struct(*fields, F.coalesce(bad, F.lit(True)).alias("malformed"))

    # A message's own columns may share a name with its contents; only those of the topic stay.
    kept = [c for c in ("topic", "partition", "offset", "timestamp", "key", "value") if c in messages.columns]
    return messages.select(*kept, F.inline(F.transform(F.array(parsed), read)))


def predictions(parsed: DataFrame) -> DataFrame:
    """The readable messages as prediction rows; times are instants, as watermarks want them."""
    return parsed.where(~F.col("malformed")).select(*PREDICTIONS.fieldNames())


def windowed_states(predictions: DataFrame, width: str, delay: str, threshold: float = HIGH_RISK) -> DataFrame:
    """Rollup states per event-time window of predictions that count once per event id.

    Late rows inside ``delay`` revise their window; rows without a time are in none.
    """
    unique = deduplicate(predictions, delay, "predicted_at")
    return R.rollup_state(unique, F.window("predicted_at", width).alias("w"), threshold=threshold)


def rollup_job(predictions: DataFrame, log: str, checkpoint: str, width: str = "1 hour", delay: str = "2 hours"):
    """Append the state of every window that changed to a log."""
    start = utc_clock(F.col("w.start")).alias(LOG.START)
    states = windowed_states(predictions, width, delay)
    rows = states.select(start, *[c for c in states.columns if c != "w"])
    spark = predictions.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        LOG.append(batch, log, LOG.generation(spark, log, query_id(spark)), batch_id)

    return each_batch(rows, write, checkpoint, "update")


def state_columns(spark: SparkSession) -> DataFrame:
    """An empty frame with the columns of a logged state."""
    scored = spark.createDataFrame([], PREDICTIONS).withColumn("predicted_at", F.col("predicted_at").cast("timestamp"))
    return R.rollup_state(scored, F.col("predicted_at").cast("timestamp_ntz").alias(LOG.START))


def rollup_table(spark: SparkSession, log: str, width: str = "1 hour") -> DataFrame:
    """The metric rows of a rollup log."""
    states = LOG.newest(spark, log, state_columns(spark))
    key = "date" if width == "1 day" else R.HOUR
    start = F.to_date(LOG.START) if key == "date" else F.col(LOG.START)
    return R.finish(states.withColumn(key, start), key)


def alert_job(predictions: DataFrame, table: str, checkpoint: str, threshold: float = HIGH_RISK):
    """Upsert an alert per customer and event time of high risk."""
    spark = predictions.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        alerts = R.high_risk_alerts(stored(batch), threshold)
        keyed.upsert_table(spark, table, alerts, ["customer_id", "detected_at"], ["risk_score"], "detected_at")

    return each_batch(predictions, write, checkpoint)
