"""Evaluation (with SQL twins) and training, scoring and storing of models."""

from __future__ import annotations

import datetime as dt

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window, functions as F

from tidewatch.catalog.features import _CLEAN, STORED
from tidewatch.catalog.registry import query
from tidewatch.catalog.sqltext import count_if, on_customers, on_pairs, rnd, share
from tidewatch.functions.expr import hash32, rounded
from tidewatch.operators import evaluation as V
from tidewatch.operators import learning as L
from tidewatch.plans.features import one_hot_features
from tidewatch.plans.fixtures import customers, outcome_counts, outcome_pairs
from tidewatch.schemas import NUMERIC, TARGET
from tidewatch.session import materialize, work_folder
from tidewatch.sources.readers import list_versions

# --- evaluation ----------------------------------------------------------------

_COUNTS = f"""counts AS (SELECT {count_if('true_label = 0 AND predicted_label = 0')} AS tn,
  {count_if('true_label = 0 AND predicted_label = 1')} AS fp, {count_if('true_label = 1 AND predicted_label = 0')} AS fn,
  {count_if('true_label = 1 AND predicted_label = 1')} AS tp FROM pairs)"""


def _per_class(counts: str) -> str:
    """CTEs: precision, recall, F1 and support per class, from a table of counts."""
    return f"""pr AS (
  SELECT '0' AS class, coalesce(tn / nullif(tn + fn, 0), 0) AS p, coalesce(tn / nullif(tn + fp, 0), 0) AS r, tn + fp AS support,
    (tp + tn) / (tp + tn + fp + fn) AS accuracy FROM {counts}
  UNION ALL SELECT '1', coalesce(tp / nullif(tp + fp, 0), 0), coalesce(tp / nullif(tp + fn, 0), 0), tp + fn,
    (tp + tn) / (tp + tn + fp + fn) FROM {counts}),
per_class AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM pr)"""


_CLASSES = _per_class("counts")
_POSITIVE = f"""metrics AS (SELECT {rnd('accuracy', 6)} AS accuracy, {rnd('p', 6)} AS precision, {rnd('r', 6)} AS recall,
  {rnd('f', 6)} AS f1_score FROM per_class WHERE class = '1')"""


@query("classification_metrics", on_pairs("SELECT * FROM metrics", _COUNTS, _CLASSES, _POSITIVE))
def classification_metrics(spark, folder):
    return V.classification_metrics(outcome_counts(spark, folder), weight="n")


def _weighted(c: str) -> str:
    return f"(sum({c} * support) / sum(support))"


@query(
    "classification_metrics_weighted",
    on_pairs(
        f"""SELECT {rnd('any_value(accuracy)', 6)} AS accuracy, {rnd(_weighted('p'), 6)} AS precision,
          {rnd(_weighted('r'), 6)} AS recall, {rnd(_weighted('f'), 6)} AS f1_score FROM per_class""",
        _COUNTS, _CLASSES,
    ),
)
def classification_metrics_weighted(spark, folder):
    return V.classification_metrics(outcome_counts(spark, folder), "weighted", weight="n")


@query(
    "classification_report",
    on_pairs(
        f"""SELECT class, {rnd('p', 6)} AS precision, {rnd('r', 6)} AS recall, {rnd('f', 6)} AS f1_score, support FROM per_class
        UNION ALL SELECT 'macro avg', {rnd('avg(p)', 6)}, {rnd('avg(r)', 6)}, {rnd('avg(f)', 6)}, CAST(sum(support) AS BIGINT) FROM per_class
        UNION ALL SELECT 'weighted avg', {rnd(_weighted('p'), 6)}, {rnd(_weighted('r'), 6)}, {rnd(_weighted('f'), 6)},
          CAST(sum(support) AS BIGINT) FROM per_class""",
        _COUNTS, _CLASSES,
    ),
)
def classification_report(spark, folder):
    return V.classification_report(outcome_counts(spark, folder), weight="n")


@query(
    "confusion_matrix",
    on_pairs(
        f"""SELECT tn, fp, fn, tp, {share('fp', '(tn + fp + fn + tp)')} AS false_alert_percentage,
          {share('fn', '(tn + fp + fn + tp)')} AS missed_percentage FROM counts""",
        _COUNTS,
    ),
)
def confusion_matrix(spark, folder):
    return V.confusion_matrix(outcome_counts(spark, folder), weight="n")


@query(
    "roc_auc",
    on_pairs(
        f"""SELECT CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives,
          {rnd('(sum(CAST(pos AS DOUBLE) * (CAST(upto AS DOUBLE) - neg / 2)) / (sum(pos) * CAST(sum(neg) AS DOUBLE)))', 9)} AS roc_auc
        FROM (SELECT pos, neg, sum(neg) OVER (ORDER BY prediction_probability) AS upto FROM (
          SELECT prediction_probability, {count_if('true_label = 1')} AS pos, {count_if('true_label = 0')} AS neg
          FROM pairs GROUP BY prediction_probability))"""
    ),
)
def roc_auc(spark, folder):
    return V.roc_auc(outcome_pairs(spark, folder))


@query(
    "model_gate",
    on_pairs(
        """SELECT 'accuracy' AS metric, accuracy AS value, 0.75e0 AS threshold, true AS enforced, accuracy >= 0.75 AS passed FROM metrics
        UNION ALL SELECT 'precision', precision, NULL, false, true FROM metrics
        UNION ALL SELECT 'recall', recall, NULL, false, true FROM metrics
        UNION ALL SELECT 'f1_score', f1_score, NULL, false, true FROM metrics""",
        _COUNTS, _CLASSES, _POSITIVE,
    ),
)
def model_gate(spark, folder):
    return V.model_gate(V.classification_metrics(outcome_counts(spark, folder), weight="n"))


_EVENT_HASH = "CAST('0x' || substring(md5('7|' || event_id), 1, 8) AS BIGINT)"


def _side_metrics(side: str, condition: str) -> list[str]:
    counts = _COUNTS.replace("counts AS", f"counts_{side} AS").replace("FROM pairs", f"FROM pairs WHERE {condition}")
    classes = _per_class(f"counts_{side}").replace("pr AS", f"pr_{side} AS").replace("per_class AS", f"class_{side} AS").replace("FROM pr)", f"FROM pr_{side})")
    metrics = _POSITIVE.replace("metrics AS", f"metrics_{side} AS").replace("FROM per_class", f"FROM class_{side}")
    return [counts, classes, metrics]


@query(
    "overfit_gap",
    on_pairs(
        " UNION ALL ".join(
            f"""SELECT '{m}' AS metric, a.{m} AS train_value, b.{m} AS test_value, {rnd(f'(a.{m} - b.{m})', 6)} AS gap,
              a.{m} - b.{m} <= 0.1 AS passed FROM metrics_train a, metrics_test b"""
            for m in ("accuracy", "precision", "recall", "f1_score")
        ),
        *_side_metrics("train", f"{_EVENT_HASH} >= 2147483648"),
        *_side_metrics("test", f"{_EVENT_HASH} < 2147483648"),
    ),
)
def overfit_gap(spark, folder):
    pairs = outcome_counts(spark, folder, (hash32(7, F.col("event_id")) < 2**31).alias("half"))
    return V.overfit_gap(pairs.where(~F.col("half")), pairs.where("half"), weight="n")


# --- models --------------------------------------------------------------------

_COMPLETE = " AND ".join(f'"{c}" IS NOT NULL' for c in NUMERIC)


@query(
    "assemble_features",
    on_customers(
        'SELECT "CustomerId", '
        + ", ".join(f'"{c}" * 1e0 AS f{i}' for i, c in enumerate(NUMERIC))
        + f', "Exited" * 1e0 AS label FROM customers WHERE {_COMPLETE}'
    ),
)
def assemble_features(spark, folder):
    df = L.assemble_features(customers(spark, folder), NUMERIC, TARGET, keep=["CustomerId"])
    array = vector_to_array("features")
    return df.select("CustomerId", *[array[i].alias(f"f{i}") for i in range(len(NUMERIC))], "label")


def _sides(spark, folder):
    features = materialize(one_hot_features(customers(spark, folder), STORED), "features")
    cols = [c for c in features.columns if c not in ("CustomerId", TARGET, "split")]
    return features.where("split = 'train'"), features.where("split = 'test'"), cols


_SCORED_AT = dt.datetime(2024, 1, 31)


def _trained(spark, folder, classifier):
    train, test, cols = _sides(spark, folder)
    model = L.train(train, classifier, cols, TARGET)
    scored = L.batch_score(model, test, ["CustomerId", TARGET], "batch_1", _SCORED_AT)
    return model, scored


def _test_metrics(scored):
    pairs = scored.select(
        F.col(TARGET).alias("true_label"), F.col("prediction").alias("predicted_label"),
        F.col("probability").alias("prediction_probability"),
    )
    return V.classification_metrics(pairs)


# What can be said of a model without its weights: how many test rows it scored, that its
# figures lie where they must, and that it ranks churners above others.
_JUDGED = on_customers(
    """SELECT count(*) AS scored, true AS in_range, true AS better_than_chance FROM sided WHERE split = 'test'""", *_CLEAN
)


def _judged(spark, folder, classifier):
    _, scored = _trained(spark, folder, classifier)
    scored = materialize(scored, "scored")
    found = _test_metrics(scored)
    names = [c for c in ("accuracy", "precision", "recall", "f1_score") if c in found.columns]
    inside = F.lit(True)
    for c in names:
        inside = inside & F.col(c).between(0, 1)
    count = scored.agg(F.count("prediction").alias("n")).scalar()
    # Half the area is what calling everyone the larger class would get.
    area = V.roc_auc(scored.select(F.col(TARGET).alias("true_label"), F.col("probability").alias("prediction_probability")))
    return found.select(count.alias("scored"), inside.alias("in_range"), (area.select("roc_auc").scalar() > 0.5).alias("better_than_chance"))


@query("train_random_forest", _JUDGED)
def train_random_forest(spark, folder):
    return _judged(spark, folder, L.random_forest())


@query("train_gbt", _JUDGED)
def train_gbt(spark, folder):
    return _judged(spark, folder, L.gradient_boosting())


@query("train_logistic", _JUDGED)
def train_logistic(spark, folder):
    return _judged(spark, folder, L.logistic())


@query(
    "batch_score",
    on_customers(
        """SELECT "CustomerId", true AS scored, true AS class_fits, true AS confidence_fits, true AS status_fits,
          'batch_1' AS batch_id, TIMESTAMP '2024-01-31' AS scored_at FROM sided WHERE split = 'test'""",
        *_CLEAN,
    ),
)
def batch_score(spark, folder):
    """Every test row is scored, and its class, status and confidence follow from its probability."""
    _, scored = _trained(spark, folder, L.logistic())
    p, churns = F.col("probability"), F.col("prediction") == 1
    return scored.select(
        "CustomerId", p.between(0, 1).alias("scored"), ((p > 0.5) == churns).alias("class_fits"),
        (F.col("confidence") == rounded(100 * p, 2)).alias("confidence_fits"),
        (F.col("status") == F.when(churns, "Churn").otherwise("Retain")).alias("status_fits"), "batch_id", "scored_at",
    )


_ALL_FEATURES = [*NUMERIC, "CreditScoreBins", *(f"{c}_{v}" for c, vs in STORED.items() for v in vs)]


@query(
    "feature_importance",
    " UNION ALL ".join(f"SELECT '{f}' AS feature, true AS is_share, true AS shares_add_up, count(*) > 0 AS trained FROM customer" for f in _ALL_FEATURES),
)
def feature_importance(spark, folder):
    """Each named feature once, with a share of the whole."""
    model, _ = _trained(spark, folder, L.random_forest(trees=20, depth=5))
    found = L.feature_importance(spark, model)
    whole = found.agg(F.sum("importance").alias("s")).scalar()
    return found.select(
        "feature", F.col("importance").between(0, 1).alias("is_share"), (F.abs(whole - 1) < 1e-9).alias("shares_add_up"), F.lit(True).alias("trained")
    )


@query("top_features", "SELECT unnest(range(1, 6)) AS rank, true AS not_above_the_one_before, 16 - 5 AS others_not_above FROM (SELECT count(*) FROM customer)")
def top_features(spark, folder):
    """Five features in falling order; none of the others weighs more than the last of them."""
    model, _ = _trained(spark, folder, L.logistic())
    every = L.feature_importance(spark, model)
    best = L.top_features(every, 5)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("importance"), "feature")  # five rows
    least = best.agg(F.min("importance").alias("m")).scalar()
    others = every.join(best.select("feature"), "feature", "left_anti").agg(
        F.count(F.when(F.col("importance") <= least, 1)).cast("int").alias("n")
    )
    return best.select(
        F.row_number().over(order).cast("bigint").alias("rank"),
        F.coalesce(F.col("importance") <= F.lag("importance").over(order), F.lit(True)).alias("not_above_the_one_before"),
        others.scalar().alias("others_not_above"),
    )


_DATASET = "20240101000000"
_TRAIN_ROWS = "(SELECT count(*) FROM sided WHERE split = 'train')"


def _save_versions(spark, folder):
    train, test, cols = _sides(spark, folder)
    root, n = work_folder(spark, "models"), train.count()
    L.save_model(L.train(train, L.logistic(iterations=5), cols, TARGET), root, "20240101000000", _DATASET, n)
    L.save_model(L.train(train, L.logistic(), cols, TARGET), root, "20240131000000", _DATASET, n)
    return root, test


@query(
    "model_save",
    on_customers(
        " UNION ALL ".join(
            f"""SELECT '{v}' AS run_ts, '{_DATASET}' AS dataset_version, 2 AS stages, 'LogisticRegressionModel' AS classifier,
              {_TRAIN_ROWS} AS train_rows""" for v in ("20240101000000", "20240131000000")
        ),
        *_CLEAN,
    ),
)
def model_save(spark, folder):
    """The stored versions and the dataset each was fitted on; all of them can be loaded."""
    root, _ = _save_versions(spark, folder)
    for v in list_versions(spark, root, "models"):
        L.load_model(spark, root, v)
    return L.lineage(spark, root)


@query(
    "model_load",
    on_customers("""SELECT "CustomerId", true AS same_as_saved FROM sided WHERE split = 'test'""", *_CLEAN),
)
def model_load(spark, folder):
    """The newest stored model scores every test row as the one named by its version does."""
    root, test = _save_versions(spark, folder)
    newest = L.batch_score(L.load_model(spark, root), test, ["CustomerId"], "batch_1", _SCORED_AT)
    named = L.batch_score(L.load_model(spark, root, "20240131000000"), test, ["CustomerId"], "batch_1", _SCORED_AT)
    pairs = newest.select("CustomerId", F.struct("prediction", "probability").alias("a")).join(
        named.select("CustomerId", F.struct("prediction", "probability").alias("b")), "CustomerId"
    )
    return pairs.select("CustomerId", F.col("a").eqNullSafe(F.col("b")).alias("same_as_saved"))


# --- insights ------------------------------------------------------------------

@query(
    "insights_report",
    on_pairs(
        f"""SELECT count(*) AS total, {count_if('predicted_label = 1')} AS predicted_churn, {count_if('predicted_label = 0')} AS predicted_stay,
          {count_if('true_label = 1')} AS true_churn, {count_if('true_label = 0')} AS true_stay,
          {share(count_if('correct_prediction'), 'count(*)')} AS accuracy_percentage,
          {share(count_if('predicted_label = 1'), 'count(*)')} AS churn_rate,
          {share(count_if('predicted_label = 0'), 'count(*)')} AS retention_rate,
          {count_if('prediction_probability > 0.7')} AS high_risk, {count_if('prediction_probability BETWEEN 0.3 AND 0.7')} AS medium_risk,
          {count_if('prediction_probability < 0.3')} AS low_risk,
          {count_if('prediction_probability > 0.8 OR prediction_probability < 0.2')} AS confident,
          {count_if('prediction_probability BETWEEN 0.4 AND 0.6')} AS uncertain,
          CASE WHEN {share(count_if('predicted_label = 1'), 'count(*)')} > 25 THEN 'HIGH'
               WHEN {share(count_if('predicted_label = 1'), 'count(*)')} > 15 THEN 'MODERATE' ELSE 'LOW' END AS risk_level
        FROM pairs"""
    ),
)
def insights_report(spark, folder):
    return V.insights(outcome_pairs(spark, folder))
