"""Classifier metrics as SQL aggregates.

Inputs have ``true_label`` and ``predicted_label`` in {0, 1}.  One aggregation
gives the four counts; all metrics are expressions on that row.  ``weight`` names
a column that says how many predictions a row stands for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.expr import count_if, rounded, share
from tidewatch.functions.stats import running_counts


def weighted_count(condition: Column, weight: str | None) -> Column:
    if weight is None:
        return count_if(condition)
    return F.coalesce(F.sum(F.when(condition, F.col(weight))), F.lit(0).cast("bigint"))


def confusion_counts(pairs: DataFrame, weight: str | None = None) -> DataFrame:
    truth, said = F.col("true_label"), F.col("predicted_label")
    return pairs.agg(
        weighted_count((truth == 0) & (said == 0), weight).alias("tn"),
        weighted_count((truth == 0) & (said == 1), weight).alias("fp"),
        weighted_count((truth == 1) & (said == 0), weight).alias("fn"),
        weighted_count((truth == 1) & (said == 1), weight).alias("tp"),
    )


def prediction_summary(pairs: DataFrame, weight: str | None = None) -> DataFrame:
    """Predicted and true class totals, and the accuracy."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return confusion_counts(pairs, weight).select(
        _total().alias("total_predictions"),
        (fp + tp).alias("predicted_churn"),
        (tn + fn).alias("predicted_stay"),
        (fn + tp).alias("true_churn"),
        (tn + fp).alias("true_stay"),
        rounded(F.try_divide((tn + tp).cast("double"), _total()), 6).alias("accuracy"),
    )


def confusion_matrix(pairs: DataFrame, weight: str | None = None) -> DataFrame:
    total = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return confusion_counts(pairs, weight).select(
        "tn", "fp", "fn", "tp",
        share(F.col("fp"), total).alias("false_alert_percentage"),
        share(F.col("fn"), total).alias("missed_percentage"),
    )


def _ratio(part: Column, whole: Column) -> Column:
    """0 where the denominator is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _class_metrics(label: int) -> dict[str, Column]:
    hit, said_wrongly, missed = ("tp", "fp", "fn") if label == 1 else ("tn", "fn", "fp")
    precision = _ratio(F.col(hit), F.col(hit) + F.col(said_wrongly))
    recall = _ratio(F.col(hit), F.col(hit) + F.col(missed))
    return {
        "precision": precision,
        "recall": recall,
        "f1_score": _ratio(2 * precision * recall, precision + recall),
        "support": F.col(hit) + F.col(missed),
    }


def _total() -> Column:
    return F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")


def _weighted(metric: str) -> Column:
    zero, one = _class_metrics(0), _class_metrics(1)
    return _ratio(zero[metric] * zero["support"] + one[metric] * one["support"], _total())


def classification_metrics(pairs: DataFrame, average: str = "positive", weight: str | None = None) -> DataFrame:
    """Accuracy, precision, recall and F1 of the churn class, or weighted by support."""
    if average not in ("positive", "weighted"):
        raise ValueError(f"unknown average {average!r}")
    metrics = ["precision", "recall", "f1_score"]
    values = _class_metrics(1) if average == "positive" else {m: _weighted(m) for m in metrics}
    return confusion_counts(pairs, weight).select(
        rounded(_ratio(F.col("tp") + F.col("tn"), _total()), 6).alias("accuracy"),
        *[rounded(values[m], 6).alias(m) for m in metrics],
    )


def classification_report(pairs: DataFrame, weight: str | None = None) -> DataFrame:
    """Precision, recall, F1 and support per class, and their macro and weighted averages."""
    zero, one = _class_metrics(0), _class_metrics(1)
    metrics = ["precision", "recall", "f1_score"]

    def row(name: str, values: dict[str, Column], support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"), *[rounded(values[m], 6).alias(m) for m in metrics], support.alias("support")
        )

    rows = [
        row("0", zero, zero["support"]),
        row("1", one, one["support"]),
        row("macro avg", {m: (zero[m] + one[m]) / 2 for m in metrics}, _total()),
        row("weighted avg", {m: _weighted(m) for m in metrics}, _total()),
    ]
    return confusion_counts(pairs, weight).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def roc_auc(pairs: DataFrame, score: str = "prediction_probability") -> DataFrame:
    """Exact area under the ROC curve; equal scores count one half.

    Equal scores are merged first, and the order over scores is built in ranges.
    """
    points = pairs.groupBy(F.col(score).alias("value")).agg(
        count_if(F.col("true_label") == 1).alias("positives"),
        count_if(F.col("true_label") == 0).alias("negatives"),
    )
    ordered = running_counts(points, ["negatives"])
    below = F.col("upto_negatives") - F.col("negatives") / 2
    area = F.sum(F.col("positives").cast("double") * below.cast("double"))
    positives, negatives = F.sum("positives"), F.sum("negatives")
    return ordered.agg(
        positives.alias("positives"),
        negatives.alias("negatives"),
        rounded(F.try_divide(area, positives.cast("double") * negatives.cast("double")), 9).alias("roc_auc"),
    )


def model_gate(metrics: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """One row per metric; only metrics with a threshold decide."""
    thresholds = {"accuracy": 0.75} if thresholds is None else thresholds
    rows = [
        F.struct(
            F.lit(m).alias("metric"),
            F.col(m).alias("value"),
            F.lit(thresholds.get(m)).cast("double").alias("threshold"),
            F.lit(m in thresholds).alias("enforced"),
            (F.col(m) >= thresholds[m] if m in thresholds else F.lit(True)).alias("passed"),
        )
        for m in metrics.columns
    ]
    return metrics.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def overfit_gap(train: DataFrame, test: DataFrame, limit: float = 0.10, weight: str | None = None) -> DataFrame:
    """Per metric the training value minus the test value."""
    a = classification_metrics(train, weight=weight)
    b = classification_metrics(test, weight=weight).select(F.struct("*").alias("t"))
    joined = a.withColumn("t", b.scalar())
    rows = [
        F.struct(
            F.lit(m).alias("metric"),
            F.col(m).alias("train_value"),
            F.col(f"t.{m}").alias("test_value"),
            rounded(F.col(m) - F.col(f"t.{m}"), 6).alias("gap"),
            (F.col(m) - F.col(f"t.{m}") <= limit).alias("passed"),
        )
        for m in a.columns
    ]
    return joined.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def insights(pairs: DataFrame) -> DataFrame:
    """One row about a scored batch: predicted and true classes, rates, risk and confidence bands.

    The bands are those of the segment reports: above 0.7 high, 0.3 to 0.7 medium; beyond 0.2
    and 0.8 confident, 0.4 to 0.6 uncertain.  An empty batch has counts of 0 and no rates.
    """
    p, guess, truth = F.col("prediction_probability"), F.col("predicted_label"), F.col("true_label")
    counts = pairs.agg(
        F.count("*").alias("total"), count_if(guess == 1).alias("predicted_churn"), count_if(guess == 0).alias("predicted_stay"),
        count_if(truth == 1).alias("true_churn"), count_if(truth == 0).alias("true_stay"), count_if(guess == truth).alias("_right"),
        count_if(p > 0.7).alias("high_risk"), count_if(p.between(0.3, 0.7)).alias("medium_risk"), count_if(p < 0.3).alias("low_risk"),
        count_if((p > 0.8) | (p < 0.2)).alias("confident"), count_if(p.between(0.4, 0.6)).alias("uncertain"),
    )
    rates = counts.withColumns({
        "accuracy_percentage": share(F.col("_right"), F.col("total")), "churn_rate": share(F.col("predicted_churn"), F.col("total")),
        "retention_rate": share(F.col("predicted_stay"), F.col("total")),
    })
    level = F.when(F.col("churn_rate") > 25, "HIGH").when(F.col("churn_rate") > 15, "MODERATE").otherwise("LOW")
    return rates.withColumn("risk_level", F.when(F.col("total") > 0, level)).drop("_right")
