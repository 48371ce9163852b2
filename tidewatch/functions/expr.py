"""Column expressions shared by the batch and the streaming jobs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: the alert threshold of the dashboards and of the alert job.
HIGH_RISK = 0.7


def rounded(value: Column, places: int) -> Column:
    """Round half away from zero, as a SQL ``numeric`` does.

    Going through a decimal makes a sum that differs only in its last binary
    digits (another partitioning, another engine) round to the same number.
    """
    return F.round(value.cast("decimal(28,9)"), places).cast("double")


def share(part: Column, whole: Column, places: int = 2) -> Column:
    """``part`` as a percentage of ``whole``; null when ``whole`` is 0."""
    return rounded(F.try_divide(F.lit(100.0) * part, whole), places)


def count_if(condition: Column) -> Column:
    """How many rows satisfy ``condition``; null counts as no, no rows give 0."""
    return F.count(F.when(condition, F.lit(1)))


def naive(ts: dt.datetime) -> Column:
    """A datetime as a zone-less constant, whatever the zone of the session."""
    return F.lit(ts.isoformat(sep=" ")).cast("timestamp_ntz")


_EPOCH = "TIMESTAMP '1970-01-01 00:00:00Z'"
_EPOCH_CLOCK = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def utc_instant(text: Column) -> Column:
    """The instant an ISO text names, in UTC unless it says otherwise; null if it is none."""
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.try_to_timestamp(F.when(zoned, text).otherwise(F.concat(text, F.lit("Z"))))


def utc_clock(instant: Column) -> Column:
    """What a clock in UTC shows at an instant."""
    return F.expr(_EPOCH_CLOCK) + (instant - F.expr(_EPOCH))


def earlier(as_of: DataFrame | dt.datetime, interval: str) -> Column:
    """The instant ``interval`` before ``as_of``, as one constant.

    ``as_of`` is a datetime, or a one-row one-column DataFrame.  In the latter
    case the subtraction happens inside the subquery: the comparison that uses
    it is then ``column >= constant`` and reaches the Parquet reader.
    """
    if isinstance(as_of, DataFrame):
        name = as_of.columns[0]
        return as_of.select(F.col(name) - F.expr(f"INTERVAL {interval}")).scalar()
    return naive(as_of) - F.expr(f"INTERVAL {interval}")


def instant(as_of: DataFrame | dt.datetime) -> Column:
    """``as_of`` itself as a constant."""
    if isinstance(as_of, DataFrame):
        return as_of.scalar()
    return naive(as_of)


def hour_of(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def risk_score(probability: Column, prediction: Column, mode: str = "certainty") -> Column:
    """Risk of a scored row.

    ``certainty`` is the published rule: the probability of the *predicted*
    class, so a safe customer with p = 0.1 has risk 0.9.  ``probability`` is
    the churn probability itself.
    """
    if mode == "probability":
        return probability
    if mode != "certainty":
        raise ValueError(f"unknown risk mode {mode!r}")
    return F.when(prediction == 1, probability).otherwise(1 - probability)


def churn_label(prediction: Column, churn: str = "CHURN", retain: str = "RETAIN") -> Column:
    return F.when(prediction == 1, churn).otherwise(retain)


def hash32(seed: int, *keys: Column) -> Column:
    """Uniform integer in [0, 2**32) from ``keys``.

    Depends on the values alone, never on partitioning, and any SQL engine
    with md5 can reproduce it.  A null key hashes as an empty string.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def banded(value: Column, bands: list[tuple[str, Column]], default: str | None) -> Column:
    """First label whose condition holds."""
    out = None
    for label, condition in bands:
        out = F.when(condition, label) if out is None else out.when(condition, label)
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)
