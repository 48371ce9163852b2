"""Column selection, casts and event payloads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidewatch.functions.expr import utc_instant
from tidewatch.schemas import IDENTIFIERS, TARGET

CORRUPT = "_corrupt"

# The ordered model matrix.
MODEL_COLUMNS = [
    "CreditScore", "Age", "Tenure", "Balance", "NumOfProducts", "HasCrCard", "IsActiveMember",
    "EstimatedSalary", "CreditScoreBins", "Geography_France", "Geography_Germany",
    "Geography_Spain", "Gender_Female", "Gender_Male",
]

# The defaults of an incoming event.
EVENT_DEFAULTS = {
    "CustomerId": ("bigint", 0),
    "Geography": ("string", "Unknown"),
    "Gender": ("string", "Unknown"),
    "Age": ("int", 0),
    "CreditScore": ("int", 600),
    "Balance": ("double", 0.0),
    "EstimatedSalary": ("double", 0.0),
    "Tenure": ("int", 0),
    "NumOfProducts": ("int", 1),
    "HasCrCard": ("int", 0),
    "IsActiveMember": ("int", 0),
}


def drop_identifiers(df: DataFrame, cols: Sequence[str] = IDENTIFIERS) -> DataFrame:
    return df.drop(*cols)


def model_columns(categories: Mapping[str, Sequence[str]]) -> list[str]:
    """The model matrix for other category values than the default ones."""
    numbers = MODEL_COLUMNS[: MODEL_COLUMNS.index("CreditScoreBins") + 1]
    return numbers + [f"{c}_{v}" for c, values in categories.items() for v in values]


def align_features(
    df: DataFrame, expected: Sequence[str] = MODEL_COLUMNS, keep: Sequence[str] = ()
) -> DataFrame:
    """Exactly ``expected`` in that order: absent columns become 0, others go."""
    present = set(df.columns)
    return df.select(
        *keep, *[F.col(f"`{c}`") if c in present else F.lit(0).alias(c) for c in expected]
    )


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast the columns that exist; a text that does not parse becomes null."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items() if c in df.columns})


def null_or_empty(df: DataFrame, column: str) -> Column:
    c = F.col(column)
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType):
        return c.isNull() | (c == "")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def feature_target(df: DataFrame, target: str = TARGET) -> tuple[DataFrame, DataFrame]:
    """X and y.  Prefer keeping the label in the row: the two cannot be rejoined by position."""
    return df.drop(target), df.select(target)


def event_payload(df: DataFrame, cols: Sequence[str], keep_nulls: bool = True) -> Column:
    """The columns as one JSON object; null fields are written unless told otherwise."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false" if keep_nulls else "true"})


def enveloped(data: Column, timestamp: Column) -> Column:
    """The message around an event: ``{"timestamp": …, "data": {…}}``."""
    return F.to_json(F.struct(timestamp.alias("timestamp"), data.alias("data")))


def event_struct() -> T.StructType:
    """What a message may hold: the fields at the top, or under ``data``.

    Scalars are read as text, so that a number in another form (42.0, "42") does not
    make the message unreadable.
    """
    fields = [T.StructField(n, T.StringType()) for n in EVENT_DEFAULTS]
    fields += [T.StructField("event_id", T.StringType()), T.StructField("event_timestamp", T.StringType())]
    return T.StructType([*fields, T.StructField("timestamp", T.StringType()), T.StructField("data", T.StructType(fields))])


def _typed(text: Column, kind: str) -> Column:
    """A scalar of a message; null if it is none of its kind.  Whole numbers may be
    written with a fraction, which is cut off."""
    if kind == "string":
        return text
    direct = text.try_cast(kind)
    return direct if kind == "double" else F.coalesce(direct, text.try_cast("double").try_cast(kind))


def event_records(value: Column, origin: Column, arrived: Column | None = None) -> Column:
    """The event of a message, as an array of one struct: every field with its default,
    event_id, event_time, and whether the message is malformed.

    ``inline`` unfolds it.  Parsing happens once, inside the array: later steps, filters
    too, only read columns.  Malformed is what is no JSON, a value that its field cannot
    take, or a time that is none.  The fields come from ``data`` when the message has one,
    else from the message itself; JSON null and an absent field take the default.

    An event without a time has that of its message (``arrived``), one without an id gets
    it from customer and second, or without any time from the message's ``origin``.
    """
    schema = event_struct().add(CORRUPT, "string")
    parsed = F.from_json(value, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return F.transform(F.array(parsed), lambda m: _event(m, origin, arrived))


def _event(m: Column, origin: Column, arrived: Column | None) -> Column:
    data = m["data"]
    nested = data.isNotNull()
    pick = lambda name: F.when(nested, data[name]).otherwise(m[name])
    stamp = F.coalesce(m["timestamp"], pick("event_timestamp"))
    stated = utc_instant(stamp)
    bad = m.isNull() | m[CORRUPT].isNotNull() | (stamp.isNotNull() & stated.isNull())
    values = {}
    for name, (kind, default) in EVENT_DEFAULTS.items():
        text = pick(name)
        typed = _typed(text, kind)
        bad = bad | (text.isNotNull() & typed.isNull())
        values[name] = F.coalesce(typed, F.lit(default).cast(kind))
    at = stated if arrived is None else F.coalesce(stated, arrived)
    second = F.coalesce(F.unix_seconds(at).cast("string"), origin)
    fallback = F.concat(F.lit("evt_"), values["CustomerId"].cast("string"), F.lit("_"), second)
    identity = F.coalesce(m["event_id"], data["event_id"], fallback)
    fields = {**values, "event_id": identity, "event_time": at, "malformed": F.coalesce(bad, F.lit(True))}
    return F.struct(*[c.alias(n) for n, c in fields.items()])
