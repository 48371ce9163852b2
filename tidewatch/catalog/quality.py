"""Data checks and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.catalog.registry import query
from tidewatch.catalog.sqltext import CUSTOMERS, count_if, on_customers, rnd, share
from tidewatch.operators import quality as Q
from tidewatch.operators.reports import union_all
from tidewatch.plans.fixtures import customers, table
from tidewatch.schemas import CATEGORICAL, CUSTOMER, NUMERIC, REQUIRED

_WIDTH = len(CUSTOMER.fields)
# Categories the fixture may have: one of its regions is left out, so the check has something to find.
ALLOWED = {"Geography": ["AFRICA", "AMERICA", "ASIA", "EUROPE"], "Gender": ["Male", "Female"]}


def _rule(check: str, column: str, observed: str, threshold: str, passed: str) -> str:
    return f"""SELECT '{check}' AS "check", '{column}' AS "column", {rnd(observed, 6)} AS observed,
      CAST({threshold} AS DOUBLE) AS threshold, coalesce({passed}, true) AS passed FROM customers"""


_SHAPE = [
    _rule("rows", "*", "count(*)", "5000", "count(*) >= 5000"),
    _rule("columns", "*", f"max({_WIDTH})", "12", f"max({_WIDTH}) >= 12"),
]
_COLUMNS = [_rule("required_column", c, f'count("{c}")', "NULL", "true") for c in REQUIRED]
_TYPES = [_rule("numeric_type", c, f'count("{c}")', "NULL", "true") for c in (*NUMERIC, "Exited")] + [
    _rule("text_type", c, f'count("{c}")', "NULL", "true") for c in CATEGORICAL
]
_RANGES = [
    rule
    for c, (low, high) in Q.RANGES.items()
    for rule in (
        _rule("minimum", c, f'min("{c}")', str(low), f'min("{c}") >= {low}'),
        _rule("maximum", c, f'max("{c}")', str(high), f'max("{c}") <= {high}'),
    )
]


def _invalid(c: str, allowed) -> str:
    values = ", ".join(f"'{v}'" for v in allowed)
    return count_if(f'"{c}" IS NULL OR "{c}" NOT IN ({values})')


def _category_rules(allowed) -> list[str]:
    return [
        _rule("invalid_category", c, _invalid(c, values), "0", f"{_invalid(c, values)} = 0")
        for c, values in allowed.items()
    ]


def _missing(c: str) -> str:
    return f'(100e0 * (count(*) - count("{c}")) / count(*))'


_MISSING = [_rule("missing_percentage", c, _missing(c), "8", f"{_missing(c)} <= 8") for c in REQUIRED]
_ZERO = f"""(100e0 * {count_if('"Exited" = 0')} / count(*))"""
_ONE = f"""(100e0 * {count_if('"Exited" = 1')} / count(*))"""
_BALANCE = [
    _rule("minority_percentage", "Exited", f"least({_ZERO}, {_ONE})", "20", f"least({_ZERO}, {_ONE}) >= 20"),
    _rule("majority_percentage", "Exited", f"greatest({_ZERO}, {_ONE})", "80", f"greatest({_ZERO}, {_ONE}) <= 80"),
    _rule("imbalance_ratio", "Exited", f"(greatest({_ZERO}, {_ONE}) / least({_ZERO}, {_ONE}))", "NULL", "true"),
]


def _duplicates(check: str, column: str, keys: str) -> str:
    rate = "(100e0 * sum(n - 1) / sum(n))"
    return f"""SELECT '{check}' AS "check", '{column}' AS "column", {rnd(rate, 6)} AS observed, 1e0 AS threshold,
      {rate} <= 1 AS passed FROM (SELECT count(*) AS n FROM customers GROUP BY {keys})"""


_DUPLICATES = [
    _duplicates("duplicate_keys", "CustomerId", '"CustomerId"'),
    _duplicates("duplicate_rows", "*", ", ".join(f'"{f.name}"' for f in CUSTOMER.fields)),
]


def _all(rules: list[str]) -> str:
    return "WITH " + CUSTOMERS + " " + " UNION ALL ".join(rules)


@query("check_shape", _all(_SHAPE))
def check_shape(spark, folder):
    df = customers(spark, folder)
    return Q.rules_frame(df, Q.shape_rules(df))


@query("check_required_columns", _all(_COLUMNS))
def check_required_columns(spark, folder):
    df = customers(spark, folder)
    return Q.rules_frame(df, Q.column_rules(df))


@query("check_types", _all(_TYPES))
def check_types(spark, folder):
    df = customers(spark, folder)
    return Q.rules_frame(df, Q.type_rules(df))


@query("check_ranges", _all(_RANGES))
def check_ranges(spark, folder):
    df = customers(spark, folder)
    return Q.rules_frame(df, Q.range_rules(df))


@query("check_categories", _all(_category_rules(ALLOWED)))
def check_categories(spark, folder):
    df = customers(spark, folder)
    return Q.rules_frame(df, Q.category_rules(df, ALLOWED))


@query("check_missing", _all(_MISSING))
def check_missing(spark, folder):
    df = customers(spark, folder)
    return Q.rules_frame(df, Q.missing_rules(df))


@query("check_duplicates", _all(_DUPLICATES))
def check_duplicates(spark, folder):
    return Q.check_duplicates(customers(spark, folder))


@query("check_class_balance", _all(_BALANCE))
def check_class_balance(spark, folder):
    df = customers(spark, folder)
    return Q.rules_frame(df, Q.balance_rules(df))


@query(
    "set_difference",
    on_customers(
        """SELECT 'Geography' AS "column", "Geography" AS value, count(*) AS count FROM customers
          WHERE "Geography" IS NULL OR "Geography" NOT IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE') GROUP BY "Geography"
        UNION ALL SELECT 'Gender', "Gender", count(*) FROM customers
          WHERE "Gender" IS NULL OR "Gender" NOT IN ('Male', 'Female') GROUP BY "Gender" """
    ),
)
def set_difference(spark, folder):
    df = customers(spark, folder)
    return union_all([Q.unexpected_values(df, c, values) for c, values in ALLOWED.items()])


# --- drift -------------------------------------------------------------------

_SIDES = """sides AS (
  SELECT CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 1 ELSE 0 END AS r, value,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events),
points AS (
  SELECT feature, value, sum(r) AS r, sum(1 - r) AS c FROM (
    SELECT 'value' AS feature, value, r FROM sides WHERE value IS NOT NULL AND NOT isnan(value)
    UNION ALL SELECT 'k', k, r FROM sides WHERE k IS NOT NULL) GROUP BY feature, value),
steps AS (
  SELECT feature, sum(r) OVER w AS ur, sum(c) OVER w AS uc,
    sum(r) OVER (PARTITION BY feature) AS n1, sum(c) OVER (PARTITION BY feature) AS n2
  FROM points WINDOW w AS (PARTITION BY feature ORDER BY value)),
measured AS (
  SELECT feature, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2,
    max(abs(CAST(ur AS DOUBLE) / n1 - CAST(uc AS DOUBLE) / n2)) AS d FROM steps GROUP BY feature, n1, n2),
scaled AS (SELECT *, sqrt(CAST(n1 AS DOUBLE) * n2 / (CAST(n1 AS DOUBLE) + n2)) * d AS x FROM measured),
tested AS (
  SELECT *, CASE WHEN x < 0.04e0 THEN 1e0 ELSE greatest(0e0, least(1e0,
    list_sum([(CASE WHEN i % 2 = 1 THEN 2e0 ELSE -2e0 END) * exp(-2e0 * i * i * x * x) for i in range(1, 101)]))) END AS p
  FROM scaled)"""


def _drift(spark, folder):
    events = table(spark, folder, "events").select(
        "ts", "value", F.get_json_object("props", "$.k").try_cast("double").alias("k")
    )
    middle = F.lit("2024-01-15").cast("timestamp_ntz")
    return Q.drift_ks(events.where(F.col("ts") >= middle), events.where(F.col("ts") < middle), ["value", "k"])


@query(
    "drift_ks",
    f"""WITH {_SIDES} SELECT feature AS "column", n1 AS reference_rows, n2 AS current_rows, {rnd('d', 9)} AS statistic,
      {rnd('p', 6)} AS p_value, CASE WHEN p < 0.01 THEN 'HIGH' WHEN p < 0.05 THEN 'MEDIUM' ELSE 'NONE' END AS severity,
      p >= 0.01 AS passed FROM tested""",
)
def drift_ks(spark, folder):
    return _drift(spark, folder)


_LINES = {
    "Shape": _SHAPE, "Required Columns": _COLUMNS, "Data Types": _TYPES, "Value Ranges": _RANGES,
    "Categorical Values": _category_rules(Q.ALLOWED), "Missing Values": _MISSING, "Duplicates": _DUPLICATES,
    "Class Balance": _BALANCE,
}
_REPORT = (
    "found AS ("
    + " UNION ALL ".join(f"SELECT '{name}' AS name, passed FROM ({rule})" for name, rules in _LINES.items() for rule in rules)
    + " UNION ALL SELECT 'Data Drift', p >= 0.01 FROM tested)"
)


@query(
    "validation_report",
    on_customers(
        """SELECT coalesce(name, 'Total') AS name, count(*) AS rules, count(CASE WHEN NOT passed THEN 1 END) AS failed_rules,
          CASE WHEN count(CASE WHEN NOT passed THEN 1 END) = 0 THEN 'PASS' ELSE 'FAIL' END AS status
        FROM found GROUP BY ROLLUP (name)""",
        _SIDES, _REPORT,
    ),
)
def validation_report(spark, folder):
    return Q.validation_report(customers(spark, folder), _drift(spark, folder))
