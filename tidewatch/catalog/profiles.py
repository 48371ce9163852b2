"""Profiles: distributions, missing values, column statistics, duplicates."""

from __future__ import annotations

from tidewatch.catalog.registry import query
from tidewatch.catalog.sqltext import CUSTOMERS, on_customers, rnd, share
from tidewatch.operators import profile as P
from tidewatch.operators.reports import top_values, value_distribution
from tidewatch.plans.fixtures import customers, table
from tidewatch.schemas import CUSTOMER, NUMERIC

_NAMES = [f.name for f in CUSTOMER.fields]
_TEXT = {"Firstname", "Lastname", "Geography", "Gender"}
_TYPES = {f.name: f.dataType.simpleString() for f in CUSTOMER.fields}


@query(
    "value_distribution",
    on_customers(
        f"""SELECT "Exited" AS value, count(*) AS count,
          {share('count(*)', '(SELECT count(*) FROM customers)')} AS percentage FROM customers GROUP BY 1"""
    ),
)
def distribution(spark, folder):
    return value_distribution(customers(spark, folder), "Exited")


@query(
    "missing_profile",
    "WITH " + CUSTOMERS + " " + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) - count("{c}") AS missing_count,
          {share(f'(count(*) - count("{c}"))', 'count(*)')} AS missing_percentage FROM customers"""
        for c in _NAMES
    ),
)
def missing(spark, folder):
    return P.missing_profile(customers(spark, folder))


def _profile_row(c: str) -> str:
    number = [rnd(f'{f}("{c}")', 6) if c not in _TEXT else "CAST(NULL AS DOUBLE)" for f in ("avg", "stddev_samp", "min", "max")]
    return f"""SELECT '{c}' AS "column", '{_TYPES[c]}' AS data_type, count(*) AS total_rows,
      {len(_NAMES)} AS total_columns, count("{c}") AS non_null, {number[0]} AS mean, {number[1]} AS stddev,
      {number[2]} AS min, {number[3]} AS max FROM customers"""


@query("dataset_profile", "WITH " + CUSTOMERS + " " + " UNION ALL ".join(map(_profile_row, _NAMES)))
def dataset(spark, folder):
    return P.dataset_profile(customers(spark, folder))


def _numeric_row(c: str) -> str:
    q = [rnd(f'quantile_cont("{c}", {p})', 6) for p in (0.25, 0.5, 0.75)]
    return f"""SELECT '{c}' AS "column", count(*) - count("{c}") AS null_count,
      {share(f'(count(*) - count("{c}"))', 'count(*)')} AS null_percentage, {rnd(f'avg("{c}")', 6)} AS mean,
      {rnd(f'stddev_samp("{c}")', 6)} AS stddev, {rnd(f'min("{c}")', 6)} AS min, {rnd(f'max("{c}")', 6)} AS max,
      {q[0]} AS q1, {q[1]} AS median, {q[2]} AS q3 FROM customers"""


@query("numeric_column_stats", "WITH " + CUSTOMERS + " " + " UNION ALL ".join(map(_numeric_row, NUMERIC)))
def numeric_stats(spark, folder):
    return P.numeric_column_stats(customers(spark, folder), NUMERIC)


def _text_rows(c: str) -> str:
    return f"""SELECT * FROM (SELECT '{c}' AS "column",
        (SELECT count(DISTINCT "{c}") FROM customers) AS distinct_count, "{c}" AS value, count(*) AS count
      FROM customers WHERE "{c}" IS NOT NULL GROUP BY "{c}" ORDER BY count DESC, value LIMIT 10)"""


_PROFILED = ["Geography", "Gender", "Firstname", "Lastname"]


@query("categorical_column_stats", "WITH " + CUSTOMERS + " " + " UNION ALL ".join(map(_text_rows, _PROFILED)))
def categorical_stats(spark, folder):
    return P.categorical_column_stats(customers(spark, folder), _PROFILED)


@query(
    "duplicate_count",
    f"""WITH groups AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
    SELECT CAST(sum(n) AS BIGINT) AS total_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows,
      {share('sum(n - 1)', 'sum(n)')} AS duplicate_percentage FROM groups""",
)
def duplicates(spark, folder):
    return P.duplicate_count(table(spark, folder, "events").select("user_id", "event_type"))


@query(
    "top_values",
    """SELECT user_id AS value, count(*) AS count FROM events GROUP BY user_id
    ORDER BY count DESC, value LIMIT 10""",
)
def top(spark, folder):
    return top_values(table(spark, folder, "events"), "user_id")
