"""SQL building blocks of the twins (DuckDB dialect)."""

from __future__ import annotations


def rnd(value: str, places: int) -> str:
    return f"CAST(round(CAST({value} AS DECIMAL(28,9)), {places}) AS DOUBLE)"


def share(part: str, whole: str, places: int = 2) -> str:
    return rnd(f"(100e0 * {part} / nullif({whole}, 0))", places)


def count_if(condition: str) -> str:
    return f"count(CASE WHEN {condition} THEN 1 END)"


def hash32(seed: int, *keys: str) -> str:
    parts = " || '|' || ".join([f"'{seed}'", *[f"coalesce(CAST({k} AS VARCHAR), '')" for k in keys]])
    return f"CAST('0x' || substring(md5({parts}), 1, 8) AS BIGINT)"


PREDICTIONS = """predictions AS (
  SELECT CAST(e.event_id AS VARCHAR) AS event_id, CAST(e.user_id AS VARCHAR) AS customer_id,
    CAST(CASE WHEN e.value >= 100 THEN 1 ELSE 0 END AS INTEGER) AS prediction,
    least(e.value / 200, 1e0) AS probability,
    CASE WHEN e.value >= 100 THEN least(e.value / 200, 1e0) ELSE 1 - least(e.value / 200, 1e0) END AS risk_score,
    CAST(e.ts AS TIMESTAMP) AS predicted_at, 'rule_v1' AS model_version,
    r.r_name AS geography,
    CASE WHEN c.c_custkey IS NULL THEN NULL WHEN c.c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
    CAST(18 + (31 * c.c_custkey) % 75 AS INTEGER) AS age, CAST(c.c_custkey % 11 AS INTEGER) AS tenure,
    c.c_acctbal AS balance, CAST(1 + c.c_custkey % 4 AS INTEGER) AS num_of_products,
    CASE WHEN c.c_custkey IS NULL THEN NULL WHEN c.c_custkey % 3 <> 0 THEN 1 ELSE 0 END AS has_cr_card,
    CASE WHEN c.c_custkey IS NULL THEN NULL WHEN c.c_custkey % 5 < 3 THEN 1 ELSE 0 END AS is_active_member
  FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id
  LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
  LEFT JOIN region r ON r.r_regionkey = n.n_regionkey),
clock AS (SELECT max(CAST(ts AS TIMESTAMP)) AS as_of FROM events)"""

CUSTOMERS = f"""per_customer AS (
  SELECT o_custkey, count(*) AS n_orders, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS spent,
    max(o_orderdate) AS newest FROM orders GROUP BY o_custkey),
customers AS (
  SELECT c_custkey + 1 AS "RowNumber", c_custkey AS "CustomerId",
    CASE WHEN c_custkey % 89 <> 0 THEN c_mktsegment END AS "Firstname", n_name AS "Lastname",
    CAST(350 + (7919 * c_custkey) % 501 AS INTEGER) AS "CreditScore", r_name AS "Geography",
    CASE WHEN c_custkey % 97 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS "Gender",
    CAST(CASE WHEN c_custkey % 17 <> 0 THEN 18 + (31 * c_custkey) % 75 END AS INTEGER) AS "Age",
    CAST(c_custkey % 11 AS INTEGER) AS "Tenure", c_acctbal AS "Balance",
    CAST(least(4, 1 + coalesce(n_orders, 0) // 6) AS INTEGER) AS "NumOfProducts",
    CASE WHEN c_custkey % 3 <> 0 THEN 1 ELSE 0 END AS "HasCrCard",
    CASE WHEN c_custkey % 5 < 3 THEN 1 ELSE 0 END AS "IsActiveMember",
    {rnd("(CAST(spent AS DOUBLE) / n_orders)", 2)} AS "EstimatedSalary",
    CASE WHEN newest IS NULL OR newest < (SELECT max(o_orderdate) - INTERVAL 365 DAY FROM orders)
      THEN 1 ELSE 0 END AS "Exited"
  FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
  LEFT JOIN region ON r_regionkey = n_regionkey
  LEFT JOIN per_customer ON o_custkey = c_custkey)"""

PAIRS = f"""{CUSTOMERS},
pairs AS (
  SELECT CAST(e.event_id AS VARCHAR) AS event_id, c."Exited" AS true_label,
    CASE WHEN e.value >= 100 THEN 1 ELSE 0 END AS predicted_label,
    least(e.value / 200, 1e0) AS prediction_probability,
    (CASE WHEN e.value >= 100 THEN 1 ELSE 0 END) = c."Exited" AS correct_prediction
  FROM events e JOIN customers c ON c."CustomerId" = e.user_id)"""


def on_predictions(body: str, *more: str) -> str:
    return "WITH " + ", ".join([PREDICTIONS, *more]) + " " + body


def on_customers(body: str, *more: str) -> str:
    return "WITH " + ", ".join([CUSTOMERS, *more]) + " " + body


def on_pairs(body: str, *more: str) -> str:
    return "WITH " + ", ".join([PAIRS, *more]) + " " + body
