"""Missing values and outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.catalog.registry import query
from tidewatch.catalog.sqltext import CUSTOMERS, count_if, hash32, on_customers, rnd, share
from tidewatch.functions.expr import rounded
from tidewatch.operators import missing as M
from tidewatch.operators import outliers as O
from tidewatch.operators.projections import null_or_empty
from tidewatch.plans.fixtures import customers
from tidewatch.schemas import CUSTOMER

_NAMES = [f.name for f in CUSTOMER.fields]
_OUTLIER = ["CreditScore", "Age", "Balance"]


def _replaced(**new: str) -> str:
    """The customer columns with some of them computed."""
    return ", ".join(f'{new[c]} AS "{c}"' if c in new else f'"{c}"' for c in _NAMES)


def _mode(c: str, source: str = "customers") -> str:
    return f'(SELECT "{c}" FROM {source} WHERE "{c}" IS NOT NULL GROUP BY "{c}" ORDER BY count(*) DESC, "{c}" LIMIT 1)'


@query(
    "null_or_empty_filter",
    on_customers("""SELECT "CustomerId", "Gender" FROM customers WHERE "Gender" IS NULL OR "Gender" = ''"""),
)
def null_or_empty_filter(spark, folder):
    df = customers(spark, folder)
    return df.where(null_or_empty(df, "Gender")).select("CustomerId", "Gender")


@query("drop_missing_critical", on_customers('SELECT * FROM customers WHERE "Firstname" IS NOT NULL'))
def drop_missing_critical(spark, folder):
    return M.drop_missing(customers(spark, folder), ["Firstname"])


@query(
    "drop_missing_any",
    on_customers("SELECT * FROM customers WHERE " + " AND ".join(f'"{c}" IS NOT NULL' for c in _NAMES)),
)
def drop_missing_any(spark, folder):
    return M.drop_missing(customers(spark, folder))


_MEAN_AGE = rnd('avg("Age")', 9)


@query(
    "fill_mean",
    on_customers(f"""SELECT {_replaced(Age=f'coalesce("Age", (SELECT {_MEAN_AGE} FROM customers))')} FROM customers"""),
)
def fill_mean(spark, folder):
    return M.fill_mean(customers(spark, folder), "Age").withColumn("Age", rounded(F.col("Age"), 9))


@query(
    "fill_median",
    on_customers(
        f"""SELECT {_replaced(Age='coalesce("Age", (SELECT quantile_cont("Age", 0.5) FROM customers))')} FROM customers"""
    ),
)
def fill_median(spark, folder):
    return M.fill_median(customers(spark, folder), "Age")


@query("fill_mode", on_customers(f"""SELECT {_replaced(Gender=f'coalesce("Gender", {_mode("Gender")})')} FROM customers"""))
def fill_mode(spark, folder):
    return M.fill_mode(customers(spark, folder), "Gender")


@query("fill_constant", on_customers(f"""SELECT {_replaced(Gender='''coalesce("Gender", 'Unknown')''')} FROM customers"""))
def fill_constant(spark, folder):
    return M.fill_constant(customers(spark, folder), "Gender", "Unknown")


@query(
    "fill_constant_all",
    on_customers(
        "SELECT " + _replaced(**{c: f"""coalesce("{c}", 'Unknown')""" for c in ["Firstname", "Lastname", "Geography", "Gender"]})
        + " FROM customers"
    ),
)
def fill_constant_all(spark, folder):
    return M.fill_constant_all(customers(spark, folder), "Unknown")


# Every number of the table, identifiers included: the operator is not told which they are.
_IMPUTED = [c for c in _NAMES if c not in ("Firstname", "Lastname", "Geography", "Gender")]


def _mean_of(c: str) -> str:
    return f"""(SELECT {rnd(f'avg("{c}")', 9)} FROM customers)"""


@query(
    "impute_numeric_all",
    on_customers("SELECT " + _replaced(**{c: f'coalesce("{c}", {_mean_of(c)})' for c in _IMPUTED}) + " FROM customers"),
)
def impute_numeric_all(spark, folder):
    filled = M.impute_numeric(customers(spark, folder))
    return filled.withColumns({c: rounded(F.col(c), 9) for c in _IMPUTED})


@query(
    "impute_numeric_median",
    on_customers(
        "SELECT "
        + _replaced(**{c: f'coalesce("{c}", (SELECT quantile_cont("{c}", 0.5) FROM customers))' for c in _IMPUTED})
        + " FROM customers"
    ),
)
def impute_numeric_median(spark, folder):
    return M.impute_numeric(customers(spark, folder), method="median")


_LOOKUP = """lookup AS (
  SELECT "Firstname", "Lastname", "Gender" AS found FROM customers WHERE "Gender" IS NOT NULL
  GROUP BY "Firstname", "Lastname", "Gender"
  QUALIFY row_number() OVER (PARTITION BY "Firstname", "Lastname" ORDER BY count(*) DESC, "Gender") = 1)"""
_JOINED = """FROM customers c LEFT JOIN lookup l ON l."Firstname" = c."Firstname" AND l."Lastname" = c."Lastname" """


@query(
    "impute_by_key",
    on_customers(
        'SELECT c.* EXCLUDE ("Gender"), coalesce("Gender", found) AS "Gender" ' + _JOINED, _LOOKUP,
    ),
)
def impute_by_key(spark, folder):
    df = customers(spark, folder)
    names = ["Firstname", "Lastname"]
    return M.coalesce_from_lookup(df, M.majority_lookup(df, names, "Gender"), names, "Gender")


@query(
    "left_join_coalesce",
    on_customers(
        """SELECT "CustomerId", coalesce("EstimatedSalary", 0e0) AS "EstimatedSalary",
          coalesce(c."Age", CAST(l.typical AS INTEGER)) AS "Age"
        FROM customers c LEFT JOIN
          (SELECT "Lastname", max("Age") AS typical FROM customers WHERE "Age" IS NOT NULL GROUP BY "Lastname") l
          ON l."Lastname" = c."Lastname" """
    ),
)
def left_join_coalesce(spark, folder):
    df = customers(spark, folder).select("CustomerId", "Lastname", "EstimatedSalary", "Age")
    oldest = df.groupBy("Lastname").agg(F.max("Age").alias("Age"))
    return M.coalesce_from_lookup(df, oldest, ["Lastname"], "Age").fillna({"EstimatedSalary": 0.0}).drop("Lastname")


@query(
    "impute_random_valid",
    on_customers(
        f"""SELECT "CustomerId", coalesce("Gender",
          list_extract(options, CAST({hash32(42, '"CustomerId"')} % len(options) + 1 AS BIGINT))) AS "Gender"
        FROM customers, (SELECT list_sort(list(DISTINCT "Gender")) AS options FROM customers WHERE "Gender" IS NOT NULL)"""
    ),
)
def impute_random_valid(spark, folder):
    return M.impute_random_valid(
        customers(spark, folder).select("CustomerId", "Gender"), "Gender", ["CustomerId"]
    )


_NUMBERS = [c for c in _NAMES if c not in ("Firstname", "Lastname", "Geography", "Gender", "CustomerId", "RowNumber")]
_KNOWN = 'known AS (SELECT * FROM customers WHERE "Gender" IS NOT NULL)'


@query(
    "missing_policy_pandas",
    on_customers(
        "SELECT "
        + _replaced(
            **{c: f'coalesce("{c}", (SELECT quantile_cont("{c}", 0.5) FROM customers))' for c in _NUMBERS},
            **{c: f"""coalesce("{c}", {_mode(c, 'known')}, 'Unknown')""" for c in ("Geography",)},
        )
        + " FROM known", _KNOWN,
    ),
)
def missing_policy_pandas(spark, folder):
    return M.missing_policy_pandas(customers(spark, folder))


_NAMED = 'named AS (SELECT * FROM customers WHERE "Firstname" IS NOT NULL)'


@query(
    "missing_policy_spark",
    on_customers(
        "SELECT "
        + _replaced(Age=f'coalesce("Age", (SELECT {_MEAN_AGE} FROM named))', Gender="""coalesce("Gender", 'Unknown')""")
        + " FROM named", _NAMED,
    ),
)
def missing_policy_spark(spark, folder):
    return M.missing_policy_spark(customers(spark, folder)).withColumn("Age", rounded(F.col("Age"), 9))


@query(
    "fill_sentinel",
    on_customers(
        "SELECT " + _replaced(**{c: f"""coalesce("{c}", 'MISSING')""" for c in ("Geography", "Gender")}) + " FROM customers"
    ),
)
def fill_sentinel(spark, folder):
    return M.fill_sentinel(customers(spark, folder), ["Geography", "Gender"])


# --- outliers ----------------------------------------------------------------

def _bounds(c: str) -> str:
    q1, q3 = f'quantile_cont("{c}", 0.25)', f'quantile_cont("{c}", 0.75)'
    return f"""SELECT '{c}' AS feature, {q1} * 1e0 AS first_quartile, {q3} * 1e0 AS third_quartile,
      ({q1} - 1.5e0 * ({q3} - {q1})) AS lower_bound,
      ({q3} + 1.5e0 * ({q3} - {q1})) AS upper_bound FROM customers"""


_BOUNDS = "bounds AS (" + " UNION ALL ".join(map(_bounds, _OUTLIER)) + ")"


def _edge(c: str, side: str) -> str:
    return f"(SELECT {side}_bound FROM bounds WHERE feature = '{c}')"


def _out(c: str) -> str:
    return f'("{c}" < {_edge(c, "lower")} OR "{c}" > {_edge(c, "upper")})'


_SIX = ", ".join(f"{rnd(c, 6)} AS {c}" for c in ("lower_bound", "upper_bound"))


@query("iqr_bounds", on_customers(f"SELECT * EXCLUDE (lower_bound, upper_bound), {_SIX} FROM bounds", _BOUNDS))
def iqr_bounds(spark, folder):
    bounds = O.iqr_bounds(customers(spark, folder), _OUTLIER)
    return bounds.withColumns({c: rounded(F.col(c), 6) for c in ("lower_bound", "upper_bound")})


# A narrower fence than the default, so that the fixtures have outliers at all.
_NARROW = 0.4
_NARROW_BOUNDS = "bounds AS (" + " UNION ALL ".join(_bounds(c).replace("1.5e0", "0.4e0") for c in _OUTLIER) + ")"


@query(
    "iqr_flag",
    on_customers(
        'SELECT "CustomerId", ' + ", ".join(f'{_out(c)} AS "{c}_outlier"' for c in _OUTLIER) + " FROM customers",
        _NARROW_BOUNDS,
    ),
)
def iqr_flag(spark, folder):
    df = customers(spark, folder)
    flagged = O.iqr_flag(df, _OUTLIER, O.iqr_bounds(df, _OUTLIER, _NARROW))
    return flagged.select("CustomerId", *[f"{c}_outlier" for c in _OUTLIER])


@query(
    "outlier_remove",
    on_customers(
        "SELECT * FROM customers WHERE " + " + ".join(f"CAST({_out(c)} AS INTEGER)" for c in _OUTLIER) + " < 2",
        _NARROW_BOUNDS,
    ),
)
def outlier_remove(spark, folder):
    df = customers(spark, folder)
    return O.outlier_remove(df, _OUTLIER, bounds=O.iqr_bounds(df, _OUTLIER, _NARROW))


@query(
    "outlier_remove_default",
    on_customers(
        "SELECT * FROM customers WHERE " + " + ".join(f"CAST({_out(c)} AS INTEGER)" for c in _OUTLIER) + " < 2", _BOUNDS,
    ),
)
def outlier_remove_default(spark, folder):
    return O.outlier_remove(customers(spark, folder), _OUTLIER)


def _clamped(c: str) -> str:
    low, high = _edge(c, "lower"), _edge(c, "upper")
    return rnd(f'CASE WHEN "{c}" < {low} THEN {low} WHEN "{c}" > {high} THEN {high} ELSE "{c}" END', 6)


@query(
    "outlier_cap",
    on_customers("SELECT " + _replaced(**{c: _clamped(c) for c in _OUTLIER}) + " FROM customers", _NARROW_BOUNDS),
)
def outlier_cap(spark, folder):
    df = customers(spark, folder)
    capped = O.outlier_cap(df, _OUTLIER, O.iqr_bounds(df, _OUTLIER, _NARROW))
    return capped.withColumns({c: rounded(F.col(c), 6) for c in _OUTLIER})


def _far(c: str) -> str:
    return (
        f'abs("{c}" - (SELECT avg("{c}") FROM customers))'
        f' > 1.5e0 * (SELECT stddev_samp("{c}") FROM customers)'
    )


@query(
    "zscore_flag",
    on_customers('SELECT "CustomerId", ' + ", ".join(f'{_far(c)} AS "{c}_outlier"' for c in _OUTLIER) + " FROM customers"),
)
def zscore_flag(spark, folder):
    flagged = O.zscore_flag(customers(spark, folder), _OUTLIER, 1.5)
    return flagged.select("CustomerId", *[f"{c}_outlier" for c in _OUTLIER])


@query(
    "check_outlier_share",
    "WITH " + CUSTOMERS + ", bounds AS (" + " UNION ALL ".join(map(_bounds, ["CreditScore", "Age", "Balance", "NumOfProducts"])) + ") "
    + " UNION ALL ".join(
        f"""SELECT 'outlier_percentage' AS "check", '{c}' AS "column", {share(count_if(_out(c)), 'count(*)')} AS observed,
          10e0 AS threshold, coalesce({share(count_if(_out(c)), 'count(*)')} <= 10, true) AS passed FROM customers"""
        for c in ["CreditScore", "Age", "Balance", "NumOfProducts"]
    ),
)
def check_outlier_share(spark, folder):
    from tidewatch.operators.quality import check_outlier_share as check

    return check(customers(spark, folder))
