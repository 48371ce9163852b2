"""Projections, binning, encoding, scaling, splits and the whole feature plans."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidewatch.catalog.registry import query
from tidewatch.catalog.sqltext import CUSTOMERS, count_if, hash32, on_customers, on_predictions, rnd, share
from tidewatch.functions.expr import rounded
from tidewatch.operators import binning as B
from tidewatch.operators import encoding as E
from tidewatch.operators import projections as P
from tidewatch.operators import scaling as S
from tidewatch.operators import split as SP
from tidewatch.operators.reports import union_all, value_distribution
from tidewatch.operators.learning import load_model, save_model
from tidewatch.operators.serving import fit_preprocessing, preprocess
from tidewatch.plans.features import SCALED, as_json, cleaned_sides, indexed_features, manifest, one_hot_features
from tidewatch.plans.fixtures import customers, predictions, score_facts, table
from tidewatch.schemas import CUSTOMER, IDENTIFIERS
from tidewatch.session import work_folder

_NAMES = [f.name for f in CUSTOMER.fields]
_KEY = ["CustomerId"]
# The values of the fixture, as a serving job would have them stored.
GEOGRAPHIES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
GENDERS = ["Female", "Male"]
STORED = {"Geography": GEOGRAPHIES, "Gender": GENDERS}


def _replaced(**new: str) -> str:
    return ", ".join(f'{new[c]} AS "{c}"' if c in new else f'"{c}"' for c in _NAMES)


def _others(*dropped: str) -> str:
    return ", ".join(f'"{c}"' for c in _NAMES if c not in dropped)


# --- projections -------------------------------------------------------------

@query("drop_identifiers", on_customers(f"SELECT {_others(*IDENTIFIERS)} FROM customers"))
def drop_identifiers(spark, folder):
    return P.drop_identifiers(customers(spark, folder))


def _hot(values) -> str:
    return ", ".join(
        f"""CASE WHEN "{c}" = '{v}' THEN 1 ELSE 0 END AS "{c}_{v}" """ for c, known in values.items() for v in known
    )


_ORDINAL = """CASE WHEN "CreditScore" IS NULL THEN 4 WHEN "CreditScore" <= 580 THEN 0 WHEN "CreditScore" <= 670 THEN 1
  WHEN "CreditScore" <= 740 THEN 2 WHEN "CreditScore" <= 800 THEN 3 ELSE 4 END"""
_MATRIX = ["CreditScore", "Age", "Tenure", "Balance", "NumOfProducts", "HasCrCard", "IsActiveMember", "EstimatedSalary"]


@query(
    "align_features",
    on_customers(
        'SELECT "CustomerId", ' + ", ".join(f'"{c}"' for c in _MATRIX) + f', {_ORDINAL} AS "CreditScoreBins", '
        '0 AS "Geography_France", 0 AS "Geography_Germany", 0 AS "Geography_Spain", '
        + _hot({"Gender": GENDERS}) + " FROM customers"
    ),
)
def align_features(spark, folder):
    hot = E.one_hot_apply(B.bin_ordinal(customers(spark, folder)), STORED)
    return P.align_features(hot, keep=_KEY)


@query(
    "cast_columns",
    """SELECT event_id, CAST(value AS BIGINT) AS value, CAST(user_id AS VARCHAR) AS user_id, CAST(NULL AS INTEGER) AS event_type
    FROM (SELECT event_id, trunc(value) AS value, user_id FROM events)""",
)
def cast_columns(spark, folder):
    df = table(spark, folder, "events").select("event_id", "value", "user_id", "event_type")
    return P.cast_columns(df, {"value": "bigint", "user_id": "string", "event_type": "int", "absent": "int"})


@query(
    "feature_target_projection",
    on_customers(
        """SELECT 'X' AS part, count(*) AS rows, count("Age") AS ages, CAST(NULL AS BIGINT) AS positives FROM customers
        UNION ALL SELECT 'y', count(*), NULL, CAST(sum("Exited") AS BIGINT) FROM customers"""
    ),
)
def feature_target_projection(spark, folder):
    x, y = P.feature_target(customers(spark, folder))
    none = F.lit(None).cast("bigint")
    return union_all(
        [
            x.agg(F.lit("X").alias("part"), F.count("*").alias("rows"), F.count("Age").alias("ages"), F.first(none).alias("positives")),
            y.agg(F.lit("y").alias("part"), F.count("*").alias("rows"), F.first(none).alias("ages"), F.sum("Exited").alias("positives")),
        ]
    )


@query("attach_label", on_customers('SELECT "CustomerId", "CreditScore", "Age", "Exited" AS label FROM customers'))
def attach_label(spark, folder):
    # The label never leaves the row; joining by position has no meaning in Spark.
    return customers(spark, folder).select("CustomerId", "CreditScore", "Age", F.col("Exited").alias("label"))


# --- binning -----------------------------------------------------------------

_NAMED_BIN = """CASE WHEN s = 850 THEN 'Excellent' WHEN s >= 300 AND s <= 580 THEN 'Poor'
  WHEN s >= 580 AND s <= 670 THEN 'Fair' WHEN s >= 670 AND s <= 740 THEN 'Good'
  WHEN s >= 740 AND s <= 800 THEN 'Very Good' WHEN s >= 800 AND s <= 850 THEN 'Excellent' ELSE 'Invalid' END"""


def _bin_of(expression: str, column: str = '"CreditScore"') -> str:
    return expression.replace("s >", f"{column} >").replace("s <", f"{column} <").replace("s =", f"{column} =")


@query(
    "bin_named_ranges",
    on_customers(f"""SELECT {_others("CreditScore")}, {_bin_of(_NAMED_BIN)} AS "CreditScoreBins" FROM customers"""),
)
def bin_named_ranges(spark, folder):
    return B.bin_named_ranges(customers(spark, folder), "CreditScore", B.CREDIT_RANGES, first={850: "Excellent"})


@query(
    "bin_splits",
    """SELECT event_id, CASE WHEN value >= 0 AND value < 25 THEN 'low' WHEN value >= 25 AND value < 75 THEN 'mid'
      WHEN value >= 75 AND value <= 150 THEN 'high' ELSE 'Unknown' END AS "valueBins" FROM events""",
)
def bin_splits(spark, folder):
    df = table(spark, folder, "events").select("event_id", "value")
    return B.bin_splits(df, "value", [0, 25, 75, 150], ["low", "mid", "high"])


@query(
    "bin_credit_preset",
    on_customers(
        f"""SELECT {_others("CreditScore")}, CASE WHEN "CreditScore" >= 0 AND "CreditScore" < 450 THEN 'Poor'
          WHEN "CreditScore" >= 450 AND "CreditScore" < 580 THEN 'Fair'
          WHEN "CreditScore" >= 580 AND "CreditScore" < 680 THEN 'Good'
          WHEN "CreditScore" >= 680 AND "CreditScore" < 750 THEN 'Very Good'
          WHEN "CreditScore" >= 750 THEN 'Excellent' ELSE 'Unknown' END AS "CreditScoreBins" FROM customers"""
    ),
)
def bin_credit_preset(spark, folder):
    return B.bin_credit_preset(customers(spark, folder))


@query("bin_ordinal", on_customers(f'SELECT *, {_ORDINAL} AS "CreditScoreBins" FROM customers'))
def bin_ordinal(spark, folder):
    return B.bin_ordinal(customers(spark, folder))


@query(
    "bin_distribution",
    on_customers(
        f"""SELECT {_bin_of(_NAMED_BIN)} AS value, count(*) AS count,
          {share('count(*)', '(SELECT count(*) FROM customers)')} AS percentage FROM customers GROUP BY 1"""
    ),
)
def bin_distribution(spark, folder):
    binned = B.bin_named_ranges(customers(spark, folder), "CreditScore", B.CREDIT_RANGES, first={850: "Excellent"})
    return value_distribution(binned, "CreditScoreBins")


# --- encoding ----------------------------------------------------------------

def _codes(c: str, order: str, null_as: str) -> str:
    return f"""SELECT '{c}' AS "column", coalesce("{c}", '{null_as}') AS category,
      CAST(row_number() OVER (ORDER BY {order}) - 1 AS INTEGER) AS code FROM customers GROUP BY 2"""


_FREQUENCY = "codes AS (" + " UNION ALL ".join(
    _codes(c, f"""count(*) DESC, coalesce("{c}", 'MISSING')""", "MISSING") for c in ("Geography", "Gender")
) + ")"
_ALPHA = "codes AS (" + " UNION ALL ".join(
    _codes(c, f"""coalesce("{c}", 'nan')""", "nan") for c in ("Firstname", "Lastname")
) + ")"


def _code(c: str, null_as: str) -> str:
    return f"""(SELECT code FROM codes WHERE "column" = '{c}' AND category = coalesce(customers."{c}", '{null_as}'))"""


@query(
    "index_by_frequency",
    on_customers(
        "SELECT " + _replaced(Geography=_code("Geography", "MISSING"), Gender=_code("Gender", "MISSING")) + " FROM customers",
        _FREQUENCY,
    ),
)
def index_by_frequency(spark, folder):
    return E.index_by_frequency(customers(spark, folder), ["Geography", "Gender"])


@query(
    "label_encode_alpha",
    on_customers(
        "SELECT " + _replaced(Firstname=_code("Firstname", "nan"), Lastname=_code("Lastname", "nan")) + " FROM customers",
        _ALPHA,
    ),
)
def label_encode_alpha(spark, folder):
    return E.label_encode_alpha(customers(spark, folder), ["Firstname", "Lastname"])


def _vector_columns(df, column: str, width: int):
    array = vector_to_array(column)
    return [array[i].alias(f"{column}_{i}") for i in range(width)]


def _vector_sql(c: str, width: int) -> str:
    return ", ".join(f"""CASE WHEN {_code(c, "MISSING")} = {i} THEN 1e0 ELSE 0e0 END AS "{c}_vec_{i}" """ for i in range(width))


# With unseen values kept, the index has one extra slot; it is the dropped one.
@query(
    "one_hot_vector",
    on_customers(
        f"""SELECT "CustomerId", {_vector_sql("Geography", 5)}, {_vector_sql("Gender", 3)} FROM customers""", _FREQUENCY,
    ),
)
def one_hot_vector(spark, folder):
    df = E.one_hot_vector(customers(spark, folder), ["Geography", "Gender"])
    return df.select("CustomerId", *_vector_columns(df, "Geography_vec", 5), *_vector_columns(df, "Gender_vec", 3))


@query(
    "one_hot_capped",
    on_customers(f"""SELECT "CustomerId", "Lastname", {_vector_sql("Geography", 5)} FROM customers""", _FREQUENCY),
)
def one_hot_capped(spark, folder):
    df = E.one_hot_capped(customers(spark, folder), ["Geography", "Lastname"], 20)
    return df.select("CustomerId", "Lastname", *_vector_columns(df, "Geography_vec", 5))


@query(
    "ordinal_encode",
    on_customers(
        f"""SELECT "CustomerId", CASE {_bin_of(_NAMED_BIN)} WHEN 'Poor' THEN 0 WHEN 'Fair' THEN 1 WHEN 'Good' THEN 2
            WHEN 'Very Good' THEN 3 WHEN 'Excellent' THEN 4 ELSE -1 END AS "CreditScoreBins",
          CASE "Gender" WHEN 'Female' THEN 0 ELSE CASE WHEN "Gender" IS NULL THEN NULL ELSE -1 END END AS "Gender"
        FROM customers"""
    ),
)
def ordinal_encode(spark, folder):
    binned = B.bin_named_ranges(customers(spark, folder), "CreditScore", B.CREDIT_RANGES, first={850: "Excellent"})
    coded = E.ordinal_encode(binned, {"CreditScoreBins": B.CREDIT_CODES, "Gender": {"Female": 0}})
    return coded.select("CustomerId", "CreditScoreBins", "Gender")


@query("one_hot_columns", on_customers(f'SELECT {_others("Geography", "Gender")}, {_hot(STORED)} FROM customers'))
def one_hot_columns(spark, folder):
    return E.one_hot_columns(customers(spark, folder), ["Geography", "Gender"])


_PARTLY_STORED = {"Geography": ["ASIA", "EUROPE"], "Gender": ["Female", "Male"]}


@query("one_hot_apply", on_customers(f'SELECT {_others("Geography", "Gender")}, {_hot(_PARTLY_STORED)} FROM customers'))
def one_hot_apply(spark, folder):
    return E.one_hot_apply(customers(spark, folder), _PARTLY_STORED)


@query(
    "encoder_table",
    "WITH " + CUSTOMERS + " " + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", "{c}" AS category, CAST(row_number() OVER (ORDER BY "{c}") - 1 AS INTEGER) AS code
        FROM customers WHERE "{c}" IS NOT NULL GROUP BY "{c}" """
        for c in ("Geography", "Gender", "Firstname")
    ),
)
def encoder_table(spark, folder):
    return E.encoder_table(customers(spark, folder), ["Geography", "Gender", "Firstname"])


# --- scaling -----------------------------------------------------------------

def _scaled(c: str, low: str, high: str, constant: str) -> str:
    return f"""CASE WHEN {high} = {low} THEN CASE WHEN "{c}" IS NOT NULL THEN {constant} END
      ELSE ("{c}" - {low}) * 1e0 / ({high} - {low}) END"""


def _minmax(c: str, source: str = "customers", constant: str = "0.5e0") -> str:
    return _scaled(c, f'(SELECT min("{c}") FROM {source})', f'(SELECT max("{c}") FROM {source})', constant)


def _nine(c: str) -> str:
    return f'{rnd(c, 9)}'


@query(
    "scale_minmax",
    on_customers("SELECT " + _replaced(**{c: _nine(_minmax(c)) for c in SCALED}) + " FROM customers"),
)
def scale_minmax(spark, folder):
    scaled = S.scale_minmax(customers(spark, folder), SCALED)
    return scaled.withColumns({c: rounded(F.col(c), 9) for c in SCALED})


def _standard(c: str, sd: str) -> str:
    mean = f'(SELECT avg("{c}") FROM customers)'
    return _nine(f"""(("{c}" - {mean}) / (SELECT {sd}("{c}") FROM customers))""")


@query(
    "scale_standard",
    on_customers(
        'SELECT "CustomerId", ' + ", ".join(f'{_standard(c, "stddev_samp")} AS "{c}"' for c in SCALED) + ", "
        + ", ".join(f'{_standard(c, "stddev_pop")} AS "{c}_pop"' for c in SCALED) + " FROM customers"
    ),
)
def scale_standard(spark, folder):
    df = customers(spark, folder).select(
        "CustomerId", *SCALED, *[F.col(c).alias(f"{c}_pop") for c in SCALED]
    )
    populations = [f"{c}_pop" for c in SCALED]
    scaled = S.scale_standard(S.scale_standard(df, SCALED, ddof=1), populations, ddof=0)
    return scaled.withColumns({c: rounded(F.col(c), 9) for c in SCALED + populations})


_COMPLETE = 'complete AS (SELECT * FROM customers WHERE "Age" IS NOT NULL AND "EstimatedSalary" IS NOT NULL)'


@query(
    "scale_vector",
    on_customers(
        'SELECT "CustomerId", '
        + ", ".join(
            f"""CASE WHEN {" AND ".join(f'"{x}" IS NOT NULL' for x in SCALED)} THEN {_nine(_minmax(c, "complete"))} END AS scaled_{i}"""
            for i, c in enumerate(SCALED)
        )
        + " FROM customers", _COMPLETE,
    ),
)
def scale_vector(spark, folder):
    """Every customer; one with a missing value has no vector."""
    df = S.scale_vector(customers(spark, folder), SCALED, "minmax", nulls="keep")
    array = vector_to_array("scaled_features")
    return df.select(
        "CustomerId", *[F.when(F.col("scaled_features").isNotNull(), rounded(array[i], 9)).alias(f"scaled_{i}") for i in range(len(SCALED))]
    )


_LIMITS = {"Balance": (-1000.0, 10000.0), "EstimatedSalary": (0.0, 500000.0), "Age": (18.0, 92.0)}


@query(
    "scale_apply",
    on_customers(
        "SELECT "
        + _replaced(**{c: _nine(_scaled(c, f"({a}e0)", f"({b}e0)", "0e0")) for c, (a, b) in _LIMITS.items()})
        + " FROM customers"
    ),
)
def scale_apply(spark, folder):
    scaled = S.scale_apply(customers(spark, folder), _LIMITS)
    return scaled.withColumns({c: rounded(F.col(c), 9) for c in SCALED})


@query(
    "scaler_params",
    "WITH " + CUSTOMERS + " " + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", min("{c}") * 1e0 AS data_min, max("{c}") * 1e0 AS data_max,
          {rnd(f'avg("{c}")', 6)} AS mean, {rnd(f'stddev_samp("{c}")', 6)} AS stddev FROM customers"""
        for c in SCALED
    ),
)
def scaler_params(spark, folder):
    return S.scaler_params(customers(spark, folder), SCALED)


# --- splits ------------------------------------------------------------------

_HASH = hash32(42, '"CustomerId"')
_RANDOM = f"CASE WHEN {_HASH} < 858993459 THEN 'test' ELSE 'train' END"


@query("split_random", on_customers(f'SELECT "CustomerId", "Exited", {_RANDOM} AS split FROM customers'))
def split_random(spark, folder):
    return SP.split_random(customers(spark, folder), _KEY).select("CustomerId", "Exited", "split")


def exact_split_sql(source: str) -> str:
    """Stratified split of ``source``: the training rows of a class have its smallest hashes."""
    return f"""quotas AS (
  SELECT "Exited" AS class, f + CASE WHEN row_number() OVER (ORDER BY rest DESC, "Exited")
      <= n_train - sum(f) OVER () THEN 1 ELSE 0 END AS quota
  FROM (SELECT "Exited", floor(w) AS f, round(w - floor(w), 9) AS rest, n_train FROM (
    SELECT "Exited", n_train, count(*) * n_train / any_value(n) AS w FROM {source},
      (SELECT count(*) AS n, count(*) - ceil(count(*) * 0.2e0) AS n_train FROM {source}) t
    GROUP BY "Exited", n_train))),
sided AS (
  SELECT s.*, CASE WHEN row_number() OVER (PARTITION BY "Exited" ORDER BY {_HASH}, "CustomerId") > quota
    THEN 'test' ELSE 'train' END AS split
  FROM {source} s JOIN quotas ON class = "Exited")"""


@query("split_stratified", on_customers('SELECT "CustomerId", "Exited", split FROM sided', exact_split_sql("customers")))
def split_stratified(spark, folder):
    split = SP.split_stratified(customers(spark, folder), _KEY, "Exited", exact=True)
    return split.select("CustomerId", "Exited", "split")


@query(
    "sample_n",
    f"""SELECT event_id, user_id FROM events ORDER BY {hash32(42, 'event_id')}, event_id LIMIT 100""",
)
def sample_n(spark, folder):
    return SP.sample_n(table(spark, folder, "events").select("event_id", "user_id"), 100, ["event_id"])


@query("sample_fraction", f"SELECT event_id, user_id FROM events WHERE {hash32(42, 'event_id')} < 429496729")
def sample_fraction(spark, folder):
    return SP.sample_fraction(table(spark, folder, "events").select("event_id", "user_id"), 0.1, ["event_id"])


@query(
    "split_report",
    on_customers(
        f"""SELECT split, "Exited" AS target, count(*) AS count,
          CAST(sum(count(*)) OVER (PARTITION BY split) AS BIGINT) AS side_rows,
          {share('count(*)', 'sum(count(*)) OVER (PARTITION BY split)')} AS class_percentage,
          {share('sum(count(*)) OVER (PARTITION BY split)', '(SELECT count(*) FROM customers)')} AS side_percentage
        FROM sided GROUP BY split, "Exited" """,
        exact_split_sql("customers"),
    ),
)
def split_report(spark, folder):
    split = SP.split_stratified(customers(spark, folder), _KEY, "Exited", exact=True)
    return SP.split_report(split, "Exited")


# --- whole plans -------------------------------------------------------------

def _mode(c: str) -> str:
    return f'(SELECT "{c}" FROM known WHERE "{c}" IS NOT NULL GROUP BY "{c}" ORDER BY count(*) DESC, "{c}" LIMIT 1)'


_MEDIANS = {
    c: f'coalesce("{c}", (SELECT quantile_cont("{c}", 0.5) FROM customers))'
    for c in _NAMES if c not in ("Firstname", "Lastname", "Geography", "Gender", "CustomerId", "RowNumber", "Exited")
}
_CLEAN = [
    'known AS (SELECT * FROM customers WHERE "Gender" IS NOT NULL)',
    "clean AS (SELECT "
    + _replaced(**_MEDIANS, Geography=f"""coalesce("Geography", {_mode("Geography")}, 'Unknown')""") + " FROM known)",
    exact_split_sql("clean"),
]
_TRAIN = "train AS (SELECT * FROM sided WHERE split = 'train')"
_ONE_HOT_PLAN = (
    'features AS (SELECT "CustomerId", "Exited", split, '
    + ", ".join(
        (f'{_nine(_minmax(c, "train", "0e0"))} AS "{c}"' if c in SCALED else f'"{c}"') for c in _MATRIX
    )
    + f', {_ORDINAL} AS "CreditScoreBins", {_hot(STORED)} FROM sided)'
)


def _one_hot_plan(spark, folder):
    features = one_hot_features(customers(spark, folder), STORED)
    return features.withColumns({c: rounded(F.col(c), 9) for c in SCALED})


@query("feature_plan_one_hot", on_customers("SELECT * FROM features", *_CLEAN, _TRAIN, _ONE_HOT_PLAN))
def feature_plan_one_hot(spark, folder):
    return _one_hot_plan(spark, folder)


_INLIER_COLUMNS = ["CreditScore", "Age", "NumOfProducts"]


def _fence(c: str) -> str:
    q1, q3 = f'quantile_cont("{c}", 0.25)', f'quantile_cont("{c}", 0.75)'
    return f"""SELECT '{c}' AS f, ({q1} - 1.5e0 * ({q3} - {q1})) AS lo,
      ({q3} + 1.5e0 * ({q3} - {q1})) AS hi FROM filled"""


def _far(c: str) -> str:
    return f"""CAST("{c}" < (SELECT lo FROM fences WHERE f = '{c}') OR "{c}" > (SELECT hi FROM fences WHERE f = '{c}') AS INTEGER)"""


_INDEXED_PLAN = [
    'named AS (SELECT * FROM customers WHERE "Firstname" IS NOT NULL)',
    "filled AS (SELECT "
    + _replaced(Age=f"""coalesce("Age", (SELECT avg("Age") FROM named))""", Gender="""coalesce("Gender", 'Unknown')""")
    + " FROM named)",
    "fences AS (" + " UNION ALL ".join(map(_fence, _INLIER_COLUMNS)) + ")",
    f"""inliers AS (SELECT *, {_RANDOM} AS split, CASE {_bin_of(_NAMED_BIN)} WHEN 'Poor' THEN 0 WHEN 'Fair' THEN 1
      WHEN 'Good' THEN 2 WHEN 'Very Good' THEN 3 WHEN 'Excellent' THEN 4 ELSE -1 END AS "CreditScoreBins"
      FROM filled WHERE {" + ".join(map(_far, _INLIER_COLUMNS))} < 2)""",
    "train AS (SELECT * FROM inliers WHERE split = 'train')",
    "codes AS (" + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", "{c}" AS category,
          CAST(row_number() OVER (ORDER BY count(*) DESC, "{c}") - 1 AS INTEGER) AS code FROM train GROUP BY "{c}" """
        for c in ("Geography", "Gender")
    ) + ")",
]


def _train_code(c: str) -> str:
    return f"""coalesce((SELECT code FROM codes WHERE "column" = '{c}' AND category = inliers."{c}"),
      (SELECT CAST(count(*) AS INTEGER) FROM codes WHERE "column" = '{c}'))"""


@query(
    "feature_plan_indexed",
    on_customers(
        f"""SELECT "CustomerId", {_train_code("Geography")} AS "Geography", {_train_code("Gender")} AS "Gender",
          {_nine(_minmax("Age", "train"))} AS "Age", "Tenure", {_nine(_minmax("Balance", "train"))} AS "Balance",
          "NumOfProducts", "HasCrCard", "IsActiveMember", {_nine(_minmax("EstimatedSalary", "train"))} AS "EstimatedSalary",
          "Exited", "CreditScoreBins", split FROM inliers""",
        *_INDEXED_PLAN,
    ),
)
def feature_plan_indexed(spark, folder):
    features = indexed_features(customers(spark, folder))
    return features.withColumns({c: rounded(F.col(c), 9) for c in SCALED})


def _list(c: str) -> str:
    return f"""(SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT "{c}" AS v FROM train))"""


_FITTED_NAMES = "'" + ",".join(_MATRIX + ["CreditScoreBins"]) + "'" + "".join(
    f""" || (SELECT string_agg(',{c}_' || v, '' ORDER BY v) FROM (SELECT DISTINCT "{c}" AS v FROM train))""" for c in STORED
)


@query(
    "dataset_manifest",
    on_customers(
        f"""SELECT {_FITTED_NAMES} AS feature_columns, 'Exited' AS target_column, 16 AS n_features, '{",".join(SCALED)}' AS scaled_columns,
          {_list("Geography")} AS "Geography_categories", {_list("Gender")} AS "Gender_categories",
          {count_if("split = 'train'")} AS train_rows, {count_if("split <> 'train'")} AS test_rows,
          {count_if("split = 'train' AND " + '"Exited" = 1')} AS train_churned,
          {count_if("split <> 'train' AND " + '"Exited" = 1')} AS test_churned, """
        + ", ".join(
            f'(SELECT {e}("{c}") * 1e0 FROM train) AS "{c}_{e}"' for c in SCALED for e in ("min", "max")
        )
        + " FROM sided",
        *_CLEAN,
        _TRAIN,
    ),
)
def dataset_manifest(spark, folder):
    sided = cleaned_sides(customers(spark, folder))
    known = E.categories(sided.where("split = 'train'"), list(STORED))
    # Through its JSON form and back, as a consumer would read it.
    fields = (
        "feature_columns string, target_column string, n_features int, scaled_columns string, "
        + ", ".join(f"{c}_categories string" for c in STORED)
        + ", train_rows bigint, test_rows bigint, train_churned bigint, test_churned bigint, "
        + ", ".join(f"{c}_{e} double" for c in SCALED for e in ("min", "max"))
    )
    return as_json(manifest(sided, known)).select(F.from_json("manifest", fields).alias("m")).select("m.*")


@query(
    "serving_features",
    on_customers(
        """SELECT * EXCLUDE ("Exited", split) FROM features WHERE split = 'test'""", *_CLEAN, _TRAIN, _ONE_HOT_PLAN
    ),
)
def serving_features(spark, folder):
    """The matrix of the test side from a saved and loaded pipeline: nothing is fitted again."""
    sided = cleaned_sides(customers(spark, folder))
    root = work_folder(spark, "serving")
    save_model(fit_preprocessing(sided.where("split = 'train'"), list(STORED), SCALED), root, "20240131000000")
    rows = sided.where("split = 'test'").drop("Exited", "split")
    found = preprocess(load_model(spark, root), rows, keep=_KEY)
    return found.withColumns({c: rounded(F.col(c), 9) for c in SCALED})
