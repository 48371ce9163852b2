"""Global statistics that stay distributed.

``attach`` brings a one-row DataFrame to every row.  ``running_counts`` and
``exact_quantiles`` need the global order of a column; they cut it into value
ranges so that no feature is ever sorted by a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

STATS = "_stats"


def attach(df: DataFrame, stats: DataFrame, name: str = STATS) -> DataFrame:
    """``df`` plus the only row of ``stats`` as struct column ``name``.

    A scalar subquery: evaluated once, then a constant in the generated code.
    """
    return df.withColumn(name, stats.select(F.struct("*")).scalar())


def stat(field: str, name: str = STATS) -> Column:
    return F.col(f"{name}.`{field}`")


def unpivoted(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Rows ``(*keep, feature, value)`` for the non-null, non-NaN numbers of ``cols``."""
    casted = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols])
    long = casted.unpivot(list(keep), list(cols), "feature", "value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def _bucketed(points: DataFrame, by: Sequence[str], buckets: int) -> DataFrame:
    """Add ``bucket``: ranges of ``value`` with about equally many points each.

    ``points`` has one row per (by, value), so equal values share a bucket and a
    hot value costs one row.  The cut points are a fixed-size sketch per group.
    """
    # As SQL text: a Python list of that length costs a call to the JVM per entry.
    cuts = ", ".join(f"{i / buckets}D" for i in range(1, buckets))
    sketch = F.expr(f"array_distinct(percentile_approx(value, array({cuts}), {10 * buckets}))")
    edges = points.groupBy(*by).agg(sketch.alias("edges"))
    # One row of at most `buckets` doubles per group; `by` is a list of feature
    # names taken from a schema, never a data column, so this is small.
    located = points.join(F.broadcast(edges), list(by)) if by else points.withColumn("edges", edges.scalar())
    return count_below(located, "edges", "value", "bucket", buckets).drop("edges")


def count_below(df: DataFrame, edges: str, value: str, name: str, limit: int) -> DataFrame:
    """Add how many entries of the sorted array ``edges`` (under ``limit``) are below ``value``.

    A binary search written out as projections: a few comparisons per row inside
    the generated code, where a higher-order function would look at every entry.
    """
    out = df.withColumn(name, F.lit(0))
    step = 1 << (max(limit - 1, 1).bit_length() - 1)
    while step:
        out = out.withColumn(name, F.expr(f"{name} + IF(get({edges}, {name} + {step - 1}) < {value}, {step}, 0)"))
        step //= 2
    return out


def _bucket_offsets(bucketed: DataFrame, by: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Per (by, bucket): what the buckets before it add up to (``before_*``)."""
    totals = bucketed.groupBy(*by, "bucket").agg(*[F.sum(c).alias(c) for c in sums])
    # At most `buckets` rows per group reach this window.
    before = W.partitionBy(*by).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    return totals.select(
        *by, "bucket", *sums, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"before_{c}") for c in sums]
    )


def running_counts(
    points: DataFrame, sums: Sequence[str], by: Sequence[str] = (), buckets: int = 1024
) -> DataFrame:
    """Add ``upto_<c>``: sum of ``c`` over all rows with a value up to this one.

    ``points`` holds one row per (by, value).  Windows run inside one value
    range; the ranges before it come in as a constant per range.
    """
    bucketed = _bucketed(points, by, buckets)
    offsets = _bucket_offsets(bucketed, by, sums).drop(*sums)
    inside = W.partitionBy(*by, "bucket").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    # At most `buckets` rows per feature name.
    joined = bucketed.join(F.broadcast(offsets), [*by, "bucket"])
    return joined.select(
        *[c for c in points.columns],
        *[(F.sum(c).over(inside) + F.col(f"before_{c}")).alias(f"upto_{c}") for c in sums],
    )


SKETCH = 2000  # a sketched quantile is at most one part in this many off its rank
_WHOLE = 20 * SKETCH  # up to this many values a bracket is the whole column


def bracketed_counts(long: DataFrame, probs: Sequence[float], accuracy: int = SKETCH) -> DataFrame:
    """Per feature and wanted quantile ``i``: the values near it with their counts, and under
    the value null how many lie below.  ``total`` is the number of the feature's values.

    A sketch brackets each quantile, four times its error to either side.  Values outside
    are only counted, on the map side, so what is shuffled is bounded by that error.
    """
    slack = 4 / accuracy
    edges = [q for p in probs for q in (max(0.0, p - slack), min(1.0, p + slack))]
    sketch = long.groupBy("feature").agg(
        F.count("*").alias("total"), F.percentile_approx("value", edges, accuracy).alias("_edges")
    )
    # One row per feature name, taken from a schema.
    near = long.join(F.broadcast(sketch), "feature")
    whole = F.col("total") <= _WHOLE
    places = []
    for i, p in enumerate(probs):
        low = F.lit(True) if p - slack <= 0 else whole | (F.col("value") >= F.col("_edges")[2 * i])
        high = F.lit(True) if p + slack >= 1 else whole | (F.col("value") <= F.col("_edges")[2 * i + 1])
        place = F.struct(F.lit(i).alias("i"), F.when(low, F.col("value")).alias("value"))
        places.append(F.when(high, place))
    each = near.select("feature", "total", F.explode(F.array_compact(F.array(*places))).alias("_at"))
    return each.groupBy("feature", "total", F.col("_at.i").alias("i"), F.col("_at.value").alias("value")).agg(F.count("*").alias("n"))


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], buckets: int = 256
) -> DataFrame:
    """Linear-interpolation quantiles of every column: ``(feature, n, q0, q1, …)``.

    Only values next to a wanted rank are ordered, in ranges; the others are counted.
    """
    counts = bracketed_counts(unpivoted(df, cols), probs)
    by = ["feature", "i"]
    below = counts.where(F.col("value").isNull()).select(*by, F.col("n").alias("_below"))
    inside = counts.where(F.col("value").isNotNull())
    bucketed = _bucketed(inside, by, buckets)
    # One row per feature name and wanted quantile on the right.
    offsets = _bucket_offsets(bucketed, by, ["n"]).join(F.broadcast(below), by, "left").join(
        F.broadcast(inside.groupBy(*by).agg(F.max("total").alias("total"))), by
    )
    offsets = offsets.withColumn("before_n", F.col("before_n") + F.coalesce("_below", F.lit(0)))
    position = (F.col("total") - 1) * F.array(*[F.lit(float(p)) for p in probs])[F.col("i")]
    sides = F.array(*[
        F.struct(F.lit(side).alias("side"), rank.cast("bigint").alias("rank"))
        for side, rank in (("lo", F.floor(position)), ("hi", F.ceil(position)))
    ])
    here = F.filter(sides, lambda w: (w["rank"] >= F.col("before_n")) & (w["rank"] < F.col("before_n") + F.col("n")))
    # At most one row per wanted rank and feature name.
    wanted = offsets.select(*by, "bucket", "before_n", here.alias("wants")).where(F.size("wants") > 0)
    order = W.partitionBy(*by, "bucket").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    hit = (
        bucketed.join(F.broadcast(wanted), [*by, "bucket"])
        .withColumn("upto", F.col("before_n") + F.sum("n").over(order))
        .select("feature", "i", "value", "n", "upto", "total", F.explode("wants").alias("w"))
        .where((F.col("w.rank") < F.col("upto")) & (F.col("w.rank") >= F.col("upto") - F.col("n")))
        .select("feature", "value", "total", "i", F.col("w.side").alias("side"))
    )

    def quantile(i: int, p: float) -> Column:
        low = F.max(F.when((F.col("i") == i) & (F.col("side") == "lo"), F.col("value")))
        high = F.max(F.when((F.col("i") == i) & (F.col("side") == "hi"), F.col("value")))
        at = (F.max("total") - 1) * F.lit(float(p))
        weight = at - F.floor(at)
        # A rank outside its bracket would be a broken sketch: say so rather than answer null.
        value = F.coalesce(low * (1 - weight) + high * weight, F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double"))
        return value.alias(f"q{i}")

    return hit.groupBy("feature").agg(
        F.max("total").alias("n"), *[quantile(i, p) for i, p in enumerate(probs)]
    )


def quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    method: str = "exact",
    accuracy: int = 10000,
) -> DataFrame:
    """``(feature, n, q0, …)``, exact or from a one-pass sketch."""
    if method == "exact":
        return exact_quantiles(df, cols, probs)
    if method != "approx":
        raise ValueError(f"unknown quantile method {method!r}")
    return (
        unpivoted(df, cols)
        .groupBy("feature")
        .agg(
            F.count("*").alias("n"),
            F.percentile_approx("value", [float(p) for p in probs], accuracy).alias("q"),
        )
        .select("feature", "n", *[F.col("q")[i].alias(f"q{i}") for i in range(len(probs))])
    )


def widened(names: Sequence[str], value: Column, suffix: str = "") -> list[Column]:
    """Aggregates that turn rows keyed by ``feature`` into one column per name."""
    return [F.max(F.when(F.col("feature") == c, value)).alias(f"{c}{suffix}") for c in names]


def numbered(df: DataFrame, *order: Column, name: str = "position", buckets: int = 1024) -> DataFrame:
    """Add the 0-based position in the global order of ``order``, which must be unique.

    The cut points are the ``buckets`` keys with the smallest hashes, a uniform
    sample of the keys; each range between two of them is ordered on its own.
    """
    keyed = df.withColumn("_key", F.struct(*order))
    sample = keyed.select("_key").orderBy(F.xxhash64("_key")).limit(buckets - 1)
    cuts = sample.agg(F.sort_array(F.collect_list("_key")).alias("cuts"))
    located = count_below(
        attach(keyed, cuts, "_cuts").withColumn("_cuts", F.col("_cuts.cuts")), "_cuts", "_key", "_range", buckets
    )
    # At most `buckets` rows.
    before = W.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        located.groupBy("_range")
        .agg(F.count("*").alias("_n"))
        .select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    inside = F.row_number().over(W.partitionBy("_range").orderBy("_key"))
    return located.join(F.broadcast(offsets), "_range").select(
        *df.columns, (F.col("_before") + inside - 1).alias(name)
    )
