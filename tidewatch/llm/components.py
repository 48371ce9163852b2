"""Connected components of a table of links, in DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import materialize


def _print(edges: DataFrame) -> tuple:
    """Number and combined hash of the edges: unchanged when a round changed nothing."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Connects neighbours to the smallest node around: the larger neighbours of every
    node (large star), or every node's smaller neighbours and itself (small star)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.where("b < a")
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    found = both.join(least, "a")
    if large:
        linked = found.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        linked = found.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return linked.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node it reaches) for every node of the links
    ``a``, ``b`` (long) that is not a root itself.

    Alternating large and small stars: the number of rounds grows with the logarithm
    of the longest chain.  Each round is written to the shared folder, so a lost
    executor costs one round at most; nothing but two numbers reaches the driver.
    """
    now = materialize(edges.select("a", "b").where("a <> b").distinct(), "links")
    mark = _print(now)
    while mark[0]:
        now = materialize(_star(_star(now, True), False), "links")
        before, mark = mark, _print(now)
        if mark == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
