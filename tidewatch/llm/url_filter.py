"""URL filters: rules first, gradient-boosted trees on lexical features for the rest.

A URL is described by its length, depth, share of digits, entropy, numbers of parameters
and labels, and by statistics of its suffixes: how often labelled URLs with the same last
one, two or three labels of the host, or the same file suffix, were blocked.  Training
rows get these statistics from folds that do not hold them, so that the trees meet them
as they will on new URLs.

Trees, their thresholds and the suffix table come from every distinct labelled URL (a
``sample`` chosen by hash only if the caller asks for one).  The suffix table grows with
the labelled URLs, so its joins carry no hint: small ones are broadcast by size, a common
suffix of a large one is split by adaptive execution.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import materialize

TASKS = 4  # least partitions of the training rows
ROWS = 50_000  # training rows of a partition
BINS = 32  # least candidate thresholds of a feature
FOLDS = 3
PRIOR = 4.0  # labelled URLs' worth of the overall rate that each suffix starts with

_SUFFIXES = ["one", "two", "three", "file"]
_LEXICAL = ["length", "host_length", "depth", "labels", "digits", "entropy", "parameters", "hyphens", "secure"]
FEATURES = [*_LEXICAL, *(f"{kind}_{s}" for s in _SUFFIXES for kind in ("rate", "seen"))]


def host(url: str) -> Column:
    """What follows the first ``://`` up to a slash, question mark or hash, A-Z in lower case."""
    found = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: str) -> Column:
    """What follows the host up to a question mark or hash."""
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def ruled(rules: Sequence[tuple[str, str, str]], host: str = "host", path: str = "path") -> Column:
    """The longest rule (verdict, host, path) that fits, as a struct (size, rule, verdict), else null.

    A rule fits its host and all hosts below it if the path starts with the rule's.
    """
    found = []
    for verdict, name, start in rules:
        at = F.col(host)
        fits = ((at == name) | at.endswith(f".{name}")) & F.col(path).startswith(start)
        rule = F.struct(F.lit(len(name + start)).alias("size"), F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        found.append(F.when(fits, rule))
    if not found:
        return F.lit(None).cast("struct<size int, rule string, verdict string>")
    return F.array_max(F.array_compact(F.array(*found)))


def described(rows: DataFrame, url: str) -> DataFrame:
    """Adds the lexical features and the hashes of the suffixes (null where there is none)."""
    text = F.coalesce(F.col(url), F.lit(""))
    rows = rows.withColumns({"_url": text, "_host": host(url), "_path": path(url)})
    rows = rows.withColumn("_labels", F.split("_host", r"\."))
    size = "greatest(length(_url), 1)"
    times = "transform(array_distinct(split(_url, '')), c -> (length(_url) - length(replace(_url, c, ''))) / length(_url))"
    rows = rows.withColumns({
        "length": F.length("_url").cast("double"),
        "host_length": F.length("_host").cast("double"),
        "depth": F.expr("CAST(size(filter(split(_path, '/'), x -> x <> '')) AS DOUBLE)"),
        "labels": F.size("_labels").cast("double"),
        "digits": F.expr(f"length(regexp_replace(_url, '[^0-9]', '')) / {size}"),
        "entropy": F.expr(f"IF(_url = '', 0D, aggregate({times}, 0D, (s, x) -> s - x * log2(x)))"),
        "parameters": F.expr("CAST(size(filter(split(regexp_extract(_url, '[?]([^#]*)', 1), '&'), x -> x <> '')) AS DOUBLE)"),
        "hyphens": F.expr("CAST(length(_host) - length(replace(_host, '-', '')) AS DOUBLE)"),
        "secure": F.lower("_url").startswith("https://").cast("double"),
    })
    ends = {
        name: F.when(F.size("_labels") >= n, F.array_join(F.slice("_labels", -n, n), ".")) for n, name in enumerate(_SUFFIXES[:3], 1)
    }
    last = F.regexp_extract("_path", r"\.([A-Za-z0-9]+)$", 1)
    ends["file"] = F.when(last != "", F.concat(F.lit("/."), F.lower(last)))
    return rows.withColumns({f"_{n}": F.xxhash64(F.lit(n), e) for n, e in ends.items()} | {
        f"_{n}_set": e.isNotNull() for n, e in ends.items()
    }).withColumns({f"_{n}": F.when(F.col(f"_{n}_set"), F.col(f"_{n}")) for n in _SUFFIXES}).drop(
        "_url", "_path", "_labels", *(f"_{n}_set" for n in _SUFFIXES)
    )


def _suffixes(rows: DataFrame, rate: float) -> DataFrame:
    """kind, suffix, rate (drawn towards the overall one), seen."""
    ends = F.array(*(F.struct(F.lit(s).alias("kind"), F.col(f"_{s}").alias("suffix")) for s in _SUFFIXES))
    each = rows.select("blocked", F.inline(ends)).where("suffix IS NOT NULL")
    return each.groupBy("kind", "suffix").agg(
        ((F.sum("blocked") + F.lit(PRIOR * rate)) / (F.count("*") + F.lit(PRIOR))).alias("rate"),
        F.log1p(F.count("*").cast("double")).alias("seen"),
    )


def _with_statistics(rows: DataFrame, suffixes: DataFrame, rate: float) -> DataFrame:
    for s in _SUFFIXES:
        known = suffixes.where(F.col("kind") == s).select(
            F.col("suffix").alias(f"_{s}"), F.col("rate").alias(f"rate_{s}"), F.col("seen").alias(f"seen_{s}")
        )
        rows = rows.join(known, f"_{s}", "left")
        rows = rows.withColumns({f"rate_{s}": F.coalesce(f"rate_{s}", F.lit(rate)), f"seen_{s}": F.coalesce(f"seen_{s}", F.lit(0.0))})
    return rows


@dataclass
class Filter:
    """Fitted trees and suffix table; without trees every URL gets the overall rate."""

    model: GBTClassificationModel | None
    suffixes: DataFrame | None
    rate: float
    threshold: float = 0.5

    def score(self, rows: DataFrame, url: str = "url") -> DataFrame:
        """Adds p_block, the probability that a URL is to be blocked; other columns stay."""
        columns = [c for c in rows.columns if c != "p_block"]
        if self.model is None:
            return rows.select(*columns, F.lit(self.rate).alias("p_block"))
        held = rows.select(F.struct(*columns).alias("_row"), F.col(url).alias("_text"))
        found = _with_statistics(described(held, "_text"), self.suffixes, self.rate)
        found = self.model.transform(VectorAssembler(inputCols=FEATURES, outputCol="_input").transform(found))
        return found.select(*(F.col("_row")[c].alias(c) for c in columns), vector_to_array("_probability")[1].alias("p_block"))

    def judge(self, pages: DataFrame, rules: Sequence[tuple[str, str, str]] = (), key: str = "page_id", url: str = "url") -> DataFrame:
        """key, host, path, rule, verdict, p_block for each page, repeated ones too.

        The verdict (allow or block) is that of the longest rule that fits; ``rule`` is
        null and the trees decide where none does.  A null URL, or one without ``://``,
        has an empty host and path and is judged by the trees.
        """
        rows = pages.select(F.col(key).alias("_key"), F.col(url).cast("string").alias("_page_url"))
        scored = self.score(rows, "_page_url").withColumns({"host": host("_page_url"), "path": path("_page_url")})
        scored = scored.withColumn("_rule", ruled(rules))
        guess = F.when(F.col("p_block") >= self.threshold, "block").otherwise("allow")
        return scored.select(
            F.col("_key").alias(key), "host", "path", F.col("_rule.rule").alias("rule"),
            F.coalesce("_rule.verdict", guess).alias("verdict"), "p_block",
        )


def rule_labels(pages: DataFrame, rules: Sequence[tuple[str, str, str]], url: str = "url") -> DataFrame:
    """Labelled URLs from the rules themselves: url and blocked (0 or 1) of every page a rule decides."""
    rows = pages.select(F.col(url).cast("string").alias("url")).withColumns({"host": host("url"), "path": path("url")})
    return rows.withColumn("_rule", ruled(rules)).where("_rule IS NOT NULL").select(
        "url", F.when(F.col("_rule.verdict") == "block", 1).otherwise(0).alias("blocked")
    )


def train(
    labelled: DataFrame, url: str = "url", label: str = "blocked", sample: int | None = None, trees: int = 20, depth: int = 4,
    threshold: float = 0.5, seed: int = 17,
) -> Filter:
    """Fits the trees on all distinct labelled URLs, or on ``sample`` of them, chosen by hash.

    Rows with a null URL or another label than 0 and 1 are left out; of several labels
    of a URL the largest counts.  Without rows, or with one class only, there are no
    trees and every URL gets the share of blocked ones (0 without rows).
    """
    rows = labelled.where(F.col(url).isNotNull() & F.col(label).isin(0, 1))
    rows = rows.groupBy(F.xxhash64(url).alias("_order"), F.col(url).cast("string").alias("url")).agg(
        F.max(label).cast("int").alias("blocked")
    )
    short = described(rows, "url").drop("url")  # numbers and hashes only: rows of bounded size
    short = short.withColumn("_fold", F.expr(f"CAST(pmod(xxhash64(_host), {FOLDS}) AS INT)")).drop("_host")
    if sample is not None:
        short = short.orderBy("_order", *_LEXICAL, *(f"_{s}" for s in _SUFFIXES)).limit(sample)
    chosen = materialize(short, "urls")
    count, blocked = chosen.agg(F.count("*"), F.coalesce(F.sum("blocked"), F.lit(0))).first()
    rate = blocked / count if count else 0.0
    if blocked in (0, count):
        return Filter(None, None, rate, threshold)
    parts = []
    for fold in range(FOLDS):
        others = _suffixes(chosen.where(F.col("_fold") != fold), rate)
        parts.append(_with_statistics(chosen.where(F.col("_fold") == fold), others, rate))
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    table = VectorAssembler(inputCols=FEATURES, outputCol="_input").transform(table).select("_input", "blocked", "_order")
    tasks = max(TASKS, math.ceil(count / ROWS))
    table = materialize(table.repartition(tasks, "_order").sortWithinPartitions("_order", "blocked").drop("_order"), "urls")
    learner = GBTClassifier(
        featuresCol="_input", labelCol="blocked", predictionCol="_prediction", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=seed,
        maxBins=max(BINS, math.ceil(math.sqrt(count))),  # Spark ML draws a sample of maxBins squared rows for thresholds: here all
    ).setProbabilityCol("_probability").setRawPredictionCol("_raw")
    return Filter(learner.fit(table), materialize(_suffixes(chosen, rate), "suffixes"), rate, threshold)
