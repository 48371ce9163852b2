"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept and returns the columns of ``documents``,
the last one its pieces.  Null texts count as empty, repeated rows as documents of
their own until near-duplicates are removed, and an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontaminate, ngram_join, packing, secrets
from tidewatch.llm.settings import table, toxicity_chain, vocabulary
from tidewatch.session import work_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

# The first stage learns from labels and the second is randomized: no SQL says the same.
ORACLE_SQL = None


def clean(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drops documents that the classifier chain finds toxic."""
    docs = docs.select(*COLUMNS)
    scored = toxicity_chain(docs, table(spark, folder, "labels")).score(docs)
    return scored.where("NOT is_toxic").select(*COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each group of near-duplicates."""
    return ngram_join.keep_one(docs.select(*COLUMNS))


def unseen(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs."""
    found = decontaminate.find(docs, table(spark, folder, "benchmark"), keep=tuple(COLUMNS))
    return found.where(F.size("spans") == 0).select(*COLUMNS)


def redacted(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Replaces secrets in the texts, and counts the characters of those texts anew."""
    found = secrets.find(docs, keep=tuple(COLUMNS))
    counted = F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return secrets.redact(found).withColumn("n_chars", counted).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Tokenizes the texts and packs them into sequences of at most 2048 tokens."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("toxicity", clean), ("ngram_join", distinct), ("decontaminate", unseen), ("secrets", redacted), ("packing", packed),
]


def run(spark: SparkSession, folder: str) -> DataFrame:
    """Applies the stages to the table of documents, each one's result written and read again."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES:
        path = work_folder(spark, f"pipeline-{name}")
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
