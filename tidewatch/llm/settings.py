"""What the queries and the pipeline share: tables, labels and the vocabulary file."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import toxicity

CATEGORIES = ["quality", "toxic"]  # the labelled categories, in the order of the chain


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def toxicity_chain(docs: DataFrame, labels: DataFrame) -> toxicity.Chain:
    rows = toxicity.training_rows(docs, labels, CATEGORIES, "doc_id", "text")
    return toxicity.train(rows, CATEGORIES)


@functools.cache
def vocabulary() -> str:
    """The tokenizer file that the sequences are counted in."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
