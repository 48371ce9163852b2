"""Ranked lexical search, term at a time with a limited number of accumulators.

One pass over the documents notes their lengths and how often they hold each term that
some query asks for.  A second pass reads these notes in segments of bounded size, each
with an inverted index of its own, and answers every query on every segment: the rarest
term comes first and opens an accumulator for each of its documents; once all terms
still to come cannot lift a new document to the k-th best partial score, no accumulator
is opened any more and the remaining terms only update, exactly, those that are open.
A task carries the best documents of a query from segment to segment, so later segments
stop earlier.  No posting is shuffled, a term that every document holds is spread over
all segments, and what leaves a task is at most k rows a query.

Queries are broadcast in shards of bounded size; a larger set is searched shard by shard.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from tidewatch.llm.words import words
from tidewatch.session import discard, materialize, work_folder

SHARD_TERMS, SHARD_BYTES = 100_000, 16 << 20  # query terms, with their bytes, searched for at once
SEGMENT_ROWS, SEGMENT_POSTINGS = 50_000, 4_000_000  # of a segment: bounds memory only


class Segment:
    """Inverted index of some documents: what each occurrence adds for a weight of 1."""

    def __init__(self, terms: np.ndarray, docs: np.ndarray, times: np.ndarray, norms: np.ndarray):
        order = np.argsort(terms, kind="stable")
        terms, self.docs, times = terms[order], docs[order], times[order]
        self.parts = (1_000_000_000 * times) // (1000 * times + 8 * norms[self.docs])
        found, starts = np.unique(terms, return_index=True)
        ends = [*starts[1:].tolist(), len(terms)]
        self.ranges = dict(zip(found.tolist(), zip(starts.tolist(), ends, strict=True), strict=True))
        most = np.maximum.reduceat(self.parts, starts) if len(starts) else np.empty(0, np.int64)
        self.most = dict(zip(found.tolist(), most.tolist(), strict=True))
        self.scores, self.open = np.zeros(len(norms), np.int64), np.zeros(len(norms), bool)

    def best(self, query: list[tuple[int, int]], k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents that may be among the ``k`` best, their scores, and the number of accumulators.

        ``query`` has terms and weights, the rarest first; documents that score less
        than ``floor`` may be left out.
        """
        here = [(t, w) for t, w in query if t in self.ranges and w > 0]
        bounds = [w * self.most[t] for t, w in here]
        left, limited = sum(bounds), False
        scores = self.scores
        held = np.empty(0, np.int64)
        for (term, weight), bound in zip(here, bounds, strict=True):
            if not limited and left < self._threshold(scores[held], k, floor):
                limited = True
            begin, end = self.ranges[term]
            docs, parts = self.docs[begin:end], self.parts[begin:end]
            known = self.open[docs]
            if limited:
                docs, parts = docs[known], parts[known]
            else:
                held = np.concatenate([held, docs[~known]])
                self.open[docs] = True
            scores[docs] += weight * parts
            left -= bound
        found = scores[held]
        scores[held] = 0
        self.open[held] = False
        keep = (found > 0) & (found >= self._threshold(found, k, floor))
        return held[keep], found[keep], len(held)

    @staticmethod
    def _threshold(found: np.ndarray, k: int, floor: int) -> int:
        if len(found) < k:
            return floor
        return max(floor, int(np.partition(found, len(found) - k)[len(found) - k]))


def _first(item: tuple) -> tuple:
    """The order of results: high scores, then small keys, a null key last."""
    score, key = item
    return (-score, key is None, 0 if key is None else key)


def _terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """query (a number for each row), item, term, times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, terms, times = [], [], []
            for row, body in enumerate(batch.column("text")):
                found = Counter(words(body.as_py()))
                at += [row] * len(found)
                terms += [t.decode() for t in found]
                times += found.values()
            rows = batch.select(["query", "item"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(terms, pa.string()), pa.array(times, pa.int64())], names=["query", "item", "term", "times"]
            )

    rows = items.select(
        F.monotonically_increasing_id().alias("query"), F.col(item).alias("item"), F.col(text).cast("string").alias("text")
    )
    schema = T.StructType([rows.schema["query"], rows.schema["item"], *T.StructType.fromDDL("term string, times long").fields])
    return rows.mapInArrow(run, schema)


def _notes(docs: DataFrame, wanted) -> DataFrame:
    """key, n (all terms of the document), terms and times of those that are ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = wanted.value
        for batch in batches:
            lengths, sizes, terms, times = [], [0], [], []
            for body in batch.column("text"):
                found = words(body.as_py())
                lengths.append(len(found))
                for term, count in Counter(found).items():
                    number = numbers.get(term)
                    if number is not None:
                        terms.append(number)
                        times.append(count)
                sizes.append(len(terms))
            ends = pa.array(sizes, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(times, pa.int64()))],
                names=["key", "n", "terms", "times"],
            )

    added = T.StructType.fromDDL("n long, terms array<int>, times array<long>").fields
    return docs.mapInArrow(run, T.StructType([docs.schema["key"], *added]))


def _segments(batches: Iterator[pa.RecordBatch], n_all: int, length: int) -> Iterator[tuple[Segment, list]]:
    """The documents of a task, some at a time: their index and their keys."""
    waiting: list[pa.RecordBatch] = []

    def built() -> tuple[Segment, list]:
        rows = pa.Table.from_batches(waiting).combine_chunks()
        terms, times = (rows.column(c).combine_chunks() for c in ("terms", "times"))
        norms = 25 + (75 * n_all * rows.column("n").to_numpy()) // max(1, length)
        docs = np.repeat(np.arange(rows.num_rows), np.diff(terms.offsets.to_numpy()))
        segment = Segment(terms.flatten().to_numpy(), docs, times.flatten().to_numpy(), norms)
        return segment, rows.column("key").to_pylist()

    held = postings = 0
    for batch in batches:
        waiting.append(batch)
        held += batch.num_rows
        postings += len(batch.column("terms").flatten())
        if held >= SEGMENT_ROWS or postings >= SEGMENT_POSTINGS:
            yield built()
            waiting, held, postings = [], 0, 0
    if held:
        yield built()


def _answers(notes: DataFrame, asked, n_all: int, length: int, k: int) -> DataFrame:
    """query, key, score: the best ``k`` of every task."""
    schema = T.StructType([T.StructField("query", T.LongType()), notes.schema["key"], T.StructField("score", T.LongType())])
    kind = to_arrow_type(notes.schema["key"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = asked.value
        best: dict[int, list[tuple]] = {q: [] for q, _ in queries}
        for segment, keys in _segments(batches, n_all, length):
            for query, terms in queries:
                kept = best[query]
                docs, scores, _ = segment.best(terms, k, kept[-1][0] if len(kept) == k else 1)
                if len(docs):
                    found = zip(scores.tolist(), map(keys.__getitem__, docs.tolist()), strict=True)
                    best[query] = sorted([*kept, *found], key=_first)[:k]
        rows = [(q, key, score) for q, kept in best.items() for score, key in kept]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int64(), kind, pa.int64()), strict=True)], names=schema.names
        )

    return notes.mapInArrow(run, schema)


def weight(holding: int, n_all: int) -> int:
    """What a term adds at most a million times, by the number of documents that hold it."""
    return math.floor(1000 * math.log((2 * n_all + 2) / (2 * holding + 1)))


def _search(docs: DataFrame, shard: DataFrame, k: int) -> DataFrame:
    """query, key, score: of each query of the shard the best of every task."""
    spark = docs.sparkSession
    context = spark.sparkContext
    asked = [tuple(r) for r in shard.select("query", "term", "times").collect()]  # bounded by the shard
    numbers = {t: i for i, t in enumerate(sorted({t for _, t, _ in asked}))}
    wanted = context.broadcast({t.encode(): i for t, i in numbers.items()})
    place = work_folder(spark, "notes")
    _notes(docs, wanted).write.parquet(place)
    wanted.destroy()
    notes = spark.read.parquet(place)
    n_all, length = notes.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = notes.select(F.explode("terms").alias("term")).groupBy("term").count()
    holding = {term: count for term, count in held.collect()}  # one row per asked term
    plans: dict[int, list[tuple[int, int, int]]] = {}
    for query, term, times in asked:
        count = holding.get(numbers[term], 0)
        if count:
            plans.setdefault(query, []).append((count, numbers[term], times * weight(count, n_all)))
    queries = context.broadcast([(q, [(t, w) for _, t, w in sorted(p)]) for q, p in sorted(plans.items())])
    found = materialize(_answers(notes.where("size(terms) > 0"), queries, n_all, length, k), "answers")
    queries.destroy()
    discard(spark, place)
    return found


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", shard_terms: int = SHARD_TERMS, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """The ``k`` highest-scoring documents of each item: item, rank (from 1), key, score.

    A term's weight falls with the number of documents that hold it, its share in a
    document's score rises with its occurrences there and falls with the document's
    length; scores are whole numbers.  Repeated terms of an item count as often.
    Documents that score 0 are left out; equal scores are ordered by key, a null key
    last.  Null and empty texts have no terms; repeated documents are ranked one by one,
    a repeated item gets its rows again.  Without documents or items there are no rows.
    """
    spark = docs.sparkSession
    terms = materialize(_terms(items, item, item_text), "terms")
    total, size = terms.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    shards = max(1, -(-total // shard_terms), -(-size // shard_bytes))
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    parts = [
        _search(rows, terms.where(F.expr(f"pmod(xxhash64(query), {shards}) = {number}")), k) for number in range(shards)
    ]
    found = functools.reduce(DataFrame.unionByName, parts)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("key")))
    best = found.withColumn("rank", place).where(F.col("rank") <= k)
    named = terms.select("query", "item").distinct()
    return best.join(named, "query").select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score")
