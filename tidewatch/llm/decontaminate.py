"""Benchmark decontamination with Wu-Manber multi-pattern search over words.

The test strings are the benchmark's windows of consecutive words.  For each window
length a shift table says, for the block of words that ends at a text position, how
far no window can end; positions with shift zero look up the bucket of windows with
that last block, and the whole window is compared.  Documents are read once, with no
shuffle.  At most ``SHARD`` windows are in memory at a time: a larger benchmark is
searched shard by shard, what was found so far travelling along with the document.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.words import words
from tidewatch.session import materialize

SHARD = 200_000  # windows searched for at once: bounds what is broadcast, not what is searched

_FOUND = "n_words long, spans array<int>, items array<string>"
_searchers: dict[str, list[WuManber]] = {}


class WuManber:
    """All occurrences of word sequences of one length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], list[str]]):
        self.length = length
        self.block = block = 3 if length >= 6 else min(2, length)
        self.furthest = length - block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], dict] = {}
        for pattern, items in patterns.items():
            for end in range(block, length + 1):
                part = pattern[end - block:end]
                self.shift[part] = min(length - end, self.shift.get(part, self.furthest))
            self.bucket.setdefault(pattern[-block:], {})[pattern] = items

    def search(self, text: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """Start position and items of each occurrence, from left to right."""
        length, block, shift, furthest = self.length, self.block, self.shift, self.furthest
        end = length
        while end <= len(text):
            last = tuple(text[end - block:end])
            step = shift.get(last, furthest)
            if step == 0:
                items = self.bucket[last].get(tuple(text[end - length:end]))
                if items is not None:
                    yield end - length, items
                step = 1
            end += step


def searchers(name: str, pairs: list[tuple[str, str]]) -> list[WuManber]:
    """The searchers of a shard, one per window length, built once per Python worker."""
    if name not in _searchers:
        _searchers.clear()
        patterns: dict[int, dict] = {}
        for window, item in pairs:
            pattern = tuple(window.encode().split(b" "))
            patterns.setdefault(len(pattern), {}).setdefault(pattern, []).append(item)
        _searchers[name] = [WuManber(n, found) for n, found in patterns.items()]
    return _searchers[name]


def merged(spans: list[tuple[int, int]]) -> list[int]:
    """The union of word ranges, as start, end, start, end ..."""
    out: list[int] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def windows(items: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """Distinct (window, item): ``size`` consecutive words; an item of fewer is one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = words(body)
                for start in range(max(1, len(found) - size + 1) if found else 0):
                    rows.append((b" ".join(found[start:start + size]).decode(), item))
            yield pa.RecordBatch.from_pylist(
                [{"window": w, "item": i} for w, i in rows],
                schema=pa.schema([("window", pa.string()), ("item", pa.string())]),
            )

    chosen = items.select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("item"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, "window string, item string").distinct()


def _search(docs: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Adds a shard's occurrences to the columns spans and items."""
    name = uuid.uuid4().hex
    shard = docs.sparkSession.sparkContext.broadcast(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = searchers(name, shard.value)
        for batch in batches:
            counts, spans, items = [], [], []
            before = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True)
            for body, (ranges, named) in zip(batch.column("text"), before, strict=True):
                text = words(body.as_py())
                hits, seen = list(zip(ranges[::2], ranges[1::2], strict=True)), set(named)
                for searcher in found:
                    for start, which in searcher.search(text):
                        hits.append((start, start + searcher.length))
                        seen.update(which)
                counts.append(len(text))
                spans.append(merged(hits))
                items.append(sorted(seen))
            kept = [n for n in batch.schema.names if n not in ("n_words", "spans", "items")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in kept), pa.array(counts, pa.int64()),
                 pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))],
                names=[*kept, "n_words", "spans", "items"],
            )

    return docs.mapInArrow(run, docs.schema)


def find(
    docs: DataFrame, benchmark: DataFrame, size: int = 10, text: str = "text", item: str = "item_id",
    item_text: str = "text", keep: tuple[str, ...] = ("doc_id",), shard: int = SHARD,
) -> DataFrame:
    """One row per document: the columns ``keep``, n_words, spans and items.

    ``spans`` are the hit word ranges (start, end, start, end ...), ``items`` the ids
    whose windows occur, sorted as strings.  A null or empty text has no words; an item
    without words has no window; a null item id reads "null"; repeated items count
    once, repeated documents each give a row.  Without items nothing is hit.
    """
    pairs = materialize(windows(benchmark, size, item, item_text), "windows")
    shards = max(1, -(-pairs.count() // shard))
    others = [c for c in keep if c != text]
    rows = docs.select(
        F.struct(*(others or [F.lit(1).alias("none")])).alias("kept"), F.col(text).cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<int>").alias("spans"), F.array().cast("array<string>").alias("items"),
    )
    # Arrow hands nullability on; declare what comes back.
    names = T.StructType([rows.schema["kept"], rows.schema["text"], *T.StructType.fromDDL(_FOUND).fields])
    rows = rows.to(names)
    for number in range(shards):
        chosen = pairs.where(F.expr(f"pmod(xxhash64(window, item), {shards}) = {number}"))
        rows = _search(rows, [tuple(r) for r in chosen.collect()])
        if number + 1 < shards:
            rows = materialize(rows, "searched")
    kept = [F.col("text").alias(c) if c == text else F.col("kept")[c].alias(c) for c in keep]
    return rows.select(*kept, "n_words", "spans", "items")


def report(found: DataFrame) -> DataFrame:
    """Digest columns of ``find``: hit words, items and whether there are any."""
    pair = "aggregate(spans, 0L, (s, x) -> x - s)"  # ends minus starts, alternating
    return found.withColumns({
        "n_hit": F.expr(pair), "n_items": F.size("items").cast("long"),
        "items_sha256": F.sha2(F.array_join("items", ","), 256),
    }).withColumn("contaminated", F.col("n_hit") > 0).drop("spans", "items")
