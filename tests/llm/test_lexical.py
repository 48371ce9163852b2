"""Ranked search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np

from tidewatch.llm import lexical

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(_LOWER))


def brute(docs, items, k=10):
    found = [(key, Counter(plain_words(text))) for key, text in docs]
    n_all = sum(1 for _, c in found if c)
    length = sum(sum(c.values()) for _, c in found)
    holding = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scores = []
        for key, counts in found:
            m = 25 + (75 * sum(counts.values()) * n_all) // max(1, length)
            score = sum(
                math.floor(1000 * math.log((2 * n_all + 2) / (2 * holding[t] + 1))) * ((1000000000 * counts[t]) // (1000 * counts[t] + 8 * m))
                for t in plain_words(text) if counts[t]
            )
            if score > 0:
                scores.append((-score, key is None, key or 0))
        out += [(item, rank, None if none else key, -score) for rank, (score, none, key) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def data(seed, rows=400):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "É", "漢字", "A1", "a1"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    text = lambda n: "-".join(rng.choices(vocabulary, weights, k=n))
    docs = [(i, text(rng.randint(0, 40))) for i in range(rows)]
    docs += [(None, docs[3][1]), (5, docs[5][1]), (5, docs[5][1]), (900, None), (901, ""), (902, "..!"), (903, "W1 w2 " * 20000)]
    docs += [(1000 + i, "w7 same text w9") for i in range(30)]
    items = [(i, text(rng.randint(1, 12))) for i in range(12)]
    return docs, [*items, (50, None), (51, "w7 w9 w9"), (52, "unknown"), (51, "w7 w9 w9"), (None, "w1"), (53, "w7 " * 500)]


def searched(spark, docs, items, **options):
    rows = spark.createDataFrame([(k, t, 1, 2, "z") for k, t in docs], "doc_id long, text string, rank int, score int, item_id string")
    asked = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, doc_id int")
    found = lexical.search(rows, asked, **options)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_whole_and_in_shards_and_segments(spark, conf):
    docs, items = data(1)
    expected = brute(docs, items)
    assert searched(spark, docs, items) == expected
    assert searched(spark, docs, items, k=3) == brute(docs, items, 3)
    assert searched(spark, docs, items, shard_terms=20) == expected
    assert searched(spark, docs, items, shard_bytes=50) == expected


def test_empty_tables(spark):
    docs, items = data(2, 20)
    assert searched(spark, docs, []) == []
    assert searched(spark, [], items) == []
    assert searched(spark, [(1, None)], [(1, "a")]) == []


def test_accumulators_are_limited_and_survivors_exact():
    rng = np.random.default_rng(5)
    rows, limited = 3000, 0
    for _ in range(20):
        terms = [np.flatnonzero(rng.random(rows) < share) for share in (0.003, 0.02, 0.3, 0.8, 1.0)]
        flat = np.concatenate([np.full(len(d), t) for t, d in enumerate(terms)])
        docs, times = np.concatenate(terms), rng.integers(1, 4, len(flat))
        norms = rng.integers(25, 300, rows)
        segment = lexical.Segment(flat, docs, times, norms)
        query = [(0, 7000), (1, 4000), (9, 100), (2, 1200), (3, 200), (4, 3), (4, 0)]
        scores = np.zeros(rows, np.int64)
        for term, weight in query:
            here = flat == term
            np.add.at(scores, docs[here], weight * ((10**9 * times[here]) // (1000 * times[here] + 8 * norms[docs[here]])))
        for floor in (1, int(np.sort(scores)[-5])):
            found, values, opened = segment.best(query, 10, floor)
            limited += opened < rows
            assert (scores[found] == values).all()
            least = max(floor, np.sort(scores)[-10])
            assert set(np.flatnonzero(scores >= least)) <= set(found.tolist())
    assert limited >= 30


def test_segments_of_one_task(spark, monkeypatch):
    docs, items = data(4, 120)
    import pyarrow as pa

    numbers = {t.encode(): i for i, t in enumerate(sorted({w for _, x in items for w in plain_words(x)}))}
    table = {"key": [], "n": [], "terms": [], "times": []}
    for key, text in docs:
        found = Counter(w.encode() for w in plain_words(text))
        some = {numbers[w]: c for w, c in found.items() if w in numbers}
        for name, value in zip(table, (key, sum(found.values()), list(some), list(some.values())), strict=True):
            table[name].append(value)
    kinds = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("times", pa.list_(pa.int64()))])
    batches = pa.table(table, kinds).to_batches(max_chunksize=10)
    monkeypatch.setattr(lexical, "SEGMENT_ROWS", 25)
    parts = list(lexical._segments(iter(batches), 100, 2000))
    assert [len(keys) for _, keys in parts[:-1]] == [30] * (len(parts) - 1)
    assert [k for _, keys in parts for k in keys] == table["key"]
