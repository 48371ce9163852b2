"""Word windows against a search of every window at every place."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import decontaminate

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_LOWER))


def brute(text, items, size):
    found = plain_words(text)
    hit, named = set(), set()
    for key, body in items:
        item = plain_words(body)
        m = min(size, len(item))
        wanted = {tuple(item[i:i + m]) for i in range(len(item) - m + 1)} if m else set()
        for i in range(len(found) - m + 1):
            if tuple(found[i:i + m]) in wanted:
                hit.update(range(i, i + m))
                named.add("null" if key is None else str(key))
    return len(found), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)


BODIES = [
    None, "", "...", "one two three four five six seven", "One TWO three, four-five six seven eight",
    "x one two three four five six seven eight nine ten " * 3, "a a a a a a a a a a a a a a a a", "é É Ünd ß ½ 漢字 K",
    "a " * 5000 + "one two three four five six seven eight nine ten eleven", "zero b c zero b c d",
]
ITEMS = [
    (1, "one two three four five six seven eight nine ten eleven"), (10, "a a a a a a a a a a a"), (2, "ZERO b c"),
    (2, "zero b c d"), (None, "ünd ß ½ 漢字"), (7, None), (8, " ,"), (9, "one two three four five six seven eight nine ten"),
]


def test_edge_rows_in_one_and_many_shards(spark):
    rows = [(i, b, 1, "z") for i, b in enumerate(BODIES)] + [(3, BODIES[5], 1, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, items string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    expected = sorted((i, *brute(b, ITEMS, 10)) for i, b, *_ in rows)
    for shard in (decontaminate.SHARD, 3):
        found = decontaminate.report(decontaminate.find(docs, items, shard=shard))
        assert found.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
        assert sorted(tuple(r) for r in found.collect()) == expected


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontaminate.report(decontaminate.find(docs, items)).collect()] == [0]
    assert decontaminate.find(docs.limit(0), items).count() == 0


WORD = st.sampled_from([b"a", b"b", b"c"])


@given(st.lists(WORD, max_size=60), st.lists(st.lists(WORD, min_size=1, max_size=9).map(tuple), min_size=1, max_size=6))
@settings(max_examples=400, deadline=None)
def test_search_finds_every_occurrence(text, patterns):
    for n in {len(p) for p in patterns}:
        same = {p: [str(i)] for i, p in enumerate(patterns) if len(p) == n}
        found = {(s, k) for s, ks in decontaminate.WuManber(n, same).search(text) for k in ks}
        assert found == {(i, k) for i in range(len(text) - n + 1) for k in same.get(tuple(text[i:i + n]), [])}
