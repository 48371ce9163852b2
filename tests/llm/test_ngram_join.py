"""The forest join against all pairs: recall, exactness, groups, skew and edge rows."""

import inspect
import random

import numpy as np
import pytest

from tidewatch.llm import ngram_join as N
from tidewatch.llm.queries import QUERIES
from tidewatch.llm.words import shingles, words


def plain(text, size=5):
    found = [w.decode() for w in words(text)]
    size = min(size, len(found))
    return {tuple(found[i:i + size]) for i in range(len(found) - size + 1)} if found else set()


def brute(rows):
    """(key, class, links, group, kept) of every row, from all pairs."""
    sets = [plain(t) for _, t in rows]
    n = len(rows)
    linked = np.zeros((n, n), dtype=bool)
    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])):
                common = len(sets[i] & sets[j])
                linked[i, j] = linked[j, i] = common / (len(sets[i]) + len(sets[j]) - common) >= 0.8
    root = N.roots(linked)
    least = lambda js: min((rows[j][0] for j in js if rows[j][0] is not None), default=None)
    out = []
    for i, (key, _) in enumerate(rows):
        same = least([j for j in range(n) if sets[j] == sets[i]]) if sets[i] else key
        group = least([j for j in range(n) if root[j] == root[i]])
        out.append((key, same, int(linked[i].sum()), group, key == group))
    return out


def order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("data", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_against_all_pairs(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    expected = brute(rows)
    found = QUERIES["op8_ngram_join"](spark, data).drop("text_key").collect()
    assert sum(r.n_links for r in found) > 0 and order(found) == order(expected)


def variants(count, seed, changes):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    out = []
    for _ in range(count):
        text = list(base)
        for _ in range(rng.randrange(changes)):
            text[rng.randrange(len(text))] = f"x{rng.randrange(500)}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("tile", [N.TILE, 16])
def test_large_groups_copies_and_edge_rows(spark, tile):
    texts = variants(90, 1, 4) + variants(30, 2, 8) + ["one two three"] * 25 + [None, "", " .,", "One, two: three"]
    texts += ["a b c d e", "a b c d e f", "x " * 3000, "x x x x x x", "漢字 é ß", "only once here"]
    rows = [(1000 - i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (1000, texts[0]), (None, None), (500, "")]
    random.Random(0).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS cls", "1 AS n", "2 AS cluster")
    found = N.near_duplicates(docs, tile=tile, recall=0.999, trees=40)
    assert order(found.drop("text_key").collect()) == order(brute(rows))


def test_empty_table(spark):
    assert N.near_duplicates(spark.createDataFrame([], "doc_id int, text string")).count() == 0


def test_prefix_shortens_until_the_recall():
    assert N.prefix_length(20, 8, 0.8, 0.99) == 7
    assert N.prefix_length(20, 8, 0.8, 0.9) == 8
    assert N.prefix_length(20, 8, 0.8, 0.9999) < 7
    with pytest.raises(ValueError):
        N.prefix_length(1, 8, 0.5, 0.99)


def test_exact_test_agrees_for_few_and_many_sets():
    sets = [shingles(t) for t in variants(40, 5, 9)]
    whole = N.similar(sets, sets, 0.8)
    for i in range(0, 40, 3):
        for j in range(0, 40, 7):
            assert N.similar([sets[i]], [sets[j]], 0.8)[0, 0] == whole[i, j]


def test_tasks_return_no_pairs(spark):
    rows = list(enumerate(variants(200, 9, 3)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = N.near_duplicates(docs, tile=50).collect()
    assert max(r.n_links for r in found) > 100


def test_keep_one(spark):
    same = " ".join(f"w{i}" for i in range(30))
    near = same + " more"
    rows = [(5, same, 1), (3, near, 2), (9, same, 3), (7, "alone it stands", 4), (3, near, 2), (3, same, 6), (None, None, 7),
            (None, None, 7), (8, "", 8), (None, "other words that repeat", 9), (None, "other words that repeat", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key int")
    found = sorted((tuple(r) for r in N.keep_one(docs).collect()), key=repr)
    threes = [r for r in found if r[0] == 3]
    assert len(threes) == 1 and threes[0] in rows
    assert found == sorted([threes[0], rows[3], rows[6], rows[7], rows[8], rows[9]], key=repr)
    assert N.keep_one(docs.limit(0)).count() == 0


def test_keep_one_of_each_group_though_keys_repeat(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(5, a), (7, a + " more"), (5, b), (9, b + " more"), (None, c), (None, c + " more"), (None, d), (None, d + " more")]
    found = [tuple(r) for r in N.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted((key, text[0]) for key, text in found if key) == [(5, "a"), (5, "b")]
    assert sorted(text[0] for key, text in found if key is None) == ["c", "d"] and len(found) == 4


def test_defaults_miss_next_to_no_pair_at_the_threshold():
    given = {k: p.default for k, p in inspect.signature(N.near_duplicates).parameters.items()}
    length = N.prefix_length(given["trees"], given["deepest"], given["threshold"], given["recall"])
    forest = N.Forest(given["trees"], given["deepest"], length, given["seed"])
    rng, missed = np.random.default_rng(3), 0
    for _ in range(3000):  # 80 of 100 shingles in common
        found = rng.integers(0, 2**63, 100, dtype=np.uint64) * np.uint64(2)
        a, b = (forest.nodes(forest.signature(x)) for x in (found[:90], np.concatenate([found[:80], found[90:]])))
        missed += not (a == b).any()
    assert missed <= 3


def test_searches_end_at_different_depths():
    given = {k: p.default for k, p in inspect.signature(N.near_duplicates).parameters.items()}

    def ends(size):
        least = N.least_similarity(size, 0.8)
        return least and N.levels(given["trees"], given["deepest"], least, given["recall"])

    assert ends(3) is None and set(ends(7)) == {8} and set(ends(100)) == {7, 8}
    assert sum(ends(100)) < sum(ends(11)) < sum(ends(7)) and ends(100) == ends(4) == ends(12)
    for size in (6, 7, 11, 100):
        least = N.least_similarity(size, 0.8)
        assert 1 - np.prod(1 - least ** np.array(ends(size))) >= given["recall"]


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.9])
def test_least_similarity_against_all_overlaps(threshold):
    for size in range(1, 60):
        reached = [c / (size + m - c) for m in range(1, 3 * size + 3) for c in range(1, min(size, m) + 1) if c < max(size, m)]
        assert N.least_similarity(size, threshold) == min((x for x in reached if x >= threshold), default=None)


def test_pairs_meet_at_the_end_of_either_search():
    rng = np.random.default_rng(1)
    ends, paths = rng.choice([0, 1, 2, 3, N._NEVER], 40).astype(np.uint8), rng.integers(0, 2, (40, 3), dtype=np.uint8)
    found = N.meet((ends, ends), (paths, paths))
    for i in range(40):
        for j in range(40):
            walk = [level for level in (3, 2, 1, 0) if (paths[i, :level] == paths[j, :level]).all()]
            opened = any(level >= ends[i] or level >= ends[j] for level in walk)
            assert found[i, j] == (opened and N._NEVER not in (ends[i], ends[j]))


def test_defaults_find_the_pairs_that_documents_of_each_size_can_have():
    given = {k: p.default for k, p in inspect.signature(N.near_duplicates).parameters.items()}
    whole = N.levels(given["trees"], given["deepest"], 0.8, given["recall"])
    forest, rng = N.Forest(given["trees"], given["deepest"], whole, given["seed"]), np.random.default_rng(5)
    for size, common in ((7, 6), (11, 9), (100, 80)):
        more = round(common / N.least_similarity(size, 0.8)) - size
        ends, missed = np.array(N.levels(given["trees"], given["deepest"], N.least_similarity(size, 0.8), given["recall"])), 0
        for _ in range(3000):
            found = rng.integers(0, 2**63, size + more, dtype=np.uint64) * np.uint64(2)
            a = forest.signature(found[:size]).reshape(given["trees"], -1)
            b = forest.signature(np.concatenate([found[:common], found[size:]])).reshape(given["trees"], -1)
            missed += not (np.logical_and.accumulate(a == b, axis=1).sum(axis=1) >= ends).any()
        assert missed <= 3
