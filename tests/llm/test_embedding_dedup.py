"""The pigeonhole join against all pairs, and components against a search."""

import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import embedding_dedup as E
from tidewatch.llm.components import components
from tidewatch.llm.queries import QUERIES


def brute(rows, threshold=0.93):
    """rows: (key, vector, label).  Returns (key, n_links, component, kept) in row order."""
    def ok(v, label):
        finite = v is not None and all(x is not None and math.isfinite(x) for x in v)
        return label is not None and finite and any(x != 0 for x in v)

    n = len(rows)
    link = np.zeros((n, n), dtype=bool)
    units = [E.unit(np.array([v], dtype=float))[0] if ok(v, c) else None for _, v, c in rows]
    for i in range(n):
        for j in range(i):
            a, b = units[i], units[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b):
                link[i, j] = link[j, i] = a @ b >= threshold
    root = E.roots(link)
    out = []
    for i, (key, *_) in enumerate(rows):
        keys = [rows[j][0] for j in range(n) if root[j] == root[i] and rows[j][0] is not None]
        least = min(keys, default=None)
        out.append((key, int(link[i].sum()), least, key == least))
    return out


def order(rows):
    return sorted(rows, key=repr)


def test_query_against_all_pairs(spark, folder):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    found = [tuple(r) for r in QUERIES["op3_embedding_dedup"](spark, folder).collect()]
    expected = brute(rows)
    assert order(found) == order(expected)


def test_edge_rows_and_small_tiles(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16))
    rows = []
    for i in range(160):
        v = centres[i % 12] + rng.standard_normal(16) * rng.choice([0, 0.05, 0.2, 0.35])
        rows.append((1000 - i, [float(x) for x in v * rng.choice([1, 10])], int(i % 12 < 9)))
    rows += [(5000 + i, rows[0][1], rows[0][2]) for i in range(40)]
    one = rows[1][1]
    rows += [
        (1, None, 1), (2, [], 1), (3, [0.0] * 16, 1), (4, [None, *one[1:]], 1), (5, [float("nan"), *one[1:]], 1),
        (6, [float("inf"), *one[1:]], 1), (7, one, None), (None, one, 1), (8, [1e300] * 16, 1), (9, [1e300] * 16, 1),
        (10, one[:5], 1), (10, one[:5], 1), (11, [1.0], 1), (12, [-1.0], 1),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    frame = frame.selectExpr("*", "1 AS n", "'x' AS cls", "2 AS left")
    for tile in (E.TILE, 7):
        found = [tuple(r) for r in E.near_duplicates(frame, tile=tile).collect()]
        assert order(found) == order(brute(rows))
    assert E.near_duplicates(frame.limit(0)).count() == 0


def test_tasks_return_no_pairs(spark):
    base = np.random.default_rng(1).standard_normal(8)
    rows = [(i, [float(x) for x in base + 1e-4 * i * np.eye(8)[i % 8]], 1) for i in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    classes = frame.selectExpr("vec_id AS cls", "label", "embedding", "1L AS copies")
    parts = E.links(classes, 0.93, 4, 100, 7)
    assert parts.count() < 300 * 12
    assert {r[0] for r in parts.groupBy("a").sum("n").select("sum(n)").collect()} == {299}


@given(st.integers(2, 24), st.integers(1, 8), st.integers(1, 6), st.integers(0, 10**6))
@settings(max_examples=150, deadline=None)
def test_linked_vectors_meet_in_some_block(dims, blocks, bits, seed):
    rng = np.random.default_rng(seed)
    a = E.unit(rng.standard_normal((12, dims)))
    b = E.unit(a + rng.standard_normal((12, dims)) * rng.uniform(0, 0.6) / math.sqrt(dims))
    plan = E.Blocks(dims, 0.93, blocks, bits, seed)
    x, y = plan.leading(a, np.zeros(dims)), plan.leading(b, np.zeros(dims))
    met = np.zeros((12, 12), dtype=bool)
    for block in range(len(plan.bits)):
        both = plan.meet(x, y, block)
        met |= both
        p, q = plan.part(x, block), plan.part(y, block)
        vp, vq, cp, cq = plan.visited(p, block), plan.visited(q, block), plan.cells(p), plan.cells(q)
        for i in range(12):
            for j in range(12):
                assert both[i, j] == (cp[i] == cq[j] or cq[j] in vp[i] or cp[i] in vq[j])
    assert (met | (a @ b.T < 0.93)).all()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 700)] + [(3, 3), (9, 7), (7, 9), (8, 9)]
    found = components(spark.createDataFrame(edges, "a long, b long"))
    expected = {i: 100 for i in range(101, 161)} | {i: 500 for i in range(501, 700)} | {8: 7, 9: 7}
    assert {r.node: r.root for r in found.collect()} == expected
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
