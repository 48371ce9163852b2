"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors at cosine c lie at squared distance 2 - 2c, and a rotation keeps that.
Cut into blocks, two linked vectors must in some block be closer than the block's
proportional share of the squared distance.  So each block is range-joined for itself:
its leading coordinates are cut at their means into sign cells, a vector lives in one
cell and also visits every cell that its share of the distance can reach, and whatever
meets in a cell is a candidate that the cosine of the whole vectors decides.

Equal vectors are one class from the start.  Cells with many classes are cut into
tiles that meet pairwise, so no task gets an unbounded group; a task returns, per
class, a number of links and one edge, never the pairs.  A pair that meets in several
blocks counts in the first of them, which both sides know from their own coordinates.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.components import components
from tidewatch.session import materialize

TILE = 2048  # classes of a cell that meet in one task
MOST_BITS = 16


def rotation(dims: int, seed: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision, safe against overflow."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


class Blocks:
    """The blocks of a rotated vector, their shares of the distance, and their cells.

    Squared coordinates are whole multiples of ``STEP``, so that sums of them agree
    whatever the order they are added in.
    """

    STEP = 2.0**-44

    def __init__(self, dims: int, threshold: float, blocks: int, bits: int, seed: int):
        self.starts = np.linspace(0, dims, min(blocks, dims) + 1).round().astype(int)
        sizes = np.diff(self.starts)
        self.bits = [min(bits, int(n)) for n in sizes]
        self.shares = np.ceil((sizes / dims * (2 - 2 * threshold) * (1 + 1e-9) + 1e-12) / self.STEP).astype(np.int64)
        self.turn = rotation(dims, seed)

    def leading(self, vectors: np.ndarray, centre: np.ndarray) -> np.ndarray:
        """The coordinates that choose cells, of all blocks side by side."""
        turned = (unit(vectors) - centre) @ self.turn
        return np.hstack([turned[:, at:at + n] for at, n in zip(self.starts, self.bits, strict=False)])

    def part(self, leading: np.ndarray, block: int) -> np.ndarray:
        at = sum(self.bits[:block])
        return leading[:, at:at + self.bits[block]]

    def squares(self, part: np.ndarray) -> np.ndarray:
        return np.floor(part * part / self.STEP).astype(np.int64)

    @staticmethod
    def cells(part: np.ndarray) -> np.ndarray:
        return (part >= 0) @ (1 << np.arange(part.shape[1], dtype=np.int64))

    def visited(self, part: np.ndarray, block: int) -> list[list[int]]:
        """For each row the higher cells where a vector within the block's share may live."""
        out, share = [], int(self.shares[block])
        for home, squares in zip(self.cells(part).tolist(), self.squares(part).tolist(), strict=True):
            found = [(home, 0)]
            for bit, square in enumerate(squares):
                if square <= share:
                    found += [(c ^ (1 << bit), s + square) for c, s in found if s + square <= share]
            out.append([c for c, _ in found if c > home])
        return out

    def meet(self, left: np.ndarray, right: np.ndarray, block: int) -> np.ndarray:
        """Which rows met in a block: the one in the lower cell visits the other's."""
        a, b = self.part(left, block), self.part(right, block)
        differ = (a >= 0)[:, None, :] != (b >= 0)[None, :, :]
        from_a = (differ * self.squares(a)[:, None, :]).sum(axis=2)
        from_b = (differ * self.squares(b)[None, :, :]).sum(axis=2)
        lower = self.cells(a)[:, None] <= self.cells(b)[None, :]
        return np.where(lower, from_a, from_b) <= self.shares[block]


def roots(linked: np.ndarray) -> np.ndarray:
    """The smallest row that each row reaches in a symmetric matrix of links."""
    none = len(linked)
    label = np.arange(none)
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], none).min(axis=1, initial=none))
        least = least[least]
        if (least == label).all():
            return label
        label = least


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def comparable() -> Column:
    """Whether a row has a label and a finite vector other than zero; never null."""
    return F.expr(
        "label IS NOT NULL AND embedding IS NOT NULL"
        " AND coalesce(forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < CAST('Infinity' AS DOUBLE)), false)"
        " AND coalesce(exists(embedding, x -> x <> 0), false)"
    )


def centre_of(classes: DataFrame, dims: int) -> np.ndarray:
    """Mean of the unit vectors: added up by Spark, one row per dimension is collected."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sums = unit(matrix(batch.column(0), dims)).sum(axis=0)
                yield pa.RecordBatch.from_pydict(
                    {"place": pa.array(range(dims), pa.int32()), "total": sums, "n": [batch.num_rows] * dims}
                )

    parts = classes.select("embedding").mapInArrow(add, "place int, total double, n long")
    means = parts.groupBy("place").agg((F.sum("total") / F.sum("n")).alias("mean"))
    return np.array([r["mean"] for r in means.orderBy("place").collect()])


def place(classes: DataFrame, plan: Blocks, dims: int, centre: np.ndarray) -> DataFrame:
    """Every class once per block and cell: its own (home) and those that it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            leading = plan.leading(matrix(batch.column("embedding"), dims), centre)
            values = pa.array(list(leading), pa.list_(pa.float64()))
            for block in range(len(plan.bits)):
                part = plan.part(leading, block)
                rows, cells, home = [], [], []
                for i, (own, others) in enumerate(zip(plan.cells(part).tolist(), plan.visited(part, block), strict=True)):
                    rows += [i] * (1 + len(others))
                    cells += [own, *others]
                    home += [True] + [False] * len(others)
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(at) for c in batch.columns), values.take(at), pa.array([block] * len(rows), pa.int32()),
                     pa.array(cells, pa.int64()), pa.array(home)],
                    [*batch.schema.names, "leading", "block", "cell", "home"],
                )

    added = T.StructType.fromDDL("leading array<double>, block int, cell long, home boolean")
    return classes.mapInArrow(run, T.StructType([*classes.schema.fields, *added.fields]))


def tiled(placed: DataFrame, tile: int) -> DataFrame:
    """Adds own (the tile of a row in its cell) and left, right (the tiles that meet).

    Home tiles meet each other and themselves, visiting tiles meet home tiles.
    """
    cell = ["label", "block", "cell"]
    counts = placed.groupBy(*cell).agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("visits"))
    sized = counts.where("homes > 0").selectExpr(
        *cell, f"CAST(ceil(homes / {tile}) AS INT) AS h", f"CAST(ceil(visits / {tile}) AS INT) AS v"
    )
    joined = placed.join(materialize(sized, "cells"), cell).withColumn(
        "own", F.expr("CAST(IF(home, pmod(xxhash64(cls), h), h + pmod(xxhash64(cls), greatest(v, 1))) AS INT)")
    )
    meets = F.expr(
        "IF(home, transform(sequence(0, h + v - 1), t -> struct(least(own, t) AS left, greatest(own, t) AS right)),"
        " transform(sequence(0, h - 1), t -> struct(t AS left, own AS right)))"
    )
    return joined.withColumn("meet", F.explode(meets)).select("*", "meet.*").drop("meet", "h", "v", "home")


def links(classes: DataFrame, threshold: float, blocks: int, tile: int, seed: int) -> DataFrame:
    """Partial results a, b, n: class a has n links to vectors of other classes, and its
    links reach class b (or null)."""
    shapes = classes.groupBy("label", F.size("embedding").alias("dims")).count()
    out = classes.sparkSession.createDataFrame([], "a long, b long, n long")
    for dims, most in shapes.groupBy("dims").agg(F.max("count")).collect():  # one row per vector length
        bits = min(MOST_BITS, max(1, math.ceil(math.log2(most / (2 * tile)))))  # about two tiles to a cell
        plan = Blocks(dims, threshold, blocks, bits, seed)
        same = classes.where(F.size("embedding") == dims).select("cls", "label", "embedding", "copies")
        placed = place(same, plan, dims, centre_of(same, dims))

        groups = tiled(placed, tile).groupBy("label", "block", "cell", "left", "right")
        out = out.unionByName(groups.applyInArrow(_meeting(plan, dims, threshold), "a long, b long, n long"))
    return out


def _meeting(plan: Blocks, dims: int, threshold: float) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        return meeting(table, plan, dims, threshold)

    return run


def meeting(table: pa.Table, plan: Blocks, dims: int, threshold: float) -> pa.Table:
    """Links between the two tiles of a group, or within the one tile that meets itself."""
    own, block = table.column("own").to_numpy(), table.column("block")[0].as_py()
    left, right = table.column("left")[0].as_py(), table.column("right")[0].as_py()
    rows, others = np.flatnonzero(own == left), np.flatnonzero(own == right)
    cls, copies = table.column("cls").to_numpy(), table.column("copies").to_numpy()
    leading = matrix(table.column("leading"), sum(plan.bits))
    vectors = unit(matrix(table.column("embedding"), dims))
    near = vectors[rows] @ vectors[others].T >= threshold
    if left == right:
        np.fill_diagonal(near, False)
    x, y = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    near, rows, others = near[np.ix_(x, y)], rows[x], others[y]
    for earlier in range(block if near.size else 0):
        near &= ~plan.meet(leading[rows], leading[others], earlier)
    if left == right:
        linked, members = near, rows
        count = near @ copies[others]
    else:
        members = np.concatenate([rows, others])
        linked = np.zeros((len(members), len(members)), dtype=bool)
        linked[: len(rows), len(rows):] = near
        linked |= linked.T
        count = linked @ copies[members]
    label = cls[members][roots(linked)] if len(members) else np.empty(0, np.int64)
    some = count > 0
    return pa.table({
        "a": pa.array(cls[members][some], pa.int64()), "b": pa.array(label[some], pa.int64()),
        "n": pa.array(count[some], pa.int64()),
    })


def near_duplicates(
    vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = 0.93,
    blocks: int = 4, tile: int = TILE, seed: int = 7,
) -> DataFrame:
    """One row per row of ``vectors``: key, n_links, component_id, kept.

    Vectors are compared when labels are equal and not null, and lengths agree; a
    vector that is null, empty, zero or holds a null or non-finite component links with
    nothing and is its own component.  ``n_links`` counts the other rows at cosine
    ``threshold`` or more, equal vectors included, so repeated rows count as others.
    ``component_id`` is the smallest key reached, null keys aside; ``kept`` marks rows
    that carry it.  An empty table gives no rows.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    rows = vectors.select(F.col(key).alias("key"), F.col(embedding).alias("embedding"), F.col(label).alias("label"))
    groups = rows.where(comparable()).groupBy("label", "embedding").agg(F.min("key").alias("first"), F.count("*").alias("copies"))
    classes = materialize(groups.withColumn("cls", F.monotonically_increasing_id()), "classes")
    found = materialize(links(classes, threshold, blocks, tile, seed), "links")
    counts = found.groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n"))
    root = components(found.select("a", "b")).select(F.col("node").alias("cls"), "root")
    joined = classes.join(counts, "cls", "left").join(root, "cls", "left").select(
        "label", "embedding", "first", F.coalesce("root", "cls").alias("root"),
        (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
    )
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    marked = materialize(joined.join(least, "root").drop("root", "first"), "marked")
    linked = rows.where(comparable()).join(marked, ["label", "embedding"]).select("key", "n_links", "component_id")
    alone = rows.where(~comparable()).select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("key").alias(key), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept")
    )
