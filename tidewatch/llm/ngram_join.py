"""Near-duplicate documents: Jaccard join of word shingles by an LSH forest of MinHash tries.

Every document has 40 MinHash trees, in each a path of hashes, and looks for documents that
share a prefix of a path.  It begins with the whole paths and goes up a level in one tree
after the other until a document at the smallest similarity that it can be linked at is
found with the target recall.  That similarity depends on its number of shingles (7 shingles:
6 of 7; under 4: none at 0.8), so documents end at different depths.  Documents meet if
they share the prefix at which either ends.  The order in which trees are shortened is
fixed: to shorten where a node is small would count trees known to hold nothing.

Candidates are first compared by their whole signatures, far below the threshold, and those
that look alike are tied into clusters; only documents of clusters have their texts read
again, each is sent to its cluster once, and all pairs of a cluster are verified exactly.

Documents with equal shingle sets are one class from the start.  Large nodes and
clusters are cut into tiles that meet pairwise; small ones share tasks.  Tasks return
a number of links and one edge per class, never the pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.components import components
from tidewatch.llm.embedding_dedup import roots
from tidewatch.llm.words import mixed, shingles
from tidewatch.session import materialize

TREES, DEEPEST = 40, 8
TILE = 256  # classes of a cluster that meet in one task
TILE_SHINGLES = 4_000_000  # and their shingles
PACK_ROWS, PACK_SHINGLES = 2_000, 2_000_000  # of small groups that share a task
_COLUMNS = 4096
_PAIRS = 8192  # pairs of signatures that are compared in one go
_FEW = 64  # shingles; sets of more can be linked at next to the threshold itself
_NEVER = 255  # the end of a search that is not begun
_LINKS = "a long, b long, n long"


def prefix_length(trees: int, deepest: int, threshold: float, recall: float) -> int:
    """The longest prefix, of all trees alike, at which a pair at the threshold agrees in some
    tree with probability ``recall`` or more; shortened from the deepest path."""
    for length in range(deepest, 0, -1):
        if 1 - (1 - threshold**length) ** trees >= recall:
            return length
    raise ValueError("more trees are needed for this recall")


@cache
def least_similarity(size: int, threshold: float) -> float | None:
    """The smallest similarity, from ``threshold`` on, that a set of ``size`` can have to
    another set; None if there is none.  For large sets the threshold, which is never more."""
    if size > _FEW:
        return threshold
    found = []
    for common in range(math.ceil(threshold * size) - 1, size + 1):
        union = int(common / threshold) + 1  # the largest that is similar enough
        while union and common / union < threshold:
            union -= 1
        if union >= size and union > common > 0:
            found.append(common / union)
    return min(found, default=None)


@cache
def levels(trees: int, deepest: int, similarity: float, recall: float) -> tuple[int, ...]:
    """The level of each tree at which a search ends: one tree after the other goes up a
    level until a pair at ``similarity`` is found with probability ``recall``."""
    base = prefix_length(trees, deepest, similarity, recall)
    ends = np.full(trees, min(base + 1, deepest))
    for tree in range(trees):
        if 1 - np.prod(1 - similarity**ends) >= recall:
            break
        ends[tree] = base
    return tuple(ends.tolist())


class Forest:
    """MinHash signatures of shingle sets, as prefixes of trees and as one byte per hash.

    ``prefix`` is the length of all prefixes, or one for each tree.
    """

    def __init__(self, trees: int, deepest: int, prefix: int | tuple[int, ...], seed: int):
        rng = np.random.default_rng(seed)
        self.trees, self.deepest, self.prefix = trees, deepest, np.broadcast_to(prefix, trees)
        self.factor = rng.integers(0, 2**32, trees * deepest, dtype=np.uint32) | np.uint32(1)
        self.shift = rng.integers(0, 2**32, trees * deepest, dtype=np.uint32)

    def signature(self, found: np.ndarray) -> np.ndarray:
        least = np.full(len(self.factor), 2**32 - 1, np.uint32)
        values = (found >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(values), 2048):
            least = np.minimum(least, (np.multiply.outer(values[at:at + 2048], self.factor) + self.shift).min(axis=0))
        return least

    def nodes(self, signature: np.ndarray) -> np.ndarray:
        """One number per tree for the node at the end of the prefix."""
        paths = signature.reshape(self.trees, self.deepest)
        node = np.arange(self.trees, dtype=np.uint64)
        for level in range(self.prefix.max()):
            node = np.where(level < self.prefix, mixed(node + paths[:, level].astype(np.uint64)), node)
        return node.view(np.int64)

    def below(self, tree: int, marks: np.ndarray) -> np.ndarray:
        """The part of each signature's path that lies below the tree's prefix, as long for every tree."""
        path = marks[:, tree * self.deepest + self.prefix[tree]:(tree + 1) * self.deepest]
        return np.pad(path, ((0, 0), (0, self.deepest - self.prefix.min() - path.shape[1])))

    @staticmethod
    def bytes_of(signature: np.ndarray) -> bytes:
        return (signature >> np.uint32(24) ^ signature & np.uint32(255)).astype(np.uint8).tobytes()


def meet(ends: tuple[np.ndarray, np.ndarray], paths: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Pairs of a node that share the prefix at which the search of one of them ends.

    ``ends`` count levels below the node, as ``paths`` do.
    """
    same = paths[0][:, None, :] == paths[1][None, :, :]
    shared = np.logical_and.accumulate(same, axis=2).sum(axis=2)
    return (shared >= np.minimum.outer(*ends)) & (np.maximum.outer(*ends) != _NEVER)


def alike(left: np.ndarray, right: np.ndarray, pairs: np.ndarray, least: float) -> np.ndarray:
    """Those of the pairs of one-byte signatures whose estimated similarity is at least ``least``."""
    out, (a, b) = np.zeros(pairs.shape, dtype=bool), np.nonzero(pairs)
    for at in range(0, len(a), _PAIRS):
        i, j = a[at:at + _PAIRS], b[at:at + _PAIRS]
        same = np.count_nonzero(left[i] == right[j], axis=1)
        out[i, j] = (same / left.shape[1] - 1 / 256) / (1 - 1 / 256) >= least
    return out


def similar(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Pairs of sets with a Jaccard similarity of ``threshold`` or more, exactly."""
    sizes = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    small, large = np.minimum.outer(*sizes), np.maximum.outer(*sizes)
    out = np.zeros(small.shape, dtype=bool)
    if out.size <= 16:
        for i, j in zip(*np.nonzero(small >= threshold * large), strict=True):
            common = len(np.intersect1d(left[i], right[j], assume_unique=True))
            out[i, j] = common / (sizes[0][i] + sizes[1][j] - common) >= threshold
        return out
    # Shingles that only one set has can be in no intersection.
    values, column, count = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(left) + len(right)), np.concatenate(sizes))
    shared = count[column] > 1
    row, column = row[shared], (np.cumsum(count > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros(out.shape, np.float64)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        begin, end = np.searchsorted(column, [first, first + _COLUMNS])
        present = np.zeros((len(left) + len(right), _COLUMNS), np.float32)
        present[row[begin:end], column[begin:end] - first] = 1
        common += present[: len(left)] @ present[len(left):].T
    return common / (np.add.outer(*sizes) - common) >= threshold


def tiles(members: DataFrame, group: str, sizes: DataFrame, packs: int) -> DataFrame:
    """Adds own (a row's tile in its group) and the task group's columns pack, left, right.

    ``sizes`` has the number of tiles (t) of each group.  Groups of one tile share
    ``packs`` tasks; of larger ones every tile meets itself and every other.
    """
    meet = (
        f"IF(t = 1, array(struct(CAST(pmod(xxhash64({group}), {packs}) AS BIGINT) AS pack, 0 AS left, 0 AS right)),"
        f" transform(sequence(0, t - 1), x -> struct(-1L AS pack, least(own, x) AS left, greatest(own, x) AS right)))"
    )
    joined = members.join(sizes, group).withColumn("own", F.expr("CAST(pmod(xxhash64(cls), t) AS INT)"))
    return joined.withColumn("meet", F.explode(F.expr(meet))).select("*", "meet.*").drop("meet").withColumn(
        "one", F.expr(f"IF(pack < 0, {group}, 0L)")
    )


TASK = ["pack", "one", "left", "right"]


def _forest(cls: np.ndarray, linked: np.ndarray, weight: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Links of a symmetric matrix as rows a, b, n."""
    some = linked.any(axis=1)
    if not some.any():
        return []
    linked, cls, weight = linked[np.ix_(some, some)], cls[some], weight[some]
    return [(cls, cls[roots(linked)], linked @ weight)]


def compared(
    table: pa.Table, group: str, load: Callable[[pa.Table], object], test: Callable[[object, object], np.ndarray]
) -> pa.Table:
    """Links within the groups of a task, or between the two tiles of one group.

    ``load`` turns the rows of a group into a sliceable list, ``test`` gives the matrix
    of pairs that are linked.
    """
    rows: list = []
    table = table.sort_by([(group, "ascending"), ("own", "ascending"), ("cls", "ascending")])
    names, cls_all, own_all = (table.column(c).to_numpy() for c in (group, "cls", "own"))
    weights = table.column("copies").to_numpy()
    left, right = table.column("left")[0].as_py(), table.column("right")[0].as_py()
    edges = [0, *(np.flatnonzero(np.diff(names)) + 1).tolist(), len(names)]
    for begin, end in zip(edges, edges[1:], strict=False):
        cls, first = np.unique(cls_all[begin:end], return_index=True)  # repeated rows count in copies
        at = begin + first
        if len(cls) < 2:
            continue
        items, weight = load(table.take(pa.array(at))), weights[at]
        if left == right:
            linked = test(items, items)
            np.fill_diagonal(linked, False)
        else:
            own = own_all[at]
            a, b = np.flatnonzero(own == left), np.flatnonzero(own == right)
            if not len(a) or not len(b):
                continue
            linked = np.zeros((len(at), len(at)), dtype=bool)
            linked[np.ix_(a, b)] = test([items[i] for i in a], [items[i] for i in b])
            linked |= linked.T
        rows += _forest(cls, linked, weight)
    if not rows:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    return pa.table([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*rows, strict=True)], names=["a", "b", "n"])


def signatures(docs: DataFrame, forest: Forest, size: int) -> DataFrame:
    """key, text_key, set_key (null without words), shingles (their number), nodes, signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, counts, nodes, marks = [], [], [], []
            for text in batch.column("text"):
                found = shingles(text.as_py(), size)
                counts.append(len(found))
                if len(found):
                    signature = forest.signature(found)
                    sets.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    nodes.append(forest.nodes(signature))
                    marks.append(forest.bytes_of(signature))
                else:
                    sets.append(None)
                    nodes.append(None)
                    marks.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("text_key"), pa.array(sets, pa.binary()), pa.array(counts, pa.int64()),
                 pa.array(nodes, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                ["key", "text_key", "set_key", "shingles", "nodes", "signature"],
            )

    added = T.StructType.fromDDL("text_key long, set_key binary, shingles long, nodes array<long>, signature binary")
    return docs.mapInArrow(run, T.StructType([docs.schema["key"], *added.fields]))


def _clusters(
    classes: DataFrame, forest: Forest, ends: Callable[[int], tuple[int, ...] | None], least: float, tile: int
) -> DataFrame:
    """cls and cluster, of classes that look like another one.

    ``ends`` tells from a number of shingles where the search ends in each tree, the
    shallowest being the forest's prefixes: what meets at any depth shares such a node.
    """
    slim = classes.select("cls", F.posexplode("nodes").alias("tree", "node"))
    counts = slim.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
    counts = materialize(counts.selectExpr("node", f"CAST(ceil(n / {tile}) AS INT) AS t", "n"), "nodes")
    members = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # Here and below both sides grow with the corpus: merge joins at every size, never a broadcast.
    shared = slim.join(counts.drop("n", "t").hint("merge"), "node")
    shared = shared.join(classes.select("cls", "signature", "shingles").hint("merge"), "cls")
    shared = shared.withColumn("copies", F.lit(1).cast("long"))
    width = forest.deepest - int(forest.prefix.min())

    def load(table: pa.Table) -> np.ndarray:
        """Per row the end of its search and its path, both below the node, and its signature."""
        tree, sizes = table.column("tree")[0].as_py(), table.column("shingles").to_pylist()
        marks = np.stack([np.frombuffer(s, np.uint8) for s in table.column("signature").to_pylist()])
        found = [_NEVER if (e := ends(n)) is None else e[tree] - forest.prefix[tree] for n in sizes]
        return np.hstack([np.array(found, np.uint8)[:, None], forest.below(tree, marks), marks])

    def test(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        left, right = np.asarray(left), np.asarray(right)
        pairs = meet((left[:, 0], right[:, 0]), (left[:, 1:1 + width], right[:, 1:1 + width]))
        return alike(left[:, 1 + width:], right[:, 1 + width:], pairs, least)

    def run(table: pa.Table) -> pa.Table:
        return compared(table, "node", load, test)

    placed = tiles(shared, "node", counts.drop("n"), -(-members // PACK_ROWS) or 1)
    found = components(placed.groupBy(*TASK).applyInArrow(run, _LINKS))
    tied = found.select(F.col("node").alias("cls"), F.col("root").alias("cluster"))
    return tied.unionByName(tied.select(F.col("cluster").alias("cls"), "cluster").distinct())


def _links(
    classes: DataFrame, texts: DataFrame, forest: Forest, recall: float, threshold: float, size: int, least: float, tile: int
) -> DataFrame:
    """Exact links a, b, n within clusters."""

    def ends(shingles: int) -> tuple[int, ...] | None:
        similarity = least_similarity(shingles, threshold)
        return similarity and levels(forest.trees, forest.deepest, similarity, recall)

    members = materialize(
        _clusters(classes, forest, ends, least, tile).join(
            classes.select("cls", "key", "text_key", "copies", "shingles"), "cls"
        ), "members",
    )
    sizes = members.groupBy("cluster").agg(
        F.expr(f"CAST(ceil(greatest(count(*) / {tile}, sum(shingles) / {TILE_SHINGLES})) AS INT)").alias("t")
    )
    total = members.agg(F.coalesce(F.sum("shingles"), F.lit(0))).first()[0]
    placed = tiles(members.drop("shingles"), "cluster", sizes, -(-total // PACK_SHINGLES) or 1)
    same = placed["key"].eqNullSafe(texts["key"]) & (placed["text_key"] == texts["text_key"])
    full = texts.join(placed.hint("merge"), same).select("cluster", "cls", "copies", "own", *TASK, "text")

    def load(table: pa.Table) -> list[np.ndarray]:
        return [shingles(t.as_py(), size) for t in table.column("text")]

    def run(table: pa.Table) -> pa.Table:
        return compared(table, "cluster", load, lambda a, b: similar(a, b, threshold))

    return full.groupBy(*TASK).applyInArrow(run, _LINKS)


def _marked(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, threshold: float = 0.8,
    recall: float = 0.9999, trees: int = TREES, deepest: int = DEEPEST, slack: float = 0.15, tile: int = TILE, seed: int = 17,
) -> DataFrame:
    """Columns of ``near_duplicates`` and root, the number of the group: keys repeat, it does not."""
    forest = Forest(trees, deepest, levels(trees, deepest, threshold, recall), seed)
    texts = docs.select(
        F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    ).withColumn("text_key", F.xxhash64("text"))
    found = materialize(signatures(texts, forest, size), "signatures")
    grouped = found.where("set_key IS NOT NULL").groupBy("set_key").agg(
        F.min("key").alias("first"), F.count("*").alias("copies"), F.min(F.struct("key", "text_key")).alias("row"),
        F.any_value("shingles").alias("shingles"), F.any_value("nodes").alias("nodes"),
        F.any_value("signature").alias("signature"),
    )
    classes = materialize(grouped.select(F.monotonically_increasing_id().alias("cls"), "*", "row.*").drop("row"), "classes")
    links = materialize(_links(classes, texts, forest, recall, threshold, size, threshold - slack, tile), "links")
    counts = links.groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n"))
    root = components(links).select(F.col("node").alias("cls"), "root")
    joined = classes.select("cls", "set_key", "first", "copies").join(counts, "cls", "left").join(root, "cls", "left")
    joined = joined.select(
        "set_key", F.col("first").alias("class_id"), F.coalesce("root", "cls").alias("root"),
        (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
    )
    least = joined.groupBy("root").agg(F.min("class_id").alias("group_id"))
    marked = materialize(joined.join(least, "root"), "marked")
    linked = found.where("set_key IS NOT NULL").select("key", "text_key", "set_key").join(
        marked.hint("merge"), "set_key"
    )
    alone = found.where("set_key IS NULL").select(
        "key", "text_key", F.col("key").alias("class_id"), F.lit(0).cast("long").alias("n_links"),
        F.col("key").alias("group_id"), F.lit(None).cast("long").alias("root"),
    )
    return linked.select(alone.columns).unionByName(alone).select(
        F.col("key").alias(key), "class_id", "n_links", "group_id",
        F.col("key").eqNullSafe(F.col("group_id")).alias("kept"), "text_key", "root",
    )


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, threshold: float = 0.8,
    recall: float = 0.9999, trees: int = TREES, deepest: int = DEEPEST, slack: float = 0.15, tile: int = TILE, seed: int = 17,
) -> DataFrame:
    """One row per document: key, class_id, n_links, group_id, kept, text_key.

    ``class_id`` is the smallest key with the same set of shingles, ``n_links`` the
    number of other documents at a Jaccard similarity of ``threshold`` or more (those
    of the class included), ``group_id`` the smallest key reachable over links and
    ``kept`` marks the rows that carry it.  A null or empty text, or one without words,
    has no shingles and links with nothing.  A null key is smaller than none; repeated
    rows are documents of their own and links of each other.  An empty table gives no
    rows.  ``slack`` is how far below the threshold an estimate may lie.
    """
    return _marked(docs, key, text, size, threshold, recall, trees, deepest, slack, tile, seed).drop("root")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents, less all but one of each group of near-duplicates.

    The smallest key of a group stays, also if other groups have that key or none has
    one; of rows of the group that share it, those of the smallest hash of the text,
    and one of rows that are equal in both.  Texts without words are
    in no group and all stay.  Only keys and hashes of what goes are joined to the
    texts: while that table is small no text is shuffled.
    """
    found = materialize(_marked(docs, key, text, **options), "marked")
    marks = found.select(F.col(key).alias("_key"), F.col("text_key").alias("_text_key"), "root", "kept", "n_links")
    grouped = marks.where("n_links > 0")
    first = grouped.where("kept").groupBy("root").agg(F.min("_text_key").alias("first"))
    held = grouped.join(first, "root").withColumn("stays", F.col("kept") & (F.col("_text_key") == F.col("first")))
    gone = materialize(held.where("NOT stays").select("_key", "_text_key").distinct(), "gone")
    again = materialize(
        held.where("stays").groupBy("_key", "_text_key").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "again"
    )
    texts = docs.withColumn("_text_key", F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))))

    def same(other: DataFrame):
        return texts[key].eqNullSafe(other["_key"]) & (texts["_text_key"] == other["_text_key"])

    once = texts.join(gone, same(gone), "left_anti")
    if not again.isEmpty():
        repeated = texts.join(again, same(again), "left_semi").dropDuplicates([key, "_text_key"])
        once = once.join(again, same(again), "left_anti").unionByName(repeated)
    return once.select(*docs.columns)
