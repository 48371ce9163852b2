"""Classifier chain for toxicity categories.

Categories are predicted one after another by linear models over the words of a text
and their beginnings, and the probability of each category is a feature of all later
ones.  For training that feature comes from models that have not seen the row (out of
fold), as it will when a new text is scored.

Features are hashed, so there is no vocabulary to fit, to bound or to send around.  The
models are fitted on a bounded sample of the labelled rows (``SAMPLE``): for each category
the folds and the final model are one task each of a single job, and only the few
weights that are not zero come back.  Scoring reads every document once, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.session import materialize

SAMPLE = 12_000  # labelled rows that the models are fitted on, chosen by hash
SIZE = 1 << 18  # numbers that features are hashed to: every word has one, none is left out
TASKS = 4  # partitions of the sample
PORTION = 500_000  # features that a step of the fit handles at a time: bounds memory only
_CACHE = 400_000  # hashes remembered per Python worker: bounds memory only

_word = re.compile(r"[^\W_]+")
_FITTED = "part int, row long, p double, places array<int>, weights array<double>, offset double"


class _Hashes(dict):
    def __missing__(self, name: str) -> int:
        found = xxhash.xxh32_intdigest(name) & (SIZE - 1)
        if len(self) >= _CACHE:
            self.clear()
        self[name] = found
        return found


_hashes = _Hashes()


def features(text: str | None) -> set[int]:
    """Hashes of the distinct words of a text in lower case, and of their first four and five letters."""
    words = set(_word.findall((text or "").lower()))
    words.update([w[:4] for w in words], [w[:5] for w in words])
    return set(map(_hashes.__getitem__, words))


@dataclass
class Linear:
    """A fitted category: weights of hashed features, of earlier categories, and an offset."""

    weights: dict[int, float]
    earlier: list[float]
    offset: float

    @property
    def numFeatures(self) -> int:
        return SIZE + len(self.earlier)

    def probability(self, found: set[int], before: list[float]) -> float:
        # In the order of the numbers, so that equal texts get equal sums.
        total = sum(self.weights[f] for f in sorted(found & self.weights.keys()))
        total += sum(w * p for w, p in zip(self.earlier, before, strict=True)) + self.offset
        return float(1 / (1 + np.exp(-total)))


@dataclass
class Chain:
    """Fitted categories in order; a category without training rows has probability 0."""

    categories: list[str]
    models: list[Linear | None] = field(default_factory=list)
    threshold: float = 0.4

    def probabilities(self, text: str | None) -> list[float]:
        found, out = features(text), []
        for model in self.models:
            out.append(0.0 if model is None else model.probability(found, out))
        return out

    def score(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """Adds p_<category> for each category, and the decision is_<category>.

        A null or empty text has no features and gets the offsets' probabilities.
        Columns of ``docs`` stay, but for those of the added names, which are replaced;
        rows, repeated ones too, are scored one by one.
        """
        added = [f"{kind}_{c}" for kind in ("p", "is") for c in self.categories]
        columns = [c for c in docs.columns if c not in added]
        at, names = columns.index(text), [f"p{i}" for i in range(len(self.categories))]
        rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"))
        schema = T.StructType([rows.schema["row"], *(T.StructField(n, T.DoubleType()) for n in names)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = pc.struct_field(batch.column(0), at)
                scored = np.array([self.probabilities(t.as_py()) for t in texts]).reshape(-1, len(names))
                arrays = [pa.array(scored[:, i]) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["row", *names])

        found = rows.mapInArrow(run, schema)
        return found.select(
            *(F.col("row").getField(c).alias(c) for c in columns),
            *(F.col(n).alias(f"p_{c}") for n, c in zip(names, self.categories, strict=True)),
            *((F.col(n) >= F.lit(self.threshold)).alias(f"is_{c}") for n, c in zip(names, self.categories, strict=True)),
        )


def fitted(places: np.ndarray, lengths: np.ndarray, earlier: np.ndarray, label: np.ndarray, penalty: float, rounds: int) -> np.ndarray:
    """Weights and, last, the offset of a logistic model whose weights pay ``penalty`` by their size.

    Quasi-Newton steps on the loss that stay in the orthant they start in; a weight that
    would change its sign stops at zero.  ``places`` are the features of all rows, one
    after another, ``lengths`` how many each row has; they are gone through in portions.
    """
    rows, dense = len(lengths), earlier.shape[1]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] + PORTION, PORTION)).clip(0, rows)).tolist()
    portions = [(a, b, np.repeat(np.arange(b - a, dtype=np.int32), lengths[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]
    price = np.full(SIZE + dense + 1, penalty)
    price[-1] = 0

    def loss_of(v: np.ndarray) -> tuple[float, np.ndarray]:
        score = earlier @ v[SIZE:-1] + v[-1]
        for a, b, row in portions:
            score[a:b] += np.bincount(row, v[places[ends[a]:ends[b]]], b - a)
        error = (1 / (1 + np.exp(-score)) - label) / rows
        slope = np.concatenate([np.zeros(SIZE), earlier.T @ error, [error.sum()]])
        for a, b, row in portions:
            slope[:SIZE] += np.bincount(places[ends[a]:ends[b]], error[a:b][row], SIZE)
        return float(np.mean(np.logaddexp(0, score) - label * score) + price @ np.abs(v)), slope

    v = np.zeros(SIZE + dense + 1)
    loss, slope = loss_of(v)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        steepest = np.where(v != 0, slope + price * np.sign(v), np.sign(slope) * np.maximum(np.abs(slope) - price, 0))
        way, factors = -steepest, []
        for moved, bent in reversed(past):
            factors.append(moved @ way / (moved @ bent))
            way = way - factors[-1] * bent
        if past:
            moved, bent = past[-1]
            way = way * ((moved @ bent) / (bent @ bent))
        for (moved, bent), factor in zip(past, reversed(factors), strict=True):
            way = way + moved * (factor - bent @ way / (moved @ bent))
        way = np.where(way * steepest < 0, way, 0)
        side = np.where(v != 0, np.sign(v), -np.sign(steepest))
        step = 1.0 if past else 1 / max(1e-12, float(np.linalg.norm(steepest)))
        while True:
            to = v + step * way
            to[:-1] = np.where(to[:-1] * side[:-1] > 0, to[:-1], 0)
            new_loss, new_slope = loss_of(to)
            if new_loss <= loss + 1e-4 * (steepest @ (to - v)) or step < 1e-8:
                break
            step /= 2
        moved, bent = to - v, new_slope - slope
        if moved @ bent > 1e-12:
            past = [*past[-9:], (moved, bent)]
        still = loss - new_loss < 1e-6 * abs(loss)
        v, loss, slope = to, new_loss, new_slope
        if still:
            break
    return v


def training_rows(
    docs: DataFrame, labels: DataFrame, categories: list[str], key: str, text: str, sample: int = SAMPLE
) -> DataFrame:
    """At most ``sample`` labelled documents, by hash: key, text and the categories (0 or 1).

    Rows without a key or with another label than 0 and 1 are left out; of several
    labels for a key the largest counts, of several texts that of the smallest hash.
    """
    valid = F.col(key).isNotNull()
    for c in categories:
        valid = valid & F.col(c).isin(0, 1)
    named = labels.where(valid).groupBy(key).agg(*(F.max(c).cast("int").alias(c) for c in categories))
    present = docs.select(key).where(F.col(key).isNotNull())
    chosen = named.join(present, key, "left_semi").orderBy(F.xxhash64(key), key).limit(sample)
    rows = docs.select(key, F.col(text).alias("text")).join(F.broadcast(chosen), key)  # ``sample`` rows at most
    one = F.min(F.struct(F.xxhash64("text"), "text"))
    return rows.groupBy(key, *categories).agg(one.alias("_one")).select(key, F.col("_one.text").alias("text"), *categories)


def _hashed(labelled: DataFrame, categories: list[str], key: str, text: str, folds: int) -> DataFrame:
    """row (a number), fold, the categories, places (the hashed features) and before (nothing yet)."""
    fold = F.expr(f"CAST(pmod(xxhash64(`{key}`), {folds}) AS INT)").alias("fold")
    number = F.monotonically_increasing_id().alias("row")
    rows = labelled.select(number, fold, *(F.col(c).cast("int").alias(f"y{i}") for i, c in enumerate(categories)), F.col(text).alias("text"))
    kept = [n for n in rows.columns if n != "text"]
    schema = T.StructType([*(rows.schema[n] for n in kept), *T.StructType.fromDDL("places array<int>, before array<double>").fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = pa.array([sorted(features(t.as_py())) for t in batch.column("text")], pa.list_(pa.int32()))
            before = pa.array([[]] * batch.num_rows, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), places, before], names=names)

    return rows.mapInArrow(run, schema)


def _fit(rows: DataFrame, number: int, parts: list[int], folds: int, penalty: float, rounds: int) -> DataFrame:
    """A model for each of ``parts``: of the rows outside a fold, scoring those in it, or of all rows."""
    names = T.StructType.fromDDL(_FITTED).names

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("row").combine_chunks()
        part, fold = table.column("part")[0].as_py(), table.column("fold").to_numpy()
        label = table.column(f"y{number}").to_numpy().astype(float)
        lists = table.column("places").combine_chunks()
        lengths, places = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
        before = np.array(table.column("before").to_pylist(), float).reshape(len(label), -1)
        learns = fold != part
        v = None
        if len(np.unique(label[learns])) == 2:
            v = fitted(places[np.repeat(learns, lengths)], lengths[learns], before[learns], label[learns], penalty, rounds)
        if part == folds:
            some = np.flatnonzero(v[:SIZE]) if v is not None else np.empty(0, int)
            weights = [*v[some].tolist(), *v[SIZE:-1].tolist()] if v is not None else []
            columns = [[part], [None], [None], [some.tolist()], [weights], [None if v is None else float(v[-1])]]
        else:
            held = np.flatnonzero(~learns)
            score = np.zeros(len(label)) if v is None else (
                np.bincount(np.repeat(np.arange(len(label)), lengths), v[places], len(label)) + before @ v[SIZE:-1] + v[-1]
            )
            p = np.zeros(len(held)) if v is None else 1 / (1 + np.exp(-score[held]))
            none = [None] * len(held)
            columns = [[part] * len(held), table.column("row").to_numpy()[held].tolist(), p.tolist(), none, none, none]
        kinds = (pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.float64())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    dealt = rows.withColumn("part", F.explode(F.array(*(F.lit(p) for p in parts))))
    return dealt.groupBy("part").applyInArrow(run, _FITTED)


def train(
    labelled: DataFrame, categories: list[str], key: str = "doc_id", text: str = "text", folds: int = 3,
    penalty: float = 0.001, rounds: int = 25, threshold: float = 0.4,
) -> Chain:
    """Fits the chain.  Folds follow from the hash of the key, so all rows of a key fall
    into one.  Without labelled rows, or with one class only, a category is never found."""
    chain = Chain(categories, threshold=threshold)
    now = materialize(_hashed(labelled, categories, key, text, folds).coalesce(TASKS), "features")
    if now.isEmpty():
        chain.models = [None] * len(categories)
        return chain
    for number in range(len(categories)):
        last = number + 1 == len(categories)
        parts = [folds] if last else list(range(folds + 1))  # later models train on what models that have not seen a row say of it
        found = materialize(_fit(now, number, parts, folds, penalty, rounds), "models")
        model = found.where(F.col("part") == folds).select("places", "weights", "offset").first()
        if model.offset is None:
            chain.models.append(None)
        else:
            n = len(model.places)
            chain.models.append(Linear(dict(zip(model.places, model.weights[:n], strict=True)), model.weights[n:], model.offset))
        if not last:
            held = found.where(F.col("part") < folds).select("row", "p")
            joined = now.join(held, "row").withColumn("before", F.concat("before", F.array("p"))).drop("p")
            now = materialize(joined.select(now.columns).coalesce(TASKS), "features")
    return chain
