"""Phrase collocations from sorted count streams.

The corpus is counted as language-model estimators lay out their n-gram counts on disk.
Every word opens a window of up to three words within its piece; a block of windows is
sorted and equal ones are added up before they leave the task.  The windows of all
blocks are dealt by range and sorted into one stream in prefix order.  There the counts
of phrases of one, two and three words are run lengths of neighbouring rows, read off
in a single pass that keeps nothing but the current batch: no table of words or phrases
is held anywhere.  A range cut through a group only splits its sum, which is added up
afterwards from the groups at the edges.

What is frequent is then merge-joined in lockstep: candidates in prefix order with the
counts of their first words, in suffix order with those of their last words, and pairs
with the triples that extend them.  Counts below the threshold cannot take part in any
of these, since a part of a phrase is at least as frequent as the phrase.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import discard, materialize, work_folder

LONGEST = 3  # words of a phrase
BLOCK = 500_000  # words sorted at a time in a task: bounds memory only
_BITS = 21  # a block, at most twice as long, has fewer distinct words than this many bits tell apart
_SALTS = 64  # parts that rank a language's candidates before they meet
_ROWS = 100_000

# The ends of pieces become full stops that stand alone as units.
_ENDS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b"." * 9)


def units(text: bytes) -> list[bytes]:
    """The words of a text in UTF-8, A-Z in lower case; b"." wherever a piece ends."""
    return text.lower().translate(_ENDS).replace(b".", b" . ").split()


class Block:
    """Windows of the words added so far, for each language."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {b".": 0}
        self.parts: dict[str, list[np.ndarray]] = {}
        self.held = 0

    def add(self, lang: str, found: list[bytes]) -> None:
        """Words whose windows begin here; the last two are only looked ahead at."""
        numbers = self.numbers
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in found), np.int64, len(found))
        self.parts.setdefault(lang, []).append(ids)
        self.held += len(found)

    def counts(self) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """Keys in order and their counts.  A key is the language, a line feed and the
        window's words, each followed by a blank; a blank alone counts all words."""
        ordered = sorted(self.numbers)
        rank = np.zeros(len(ordered), np.int64)
        rank[[self.numbers[w] for w in ordered]] = np.arange(1, len(ordered) + 1)
        rank[0] = 0
        words = pa.array([b"", *[w + b" " for w in ordered]], pa.string())
        for lang, parts in self.parts.items():
            first, second, third = (
                rank[np.concatenate([p[at:len(p) - 2 + at] for p in parts])] for at in range(LONGEST)
            )
            third = np.where(second > 0, third, 0)
            starts = first > 0
            packed = (first << 2 * _BITS | second << _BITS | third)[starts]
            packed, count = np.unique(packed, return_counts=True)
            opening, mask = pa.scalar(f"{lang}\n"), (1 << _BITS) - 1
            fields = [words.take(pa.array(packed >> shift & mask)) for shift in (2 * _BITS, _BITS, 0)]
            keys = pc.binary_join_element_wise(opening, *fields, "")
            yield pa.array([f"{lang}\n "], pa.string()), np.array([starts.sum()])
            yield keys, count


def windows(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """key and n: the windows of every task's blocks, added up per block."""

    def batches(block: Block) -> Iterator[pa.RecordBatch]:
        for keys, count in block.counts():
            for at in range(0, len(keys), _ROWS):
                part = [keys.slice(at, _ROWS), pa.array(count[at:at + _ROWS], pa.int64())]
                yield pa.RecordBatch.from_arrays(part, names=["key", "n"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block()
        for batch in rows:
            for language, body in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                found = units(body.as_py())
                ahead = LONGEST - 1
                for at in range(0, len(found), BLOCK):
                    part = found[at:at + BLOCK + ahead]
                    missing = min(BLOCK, len(found) - at) + ahead - len(part)
                    block.add(language, part + [b"."] * missing)
                    if block.held >= BLOCK:
                        yield from batches(block)
                        block = Block()
        yield from batches(block)

    # Neither line feeds nor blanks may stand in the language's part of a key.
    name = F.coalesce(F.col(lang).cast("string"), F.lit("und"))
    for plain, coded in (("%", "%25"), (" ", "%20"), ("\n", "%0A")):
        name = F.replace(name, F.lit(plain), F.lit(coded))
    rows = docs.select(name.alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "key string, n long")


def _named(name: str) -> F.Column:
    out = F.col(name)
    for plain, coded in (("\n", "%0A"), (" ", "%20"), ("%", "%25")):
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return out


def run_lengths(stream: DataFrame, least: int) -> DataFrame:
    """phrase (language, line feed, words), words, f: sums over neighbours in a sorted stream.

    Groups that touch the edge of a batch are always handed on, since they may go on
    beyond it; of the others those of ``least`` or more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column("n").to_numpy()
            lists = pc.split_pattern(batch.column("key"), " ")
            at, flat = lists.offsets.to_numpy()[:-1], lists.flatten()
            last = len(flat) - 1
            begins = np.zeros(len(n), bool)
            begins[0] = True
            group, whole = None, np.ones(len(n), bool)
            for order in range(1, LONGEST + 1):
                field = flat.take(pa.array(np.minimum(at + order - 1, last)))
                if order > 1:  # a window that has ended has no further words
                    whole = whole & ~pc.equal(field, "").to_numpy(zero_copy_only=False)
                begins[1:] |= pc.not_equal(field[1:], field[:-1]).to_numpy(zero_copy_only=False)
                group = field if group is None else pc.binary_join_element_wise(group, field, " ")
                starts = np.flatnonzero(begins)
                total = np.add.reduceat(n, starts)
                keep = total >= least
                keep[0] = keep[-1] = True
                keep &= whole[starts]
                chosen = starts[keep]
                yield pa.RecordBatch.from_arrays(
                    [group.take(pa.array(chosen)), pa.array(np.full(len(chosen), order), pa.int32()), pa.array(total[keep], pa.int64())],
                    names=["phrase", "words", "f"],
                )

    return stream.mapInArrow(run, "phrase string, words int, f long")


def frequent(docs: DataFrame, least: int = 10, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, phrase, words, f: phrases of one to three words that occur ``least`` times or
    more, and per language a row of no words with the number of all."""
    spark = docs.sparkSession
    place = work_folder(spark, "windows")
    windows(docs, lang, text).write.option("compression", "zstd").parquet(place)
    stream = spark.read.schema("key string, n long").parquet(place).repartitionByRange("key").sortWithinPartitions("key")
    sums = run_lengths(stream, least).groupBy("phrase", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    split = sums.select(
        F.substring_index("phrase", "\n", 1).alias("lang"), F.expr("substring(phrase, instr(phrase, '\n') + 1)").alias("phrase"),
        "words", "f",
    )
    found = materialize(split.withColumn("words", F.expr("IF(phrase = '', 0, words)")), "counts")
    discard(spark, place)
    return found


def _cuts(candidates: DataFrame) -> DataFrame:
    """Each candidate with each way to cut it: k, head, tail."""
    return candidates.withColumn("k", F.explode(F.expr("sequence(1, words - 1)"))).withColumns({
        "head": F.expr("substring_index(phrase, ' ', k)"), "tail": F.expr("substring_index(phrase, ' ', k - words)"),
    })


def mine(
    docs: DataFrame, least: int = 10, share: int = 50, top: int = 2000, lang: str = "lang", text: str = "text",
) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Phrases are two or three words within a piece that occur a >= ``least`` times.  A cut
    into parts that occur l and r times scores floor(1000000 * a * a / (l * r)); the
    lowest-scoring cut counts.  Phrases inside a longer candidate that is at least
    ``share`` percent as frequent are dropped.  Order: score and a descending, phrase.

    A null language reads "und", a null text is empty; pieces, words and repeated rows
    all count; an empty table or one without frequent phrases gives no rows.  Other
    columns are not read.
    """
    counts = frequent(docs, least, lang, text)
    candidates = counts.where("words > 1").withColumnRenamed("f", "a")
    parts = counts.where(f"words BETWEEN 1 AND {LONGEST - 1}")
    heads = parts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")).hint("merge")
    tails = parts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")).hint("merge")
    scored = _cuts(candidates).join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r")}
    square = (wide["a"] * wide["a"]).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    scored = scored.withColumns({"square": square, "product": (wide["l"] * wide["r"]).cast("decimal(38,0)")})
    scored = scored.withColumn("score", F.expr("square div product"))
    lowest = scored.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inside = candidates.where(f"words = {LONGEST}").select(
        "lang", F.explode(F.expr("array(substring_index(phrase, ' ', 2), substring_index(phrase, ' ', -2))")).alias("phrase"),
        F.col("a").alias("longer"),
    )
    longest = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = lowest.join(longest.hint("merge"), ["lang", "phrase"], "left").where(
        F.expr(f"words = {LONGEST} OR longer IS NULL OR 100 * longer < {share} * a")
    )
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = "ORDER BY score DESC, a DESC, phrase"
    salted = kept.withColumn("salt", F.expr(f"pmod(xxhash64(phrase), {_SALTS})"))
    best = salted.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang, salt {order})")).where(f"rank <= {top}")
    ranked = best.withColumn("rank", F.expr(f"CAST(row_number() OVER (PARTITION BY lang {order}) AS BIGINT)")).where(f"rank <= {top}")
    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select(_named("lang").alias("lang"), "rank", "phrase", "a", "l", "r", "n", "score")
