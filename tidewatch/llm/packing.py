"""Cost-balanced packing of tokenized documents into fixed-length sequences.

Every task packs the documents of its own partition as they stream by: no shuffle,
no total known beforehand, and memory bounded by one window of sequences and one
batch of texts.  A document is first cut into full sequences; what remains of it
(less than a sequence) joins a window.  When a window holds enough tokens, its
pieces are assigned in descending order of estimated attention cost, each to the
sequence of lowest cost so far that still has room; pieces that fit nowhere are cut
to fill the gaps, and what is left over opens the next window.  So every sequence
but a task's last few is exactly full.  The last tokens of a task fill sequences
whose lengths are powers of two, which need no padding either.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELL = 4  # bytes of a token id

PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes, as the tokenizer file gives them.

    Text of plain characters is encoded by ``tiktoken`` from the file's own merges, several
    times faster than the library the file was written for.  That needs a byte-level
    tokenizer that cuts texts by the usual expression, numbers its tokens in the order of
    its merges and has no token with white space in it; any other gets every text whole.

    Where a text holds other characters, or runs so long that merging them takes a heap,
    it is cut at spaces before visible characters, where such a tokenizer always begins
    anew, and the pieces concerned go to the tokenizer itself.  Characters that only some
    Unicode versions call white space are no place to cut.
    """

    _cuts = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    # Letters, signs and blanks whose kind no version of Unicode has changed.
    _plain = re.compile(r"[ -~\n\tªµºÀ-ÖØ-öø-ÿ¡-©«¬®-±´¶-¸»¿×÷‐-‧]*")
    _long = re.compile(r"\S{400}|\s{400}")
    _space = re.compile(r"(?= [^\s\u180e\u200b\u2060\ufeff])")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fast = self._merges(json.loads(self.tokenizer.to_str()))

    def _merges(self, state: dict):
        """The same merges for ``tiktoken``; None if the tokenizer is of another kind."""
        import tiktoken

        cuts, model, special = state["pre_tokenizer"] or {}, state["model"], state["added_tokens"]
        if (
            cuts.get("type") != "ByteLevel" or not cuts.get("use_regex") or cuts.get("add_prefix_space") or state["normalizer"]
            or model["type"] != "BPE" or model.get("dropout") or any(model.get(k) for k in ("ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
            or any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in special)
        ):
            return None
        names = {t["content"]: t["id"] for t in special}
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        numbers = [model["vocab"].get(t, -1) for t in merged]
        if numbers != sorted(set(numbers)) or len(model["vocab"].keys() - names.keys()) != 256 + len(merged) or (numbers and numbers[0] < 256):
            return None
        # Byte-level files write bytes as characters: visible ones as they are, the others from U+0100 on.
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in visible]
        value = {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(map(value.__getitem__, t)): i for t, i in model["vocab"].items() if t not in names}
        return tiktoken.Encoding("file", pat_str=self._cuts, mergeable_ranks=ranks, special_tokens=names)

    def ids(self, text: str) -> bytes:
        if self.fast is None:
            return self._slow(text)
        if self._simple(text):
            return self._quick(text)
        out, run = [], []
        for piece in self._space.split(text):
            if self._simple(piece):
                run.append(piece)
                continue
            out += [self._quick("".join(run)), self._slow(piece)]
            run = []
        return b"".join([*out, self._quick("".join(run))])

    def _simple(self, text: str) -> bool:
        return self._plain.fullmatch(text) is not None and self._long.search(text) is None

    def _quick(self, text: str) -> bytes:
        return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()

    def _slow(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def encoder(path: str) -> WordEncoder:
    """One encoder per Python worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


@dataclass
class Piece:
    """Consecutive tokens of one document, not yet placed."""

    key: object
    tokens: int
    start: int
    ids: bytes

    @property
    def length(self) -> int:
        return len(self.ids) // CELL

    def cut(self, length: int) -> tuple[Piece, Piece]:
        at = length * CELL
        return (
            Piece(self.key, self.tokens, self.start, self.ids[:at]),
            Piece(self.key, self.tokens, self.start + length, self.ids[at:]),
        )


class Packer:
    """Assigns pieces to sequences; ``rows`` collects what has been placed."""

    def __init__(self, capacity: int, linear: float, quadratic: float, window: int, first_id: int):
        self.capacity, self.linear, self.quadratic, self.window = capacity, linear, quadratic, window
        self.next_id = first_id
        self.waiting: list[Piece] = []
        self.held = 0
        self.rows: list[tuple] = []

    def cost(self, length: int) -> float:
        """Estimated cost of a document piece: attention stays within a document."""
        return self.linear * length + self.quadratic * length * length

    def emit(self, piece: Piece, sequence: int, offset: int) -> None:
        self.rows.append(
            (piece.key, piece.start, piece.length, zlib.crc32(piece.ids), piece.tokens, sequence, offset)
        )

    def add(self, piece: Piece) -> None:
        while piece.length >= self.capacity:
            full, piece = piece.cut(self.capacity)
            self.emit(full, self.next_id, 0)
            self.next_id += 1
        if piece.length:
            self.waiting.append(piece)
            self.held += piece.length
            if self.held >= self.window * self.capacity:
                self.assign([self.capacity] * (self.held // self.capacity))

    def finish(self) -> None:
        """Places everything that waits; the rest fills power-of-two sequences."""
        self.assign([self.capacity] * (self.held // self.capacity))
        rest = self.held
        self.assign([1 << bit for bit in reversed(range(rest.bit_length())) if rest >> bit & 1])

    def assign(self, sizes: list[int]) -> None:
        """Fills sequences of the given lengths, none longer than what waits, completely."""
        if not sizes:
            return
        room = np.array(sizes, dtype=np.int64)
        used = np.zeros(len(sizes), dtype=np.int64)
        cost = np.zeros(len(sizes))

        def place(piece: Piece, at: int) -> None:
            self.emit(piece, self.next_id + at, int(used[at]))
            used[at] += piece.length
            room[at] -= piece.length
            cost[at] += self.cost(piece.length)

        unplaced = []
        for piece in sorted(self.waiting, key=lambda p: -p.length):
            at = int(np.where(room >= piece.length, cost, np.inf).argmin())
            if room[at] >= piece.length:
                place(piece, at)
            else:
                unplaced.append(piece)
        self.waiting = []
        for piece in unplaced:
            while piece.length:
                at = int(np.where(room > 0, cost, np.inf).argmin())
                if room[at] == 0:
                    self.waiting.append(piece)
                    break
                head, piece = piece.cut(min(int(room[at]), piece.length))
                place(head, at)
        self.next_id += len(sizes)
        self.held = sum(p.length for p in self.waiting)


def pack(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = 2048,
    end_id: int = 1, linear: float = 1.0, quadratic: float = 1.0 / 2048, window: int = 512,
) -> DataFrame:
    """One row per piece: ``key`` and the columns of ``PIECES``.

    ``tokenizer`` is the path of a tokenizer file that every executor has.  A null
    text counts as empty and an empty one is its end token alone; a null or repeated
    key is carried through, each row being a document of its own; an empty table
    gives no piece.  Other columns of ``docs`` are not read.  ``sequence_id`` is
    unique across the table: the partition number times 2**32, plus a running number.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), *T.StructType.fromDDL(PIECES).fields])
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).ids
        packer = Packer(capacity, linear, quadratic, window, TaskContext.get().partitionId() << 32)
        names = schema.names
        types = None

        def taken() -> pa.RecordBatch:
            columns = list(zip(*packer.rows, strict=True))
            packer.rows = []
            arrays = [pa.array(c, type=t) for c, t in zip(columns, types, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            types = types or [batch.schema.field(0).type, *[pa.int64()] * 6]
            for found, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(words.as_py() or "") + end
                packer.add(Piece(found, len(ids) // CELL, 0, ids))
                if len(packer.rows) >= 20_000:
                    yield taken()
        packer.finish()
        if packer.rows:
            yield taken()

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
