"""Packing against a token-by-token rebuild of every sequence."""

import json
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewatch.llm import packing
from tidewatch.llm.queries import QUERIES
from tidewatch.llm.settings import vocabulary

TOKENS = Tokenizer.from_file(vocabulary())


def ids_of(text):
    return [*TOKENS.encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, texts, capacity=2048):
    """Every id in one piece, sequences gapless and unpadded; returns the sequence lengths."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for key, found in pieces.items():
        ids, at = ids_of(texts[key]), 0
        for r in sorted(found, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            part = ids[at:at + r.length]
            assert r.ids_crc32 == zlib.crc32(np.array(part, dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    lengths = []
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity and at & (at - 1) == 0
        lengths.append(at)
    return lengths


def test_query_against_tokenizer(spark, folder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    lengths = check(QUERIES["op6_packing"](spark, folder).collect(), texts)
    assert sum(n == 2048 for n in lengths) > 0.8 * len(lengths)


def test_edge_rows(spark):
    texts = {0: None, 1: "", 2: "a" * 9000, 3: " b" * 30_000, 4: "x <|endoftext|> y", 5: "é　\n  z\t \x85 q's"}
    rows = [(k, v, 9, 9) for k, v in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int, sequence_id int")
    check(packing.pack(docs, vocabulary()).collect(), texts)
    lengths = check(packing.pack(docs, vocabulary(), capacity=64, window=4).collect(), texts, 64)
    assert max(lengths) == 64
    assert packing.pack(docs.limit(0), vocabulary()).count() == 0


def test_repeated_rows_are_documents_of_their_own(spark):
    docs = spark.createDataFrame([(None, "one two"), (None, "one two"), (3, "one two")], "doc_id int, text string")
    found = packing.pack(docs.coalesce(1), vocabulary()).collect()
    assert sum(r.length for r in found) == 3 * len(ids_of("one two"))
    with pytest.raises(ValueError):
        packing.pack(docs, vocabulary(), capacity=100)


SOME_TEXT = (
    st.text(alphabet=st.characters(codec="utf-8"), max_size=60) | st.text("ab 's\t\n.1é ", max_size=60)
    | st.text("aéÿ×÷ª… \n\x0b\x1c\x85\xa0²Ⅷ߀'tdm<|>—", max_size=40)
    | st.sampled_from(["<|endoftext|>", "x<|endoftext|>y z", "it'S they'll\n\n a", "a" * 200 + " b", "a  \n 漢 b  c "])
)


@given(SOME_TEXT)
@settings(max_examples=800, deadline=None)
def test_ids_are_those_of_the_tokenizer(text):
    found = packing.encoder(vocabulary()).ids(text)
    assert np.frombuffer(found, dtype="<u4").tolist() == TOKENS.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a" * 300_000, " " * 300_000 + "x", "漢字 " * 20_000, "ab" * 100_000 + " ok ok", "=" * 200_000 + "\n" * 5000])
def test_very_long_runs(text):
    found = packing.encoder(vocabulary()).ids(text)
    assert np.frombuffer(found, dtype="<u4").tolist() == TOKENS.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("change", [{"add_prefix_space": True}, {"use_regex": False}])
def test_other_tokenizers_get_whole_texts(tmp_path, change):
    state = json.loads(TOKENS.to_str())
    state["pre_tokenizer"] |= change
    path = str(tmp_path / "other.json")
    (tmp_path / "other.json").write_text(json.dumps(state))
    encoder = packing.WordEncoder(path)
    assert encoder.fast is None and packing.encoder(vocabulary()).fast is not None
    found = np.frombuffer(encoder.ids("one two"), dtype="<u4").tolist()
    assert found == Tokenizer.from_file(path).encode("one two", add_special_tokens=False).ids


@given(st.lists(st.integers(1, 200), max_size=80))
@settings(max_examples=100, deadline=None)
def test_costs_stay_even(lengths):
    packer = packing.Packer(64, 1.0, 1 / 64, 8, 0)
    for i, n in enumerate(lengths):
        packer.add(packing.Piece(i, n, 0, bytes(4 * n)))
    packer.finish()
    assert sum(r[2] for r in packer.rows) == sum(lengths)
    filled = defaultdict(int)
    for r in packer.rows:
        filled[r[5]] += r[2]
    assert sum(n != 64 for n in filled.values()) <= 6
