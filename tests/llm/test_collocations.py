"""Collocations against counting every phrase at every place."""

import random
import re
from collections import Counter

from tidewatch.llm import collocations

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, share=50, top=2000):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(_LOWER)):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i:i + size])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        ranked = []
        for p, a in candidates.items():
            longer = [b for q, b in candidates.items() if len(q) > len(p) and p in (q[:2], q[1:])]
            if any(100 * b >= share * a for b in longer):
                continue
            cuts = [(1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, l, r = min(cuts)
            ranked.append((-score, -a, " ".join(p).encode(), a, l, r, total[lang], score))
        for rank, (_, _, phrase, *numbers) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, phrase.decode(), *numbers))
    return sorted(out)


def corpus(seed, rows=120):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "é", "É", "漢字", "x\x01", "x", "x\x00y", "n-1", "\xa0", "q\x1fr", "%20", "%"]
    langs = ["en", "en", "en", "en", None, "und", "d e", "a\nb", "%20", "%0A", ""]
    return [
        (rng.choice(langs), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", " ", ". ", ",", "\n"]) for _ in range(rng.randint(0, 60))))
        for _ in range(rows)
    ]


def mined(spark, rows, **options):
    docs = spark.createDataFrame([(t, g, "z", 1) for g, t in rows], "text string, lang string, phrase string, rank int")
    return sorted(tuple(r) for r in collocations.mine(docs, **options).collect())


def test_any_words_and_languages(spark):
    rows = [*corpus(1), ("en", None), (None, ""), ("en", "one two three. " * 30), ("en", "one two three. " * 30), ("fr", "solo")]
    expected = brute(rows, 4)
    assert len(expected) > 50
    assert mined(spark, rows, least=4) == expected
    for size in (1, 2, 7, 50):  # blocks end within texts and within pieces
        found = Counter()
        for lang, text in rows:
            for keys, n in _blocks(text, size):
                for key, count in zip(keys.to_pylist(), n.tolist(), strict=True):
                    found[lang, key] += count
        whole = Counter()
        for lang, text in rows:
            for keys, n in _blocks(text, 10**6):
                for key, count in zip(keys.to_pylist(), n.tolist(), strict=True):
                    whole[lang, key] += count
        assert found == whole


def _blocks(text, size):
    found = collocations.units((text or "").encode())
    for at in range(0, len(found), size):
        block = collocations.Block()
        part = found[at:at + size + 2]
        block.add("l", part + [b"."] * (min(size, len(found) - at) + 2 - len(part)))
        yield from block.counts()


def test_order_of_ties_and_top(spark):
    rows = [("en", "b c. a d. é f. z a. ") for _ in range(10)] + [("en", "hot word " * 3000)]
    assert mined(spark, rows, top=3) == brute(rows, top=3)
    assert mined(spark, rows) == brute(rows)


def test_groups_cut_by_batches_and_ranges(spark, conf):
    conf(spark__sql__execution__arrow__maxRecordsPerBatch="7", spark__sql__shuffle__partitions="5")
    rows = corpus(3, 200)
    assert mined(spark, rows, least=3) == brute(rows, 3)


def test_exact_beyond_64_bits(spark, monkeypatch):
    counts = spark.createDataFrame(
        [("en", "", 0, 10**13), ("en", "a", 1, 4 * 10**12), ("en", "b", 1, 3 * 10**12 + 7), ("en", "a b", 2, 2 * 10**12 + 1)],
        "lang string, phrase string, words int, f long",
    )
    monkeypatch.setattr(collocations, "frequent", lambda *_: counts)
    (row,) = collocations.mine(counts).collect()
    assert row["score"] == 1000000 * (2 * 10**12 + 1) ** 2 // (4 * 10**12 * (3 * 10**12 + 7))


def test_empty(spark):
    assert mined(spark, [("en", None)]) == []
    docs = spark.createDataFrame([], "lang string, text string")
    assert collocations.mine(docs).collect() == []
