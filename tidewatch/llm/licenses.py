"""License scans: sparse TF-IDF cosine to templates, and inheritance along directories.

Sentences that speak of rights are compared with the templates by cosine; word weights
come from counts over all documents.  A document whose whole text is close to that of a
licence is the licence file of its directory; a name like LICENSE lowers what that
takes, and lets a short notice be one.  Documents without a licence of their own take
that of the nearest directory above them, found by joins on directory paths.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from importlib.resources import files

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.session import materialize

_GNU = "you can redistribute it and/or modify it under the terms of the GNU"
_LATER = "as published by the Free Software Foundation, either version"
_OR = "of the License, or (at your option) any later version."
_CC = "This work is licensed under a Creative Commons Attribution"

# How the headers and the openings of licences read.
TEMPLATES = {
    "AGPL-3.0": f"This program is free software: {_GNU} Affero General Public License {_LATER} 3 {_OR}",
    "AGPL-3.0 short": "Licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in"
                  " compliance with the License.",
    "Apache-2.0 short": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted"
                    " provided that the following conditions are met. BSD License.",
    "BSD-3-Clause short": "Released under the BSD License.",
    "CC-BY": "Licensed under a Creative Commons Attribution License. CC BY.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright. CC0 public domain dedication.",
    "EPL-1.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "EPL-2.0 short": "Licensed under the Eclipse Public License, Version 2.0.",
    "GPL": "This work is licensed under the GNU General Public License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software. MIT License.",
    "MIT short": "Released under the MIT License.",
    "MPL-1.1": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use"
               " this file except in compliance with the License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "proprietary": "Copyright. All rights reserved.",
    "proprietary short": "All rights reserved.",
}
for _version in ("1.0", "2.0", "3.0"):
    TEMPLATES[f"GPL-{_version}"] = f"This program is free software: {_GNU} General Public License, version {_version[0]}."
    TEMPLATES[f"GPL-{_version} later"] = f"This program is free software; {_GNU} General Public License {_LATER} {_version[0]} {_OR}"
    TEMPLATES[f"GPL-{_version} short"] = f"This work is licensed under the GNU General Public License, version {_version[0]}."
for _version, _name in (("2.0", "Library"), ("2.1", "Lesser"), ("3.0", "Lesser")):
    _number = _version.removesuffix(".0")
    TEMPLATES[f"LGPL-{_version}"] = f"This library is free software; {_GNU} {_name} General Public License {_LATER} {_number} {_OR}"
    TEMPLATES[f"LGPL-{_version} short"] = f"Licensed under the GNU {_name} General Public License, version {_number}."
for _variant, _name in (
    ("", ""), ("-NC", " NonCommercial"), ("-ND", " NoDerivatives"), ("-SA", " ShareAlike"),
    ("-NC-ND", " NonCommercial NoDerivatives"), ("-NC-SA", " NonCommercial ShareAlike"),
):
    for _version, _reach in (("2.0", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
        TEMPLATES[f"CC-BY{_variant}-{_version}"] = f"{_CC}{_name} {_version} {_reach} License."
        TEMPLATES[f"CC-BY{_variant}-{_version} short"] = f"Licensed under CC BY{_variant} {_version}."

# A sentence that has none of these words does not speak of the licence, whatever its cosine.
NAMES = {
    "AGPL": ("affero", "agpl"), "Apache": ("apache",), "BSD": ("bsd", "redistribution"), "CC": ("cc", "creative"),
    "CC0": ("cc0", "waived"), "EPL": ("eclipse", "epl"), "GPL": ("gnu", "gpl"), "LGPL": ("lesser", "library", "lgpl"),
    "MIT": ("mit", "hereby"), "MPL": ("mozilla", "mpl"), "proprietary": ("rights",),
}
# Words that tell variants of one licence apart; a sentence and a licence have the same ones.
VARIANTS = {
    "affero": r"\baffero\b|\bagpl", "lesser": r"\blesser\b|\blibrary general\b|\blgpl", "nc": r"\bnon-?\s?commercial|\bnc\b",
    "nd": r"\bno-?\s?deriv|\bnd\b", "sa": r"\bshare-?\s?alike|\bsa\b",
}
_OF = {"AGPL": "affero lesser", "GPL": "affero lesser", "LGPL": "affero lesser", "CC": "nc nd sa"}
_VERSION = re.compile(
    r"(?:version|licen[sc]e|\bv\.?|gpl|mpl|epl|\bby|attribution|commercial|derivatives|derivs|alike|\bn[cd]|\bsa)"
    r"[\s,(-]*v?\.?\s?([0-9](?:\.[0-9]+)*)(?![0-9])"
)
_DENIED = re.compile(r"\b(?:not|never|no longer|neither|isn't|aren't)\b[^.;,]{0,20}\b(?:licen[sc]ed|released|covered|available)\b", re.I)
_SPDX = re.compile(r"SPDX-License-Identifier:[\s(]*([A-Za-z0-9.+-]+)", re.I)
_ASIDE = re.compile(r"(?:-only|-or-later|\+)\Z")  # of an identifier
_WRAP = re.compile(r"(?<!\n)\n(?![ \t]*\n)[ \t*#/;-]*")
OTHER = "other"  # a licence, but none of the templates'
MARGIN = 0.1  # by which the best template may beat the best one that agrees with the sentence

_CUE = re.compile(r"licen[sc]e|copyright|rights reserved|public domain|permission is hereby|redistribution and use", re.I)
_SENTENCE_END = re.compile(r"\n|[.!?](?=\s)")
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_FILE_NAME = re.compile(r"(?:[^/]*[._-])?(?:un)?(?:licen[sc]e|copying|copyright|notice)[^/]*\Z", re.I)  # of a licence file


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


VOCABULARY = frozenset(w for text in TEMPLATES.values() for w in words(text))


@cache
def whole_licences() -> dict[str, str]:
    """Whole texts of licences by name; read on the driver only."""
    found = [f for f in files(__package__).joinpath("license_texts").iterdir() if f.name.endswith(".txt")]
    return {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in sorted(found, key=lambda f: f.name)}


def sentences(text: str) -> list[str]:
    """Whole sentences with a cue word, in order, each once."""
    out, done = [], 0
    for cue in _CUE.finditer(text):
        if cue.start() < done:
            continue
        begin = done
        for end in _SENTENCE_END.finditer(text, done, cue.start()):
            begin = end.end()
        found = _SENTENCE_END.search(text, cue.end())
        done = found.end() if found else len(text)
        out.append(text[begin:done].strip())
    return out


def _plain_version(number: str) -> str:
    return number.removesuffix(".0")


def marks(text: str) -> tuple[frozenset[str], frozenset[str]]:
    """What tells variants apart in a text: words of ``VARIANTS`` and version numbers."""
    text = text.lower()
    variants = frozenset(v for v, pattern in VARIANTS.items() if re.search(pattern, text))
    return variants, frozenset(_plain_version(m[1]) for m in _VERSION.finditer(text))


@cache
def template_marks(licence: str) -> tuple[str, frozenset[str], frozenset[str], str | None]:
    """Name, the variant words that count for it, those it has, and its version."""
    name = next(n for n in sorted(NAMES, key=len, reverse=True) if re.match(rf"{n}(?![A-Z0-9])", licence))
    counted = frozenset(_OF.get(name, "").split())
    version = re.search(r"-([0-9]\.[0-9])\Z", licence)
    variants = {"AGPL": {"affero"}, "LGPL": {"lesser"}}.get(name, {v for v in ("nc", "nd", "sa") if f"-{v.upper()}" in licence})
    return name, counted, frozenset(variants), _plain_version(version[1]) if version and name != "CC0" else None


def agrees(licence: str, text: str, said: tuple[frozenset[str], frozenset[str]]) -> bool:
    """Whether a sentence with these marks can speak of this licence."""
    name, counted, variants, version = template_marks(licence)
    variants_said, versions = said
    named = any(re.search(rf"\b{word}", text, re.I) for word in NAMES[name])
    return named and variants_said & counted == variants and (version is None or not versions or version in versions)


def identifier(text: str) -> str | None:
    """The licence of an SPDX line, without its "only" or "or later"."""
    found = _SPDX.search(text)
    name = _ASIDE.sub("", found[1]) if found else ""
    return name if name.upper() not in ("", "NONE", "NOASSERTION") else None


_AFFERO = "gnu affero general public license version 3"


class Weights:
    """TF-IDF vectors of length one, over the words of the templates or of whole licences.

    A word of a text that no template has counts in its length alone.
    """

    def __init__(self, documents: int, counts: dict[str, int]):
        idf = lambda names: {w: 1 + math.log((1 + documents) / (1 + counts.get(w, 0))) for w in names}
        self.idf, self.whole_idf = idf(VOCABULARY), idf({w for text in whole_licences().values() for w in words(text)})
        self.other = 1 + math.log(1 + documents) / 2
        self.templates = {name.partition(" ")[0]: [] for name in TEMPLATES}
        for name, text in TEMPLATES.items():
            self.templates[name.partition(" ")[0]].append(self.vector(text, self.idf))
        self.licences = {name: [self.vector(text, self.whole_idf)] for name, text in whole_licences().items()}

    def vector(self, text: str, idf: dict[str, float]) -> dict[str, float]:
        weights = {w: n * idf.get(w, self.other) for w, n in Counter(words(text)).items()}
        length = math.sqrt(sum(x * x for x in weights.values()))
        return {w: x / length for w, x in weights.items()} if length else {}

    @staticmethod
    def _highest(vector: dict[str, float], templates: dict[str, list[dict[str, float]]]) -> tuple[float, str]:
        cosine = lambda other: sum(x * vector.get(w, 0.0) for w, x in other.items())
        return max(((max(map(cosine, v)), name) for name, v in sorted(templates.items())), key=lambda f: f[0])

    def best(self, text: str) -> tuple[float, str]:
        """The highest cosine and its licence, the first name in a tie, of those that agree in
        name, variant and version; ``OTHER`` if one that does not agree is closer by far."""
        vector, said = self.vector(text, self.idf), marks(text)
        nearest, _ = self._highest(vector, self.templates)
        agreeing = {name: v for name, v in self.templates.items() if agrees(name, text, said)}
        score, licence = self._highest(vector, agreeing) if agreeing else (0.0, OTHER)
        return (score, licence) if score >= nearest - MARGIN else (nearest, OTHER)

    def whole(self, text: str) -> tuple[float, str]:
        """The same for a whole text and the texts of licences."""
        return self._highest(self.vector(text, self.whole_idf), self.licences)


def word_counts(docs: DataFrame, text: str) -> tuple[int, dict[str, int]]:
    """Number of documents, and of those with each word of the templates and licences; over all documents."""
    known = VOCABULARY.union(w for licence in whole_licences().values() for w in words(licence))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            counts[""] += batch.num_rows
            for value in batch.column(0):
                counts.update(known.intersection(words(value.as_py() or "")))
        yield pa.RecordBatch.from_pydict({"word": list(counts), "n": pa.array(counts.values(), pa.int64())})

    parts = docs.select(F.col(text).cast("string")).mapInArrow(run, "word string, n long")
    found = {r["word"]: r["n"] for r in parts.groupBy("word").agg(F.sum("n").alias("n")).collect()}  # the vocabulary
    return found.pop("", 0), found


def judged(
    body: str, name: str, weights: Weights, threshold: float, share: float, whole: float, named: float,
) -> tuple[str | None, float, bool]:
    """Licence or none, cosine, and whether it is a licence file; ``name`` is the file's name, empty if unknown."""
    found, says = sentences(body), bool(_FILE_NAME.match(name))
    if found or says:
        score, licence = weights.whole(body)
        if score >= (named if says else whole):
            if licence == "GPL-3.0" and _AFFERO in " ".join(words(body)):
                licence = "AGPL-3.0"  # but for the title and one section the same text
            return licence, score, True
    told = next(filter(None, map(identifier, found)), None)
    if told:
        score, licence = 1.0, told
    else:
        # Headers are often wrapped: lines are looked at alone and joined.
        wrapped = dict.fromkeys(found + (sentences(_WRAP.sub(" ", body)) if found else []))
        scores = [weights.best(s) for s in wrapped if not _DENIED.search(s)]
        known = [f for f in scores if f[0] >= threshold and f[1] != OTHER]
        score, licence = max(known or scores, key=lambda f: f[0], default=(0.0, None))
    if score < threshold:
        return None, score, False
    return licence, score, says and sum(map(len, found)) >= share * len(body.strip())


def scan(docs: DataFrame, weights: Weights, *limits: float) -> DataFrame:
    """kept, path, own (licence or null), cosine, file (whether it is a licence file)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, cosines, files = [], [], []
            for value, path in zip(batch.column("text"), batch.column("path"), strict=True):
                licence, score, file = judged(
                    value.as_py() or "", (path.as_py() or "").rpartition("/")[2], weights, *limits
                )
                own.append(licence)
                cosines.append(round(score, 12))  # equal cosines tie whatever the order of their sums
                files.append(file)
            yield pa.RecordBatch.from_arrays(
                [batch.column("kept"), batch.column("path"), pa.array(own, pa.string()), pa.array(cosines, pa.float64()),
                 pa.array(files, pa.bool_())], ["kept", "path", "own", "cosine", "file"],
            )

    added = T.StructType.fromDDL("path string, own string, cosine double, file boolean")
    return docs.mapInArrow(run, T.StructType([docs.schema["kept"], *added.fields]))


def find(
    docs: DataFrame, path, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.6, share: float = 0.5,
    whole: float = 0.85, named: float = 0.7,
) -> DataFrame:
    """One row per document: the columns ``keep``, license, cosine, origin (own, inherited or none).

    A sentence stands for the closest template that agrees with it in name, variant and
    version; a licence beyond the templates is ``other``, one named by an SPDX line is what
    that says, at cosine 1.  A sentence that denies a licence has none.

    ``path`` is a column expression for a document's path, directories separated by
    slashes.  A licence file is a document whose whole text has a cosine of ``whole`` to
    a licence's, ``named`` if its name says so; with such a name also one whose sentences
    with a licence make up ``share`` of it.  A null or empty text has no licence of its own; a null path is in no
    directory and inherits nothing; of several licence files in a directory the one of
    the highest cosine counts, then the first name.  Repeated rows are scanned each for
    itself; an empty table gives no rows.
    """
    weights = Weights(*word_counts(docs, text))
    rows = docs.select(F.struct(*keep).alias("kept"), F.col(text).cast("string").alias("text"), path.alias("path"))
    scanned = materialize(scan(rows, weights, threshold, share, whole, named), "licenses").withColumn(
        "dir", F.expr("regexp_extract(path, '^(.*)/[^/]*$', 1)")
    )
    files = scanned.where("file AND path IS NOT NULL").groupBy(F.col("dir").alias("above")).agg(
        F.min(F.struct((-F.col("cosine")).alias("least"), "own")).alias("best")
    ).selectExpr("above", "best.own AS inherited")
    # One row per directory, not per document, looks through the directories above it.
    above = (
        "transform(sequence(0, size(split(dir, '/'))), n -> named_struct('depth', n, 'above',"
        " array_join(slice(split(dir, '/'), 1, n), '/')))"
    )
    dirs = scanned.where("path IS NOT NULL").select("dir").distinct().select("dir", F.explode(F.expr(above)).alias("a"))
    nearest = dirs.select("dir", "a.*").join(files, "above").groupBy("dir").agg(
        F.max(F.struct("depth", "inherited")).alias("near")
    ).selectExpr("dir", "near.inherited")
    joined = scanned.join(materialize(nearest, "nearest"), "dir", "left")
    inherits = F.col("own").isNull() & F.col("path").isNotNull() & F.col("inherited").isNotNull()
    return joined.select(
        "kept.*", F.coalesce("own", F.when(inherits, F.col("inherited"))).alias("license"), "cosine",
        F.when(F.col("own").isNotNull(), "own").when(inherits, "inherited").otherwise("none").alias("origin"),
    )
