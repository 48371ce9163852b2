"""Cosines against a plain computation, inheritance against a walk up the path."""

import math
from collections import Counter

from pyspark.sql import functions as F

from tidewatch.llm import licenses as L
from tidewatch.llm.queries import QUERIES

LINES = {
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "All rights reserved.": "proprietary",
}


def test_query_finds_every_line(spark, folder):
    found = {r.doc_id: r for r in QUERIES["op9_licenses"](spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(found) == len(rows)
    for r in rows:
        named = [n for line, n in LINES.items() if line in (r.text or "")]
        assert found[r.doc_id].license in named if named else found[r.doc_id].origin != "own"


def plain_best(text, rows):
    seen = Counter(w for _, t in rows for w in set(L.words(t or "")) & L.VOCABULARY)
    n = len(rows)

    def vector(t):
        return {w: c * (1 + math.log((1 + n) / (1 + seen[w])) if w in L.VOCABULARY else 1 + math.log(1 + n) / 2)
                for w, c in Counter(L.words(t)).items()}

    def cosine(a, b):
        return sum(a[w] * b.get(w, 0) for w in a) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))

    return max(cosine(vector(t), vector(text)) for t in L.TEMPLATES.values())


ROWS = [
    ("a/LICENSE", "Released under the MIT License."), ("a/b/c/x", "words only"), ("a/b/LICENSE", "All rights reserved."),
    ("a/y", None), ("z", ""), (None, "nothing"), ("q/r/s", "no licence was ever granted to drive this car, they said"),
    ("a/b/own", "text of a file\nLicensed under CC BY-NC 4.0.\nand " + "much more " * 50), ("a/y", None),
    ("a/LICENSE2", "Licensed under the Apache License, Version 2.0. " + "x"), ("long", "licence " * 40_000),
]


def test_inheritance_and_edge_rows(spark):
    frame = spark.createDataFrame([(i, p, t, "x") for i, (p, t) in enumerate(ROWS)], "doc_id long, path string, text string, dir string")
    found = {r.doc_id: r for r in L.find(frame, F.col("path")).collect()}
    assert len(found) == len(ROWS)
    kinds = [(found[i].license, found[i].origin) for i in range(len(ROWS) - 1)]
    assert kinds[:7] == [("MIT", "own"), ("proprietary", "inherited"), ("proprietary", "own"), ("Apache-2.0", "inherited"),
                         (None, "none"), (None, "none"), (None, "none")]
    assert kinds[7] == ("CC-BY-NC-4.0", "own") and kinds[8] == ("Apache-2.0", "inherited")
    for i in (0, 2):
        assert abs(found[i].cosine - plain_best(ROWS[i][1], ROWS)) < 1e-9
    assert L.find(frame.limit(0), F.col("path")).count() == 0


def test_whole_licences_are_licence_files(spark):
    whole = L.whole_licences()
    holder = "Copyright (c) 2021 Jo Doe <jo@example.org>\n\n"
    full = [("MIT", "The MIT License (MIT)\n\n" + holder + " ".join(whole["MIT"].split())), ("BSD-3-Clause", whole["BSD-3-Clause"]
             .replace("The Regents of the University of California", "Jo Doe").replace("REGENTS", "AUTHORS")),
            ("Apache-2.0", whole["Apache-2.0"].split("APPENDIX")[0]), ("GPL-3.0", holder + whole["GPL-3.0"].split("How to Apply These")[0])]
    rows = [(f"p{i}/1", text) for i, (_, text) in enumerate(full)] + [(f"p{i}/deep/er/2", "plain words") for i in range(4)]
    prose = "the ship sailed on and the crew of it sang to the wind in any weather " * 40
    rows += [("q/1", prose + "\nReleased under the MIT License."), ("q/2", "plain words"), ("r/1", "Released under the MIT License."),
             ("r/2", "plain words")] + [(f"s/{i}", prose) for i in range(20)]
    frame = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "doc_id long, path string, text string")
    found = {r.doc_id: (r.license, r.origin) for r in L.find(frame, F.col("path")).collect()}
    for i, (name, _) in enumerate(full):
        assert found[i] == (name, "own") and found[i + 4] == (name, "inherited")
    # A line in a document is no licence file, nor is a short text without a name that says so.
    assert [found[i] for i in range(8, 12)] == [("MIT", "own"), (None, "none")] * 2


def test_query_searches_several_levels(spark, tmp_path):
    whole, plain = L.whole_licences(), "plain words of a document"
    rows = [(0, whole["Apache-2.0"], "s", "en"), (100, whole["MIT"], "s", "en"), (101, plain, "s", "en"), (5, plain, "s", "en"),
            (10101, plain, "s", "en"), (10100, plain, "s", "en"), (203, "Licensed under CC BY-NC 4.0.", "s", "en"),
            (204, plain, "s", "en"), (102, plain, "t", "en"), (103, plain, None, None), (None, plain, "s", "en")]
    rows += [(i, "the ship sailed on and the crew sang to the wind", "u", "en") for i in range(20, 50)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: (r.license, r.origin) for r in QUERIES["op9_licenses"](spark, str(tmp_path)).collect()}
    mit, apache = ("MIT", "inherited"), ("Apache-2.0", "inherited")
    assert [found[i] for i in (101, 5, 204)] == [mit] * 3  # one level up, past a notice beside it
    assert [found[i] for i in (10101, 10100, None)] == [apache] * 3  # two levels up, one, and none
    assert [found[i] for i in (0, 100, 203)] == [("Apache-2.0", "own"), ("MIT", "own"), ("CC-BY-NC-4.0", "own")]
    assert found[102] == found[103] == (None, "none")


GPL = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU {}General Public License" \
      " as published by\nthe Free Software Foundation; either version {} of the License, or\n(at your option) any later version.\n"
SAID = {
    GPL.format("", 2): "GPL-2.0", GPL.format("", 3): "GPL-3.0", GPL.format("Affero ", 3): "AGPL-3.0",
    GPL.replace("program", "library").format("Lesser ", 2.1): "LGPL-2.1", GPL.replace("\n", " ").format("Lesser ", 3): "LGPL-3.0",
    GPL.replace("\n", "\n * ").format("", 2): "GPL-2.0", GPL.replace("program", "library").format("Library ", 2): "LGPL-2.0",
    "Licensed under the GNU Lesser General Public License, version 2.1.": "LGPL-2.1",
    "This work is licensed under the GNU General Public License.": "GPL",
    "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file"
    " except in compliance with the License.": "MPL-1.1",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "MPL-2.0",
    "Licensed under the Eclipse Public License, Version 2.0.": "EPL-2.0",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0": "EPL-1.0",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.": "CC-BY-ND-4.0",
    "This work is licensed under a Creative Commons Attribution 3.0 Unported License.": "CC-BY-3.0",
    "Licensed under CC BY-NC-SA 4.0.": "CC-BY-NC-SA-4.0", "Licensed under CC BY 4.0.": "CC-BY-4.0",
    "Licensed under the Apache License, Version 1.1.": L.OTHER, "Licensed under the Sleepycat License, Version 2.0.": L.OTHER,
    "This is not licensed under the MIT License.": None, "no licence was ever granted to drive": None,
    "// SPDX-License-Identifier: MIT\nint x;": "MIT", "# SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0",
    "SPDX-License-Identifier: (Apache-2.0 OR MIT)": "Apache-2.0", "SPDX-License-Identifier: LGPL-2.1+": "LGPL-2.1",
    "SPDX-License-Identifier: NONE": None,
    "words " * 300 + "and all of it is Licensed under the Apache License, Version 2.0": None,  # one whole sentence, of other words
}


def test_versions_variants_and_identifiers(spark):
    prose = [f"the ship sailed on and the crew of it sang to the wind {i}" for i in range(200)]
    rows = list(enumerate([*SAID, *prose]))
    found = {r.doc_id: r for r in L.find(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(None).cast("string")).collect()}
    wrong = [(text, found[i].license, found[i].cosine, name) for i, (text, name) in enumerate(SAID.items()) if found[i].license != name]
    assert not wrong
    assert all(found[i].origin == "none" for i in range(len(SAID), len(rows)))


def test_headers_of_templates_are_their_own_licence():
    weights = L.Weights(1000, {})
    for name, text in L.TEMPLATES.items():
        assert weights.best(text) == (weights.best(text)[0], name.partition(" ")[0])


def test_affero_text_is_not_the_general_one():
    text = L.whole_licences()["GPL-3.0"]
    affero = text.replace("GNU GENERAL PUBLIC LICENSE", "GNU AFFERO GENERAL PUBLIC LICENSE", 1)
    for body, name in ((text, "GPL-3.0"), (affero, "AGPL-3.0")):
        assert L.judged(body, "COPYING", L.Weights(1000, {}), 0.6, 0.5, 0.85, 0.7)[::2] == (name, True)
