"""License labels against a plain scan."""

import re

import pytest

from jobsieve.llm import license_scan as L

MIT = L.TEMPLATES[5][1]
FILL = " ".join(f"w{i}" for i in range(50))
DOCS = [
    (1, "Licensed under CC BY-NC 4.0.\n" + FILL), (2, FILL), (3, None), (4, ""), (5, "Cc-by CC by, cc\nBY all RIGHTS reserved"),
    (6, FILL + " This work is licensed under the GNU General Public License, version 3. " + FILL),
    (7, FILL + " " + MIT.replace("free of charge", "free of any charge").replace("obtaining", "getting").upper()),
    (8, "the cc of by. All rights are reserved. General Publics License"), (9, "K" + "cc by İcc by Écc by"),
    (10, "Released under the MIT License. " * 3 + "x " * 100_000 + "Licensed under the Apache License, Version 2.0"),
    (None, "All rights reserved"), (1, "All rights reserved"), (1, "All rights reserved"),
    (11, " ".join(MIT.split()[:7]) + " " + FILL), (12, "cc"), (13, "by cc by"),
]


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(text):
    w, places = words(text), {}
    for label, phrase in L.PHRASES.items():
        p = phrase.split()
        places[label] = [i for i in range(len(w)) if w[i:i + len(p)] == p]
    every = sorted(sum(places.values(), []))
    base = sorted(k for k, v in places.items() if v)
    found = []
    for label, template in L.TEMPLATES:
        t = words(template)
        for i in range(len(w) - L.GRAM + 1):  # windows around every shared k-gram
            gram = w[i:i + L.GRAM]
            for j in range(len(t) - L.GRAM + 1):
                if t[j:j + L.GRAM] == gram:
                    at = max(i - j, 0)
                    share, a, b = L.aligned(t, w[at:i - j + len(t) + 1])
                    own = w[at + a:at + b]
                    same = {x for x in own if x in L.DECIDING} == {x for x in t if x in L.DECIDING}
                    digits = [x for x in t if x.isdigit()]
                    same &= not digits or digits == [x for x in own if x.isdigit()]
                    if share >= L.LEAST_COVER and same:
                        found.append((-share, a - b, at + a, label, at + b))
    labels, best, taken = set(base), 1.0 if base else 0.0, set()
    for share, _, a, label, b in sorted(set(found)):
        if not taken & set(range(a, b)):
            taken |= set(range(a, b))
            labels.add(label)
            best = max(best, -share)
    return len(w), len(every), min(every, default=None), max(every, default=None), ",".join(base), ",".join(sorted(labels)), best


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*d, 1, "x") for d in DOCS], "doc_id long, text string, _row int, labels string").repartition(3)


def test_against_plain_scan(docs):
    rows = L.document_licenses(docs).collect()
    got = sorted(((r.doc_id, *r[1:7]) for r in rows), key=str)
    want = [(d, *plain(t)) for d, t in DOCS]
    assert got == sorted((w[:7] for w in want), key=str)
    scores = {r.doc_id: r.score for r in rows if r.doc_id not in (None, 1)}
    assert scores[2] == scores[3] == scores[8] == 0 and scores[5] == scores[6] == 1 and 0.75 <= scores[7] < 1


@pytest.mark.parametrize("text, labels", [
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
     "License as published by the Free Software Foundation, either version 3", "agpl,gpl"),
    ("This work is licensed under the GNU Affero General Public License, version 3.", "agpl-3.0,gpl"),
    ("This work is licensed under the GNU General Public License, version 2.", "gpl,gpl-2.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
    ("This work is licensed under the GNU General Public License, version 1.", "gpl"),
    ("Licensed under CC BY-ND 4.0.", "cc-by,cc-by-nd-4.0"), ("Licensed under CC BY-NC-ND 4.0.", "cc-by,cc-by-nc-nd-4.0"),
    ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"), ("Licensed under CC BY 4.0.", "cc-by,cc-by-4.0"),
    ("Licensed under CC BY 3.0.", "cc-by"),
    ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "cc-by-nd-4.0"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "cc-by-nc-nd-4.0"),
    ("// SPDX-License-Identifier: MIT", "mit"), ("# SPDX-License-Identifier: (Apache-2.0 OR MIT) AND BSD-3-Clause.\nx", "apache-2.0,bsd-3-clause,mit"),
    ("SPDX-License-Identifier:", ""), ("SPDX-License-Identifier: GPL-2.0+ with Classpath-exception-2.0", "classpath-exception-2.0,gpl-2.0+"),
])
def test_relatives(spark, text, labels):
    row = L.document_licenses(spark.createDataFrame([(1, FILL + " " + text)], "doc_id long, text string")).first()
    assert row.labels == labels and (row.score > 0.75) == bool(labels)


def test_words():
    for _, t in DOCS:
        assert L.plain_words(t) == words(t)


def test_spans(docs):
    rows = [r for r in L.scan(docs.where("doc_id = 7")).collect() if r.label == "mit"]
    assert len(rows) == 1 and rows[0].start <= 50 and rows[0].stop >= 50 + 25


def test_empty_table(docs):
    assert L.document_licenses(docs.limit(0)).count() == 0
