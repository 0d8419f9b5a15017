"""The licence scan against a plain version, and its classifier on wordings that it did not learn from."""

import math
import random
import re

import numpy as np
import pytest

from logmill.llm import licenses as L


def plain_paragraphs(text):
    out, open_ = [], ""
    for line in re.split("\r\n|\n|\r", text):
        line = re.sub(L._CLOSE.replace("$", r"\Z"), "", re.sub(L._MARK, "", line, count=1))
        open_ += line
        rest = line
        while rest and not rest[-1].isalnum() and rest[-1] not in ".!?:":
            rest = rest[:-1]
        if not line.strip(" ") or rest[-1:] in (".", "!", "?", ":"):
            out.append(open_)
            open_ = ""
        else:
            open_ += " "
    return [p.strip(" ") for p in [*out, open_] if p.strip(" ")]


def classified(text):
    """(family, score, share, probability of the best family, best family), one gram at a time."""
    families, weights, bias = L.model()
    grams = L.grams_of(L.words_of(text))
    z = [b + sum(weights[g][i] for g in grams if g in weights) for i, b in enumerate(bias)]
    p = [math.exp(v - max(z)) for v in z]
    p = [v / sum(p) for v in p]
    best = z.index(max(z))
    pairs = {g for g in grams if " " in g}
    share = 0.0
    for family, own in L.templates():
        common = len(own & pairs)
        if family == families[best] and common >= min(2, len(own)):
            share = max(share, common / min(max(len(pairs), 1), len(own)))
    named = best > 0 and p[best] >= L.PROBABILITY and share >= L.SHARE
    return families[best] if named else L.UNKNOWN, p[best] if named else p[0], share, p[best], families[best]


def brute(text):
    return [(k, p, *classified(p)[:3]) for k, p in enumerate(plain_paragraphs(text or "")) if any(a in p.lower() for a in L.ANCHORS)]


GPL = "This program is free software: you can redistribute it and/or modify\n{}it under the terms of the GNU General Public License as published by\n{}the Free Software Foundation, either version 3 of the License, or\n{}(at your option) any later version."
TEXTS = [
    "Some prose.\nReleased under the MIT License.\nmore prose",
    "the end. Licensed under the Apache License, Version 2.0. Next.\r\nAll rights reserved.\rlicense",
    "LICENSED UNDER CC BY-NC 4.0.\nLicensed under CC BY-NC-SA 4.0.\nlicensed under CC BY 4.0",
    "This work is licensed under the GNU General Public License, version 3.\nThis work is licensed under the GNU General Public License, version 2.",
    "You need a license to drive a car. license license",
    "/*\n * Permission is hereby granted, free of charge, to any person obtaining a copy of this software and\n * associated documentation files\n */\nint main;",
    "copyright © 2020 Someone.\n\n\nlicen",
    "wordy " * 30000 + "released under the MIT license.\n" + "x" * 100000,
    GPL.format("", "", ""),
    "#!/bin/sh\n# " + GPL.format("# ", "# ", "# ") + "\n#\n# license",
    "prose!!$$$\nReleased under the MIT License.$$$\nSPDX-License-Identifier: BSL-1.0",
    " " * 50000 + "\n" * 50000 + "\tlicense" + "-" * 50000 + "\n" + "." * 50000,
]


def test_brute_force(spark):
    rows = list(enumerate(TEXTS)) + [(20, None), (21, ""), (22, "nothing here"), (None, TEXTS[0]), (23, TEXTS[2]), (23, TEXTS[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS gram", "'x' AS family", "2 AS words", "3 AS two", "4 AS paragraph")
    got = sorted(map(tuple, L.scan(docs).collect()), key=str)
    want = sorted(((k, *x) for k, t in rows for x in brute(t)), key=str)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want):
        assert g[4] == pytest.approx(w[4], abs=1e-9)
        assert g[5] == pytest.approx(w[5])
    named = {(g[0], g[1]): g[3] for g in got}
    assert [named[0, 1], named[1, 0], named[1, 1], named[1, 2]] == ["MIT", "Apache-2.0", "Proprietary", "unknown"]
    assert [named[2, k] for k in range(3)] == ["CC-BY-NC", "CC-BY-NC-SA", "CC-BY"]
    assert [named[3, k] for k in range(2)] == ["GPL-3.0", "GPL-2.0"]
    assert named[4, 0] == "unknown"
    assert named[5, 0] == named[7, 0] == named[10, 1] == "MIT"
    assert named[8, 0] == named[9, 0] == "GPL-3.0"
    assert named[10, 2] == "BSL-1.0"
    assert L.scan(docs.limit(0)).collect() == []


def test_a_line_of_many_words(spark):
    text = " ".join(f"w{k}" for k in range(200_000)) + " released under the MIT license"
    got = L.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(r["family"], r["template_share"]) for r in got] == [("MIT", 1.0)]


def test_no_shuffle_and_no_python(spark):
    plan = L.scan(spark.createDataFrame([(1, "license")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow|Join", plan)


#: Grants without any of ANCHORS in a line, with their families.
WITHOUT_ANCHOR = [
    ("Released under the MPL 2.0.", "MPL-2.0"),
    ("All content here is made available under the EUPL, Version 1.2.", "EUPL"),
    (L.TEXTS["Unlicense"][1], "Unlicense"),
    ("Example Corp.\n\nAll rights\nreserved.", "Proprietary"),
    ("# All  rights  reserved.", "Proprietary"),
    ("// Source files: MPL\n// 2.0.", "MPL-2.0"),
]


def test_every_paragraph_is_classified(spark):
    assert not any(a in line.lower() for t, _ in WITHOUT_ANCHOR for line in t.split("\n") for a in L.ANCHORS)
    rows = [(k, "The river was cold that day.\n" + t + "\n\nThey walked home by any means.") for k, (t, _) in enumerate(WITHOUT_ANCHOR)]
    rows += [(90, "The river was cold that day.\nBy any means."), (91, None), (92, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["text"].split()[0], r["family"]) for r in L.scan(docs).orderBy("doc_id").collect()]
    assert [(k, f) for k, _, f in got] == [(k, f) for k, (_, f) in enumerate(WITHOUT_ANCHOR)]
    # with all that are unknown, as a plain version gives them
    got = sorted(map(tuple, L.scan(docs, every=True).collect()))
    want = sorted((k, n, p, *classified(p)[:3]) for k, t in rows for n, p in enumerate(plain_paragraphs(t or "")))
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want])


def test_a_word_of_many_parts(spark):
    text = "a-b." * 200_000 + "a\nreleased under the MIT license."
    got = L.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(r["paragraph"], r["family"]) for r in got] == [(0, "MIT")]


#: Wordings of which none was learned from or calibrated by.
HELD = {
    "MIT": ["You may use this library under the MIT License.", "Code samples in this book are covered by the MIT license."],
    "Apache-2.0": ["We offer this tool under the Apache License, Version 2.0, without charge.", "Everything in this repository falls under the Apache 2.0 license."],
    "GPL-3.0": ["The authors release this game under the GNU General Public License, version 3.", "Source files are covered by the GNU GPL version 3."],
    "GPL-2.0": ["The kernel module is covered by the GNU General Public License, version 2.", "This driver comes under the GNU GPL version 2."],
    "LGPL": ["You may link to it under the GNU Lesser General Public License, version 2.1."],
    "AGPL-3.0": ["The server is offered under the GNU Affero General Public License, version 3."],
    "BSD": ["Our parser is free to use under the BSD 3-Clause License."],
    "ISC": ["Use it under the ISC License."],
    "MPL-2.0": ["These files are covered by the Mozilla Public License, version 2.0."],
    "EPL": ["The plugin comes under the Eclipse Public License 2.0."],
    "BSL-1.0": ["You may use the headers under the Boost Software License, Version 1.0."],
    "CC0": ["The dataset is dedicated under CC0 1.0 Universal."],
    "CC-BY": ["Photos in this album: CC BY 4.0.", "You may share these slides under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Text of this wiki: CC BY-SA 4.0."],
    "CC-BY-NC": ["You may share the drawings under CC BY-NC 4.0."],
    "CC-BY-NC-SA": ["Lecture notes, CC BY-NC-SA 4.0."],
    "Proprietary": ["Copyright 2019 Example Corp. All rights reserved.", "This manual is proprietary and confidential, do not share it.", "Unauthorized copying of this document, by any means, is strictly prohibited."],
    "unknown": ["The teacher gave permission to use calculators.", "His pilot licence was taken away.", "We talked about the MIT License over lunch.", "A book on copyright was reserved for her.", "The prize was distributed under loud applause.", "What does the GNU General Public License say about patents?", "The public domain theater plays on Sunday.", "She asked whether the Apache License, Version 2.0 is shorter than a novel.", "Parking is prohibited here.", "The licence fee rises every year.", "Many companies fear the GNU Affero General Public License, version 3.", "House rules: dogs are prohibited, cats need permission.", "Licensing of doctors is a matter of the states.", "Permission to speak was denied by the chair.", "Open source licenses differ in length."],
}


def edited(text, r):
    prose = "Some days the weather was fine and they walked along the river to the old mill where a friend of hers had a small shop".split()
    words, kind = text.split(), r.randrange(3)
    if kind == 0 and len(words) > 6:
        words.pop(r.randrange(2))
    return " ".join([words, r.choices(prose, k=12) + words, words + r.choices(prose, k=30)][kind])


def test_unseen_wordings():
    assert not {t for ts in HELD.values() for t in ts} & {t for _, t in L.grants(L.FORMS + L.CHECKED + L.MENTIONS + L.CHECKED_MENTIONS)}
    r = random.Random(5)
    found, unknown, sure = [], [], []
    for family, texts in HELD.items():
        for text in [x for t in texts for x in [t, *(edited(t, r) for _ in range(9))]]:
            got, _, _, p, best = classified(text)
            (unknown if family == L.UNKNOWN else found).append(got == family)
            sure.append((p, best == family))
    assert np.mean(found) >= 0.85
    assert np.mean(unknown) >= 0.8
    # expected error of calibration, over ten bins
    p, right = np.array(sure, dtype=float).T
    bins = np.minimum((p * 10).astype(int), 9)
    assert sum((bins == k).mean() * abs(p[bins == k].mean() - right[bins == k].mean()) for k in set(bins.tolist())) <= 0.25


def test_templates_and_others():
    for family, texts in L.TEXTS.items():
        for t in texts:
            assert all(x[2] == family for x in brute(t)), t
        assert any(brute(t) for t in texts)
    assert np.mean([all(x[2] == family for x in brute(t)) for family, t in L.grants(L.FORMS)]) > 0.95
    assert all(x[2] == "unknown" for t in L.OTHER for x in brute(t))
