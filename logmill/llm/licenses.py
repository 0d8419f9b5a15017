"""License scan: a trained classifier of paragraphs, confirmed by templates.

A paragraph is what stands between blank lines and ends of sentences at line
ends, without comment marks: hard-wrapped lines are joined.  A sparse logistic
regression over word uni- and bigrams, learned from grants of licences in many
wordings and from sentences that speak of licences without granting one, gives
each paragraph a family or `unknown`; its softmax is calibrated on wordings that
it did not learn from.  A family counts only if the paragraph also shares enough
bigrams with one of its templates.  Every paragraph of every text is classified.
The scan is one projection of the texts: only the grams that the model knows are
kept of a paragraph, nothing is shuffled.
"""

from __future__ import annotations

import json
import random
import re
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: Least calibrated probability of a family, and least share of the shorter one's bigrams that paragraph and template have in common.
PROBABILITY, SHARE = 0.5, 0.7

# Names of licences.
NAMES = {
    "MIT": ["MIT License", "MIT license (MIT)", "Expat License", "MIT/Expat license"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache 2.0 license", "Apache License 2.0", "Apache Software License 2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL version 3", "GNU General Public License v3.0", "GPL v3 license", "GPLv3 license"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL version 2", "GNU General Public License v2.0", "GPL v2 license", "GPLv2 license"],
    "LGPL": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License, version 3", "GNU Library General Public License", "GNU LGPL", "LGPL license"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL version 3", "AGPLv3 license", "Affero GPL"],
    "BSD": ["BSD 3-Clause License", "BSD 2-Clause license", "new BSD license", "Simplified BSD License", "BSD license"],
    "ISC": ["ISC License", "ISC license (ISC)"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "EPL": ["Eclipse Public License 2.0", "Eclipse Public License v1.0", "Eclipse Public License, version 2.0"],
    "EUPL": ["European Union Public Licence", "EUPL, Version 1.2", "European Union Public License v1.2"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "Artistic-2.0": ["Artistic License 2.0", "Artistic License", "Perl Artistic License"],
    "Zlib": ["zlib License", "zlib/libpng license"],
    "OFL-1.1": ["SIL Open Font License, Version 1.1", "SIL Open Font License"],
    "Unlicense": ["The Unlicense", "Unlicense license"],
    "CC0": ["CC0 1.0 Universal", "CC0 1.0", "Creative Commons Zero", "CC0 public domain dedication"],
    "CC-BY": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License"],
    "CC-BY-SA": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License"],
    "CC-BY-NC": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial License"],
    "CC-BY-ND": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License", "Creative Commons Attribution-NoDerivatives License"],
    "CC-BY-NC-SA": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-NC-ND": ["CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
}
# Identifiers of SPDX.
SPDX = {
    "MIT": ["MIT"], "Apache-2.0": ["Apache-2.0"], "GPL-3.0": ["GPL-3.0-only", "GPL-3.0-or-later", "GPL-3.0"], "GPL-2.0": ["GPL-2.0-only", "GPL-2.0-or-later", "GPL-2.0"],
    "LGPL": ["LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"], "AGPL-3.0": ["AGPL-3.0-only", "AGPL-3.0-or-later"], "BSD": ["BSD-3-Clause", "BSD-2-Clause"],
    "ISC": ["ISC"], "MPL-2.0": ["MPL-2.0"], "EPL": ["EPL-2.0", "EPL-1.0"], "EUPL": ["EUPL-1.2"], "BSL-1.0": ["BSL-1.0"], "Artistic-2.0": ["Artistic-2.0"], "Zlib": ["Zlib"], "OFL-1.1": ["OFL-1.1"],
    "Unlicense": ["Unlicense"], "CC0": ["CC0-1.0"], "CC-BY": ["CC-BY-4.0"], "CC-BY-SA": ["CC-BY-SA-4.0"], "CC-BY-NC": ["CC-BY-NC-4.0"], "CC-BY-ND": ["CC-BY-ND-4.0"], "CC-BY-NC-SA": ["CC-BY-NC-SA-4.0"], "CC-BY-NC-ND": ["CC-BY-NC-ND-4.0"],
}
# Sentences of licences and notices themselves.
TEXTS = {
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS"],
    "GPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "EPL": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License which accompanies this distribution"],
    "EUPL": ["Licensed under the EUPL, Version 1.2 or, as soon they will be approved by the European Commission, subsequent versions of the EUPL"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0.", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"],
    "Artistic-2.0": ["This is free software; you can redistribute it and/or modify it under the same terms as Perl itself."],
    "Zlib": ["The origin of this software must not be misrepresented; you must not claim that you wrote the original software.", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "OFL-1.1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."],
    "Proprietary": ["All rights reserved.", "This document is proprietary and confidential.", "No part of this publication may be reproduced without the prior written permission of the publisher.", "Unauthorized copying of this file is strictly prohibited.", "This software is the confidential and proprietary information of the company.", "Reproduction or distribution without written permission is prohibited."],
}
#: Wordings of a grant, to learn from and (CHECKED) to calibrate by.
FORMS = ["Released under the {}.", "Licensed under {}.", "This project is licensed under the terms of the {}.", "This work is licensed under the {}.", "This file is distributed under the {}.", "You can redistribute it under the terms of the {}.", "This package is available under the {}.", "License: {}", "The code is published under the {}, see the file LICENSE.", "Use of this source code is governed by the {} that can be found in the LICENSE file.", "Distributed under the terms of the {}.", "You may copy and change it under the {}.", "We publish all figures under {}.", "{}"]
CHECKED = ["All content here is made available under the {}.", "The software is provided to you under the {}.", "Copyright the authors, {}.", "Its source code may be used under the {}, as the authors state."]
#: Wordings that speak of a licence and grant none, to learn from and to calibrate by.
MENTIONS = ["He wrote an article about the {} last year.", "The {} was discussed at the conference.", "A comparison of the {} with other licenses follows.", "The history of the {} is long.", "Some lawyers think that the {} is hard to read.", "Unlike the {}, this contract forbids resale.", "Nobody at the company had read the {}.", "This is not compatible with the {}.", "What would the {} demand of a shop?", "They fear the {} for its terms."]
CHECKED_MENTIONS = ["The court had to explain the {} to the jury.", "Students often ask what the {} means.", "They argued for hours over the {} and its critics."]
#: Sentences with words of licences that name none; every fourth is for calibration.
OTHER = ["You need a license to drive a car.", "His fishing license was renewed in spring.", "The driver had no valid licence.", "They asked permission to leave the room.", "The Apache helicopter landed near the base.", "She studied physics at MIT for four years.", "The general public was not allowed inside.", "The public domain is a topic of the lecture.", "The committee reserved a table for eight.", "All seats are reserved for members.", "Civil rights were the subject of the debate.", "The warranty of the phone ends next year.", "A copy of the letter was sent to the office.", "Creative people work in common rooms.", "The foundation gave free meals to any person.", "The source of the river lies in the hills.", "Copyright law changed in that decade.", "See the license file for details.", "Terms and conditions apply to this offer.", "The software was sold with a commercial license.", "Redistribution of wealth was discussed in parliament.", "The notice was published by the ministry.", "The version of events differs.", "Binary stars are two suns that circle each other.", "Smoking is prohibited in all rooms.", "The new version of the program is faster.", "Permission to land was granted by the tower.", "The bakery lost its licence to sell beer.", "Her permission is not needed for that.", "Copyright is a right that ends after seventy years.", "A license plate was found in the river.", "The rights of the workers were at stake."]
#: Words of any text, and how many words may stand before and after a sentence to learn from.
COMMON, AROUND = "the of and to in is this that it for as with on be at by not are or was from".split(), [0, 0, 0, 3, 8, 20, 60]
#: Words of licences: a paragraph with one of these is listed even if it is `unknown`.
ANCHORS = ("licen", "permission", "redistribut", "rights reserved", "proprietary", "public domain", "copyright", "prohibited", "commons", "cc0", "cc by", "gpl", "misrepresented", "distributed under")

#: Steps of gradient descent, and their size for each weight.
STEPS, RATE = 300, 0.3

#: Possessive, as Java's other loops over groups recurse, and words may be long.
_WORD = "[a-z0-9]++(?:[.+-][a-z0-9]++)*+"
# Marks that begin and end lines of comments.
_MARK = "^[ \t]*(?:(?:/?\\*+|//+|#+|--+|;+|%+|<!--|dnl\\b)[ \t]*)?"
_CLOSE = "(?:\\*/|-->)[ \t]*$"
#: A line that ends so closes its paragraph; signs after the end of the sentence do not count.
_CLOSED = "[.!?:][^\\p{L}\\p{N}]*$"
_TAIL = 40


def words_of(text: str) -> list[str]:
    return re.findall(_WORD, re.sub("[A-Z]+", lambda m: m.group().lower(), text))


def pairs_of(words: list[str]) -> set[str]:
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


def grams_of(words: list[str]) -> set[str]:
    return set(words) | pairs_of(words)


def grants(forms: list[str]) -> list[tuple[str, str]]:
    """(family, sentence) of the forms with all names."""
    return [(family, form.format(name)) for family, names in NAMES.items() for name in names for form in forms]


@lru_cache(maxsize=1)
def templates() -> list[tuple[str, set[str]]]:
    """(family, bigrams): the names and identifiers of a family, and its own sentences."""
    out = [(f, pairs_of(words_of(name))) for f, names in NAMES.items() for name in names]
    out += [(f, pairs_of(words_of("SPDX-License-Identifier: " + i))) for f, ids in SPDX.items() for i in ids]
    out += [(f, pairs_of(words_of(text))) for f, texts in TEXTS.items() for text in texts]
    return [(f, pairs) for f, pairs in out if pairs]


def _edited(words: list[str], r: random.Random, filler: list[str]) -> list[str]:
    """The words with a few dropped and others put around them."""
    kept = [w for w in words if r.random() > 0.05] or words
    return r.choices(filler, k=r.choice(AROUND)) + kept + r.choices(filler, k=r.choice(AROUND))


def _samples(seed: int) -> tuple[list[str], list[tuple[set[str], int]], list[tuple[set[str], int]]]:
    """Families with `unknown` first, and grams and family of paragraphs to learn from and to calibrate by."""
    r = random.Random(seed)
    families = [UNKNOWN, *dict.fromkeys([*NAMES, *TEXTS])]
    number = {f: k for k, f in enumerate(families)}
    filler = [w for s in OTHER for w in words_of(s)] + 6 * COMMON
    learned, checked = [], []
    for into, forms, mentions, times in ((learned, FORMS, MENTIONS, 2), (checked, CHECKED, CHECKED_MENTIONS, 1)):
        for family, text in grants(forms):
            into += [(grams_of(_edited(words_of(text), r, filler)), number[family]) for _ in range(times)]
        into += [(grams_of(_edited(words_of(text), r, filler)), 0) for _, text in grants(mentions)]
    for family, ids in SPDX.items():
        for k in ids:
            for n, into in ((3, learned), (1, checked)):
                into += [(grams_of(r.choices(filler, k=r.choice([0, 0, 5])) + words_of("SPDX-License-Identifier: " + k)), number[family]) for _ in range(n)]
    for family, texts in TEXTS.items():
        for text in texts:
            words = words_of(text)
            for n, into in ((10, learned), (3, checked)):
                for _ in range(n):
                    # a notice may stand in parts
                    a = r.randrange(max(1, len(words) - 11)) if r.random() < 0.4 else 0
                    b = len(words) if a else r.randint(min(12, len(words)), len(words))
                    into.append((grams_of(_edited(words[a:b], r, filler)), number[family]))
    for k, text in enumerate(OTHER):
        into, words = (checked if k % 4 == 3 else learned), words_of(text)
        into += [(grams_of(_edited(words, r, filler)), 0) for _ in range(8)]
    every = [w for texts in TEXTS.values() for t in texts for w in words_of(t)]
    for k in range(400):
        (learned, checked)[k % 4 == 3].append((grams_of(r.choices(every, k=r.randint(3, 20))), 0))
    return families, learned, checked


@lru_cache(maxsize=1)
def model(seed: int = 0) -> tuple[list[str], dict[str, list[float]], list[float]]:
    """Families with `unknown` first, calibrated weights of each gram, and biases."""
    families, learned, checked = _samples(seed)
    spdx = ["SPDX-License-Identifier: " + k for ids in SPDX.values() for k in ids]
    sentences = [*spdx, *OTHER, *(t for ts in TEXTS.values() for t in ts), *(t for _, t in grants(FORMS + MENTIONS))]
    place = {g: k for k, g in enumerate(sorted(set().union(*(grams_of(words_of(t)) for t in sentences))))}

    def matrix(samples: list[tuple[set[str], int]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(samples), len(place)), dtype=np.float32)
        for i, (grams, _) in enumerate(samples):
            x[i, [place[g] for g in grams if g in place]] = 1
        return x, np.array([k for _, k in samples])

    x, y = matrix(learned)
    onehot = np.eye(len(families), dtype=np.float32)[y]
    weight = ((1 / np.bincount(y, minlength=len(families)))[y] * np.where(y == 0, len(families), 1.0)).astype(np.float32)
    weight /= weight.sum()
    w, b = np.zeros((len(place), len(families)), np.float32), np.zeros(len(families), np.float32)
    seen_w, seen_b = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    for _ in range(STEPS):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - onehot) * weight[:, None]
        gw, gb = x.T @ g + 1e-5 * w, g.sum(axis=0)
        seen_w += gw * gw
        seen_b += gb * gb
        w -= RATE * gw / np.sqrt(seen_w)
        b -= RATE * gb / np.sqrt(seen_b)
    x, y = matrix(checked)
    z = (x @ w + b).astype(np.float64)

    def loss(t: float) -> float:
        v = z / t
        top = v.max(axis=1)
        return float(np.mean(top + np.log(np.exp(v - top[:, None]).sum(axis=1)) - v[np.arange(len(v)), y]))

    t = min(np.geomspace(0.2, 5, 60), key=loss)
    return families, {g: [round(float(v), 6) for v in w[k] / t] for g, k in place.items()}, [round(float(v), 6) for v in b / t]


def _looked_up(table: dict[str, list], kind: str):
    """A literal map of bounded size, as a function of its key: in parts by hash, as Spark looks through a map from its begin."""
    parts: list[dict[str, list]] = [{} for _ in range(2 * len(table) + 1)]
    for g, values in table.items():
        parts[zlib.crc32(g.encode()) % len(parts)][g] = values
    literal = F.from_json(F.lit(json.dumps(parts)), f"array<map<string, array<{kind}>>>")
    return lambda g: F.element_at(F.element_at(literal, (F.crc32(g) % len(parts) + 1).cast("int")), g)


def _among(column: str, grams: list[str]) -> Column:
    """Those of an array's grams that are in a set of literals; grams hold no quotes."""
    return F.expr(f"filter({column}, g -> g IN ({', '.join(repr(g) for g in grams)}))")


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text that are not blank, without comment marks and line ends."""
    lines = F.transform(F.split(text, "\r\n|\n|\r"), lambda line: F.regexp_replace(F.regexp_replace(line, F.lit(_MARK), F.lit("")), F.lit(_CLOSE), F.lit("")))
    ends = lambda line: (F.trim(line) == "") | F.substring(line, -_TAIL, _TAIL).rlike(_CLOSED)
    lines = F.transform(lines, lambda line: F.concat(line, F.when(ends(line), F.lit("\n")).otherwise(F.lit(" "))))
    return F.filter(F.transform(F.split(F.array_join(lines, ""), "\n"), lambda p: F.trim(p)), lambda p: p != "")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: bool = False) -> DataFrame:
    """One row per paragraph that speaks of licences: doc_id, paragraph, text, family, score, template_share.

    All paragraphs are classified.  Those given a family have a row, whatever their
    words; those that are `unknown` have one if they hold any of ANCHORS, or always
    with `every`.
    Blank lines part paragraphs, and a line that ends with . ! ? or : closes one;
    other lines are joined, and marks of comments at their begin and end left out.
    paragraph is the number of it in the text, from 0, and text is so joined.
    family is `unknown` if the classifier finds none with probability PROBABILITY,
    or no template of it shares SHARE of the shorter one's bigrams; score is the
    calibrated probability of the named family, or of `unknown`; ties go to the
    first family.  Null and empty texts give no row.  Repeated rows and rows without an id give their own rows.  Other
    columns are not read.  Memory is in proportion to the longest text.
    """
    families, weights, bias = model()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", F.posexplode(paragraphs(F.col("text"))).alias("paragraph", "text"))
    # lower() may fold other letters to those of ANCHORS too, which only lists more
    listed = F.lit(True) if every else F.expr(" or ".join(f"contains(low, '{a}')" for a in ANCHORS))
    rows = rows.select("*", F.explode(F.array(F.lower("text"))).alias("low")).select("doc_id", "paragraph", "text", listed.alias("listed"))
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # what comes out of a generator is computed once, however often it is used
    rows = rows.select("*", F.explode(F.array(F.regexp_extract_all(lowered, F.lit(_WORD), F.lit(0)))).alias("words"))
    two = F.when(F.size("words") > 1, F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    rows = rows.select("doc_id", "paragraph", "text", "listed", "words", F.explode(F.array(F.array_distinct(two))).alias("two"))

    # sets of literals: of a paragraph's grams only those that the model or a template has are left, which are few
    known, holders = sorted(weights), {}
    for k, (_, pairs) in enumerate(templates()):
        for g in pairs:
            holders.setdefault(g, []).append(k)
    ones, pairs = [g for g in known if " " not in g], [g for g in known if " " in g]
    hits = F.concat(F.array_distinct(_among("words", ones)), _among("two", pairs))
    shared = F.flatten(F.transform(_among("two", sorted(holders)), _looked_up(holders, "int")))
    weight = _looked_up(weights, "double")
    logits = F.aggregate(hits, F.from_json(F.lit(json.dumps(bias)), "array<double>"), lambda z, g: F.zip_with(z, weight(g), lambda a, b: a + b))
    rows = rows.select("doc_id", "paragraph", "text", "listed", F.size("two").alias("pairs"), F.explode(F.array(F.struct(logits.alias("logits"), shared.alias("shared")))).alias("m"))
    rows = rows.select("doc_id", "paragraph", "text", "listed", "pairs", "m.shared", "m.logits", F.array_max("m.logits").alias("top"))
    rows = rows.withColumn("best", (F.array_position("logits", F.col("top")) - 1).cast("int")).withColumn("all", F.aggregate("logits", F.lit(0.0), lambda s, v: s + F.exp(v - F.col("top"))))

    # templates of the best family; two bigrams at least, so that one common pair of words is not enough
    of = [[k for k, (f, _) in enumerate(templates()) if f == family] for family in families]
    sizes = F.from_json(F.lit(json.dumps([len(pairs) for _, pairs in templates()])), "array<int>")
    mine = F.element_at(F.from_json(F.lit(json.dumps(of)), "array<array<int>>"), F.col("best") + 1)

    def share(k: Column) -> Column:
        n, common = F.element_at(sizes, k + 1), F.size(F.filter("shared", lambda x: x == k))
        return F.when(common >= F.least(F.lit(2), n), common / F.least(F.greatest(F.col("pairs"), F.lit(1)), n)).otherwise(0.0)

    rows = rows.withColumn("template_share", F.coalesce(F.array_max(F.transform(mine, share)), F.lit(0.0))).withColumn("p", 1.0 / F.col("all"))
    named = (F.col("best") > 0) & (F.col("p") >= PROBABILITY) & (F.col("template_share") >= SHARE)
    names = F.element_at(F.array(*map(F.lit, families)), F.col("best") + 1)
    unknown = F.exp(F.col("logits")[0] - F.col("top")) / F.col("all")
    return rows.where(F.col("listed") | named).select("doc_id", "paragraph", "text", F.when(named, names).otherwise(UNKNOWN).alias("family"), F.when(named, F.col("p")).otherwise(unknown).alias("score"), F.col("template_share"))


def op2_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
