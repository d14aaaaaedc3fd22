"""Licence scans with DataFrame functions only: a trained paragraph classifier, confirmed by templates.

A paragraph is a run of lines: a blank line ends it, and so does a line that ends
a sentence, so that a notice wrapped over lines is seen whole and one that
follows prose stands alone.  Its features are the vocabulary words it holds, and
the pairs of such words that follow one another (words outside the vocabulary
between them are passed over).  A multinomial logistic regression with a class
for "no known licence" weighs them; it is trained when the query is built, on
the fixed notices below and variations of them by rule.  Its temperature is
calibrated on other wordings, which it does not learn from.  A prediction stands
only where the paragraph's words also cover a template of the predicted family.
"""

from __future__ import annotations

import functools
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: Notices by family (fixed values: the usual wording of public licences).
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "lgpl-3.0": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ],
    "bsd-3-clause": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at mozilla.org/MPL/2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under the Creative Commons Attribution 4.0 International License."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0-1.0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work.", "SPDX-License-Identifier: CC0-1.0"],
}
#: Other wordings by family, for calibration alone (fixed values).
HELD_OUT = {
    "apache-2.0": ["This project is distributed under the terms of the Apache License 2.0.", "Use of this file is subject to the Apache License, version 2.0."],
    "mit": ["This software is made available under the terms of the MIT License.", "Any person obtaining a copy of the software is granted permission, free of charge, to deal in it without restriction."],
    "gpl-3.0": ["You can redistribute this program under the GNU General Public License version 3 as published by the Free Software Foundation."],
    "gpl-2.0": ["Distributed under version 2 of the GNU General Public License."],
    "lgpl-3.0": ["You may link with this library under the GNU Lesser General Public License version 3."],
    "bsd-3-clause": ["This code may be used under the BSD 3-Clause License.", "Redistribution in source and binary forms is permitted provided that these conditions are met."],
    "mpl-2.0": ["This file is available under the Mozilla Public License 2.0."],
    "cc-by-4.0": ["Text is available under the Creative Commons Attribution 4.0 License."],
    "cc-by-nc-4.0": ["Available under Creative Commons Attribution-NonCommercial 4.0."],
    "cc-by-sa-4.0": ["You may share it under the Creative Commons Attribution-ShareAlike 4.0 License."],
    "cc0-1.0": ["The author has waived all rights to this work under CC0 1.0."],
    UNKNOWN: [
        "Licensed under the terms of the vendor, version 2.0 of the agreement.", "The software includes files of other persons under a separate license.", "Copies of the general report are public and free of charge.",
        "The university MIT released its own version of the program.", "The extent of the rights under the law is related to the source.", "He has waived the charge for the library work.",
        "Commons and parliament work under the public law.", "The foundation published its terms and conditions.", "Modify the source file, then distribute the binary.",
        "The license of the station is subject to conditions.", "International attribution of the work is a creative act.", "Version 3 of the form is available in general.",
    ],
}
#: Sentences of no known licence (fixed values): near in words, but no notice of a family above.
OTHERS = [
    "All rights reserved.", "Copyright 2020 the authors.", "The version of the file is free to use.", "A person may copy the source to the file.", "This work is licensed under the terms of the publisher.",
    "The public library of the foundation is open in general.", "Conditions of use apply to any copy.", "The software was released in version 3 last year.", "He obtained a driving license under the new law.",
    "The common source of the law is the public.", "Permission to print is required.", "International commerce and the creative person.", "Terms of the program are published later.", "Use of this file without permission is not permitted.",
]
#: Notices of licences that are near a family above and are none of it (fixed values): the unknown class learns them, and their words.
NEIGHBOURS = [
    "Licensed under the GNU Affero General Public License, version 3.", "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License.", "SPDX-License-Identifier: AGPL-3.0",
    "Licensed under the GNU Lesser General Public License, version 2.1.", "Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License.",
    "Licensed under the Eclipse Public License, version 2.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "Licensed under CC BY-ND 4.0.", "This work is licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License.", "Licensed under CC BY 3.0.", "This work is licensed under the Creative Commons Attribution 3.0 Unported License.",
    "This is free and unencumbered software released into the public domain.", "Licensed under the Artistic License 2.0.",
]
#: Words that carry nothing (fixed values).
STOP = {"the", "of", "to", "and", "or", "a", "an", "in", "is", "by", "for", "with", "this", "any", "are", "that", "it", "you", "as", "may", "not", "at", "be", "on", "all", "has", "can"}
LEAST_PROBABILITY, LEAST_COVER = 0.5, 0.6
#: Share of a template's pairs of neighbouring words that a paragraph holds at least, to count as covering it: words strewn over long prose do not.
LEAST_PAIRS = 0.3
#: Temperatures tried: the best one must lie inside.
GRID = [0.02 * 1.12**k for k in range(60)]
_WORD = re.compile(r"[a-z0-9]+")
#: Where a paragraph ends; ``MARK`` stands there afterwards, and ends one in a text too.
_END, MARK = r"([.!?])[ \t\r]*\n|\n[ \t\r]*\n", "\x01"


def words(text: str) -> list[str]:
    """Runs of a-z and 0-9 after A-Z are lower-cased."""
    return _WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def paragraphs(text: str) -> list[str]:
    """The paragraphs of a text: the plain form of the query's split."""
    return re.sub(_END, lambda m: (m[1] or "") + MARK, text).split(MARK)


def _pairs(w: list[str]) -> list[str]:
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def _variations(text: str, k: int) -> list[list[str]]:
    """The notice as it stands, cut at either end, and amid other words."""
    w = words(text)
    cut = max(1, len(w) // 6)
    pad = words(OTHERS[k % len(OTHERS)])[:4]
    return [w, w, w[cut:] if len(w) > 6 else w, w[:-cut] if len(w) > 6 else w, pad + w, w + pad]


class Model:
    """Weights of every feature by class, class biases, temperature; a few hundred features by a dozen classes."""

    def __init__(self):
        self.classes = [*TEMPLATES, UNKNOWN]
        vocabulary = sorted({x for ts in (*TEMPLATES.values(), NEIGHBOURS) for t in ts for x in words(t)} - STOP)
        self.vocabulary, self.known = vocabulary, set(vocabulary)
        rows = [(w, c) for c, ts in enumerate(TEMPLATES.values()) for k, t in enumerate(ts) for w in _variations(t, k + c)]
        rows += [(words(t), len(TEMPLATES)) for t in OTHERS] * 3 + [([x], len(TEMPLATES)) for x in vocabulary] * 2  # a word alone tells no family
        rows += [(words(t), len(TEMPLATES)) for t in NEIGHBOURS]
        rows += [([], len(TEMPLATES))] * 4
        self.features = sorted({g for w, _ in rows for g in self._grams(w)})
        self.at = {g: i for i, g in enumerate(self.features)}
        x, y, n = self._matrix([w for w, _ in rows]), np.array([c for _, c in rows]), len(self.classes)
        w, goal = np.zeros((len(self.at) + 1, n)), np.eye(n)[y]
        for _ in range(600):
            w += 0.5 * (x.T @ (goal - _softmax(x @ w)) / len(x) * n - 0.002 * w)
        self.weights, self.bias = w[:-1].round(6), w[-1].round(6)
        held = [(words(t), self.classes.index(c)) for c, ts in HELD_OUT.items() for t in ts]
        hx, hy = self._matrix([w for w, _ in held]) @ w, np.array([c for _, c in held])
        loss = [-np.log(np.maximum(_softmax(hx / t)[np.arange(len(hy)), hy], 1e-12)).mean() for t in GRID]
        k = int(np.argmin(loss))
        if k in (0, len(GRID) - 1):
            raise ValueError("the held-out wordings do not fix the temperature")
        self.temperature = GRID[k]
        if int(self.bias.argmax()) != len(TEMPLATES):
            raise ValueError("a paragraph without a vocabulary word must be unknown")

    def _grams(self, w: list[str]) -> set[str]:
        return set(_pairs([x for x in w if x in self.known]))

    def _matrix(self, rows: list[list[str]]) -> np.ndarray:
        m = np.zeros((len(rows), len(self.at) + 1))
        m[:, -1] = 1
        for i, w in enumerate(rows):
            m[i, [self.at[g] for g in self._grams(w) if g in self.at]] = 1
        return m

    def predict(self, paragraph: str) -> tuple[str, float]:
        """(family, probability) of one paragraph: the plain form of the query."""
        z = self.bias + sum((self.weights[self.at[g]] for g in sorted(self._grams(words(paragraph))) if g in self.at), np.zeros(len(self.classes)))
        p = _softmax(z[None, :] / self.temperature)[0]
        return self.classes[int(p.argmax())], float(p.max())


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@functools.cache
def model() -> Model:
    return Model()


def _template(t: str) -> tuple[list[str], list[str]]:
    """A template's distinct words, and its distinct pairs of neighbouring words."""
    w = words(t)
    return sorted(set(w)), sorted(set(_pairs(w)[len(w) :]))


def cover(paragraph: str, family: str) -> float:
    """Share of a template's distinct words that the paragraph holds: the best template of the family among those with enough pairs."""
    have = set(_pairs(words(paragraph)))
    share = lambda xs: len(have.intersection(xs)) / len(xs)
    return max(share(w) if share(q) >= LEAST_PAIRS else 0.0 for w, q in map(_template, TEMPLATES[family]))


def _strings(xs: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in xs])


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, paragraph_no, family, probability, template_cover: a row per paragraph that is a known licence.

    paragraph_no counts a text's paragraphs from 0, blank ones included.  Every
    paragraph is judged; one without a vocabulary word has the weights' bias
    alone, whose class is the unknown one (the model makes sure of it), so it
    needs no sum.  Paragraphs of the unknown class, of a probability below
    LEAST_PROBABILITY, or that cover no template of the family by LEAST_COVER
    of its words and LEAST_PAIRS of its pairs give no row.  A null text has no paragraph; null keys and repeated rows are
    carried as they are; ties go to the family listed first; an empty table
    gives no rows; other columns are not read.  Weights are literals of fixed
    size; nothing is shuffled.
    """
    m = model()
    known = _strings(m.vocabulary)
    parts = F.split(F.regexp_replace(F.col(text), _END, f"$1{MARK}"), MARK, -1)
    p = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("doc_id"), F.posexplode(parts).alias("paragraph_no", "p"))
    low = F.translate("p", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    p = p.select("doc_id", "paragraph_no", F.split(low, "[^a-z0-9]+", -1).alias("w")).where(F.size(F.array_intersect("w", known)) >= 1)
    p = p.select("doc_id", "paragraph_no", "w", F.explode(F.array(F.filter("w", lambda x: F.array_contains(known, x)))).alias("k"))
    grams = F.array_distinct(F.concat("k", F.zip_with(F.slice("k", 1, F.size("k") - 1), F.slice("k", 2, F.size("k")), lambda a, b: F.concat(a, F.lit(" "), b))))
    # Weights as one literal map from feature to an array of class weights.
    table = F.map_from_arrays(_strings(m.features), F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in m.weights]))
    bias, zero = F.array(*[F.lit(float(x)) for x in m.bias]), F.array(*[F.lit(0.0)] * len(m.classes))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    z = F.aggregate(grams, bias, lambda a, g: add(a, F.coalesce(F.element_at(table, g), zero)))
    p = p.select("doc_id", "paragraph_no", "w", F.explode(F.array(z)).alias("z"))
    top = F.array_max("z")
    total = F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp((x - top) / F.lit(float(m.temperature))))
    at = F.array_position("z", top).cast("int")
    p = p.select("doc_id", "paragraph_no", "w", F.element_at(_strings(m.classes), at).alias("family"), F.round(1 / total, 6).alias("probability"))
    p = p.where((F.col("family") != UNKNOWN) & (F.col("probability") >= LEAST_PROBABILITY))
    p = p.withColumn("q", F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w")), lambda a, b: F.concat(a, F.lit(" "), b)))
    share = lambda have, xs: F.size(F.array_intersect(have, _strings(xs))) / F.lit(float(len(xs)))
    best = F.lit(0.0)
    for family, ts in TEMPLATES.items():
        each = [F.when(share("q", q) >= F.lit(LEAST_PAIRS), share("w", w)).otherwise(F.lit(0.0)) for w, q in map(_template, ts)]
        best = F.when(F.col("family") == family, F.greatest(*each, F.lit(0.0))).otherwise(best)
    p = p.withColumn("template_cover", F.round(best, 6)).where(F.col("template_cover") >= LEAST_COVER)
    return p.select("doc_id", F.col("paragraph_no").cast("long").alias("paragraph_no"), "family", "probability", "template_cover")


def oracle_sql() -> str:
    """``scan`` over ``documents`` as DuckDB SQL, the trained weights written out."""
    m = model()
    strings = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    numbers = lambda xs: "[" + ", ".join(f"{float(x)!r}::DOUBLE" for x in xs) + "]"
    weights = ", ".join(f"('{g}', {numbers(w)})" for g, w in zip(m.features, m.weights))
    sums = ", ".join(f"coalesce(sum(f.v[{k + 1}]), 0.0::DOUBLE) + {float(b)!r}::DOUBLE" for k, b in enumerate(m.bias))
    share = lambda have, xs: f"len(list_intersect({have}, {strings(xs)})) / {float(len(xs))}::DOUBLE"
    each = lambda w, q: f"CASE WHEN {share('q', q)} >= {LEAST_PAIRS}::DOUBLE THEN {share('w', w)} ELSE 0.0::DOUBLE END"
    covers = " ".join(f"WHEN '{family}' THEN greatest(" + ", ".join(each(*_template(t)) for t in ts) + ", 0.0::DOUBLE)" for family, ts in TEMPLATES.items())
    return f"""
WITH d AS (SELECT doc_id, string_split(regexp_replace(text, '{_END}', '\\1' || chr(1), 'g'), chr(1)) AS ps, rowid AS r FROM (SELECT *, row_number() OVER () AS rowid FROM documents WHERE text IS NOT NULL)),
l AS (SELECT r, doc_id, generate_subscripts(ps, 1) - 1 AS paragraph_no, unnest(ps) AS p FROM d),
w AS (SELECT r, doc_id, paragraph_no, string_split_regex(translate(p, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+') AS w FROM l),
c AS (SELECT r, doc_id, paragraph_no, w, list_filter(w, lambda x: list_contains({strings(m.vocabulary)}, x)) AS k FROM w WHERE len(list_intersect(w, {strings(m.vocabulary)})) >= 1),
g AS (SELECT r, doc_id, paragraph_no, w, unnest(list_distinct(list_concat(k, list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1])))) AS g FROM c),
f(g, v) AS (VALUES {weights}),
z AS (SELECT g.r, any_value(g.doc_id) AS doc_id, g.paragraph_no, any_value(g.w) AS w, [{sums}] AS z FROM g LEFT JOIN f ON f.g = g.g GROUP BY g.r, g.paragraph_no),
p AS (
  SELECT doc_id, paragraph_no, w, {strings(m.classes)}[list_position(z, list_max(z))] AS family,
    round(1 / list_sum(list_transform(z, lambda x: exp((x - list_max(z)) / {float(m.temperature)!r}::DOUBLE))), 6) AS probability FROM z),
q AS (SELECT *, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS q FROM p),
t AS (SELECT *, round(CASE family {covers} END, 6) AS template_cover FROM q WHERE family <> '{UNKNOWN}' AND probability >= {LEAST_PROBABILITY}::DOUBLE)
SELECT doc_id, paragraph_no, family, probability, template_cover FROM t WHERE template_cover >= {LEAST_COVER}::DOUBLE
"""
