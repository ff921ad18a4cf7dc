"""Licence scan: a sparse word n-gram logistic regression names each paragraph's licence family; templates confirm it.

A paragraph is a line, joined with those that follow while it is hard-wrapped: not blank, of at most ``WRAP`` characters, and not
ending a sentence. Its features are the distinct word bigrams and trigrams (words: letters and digits, lower-cased), hashed
by Spark. A softmax regression with an L1 penalty is fitted on sentences varied from public licence notices and on ordinary prose.

Calibration looks only at texts that the judging model has not seen: each sentence is judged by a model fitted without it, and
sentences of other licences (``UNSEEN``), which no model is fitted on, count as wrong whatever family they get. The temperature
is the one of least loss on those, and below the cut, the least probability that keeps wrong families below ``WRONG_SHARE``,
a paragraph that is not ordinary is ``unknown``. A predicted family is confirmed if the paragraph contains ``CONTAINED`` of
the n-grams of one of the family's sentences, and ``DISTINCT`` of those that no other family has (so that the notice of a
licence whose name extends another's is not taken for that one); it is ``unknown`` otherwise.

Scanning is one projection without a shuffle: n-grams meet the model's (some hundred, as one literal) by array_intersect, and
only paragraphs with such n-grams are scored.

Defined results: null and empty texts have no paragraphs; repeated paragraphs are reported each by the number of its first line
(from 0); repeated documents are scanned one by one; very long texts are scanned whole; of families with equal probability
the first by name is predicted; ordinary paragraphs give no row; an empty table gives no rows; input columns named like an added
one are replaced, others are kept whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Sentences of public notices by which licences are commonly granted.
TEMPLATES = {
    "AGPL": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "Licensed under the AGPL.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "This project is released under the Apache 2.0 license.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Use of this source code is governed by a BSD-style license.",
        "Released under the BSD License.",
    ],
    "BSD-2-Clause": [
        "Released under the BSD 2-Clause License.",
        "This software is licensed under the simplified BSD license.",
    ],
    "BSD-3-Clause": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Released under the BSD 3-Clause License.",
    ],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "This article is distributed under the terms of the Creative Commons Attribution License, which permits unrestricted use, distribution, and reproduction in any medium, provided the original work is properly cited.",
    ],
    "CC-BY-NC": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ],
    "CC-BY-NC-SA": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
    ],
    "CC-BY-ND": [
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "Licensed under CC BY-ND 4.0.",
    ],
    "CC-BY-SA": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "See the GNU General Public License for more details.",
        "Released under the GPL.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
    ],
    "LGPL": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Licensed under the MIT license.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License 2.0.",
    ],
}
# Sentences of licences that no model is fitted on.
UNSEEN = [
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution.",
    "This is free and unencumbered software released into the public domain.",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "This software is provided 'as-is', without any express or implied warranty.",
    "Distributed under the Boost Software License, Version 1.0.",
    "Licensed under the Open Software License version 3.0.",
    "The contents of this file are subject to the terms of the Common Development and Distribution License (the License).",
    "Released under the Artistic License 2.0.",
    "This software is proprietary and may not be copied, modified or distributed without the written permission of the company.",
    "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3.",
]
ORDINARY = [
    "The new version of this file was released under pressure from the public and the work is free to read.",
    "You may use the software in the office, and any person with a copy of the key can open the door.",
    "The terms of the agreement were published by the committee in the hope that it will be useful.",
    "A driving license is required by law in the state, and permission was granted without delay.",
    "All rights reserved. No part of this publication may be reproduced.",
    "The author of the work is the head of the department of general medicine at the public university.",
    "Conditions in the source region are met with or without the help of the foundation.",
    "Copyright law is a part of the law that the students of the school learn in the third year.",
    "The names of its contributors and the holder of the record were read out at the end of the evening.",
    "According to the report the license of the restaurant was not renewed for the following year.",
]
NONE, UNKNOWN = "none", "unknown"
#: Shares of a sentence's n-grams, and of those that only its family has, that confirm a family.
CONTAINED, DISTINCT = 0.6, 0.7
#: Wrong families among the unseen paragraphs that get one, at most.
WRONG_SHARE = 0.02
#: Paragraphs varied from each sentence, n-grams that a model has at most, parts in which sentences are held out.
VARIANTS, MOST_GRAMS, FOLDS = 10, 2500, 3
#: Characters of the longest line that counts as hard-wrapped, and the ends of sentences.
WRAP = 120
ENDS = [".", "!", "?", ":", ";"]


def with_paragraphs(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """keep, paragraph (its first line's number) and notice, for each paragraph that isn't blank."""
    bare = lambda x: F.btrim(x, F.lit(common.SPACE_CHARS))
    goes_on = lambda x: (F.length(x) > 0) & (F.length(x) <= WRAP) & ~F.right(x, F.lit(1)).isin(ENDS)
    lines = docs.select(*keep, F.inline_outer(F.array(F.struct(F.transform(F.split(F.col(text), "\n"), bare).alias("_lines")))))
    begins = lambda i: (F.get("_lines", i) != "") & ~F.coalesce(goes_on(F.get("_lines", i - 1)), F.lit(False))
    first = F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), begins)
    starts = lines.where("_lines is not null").select(*keep, "_lines", F.inline_outer(F.array(F.struct(first.alias("_first")))))
    # A paragraph ends before the next one's first line; blank lines between them join to nothing.
    until = lambda k: F.coalesce(F.get("_first", k + 1), F.size("_lines"))
    whole = F.transform("_first", lambda i, k: F.struct(i.alias("paragraph"), F.rtrim(F.array_join(F.slice("_lines", i + 1, until(k) - i), " ")).alias("notice")))
    return starts.select(*keep, F.inline(whole))


def word_hashes(paragraph: Column) -> Column:
    words = F.filter(F.split(F.lower(paragraph), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _shifted(h: str, k: int) -> Column:
    return F.slice(h, F.lit(k + 1), F.greatest(F.size(h), F.lit(1)))


def _bigrams(h: str) -> Column:
    """A hash for each two words; zip_with() adds one for the last word alone, which is cut."""
    two = F.zip_with(F.col(h), _shifted(h, 1), lambda a, b: F.xxhash64(a, b))
    return F.slice(two, F.lit(1), F.greatest(F.size(h) - 1, F.lit(0)))


def _trigrams(h: str, two: str) -> Column:
    three = F.zip_with(F.col(two), _shifted(h, 2), lambda a, b: F.xxhash64(a, b))
    return F.slice(three, F.lit(1), F.greatest(F.size(h) - 2, F.lit(0)))


def with_grams(df: DataFrame, paragraph: str) -> DataFrame:
    """df with _g, the hashes of the distinct word bigrams and trigrams, _two and _three, those of each place."""
    two = df.withColumn("_h", word_hashes(F.col(paragraph))).withColumn("_two", _bigrams("_h"))
    return two.withColumn("_three", _trigrams("_h", "_two")).withColumn("_g", F.array_distinct(F.concat("_two", "_three"))).drop("_h")


def labelled_paragraphs(seed: int = 5) -> list[tuple[str, str, int]]:
    """Paragraphs with their family and the sentence that they come from: sentences and prose with words dropped, cut, mixed in
    and put before or after. Paragraphs of UNSEEN have UNKNOWN for a family."""
    rng = np.random.default_rng(seed)
    filler = "the of and to in is that for on with as was this by it from are or an be at which you have has not".split()
    prose = lambda n: list(rng.choice(filler, n))
    out, number = [], 0
    for family, texts in [*TEMPLATES.items(), (UNKNOWN, UNSEEN), (NONE, ORDINARY)]:
        for text in texts:
            words = text.split()
            out.append((text, family, number))
            for _ in range(VARIANTS):
                kept = [w for w in words if rng.random() > 0.04]
                if len(kept) > 14 and rng.random() < 0.5:
                    at = int(rng.integers(0, len(kept) // 3))
                    kept = kept[at : at + max(10, 2 * len(kept) // 3)]
                out.append((" ".join([*prose(rng.integers(0, 4)), *kept, *prose(rng.integers(0, 4))]), family, number))
            number += 1
    return out + [(" ".join(prose(int(rng.integers(3, 40)))), NONE, number + i) for i in range(300)]


@dataclass
class LicenceModel:
    """Weights of each n-gram and family, temperature, cut, of each sentence all n-grams and those of its family alone, and the
    gate: bigrams of which every paragraph with a known n-gram has one (the bigrams, and those that trigrams begin with)."""

    families: list[str]
    grams: list[int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    cut: float
    templates: list[tuple[str, list[int], list[int]]]
    gate: list[int]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _softmax((x @ self.weights + self.bias) / self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _descend(x: np.ndarray, y: np.ndarray, k: int, penalty: float, steps: int = 120) -> tuple[np.ndarray, np.ndarray]:
    """Proximal gradient steps with momentum for the L1-penalised softmax loss; the bias carries no penalty."""
    n, d = x.shape
    w, b, onehot = np.zeros((d, k), np.float32), np.zeros(k, np.float32), np.eye(k, dtype=np.float32)[y]
    rate = np.float32(4.0 / max(1.0, np.square(x).sum(axis=1).mean()))
    ahead, before = w, w
    for t in range(steps):
        p = _softmax(x @ ahead + b)
        g = (p - onehot) / n
        step = ahead - rate * (x.T @ g)
        w = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0)
        b = b - rate * g.sum(axis=0)
        ahead, before = w + t / (t + 3) * (w - before), w
    return w, b


def fit(spark: SparkSession, labelled: list[tuple[str, str, int]] | None = None, penalty: float = 2e-4) -> LicenceModel:
    """A model from labelled paragraphs (text, family, sentence), a bounded list on the driver; Spark itself makes the features."""
    rows = labelled if labelled is not None else labelled_paragraphs()
    frame = with_grams(spark.createDataFrame([(i, t, f, k) for i, (t, f, k) in enumerate(rows)], "i int, t string, f string, k int"), "t").orderBy("i").toPandas()
    flat = [(i, f, t) for i, (f, t) in enumerate((f, t) for f, texts in sorted(TEMPLATES.items()) for t in texts)]
    made = [(r["f"], [int(g) for g in r["_g"]]) for r in with_grams(spark.createDataFrame(flat, "i int, f string, t string"), "t").orderBy("i").collect()]
    templates = [(f, gs, [g for g in gs if not any(g in other for name, other in made if name != f)]) for f, gs in made]
    families = [NONE, *sorted({f for _, f, _ in rows} - {NONE, UNKNOWN})]
    vocabulary = sorted({int(g) for gs in frame["_g"] for g in gs})
    place = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(frame), len(vocabulary)), np.float32)
    for i, gs in enumerate(frame["_g"]):
        x[i, [place[int(g)] for g in gs]] = 1
    known = (frame["f"] != UNKNOWN).to_numpy()
    y = np.array([families.index(f) if f in families else -1 for f in frame["f"]])

    def fitted(use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        seen = np.flatnonzero(x[use].sum(axis=0) >= 3)
        w, b = _descend(x[use][:, seen], y[use], len(families), penalty)
        strong = np.flatnonzero(np.abs(w).sum(axis=1) > 1e-6)
        strong = np.sort(strong[np.argsort(-np.abs(w[strong]).sum(axis=1), kind="stable")][:MOST_GRAMS])
        return seen[strong], w[strong], b

    # Every paragraph is judged by a model that has seen no paragraph of its sentence; UNSEEN ones by the first of them.
    fold = frame["k"].to_numpy() % FOLDS
    z = np.zeros((len(frame), len(families)))
    for k in range(FOLDS):
        own = (known & (fold == k)) | (~known & (k == 0))
        at, w, b = fitted(known & (fold != k))
        z[own] = x[own][:, at] @ w + b
    loss = lambda t: -np.log(np.maximum(_softmax(z[known] / t)[np.arange(known.sum()), y[known]], 1e-12)).mean()
    temperature = min(np.geomspace(0.1, 10, 80), key=loss)
    p = _softmax(z / temperature)
    best = p[:, 1:].argmax(axis=1) + 1
    top, wrong = p[np.arange(len(p)), best], best != y
    named = p[:, 0] < top
    cut = next((float(c) for c in np.linspace(0.1, 0.99, 90) if wrong[named & (top >= c)].mean() <= WRONG_SHARE), 0.99)
    at, w, b = fitted(known)
    grams = [vocabulary[i] for i in at]
    begins = {int(g): int(g) for two in frame["_two"] for g in two} | {int(g): int(p) for two, three in zip(frame["_two"], frame["_three"], strict=True) for p, g in zip(two, three, strict=False)}
    return LicenceModel(families, grams, w, b, float(temperature), cut, templates, sorted({begins[g] for g in grams}))


def _longs(values: list[int]) -> Column:
    """A literal array: one string that the optimizer folds."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _doubles(values: np.ndarray) -> Column:
    return F.split(F.lit(",".join(map(repr, map(float, values)))), ",").cast("array<double>")


def _held(df: DataFrame, keep: list[str], made: list[str]) -> DataFrame:
    """keep and made of df, through a generator: filters above it are not pushed down, where they would repeat the work."""
    return df.select(*keep, F.inline_outer(F.array(F.struct(*made))))


def scan(docs: DataFrame, model: LicenceModel, text: str = "text") -> DataFrame:
    """docs without text, a row for each paragraph that isn't ordinary: paragraph, family, predicted, probability, contained, notice."""
    made = ["paragraph", "family", "predicted", "probability", "contained", "notice"]
    inner, back = common.inner_names(docs.drop(*made), text)
    back = [c for c, name in zip(back, inner.columns, strict=True) if name != text]
    keep = [c for c in inner.columns if c != text]
    lines = with_paragraphs(inner, keep, text)
    # Bigrams first: most paragraphs have none of the gate, and go before trigrams and sets are made.
    two = _held(lines.withColumn("_h", word_hashes(F.col("notice"))).withColumn("_two", _bigrams("_h")), [*keep, "paragraph", "notice"], ["_h", "_two"])
    some = two.where(F.exists("_two", lambda g: g.isin(model.gate))) if model.gate else two.where("false")
    whole = some.withColumn("_g", F.array_distinct(F.concat(F.col("_two"), _trigrams("_h", "_two")))).drop("_h", "_two")
    hits = F.array_intersect(_longs(model.grams), F.col("_g"))
    known = _held(whole.withColumn("_hits", hits), keep, ["paragraph", "notice", "_g", "_hits"]).where(F.size("_hits") > 0)
    placed = known.withColumn("_at", F.transform("_hits", lambda g: (F.array_position(_longs(model.grams), g) - 1).cast("int")))

    def margin(k: int) -> Column:
        weights = _doubles(model.weights[:, k] / model.temperature)
        return F.aggregate("_at", F.lit(float(model.bias[k]) / model.temperature), lambda a, i: a + F.get(weights, i))

    sums = [margin(k) for k in range(len(model.families))]
    scored = _held(placed.withColumn("_z", F.array(*sums)), [*keep], ["paragraph", "notice", "_g", "_z"])
    scored = scored.withColumn("_e", F.transform("_z", lambda z: F.exp(z - F.array_max("_z"))))
    total = F.aggregate("_e", F.lit(0.0), lambda a, e: a + e)
    shares = scored.select(*keep, "paragraph", "notice", "_g", F.transform("_e", lambda e: e / total).alias("_p"))
    others = F.slice("_p", 2, len(model.families) - 1)
    best = F.array_max(others)
    names = F.split(F.lit("\t".join(model.families[1:])), "\t")
    judged = shares.select(
        *keep, "paragraph", "notice", "_g", best.alias("probability"), F.get(names, (F.array_position(others, best) - 1).cast("int")).alias("predicted"), (F.get("_p", F.lit(0)) < best).alias("_not_ordinary"),
    )
    judged = _held(judged, keep, ["paragraph", "notice", "_g", "probability", "predicted", "_not_ordinary"]).where("_not_ordinary")
    contained = F.lit(0.0)
    for family in model.families[1:]:
        share = lambda g: F.size(F.array_intersect(_longs(g), F.col("_g"))) / float(len(g))
        own = [F.when(share(d) >= DISTINCT, share(g)).otherwise(0.0) for f, g, d in model.templates if f == family and d]
        contained = F.when(F.col("predicted") == family, F.greatest(*own, F.lit(0.0)) if own else F.lit(0.0)).otherwise(contained)
    found = judged.withColumn("contained", contained)
    family = F.when((F.col("probability") >= model.cut) & (F.col("contained") >= CONTAINED), F.col("predicted")).otherwise(UNKNOWN)
    return found.withColumn("family", family).select(*back, *made)


def query(spark, sf_dir: str) -> DataFrame:
    found = scan(common.table(spark, sf_dir, "documents").select("doc_id", "text"), fit(spark))
    return found.select("doc_id", "paragraph", "family", "predicted", F.round("probability", 9).alias("probability"), F.round("contained", 9).alias("contained"))
