"""Licence scans by a trained paragraph classifier, in DataFrame functions only.

Paragraphs end at blank lines; their wrapped lines are joined and their sentences are scored. A sparse word n-gram
softmax regression over licence families, with a class for everything else, is trained on the driver from the templates
below, variants of them, sentences that only talk about licences, and a bounded sample of the corpus's own sentences that
share an n-gram with a template without agreeing with it (`most_negatives`). A temperature fitted on examples kept out of
training calibrates its probabilities; below `SURE` a sentence is of unknown family. A prediction counts as confirmed when
an alignment with a template of that family covers `AGREE` of the template's word pairs: pairs on one diagonal band, so
in the template's order and close together.

The features are the templates' word pairs (but for pairs of function words alone). A sentence without any of them has
no feature, and the fit makes the class for everything else win there, so a search for these pairs decides beforehand
which texts and sentences need a score, and no notice is lost. The weights and templates are small tables (bounded by the
templates) that are broadcast; Spark cuts, searches, joins, sums and compares. Equal sentences are scored once, so a notice in a
third of all documents is no hot group.

Cases: a null or empty text has no paragraphs and status none; repeated rows get equal rows; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import spread_join, stored, table, text_or_empty

#: The least calibrated probability of a family that is named; below it the family is unknown.
SURE = 0.6
#: The least share of a template's word pairs that an alignment covers where it confirms.
AGREE = 0.8
#: Diagonals of one band of the alignment.
BAND = 8
MOST_NEGATIVES = 2_000
OTHER = "other"

#: Paragraphs of public licences and usual notices, by family (fixed values).
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "Veröffentlicht unter der MIT-Lizenz.",
        "Publicado bajo la licencia MIT.",
        "Publié sous la licence MIT.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS basis, without warranties or conditions of any kind, either express or implied.",
        "Released under the Apache 2.0 license.",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD license.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "Licensed under the GPL version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Released under the GNU GPL v3.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "Released under the LGPL.",
    ],
    "agpl": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "Released under the AGPL.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, Version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc0": [
        "Licensed under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0.",
        "This work has been released into the public domain.",
        "This is free and unencumbered software released into the public domain.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright. All rights reserved.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
        "No part of this publication may be reproduced or transmitted in any form without the prior written permission of the publisher.",
        "Alle Rechte vorbehalten.",
        "Todos los derechos reservados.",
        "Tous droits réservés.",
    ],
}
#: Sentences with the templates' words that are no notices; {} stands for a licence's name (fixed values).
NEGATIVES = [
    "The driver lost his license after the accident.", "She asked for permission to leave early.", "The warranty of the fridge ran out in May.", "He studied at MIT for four years.",
    "The court issued a warrant for his arrest.", "The apache helicopter landed at noon.", "Mozilla and other companies met in Berlin.", "Water rights were reserved for farmers in the valley.",
    "The council may redistribute the funds next year.", "A fishing licence costs ten pounds.", "Die Lizenz kostet zehn Euro im Jahr.", "Copyright law was debated in parliament.", "The public domain of the park is open to all.",
]
TALK = [
    "We compare the {} with other licenses.", "The {} is popular.", "Many projects have chosen the {} in the past.", "An article on the {} and its history appeared.", "Is the {} compatible with the others?",
    "Critics of the {} say that it goes too far.", "He explained the {} to the students.", "Under the {} one may do much.",
]
NAMES = ["MIT License", "Apache License", "Apache 2.0 license", "BSD license", "GNU General Public License", "GPL", "GNU Lesser General Public License", "LGPL", "GNU Affero General Public License", "AGPL", "Mozilla Public License", "ISC License", "Creative Commons Attribution License", "CC BY license", "CC0", "public domain"]
#: Function words: a pair of two of them is no feature (fixed values).
FUNCTION_WORDS = set("a all and any are as at be been by can for from has have he in is it its may not of on or that the their this to under was were which with you".split())

_WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Where a paragraph ends, where a line does, and where a sentence does within a paragraph; Java and the regex module read them alike.
_PARAGRAPH, _LINE, _SENTENCE = r"\n(?:[ \t\r]*\n)+", r"[ \t\r]*\n[ \t\r]*", r"(?<=[.!?])[ \t]+(?=\p{Lu})"


def sentences_of(text: str | None) -> list[str]:
    """The sentences of a text's paragraphs, as sentences() cuts them."""
    joined = [regex.sub(_LINE, " ", p) for p in regex.split(_PARAGRAPH, text or "")]
    return [s for p in joined for s in regex.split(_SENTENCE, p)]


def pairs_of(sentence: str) -> list[str]:
    """Neighbouring words, as _pairs() makes them."""
    w = regex.findall(_WORD, sentence.lower())
    return [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


#: The templates' sentences of two words or more, by family.
PARTS = {family: [s for t in texts for s in sentences_of(t) if pairs_of(s)] for family, texts in TEMPLATES.items()}
FEATURES = sorted({p for parts in PARTS.values() for s in parts for p in pairs_of(s) if not set(p.split()) <= FUNCTION_WORDS})


def _trie(words: list[str]) -> str:
    """A pattern for any of the word pairs, with common beginnings written once; what is no word may stand for the blank."""
    below = defaultdict(list)
    for w in words:
        below[w[:1]].append(w[1:])
    parts = [("[^a-z0-9]+" if c == " " else regex.escape(c)) + _trie(rest) for c, rest in sorted(below.items()) if c]
    made = parts[0] if len(parts) == 1 and "" not in below else "(?:" + "|".join(parts) + ")" if parts else ""
    return f"(?:{made})?" if "" in below and made else made


#: Finds every lower-cased sentence that has a feature (and some others).
GATE = "(?<![a-z0-9])" + _trie(FEATURES)


def _pairs(text: Column) -> Column:
    w = F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))
    pairs = F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(pairs, lambda p: p.isNotNull())


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), place, key, sentence: all sentences that may have a feature."""
    rows = docs.select("doc_id", text_or_empty().alias("text")).filter(F.lower("text").rlike(GATE))
    parts = F.flatten(F.transform(F.split("text", _PARAGRAPH), lambda p: F.split(F.regexp_replace(p, _LINE, " "), _SENTENCE)))
    cut = rows.select("doc_id", F.md5("text").alias("digest"), F.posexplode(parts).alias("place", "sentence"))
    found = cut.filter(F.lower("sentence").rlike(GATE)).select("doc_id", "digest", "place", F.md5("sentence").alias("key"), "sentence")
    return stored(found, "licence-sentences")


def placed_pairs(found: DataFrame) -> DataFrame:
    """key, at, gram: the word pairs that some template has, of each different sentence."""
    each = found.groupBy("key").agg(F.first("sentence").alias("sentence")).select("key", F.posexplode(_pairs(F.col("sentence"))).alias("at", "gram"))
    known = found.sparkSession.createDataFrame([(p,) for p in sorted({p for parts in PARTS.values() for s in parts for p in pairs_of(s)})], "gram string")
    return stored(each.join(F.broadcast(known), "gram", "left_semi"), "licence-pairs")


def bands(diagonal: int) -> tuple[int, int]:
    """The two bands of diagonals that hold one: those of even number begin at multiples of BAND, the odd ones between."""
    return 2 * (diagonal // BAND), 2 * ((diagonal + BAND // 2) // BAND) + 1


def agreement(placed: DataFrame) -> DataFrame:
    """key, family, agreement: the greatest share of a template's word pairs that lie in one band of diagonals."""
    rows = [(family, k, j, gram, len(own)) for family, parts in PARTS.items() for k, s in enumerate(parts) for own in [pairs_of(s)] for j, gram in enumerate(own)]
    t = F.broadcast(placed.sparkSession.createDataFrame(rows, "family string, template int, j int, gram string, size int"))
    d = F.col("at") - F.col("j")
    in_bands = F.explode(F.array(2 * F.floor(d / BAND), 2 * F.floor((d + BAND // 2) / BAND) + 1)).alias("band")
    shared = placed.join(t, "gram").select("key", "family", "template", "size", "j", in_bands).distinct()
    each = shared.groupBy("key", "family", "template", "size", "band").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("key", "family").agg(F.max(F.col("n") / F.col("size")).alias("agreement"))


def _examples(seed: int = 5) -> list[tuple[set[str], str]]:
    """Templates, and variants of each that lack some words, stand within others or are followed by others."""
    draw = np.random.default_rng(seed)
    out = []
    for family, parts in PARTS.items():
        for text in parts:
            w = text.split()
            out += [(set(pairs_of(text)), family)] * 2
            for rate in (0.05, 0.1, 0.15, 0.2):
                kept = [x for x in w if draw.random() >= rate] or w
                out.append((set(pairs_of(" ".join(kept))), family))
            out.append((set(pairs_of(f"{text} Copyright (c) {draw.integers(1990, 2030)} the authors")), family))
    return out


def fit(negatives: list[list[str]], steps: int = 200, rate: float = 0.1, ridge: float = 1e-3) -> tuple[dict[str, list[float]], list[float], list[str], float]:
    """Weights by word pair, biases, class names and temperature: softmax regression by Adam, calibrated on a kept-out fifth.

    negatives: word pairs of sentences that are no notices. The bias of the class for everything else is the greatest.
    """
    talk = [t.format(n) for t in TALK for n in NAMES]
    data = _examples() + [(set(pairs_of(t)), OTHER) for t in NEGATIVES * 3 + talk * 2] + [(set(x), OTHER) for x in negatives] + [(set(), OTHER)] * 20
    names = [*TEMPLATES, OTHER]
    number = {f: i for i, f in enumerate(FEATURES)}
    x, y = np.zeros((len(data), len(FEATURES)), np.float32), np.array([names.index(c) for _, c in data])
    for i, (grams, _) in enumerate(data):
        for g in grams:
            if g in number:
                x[i, number[g]] = 1
    out = np.random.default_rng(3).random(len(data)) < 0.2
    w, b = np.zeros((len(FEATURES), len(names)), np.float32), np.zeros(len(names), np.float32)
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    one = np.eye(len(names), dtype=np.float32)[y]
    weigh = (1 / np.bincount(y[~out], minlength=len(names)).clip(1))[y[~out], None].astype(np.float32)
    weigh[y[~out] == names.index(OTHER)] *= len(TEMPLATES) / 2
    weigh /= weigh.sum()

    def soft(z):
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    for t in range(1, steps + 1):
        g = (soft(x[~out] @ w + b) - one[~out]) * weigh
        for k, (value, slope) in enumerate(((w, x[~out].T @ g + ridge * w / len(names)), (b, g.sum(axis=0)))):
            m, v = state[2 * k], state[2 * k + 1]
            m += 0.1 * (slope - m)
            v += 0.001 * (slope * slope - v)
            value -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        # without any feature a sentence is no notice
        b[-1] = max(b[-1], b[:-1].max() + 1)
    z = x[out] @ w + b
    choice = np.geomspace(0.25, 8, 41)
    temperature = choice[np.argmin([-np.log(soft(z / t)[np.arange(len(z)), y[out]].clip(1e-9)).mean() for t in choice])] if out.any() else 1.0
    return {f: w[i].astype(float).tolist() for f, i in number.items()}, b.astype(float).tolist(), names, float(temperature)


def train(placed: DataFrame, most_negatives: int = MOST_NEGATIVES):
    """The classifier. placed: as of placed_pairs(). Its negatives from the corpus are about `most_negatives` different sentences, picked by a
    hash among those that agree with no template by half."""
    near = agreement(placed).groupBy("key").agg(F.max("agreement").alias("agreement")).filter("agreement < 0.5").select("key")
    near = stored(near, "licence-near")
    n = max(near.count(), 1)
    picked = near.filter(F.pmod(F.xxhash64("key", F.lit("negatives")), F.lit(n)) < most_negatives)
    sample = placed.join(F.broadcast(picked), "key").groupBy("key").agg(F.array_sort(F.collect_set("gram")).alias("grams")).collect()
    return fit([r["grams"] for r in sorted(sample, key=lambda r: r["key"])])


def score_of(sentence: str, model) -> tuple[str, float]:
    """The likeliest class of a sentence and its calibrated probability, as report() finds it."""
    weights, bias, names, temperature = model
    z = np.array(bias)
    for g in set(pairs_of(sentence)):
        if g in weights:
            z = z + np.array(weights[g])
    z = z / temperature
    top = int(z.argmax())
    return names[top], float(1 / np.exp(z - z[top]).sum())


def agreement_of(sentence: str, family: str) -> float:
    """The alignment of a sentence with the templates of a family, as agreement() finds it."""
    own, best = pairs_of(sentence), 0.0
    for s in PARTS[family]:
        template, seen = pairs_of(s), defaultdict(set)
        for j, gram in enumerate(template):
            for at in (i for i, g in enumerate(own) if g == gram):
                for band in bands(at - j):
                    seen[band].add(j)
        best = max([best, *(len(x) / len(template) for x in seen.values())])
    return best


def report(docs: DataFrame, model, found: DataFrame | None = None, placed: DataFrame | None = None) -> DataFrame:
    """doc_id, status (none, unknown, predicted, confirmed), family, confidence, families (all confirmed ones), n_paragraphs (sentences that
    are a notice) for every row of docs. found, placed: sentences() and placed_pairs() of docs, where they are at hand."""
    spark = docs.sparkSession
    weights, bias, names, temperature = model
    found = sentences(docs) if found is None else found
    placed = placed_pairs(found) if placed is None else placed
    w = spark.createDataFrame(list(weights.items()), "gram string, w array<double>")
    sums = placed.select("key", "gram").distinct().join(F.broadcast(w), "gram").groupBy("key").agg(*(F.sum(F.col("w")[c]).alias(f"z{c}") for c in range(len(names))))
    margins = F.array(*((F.col(f"z{c}") + bias[c]) / temperature for c in range(len(names))))
    scored = sums.select("key", margins.alias("z")).withColumn("top", F.array_max("z"))
    chances = scored.select("key", (F.array_position("z", F.col("top")).cast("int") - 1).alias("class"), (1 / F.aggregate("z", F.lit(0.0), lambda acc, v: acc + F.exp(v - F.col("top")))).alias("confidence"))
    predicted = chances.select("key", F.get(F.array(*map(F.lit, names)), F.col("class")).alias("family"), "confidence").filter(F.col("family") != OTHER)
    sure = F.col("confidence") >= SURE
    verdict = predicted.join(agreement(placed), ["key", "family"], "left").select("key", "confidence", F.when(sure, F.col("family")).otherwise("unknown").alias("family"), (sure & (F.coalesce("agreement", F.lit(0.0)) >= AGREE)).alias("confirmed"))
    verdict = stored(verdict, "licence-verdicts")
    placed_at = spread_join(found.select("doc_id", "digest", "place", "key").distinct(), verdict, ["key"])
    best = F.struct("confirmed", (F.col("family") != "unknown").alias("known"), "confidence", "family")
    by_doc = placed_at.groupBy("doc_id", "digest").agg(F.max(best).alias("best"), F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))).alias("families"), F.count(F.lit(1)).alias("n"))
    rows = docs.select("doc_id", F.md5(text_or_empty()).alias("digest")).join(by_doc, ["doc_id", "digest"], "left")
    status = F.when(F.col("best").isNull(), "none").when(F.col("best.confirmed"), "confirmed").when(F.col("best.known"), "predicted").otherwise("unknown")
    return rows.select("doc_id", status.alias("status"), F.col("best.family").alias("family"), F.col("best.confidence").alias("confidence"), F.concat_ws(",", "families").alias("families"), F.coalesce("n", F.lit(0)).cast("long").alias("n_paragraphs"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = sentences(docs)
    placed = placed_pairs(found)
    return report(docs, train(placed), found, placed)
