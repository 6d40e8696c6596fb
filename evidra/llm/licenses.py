"""Licence scans: a trained classifier of paragraphs, with a template comparison that confirms its predictions.

A sparse multinomial logistic regression over word 1- to 3-grams learns licence families from notices made out of
the templates below, and `unknown` from notices of other licences, denials, and a bounded sample of the corpus's
own paragraphs. A temperature and the least score that a family needs are fitted on wordings and paragraphs kept
apart. Scoring is a chain of DataFrame
operations: paragraphs, words, n-grams, a join with the small table of weights, a softmax. A predicted paragraph
counts as confirmed if it shares enough word bigrams with a template of its family.
"""

from __future__ import annotations

import json
import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored
from .langid import ftrl, temperature
from .shingles import numbered

#: Names by which notices call each licence, and sentences of its text.
FAMILIES: dict[str, dict[str, list[str]]] = {
    "MIT": {
        "names": ["the MIT License", "the MIT licence", "MIT License (MIT)"],
        "texts": [
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
            "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        ],
    },
    "Apache-2.0": {
        "names": ["the Apache License, Version 2.0", "the Apache License 2.0", "Apache-2.0", "the Apache Software License, version 2.0"],
        "texts": [
            "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
            "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        ],
    },
    "GPL-3.0": {
        "names": ["the GNU General Public License, version 3", "the GNU General Public License v3.0", "GPL-3.0", "the GNU GPL version 3"],
        "texts": [
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
            "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        ],
    },
    "GPL-2.0": {
        "names": ["the GNU General Public License, version 2", "the GNU General Public License v2.0", "GPL-2.0", "the GNU GPL version 2"],
        "texts": [
            "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
            "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
            "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
        ],
    },
    "LGPL": {
        "names": ["the GNU Lesser General Public License, version 2.1", "the GNU Lesser General Public License, version 3", "LGPL-3.0", "the GNU LGPL"],
        "texts": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    },
    "BSD": {
        "names": ["the BSD 3-Clause License", "the BSD 2-Clause License", "the BSD license", "a BSD-style license"],
        "texts": [
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
            "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        ],
    },
    "MPL-2.0": {
        "names": ["the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "MPL-2.0"],
        "texts": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    },
    "CC-BY": {
        "names": ["CC BY 4.0", "the Creative Commons Attribution 4.0 International License", "a Creative Commons Attribution License", "CC-BY-4.0"],
        "texts": ["This work is licensed under a Creative Commons Attribution 4.0 International License. You are free to share and adapt the material for any purpose, even commercially, as long as you give appropriate credit."],
    },
    "CC-BY-SA": {
        "names": ["CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License", "a Creative Commons Attribution-ShareAlike License", "CC-BY-SA-4.0"],
        "texts": ["Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply."],
    },
    "CC-BY-NC": {
        "names": ["CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License", "a Creative Commons Attribution-NonCommercial License", "CC-BY-NC-4.0"],
        "texts": ["You may not use the material for commercial purposes. This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    },
    "CC0": {
        "names": ["CC0 1.0", "the CC0 1.0 Universal Public Domain Dedication", "CC0-1.0"],
        "texts": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. This work is dedicated to the public domain under CC0 1.0 Universal."],
    },
    "ISC": {
        "names": ["the ISC License", "the ISC licence"],
        "texts": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    },
    "Unlicense": {
        "names": ["the Unlicense", "The Unlicense (public domain)"],
        "texts": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, for any purpose, commercial or non-commercial, and by any means."],
    },
}
#: How notices speak of a licence.
NOTICES = ["{}.", "Licensed under {}.", "Released under {}.", "Distributed under {}.", "This work is licensed under {}.", "This software is released under the terms of {}.", "This project is made available under {}.", "Available under {}, see the LICENSE file for details.", "The content of this page is published under {}.", "Copyright the authors. Use is governed by {}."]
#: Names of licences that are no family here; notices of them are `unknown`.
STRANGERS = ["the Eclipse Public License 2.0", "the Eclipse Public License, version 1.0", "the GNU Affero General Public License, version 3", "the GNU Affero General Public License v3.0", "AGPL-3.0", "the European Union Public Licence 1.2", "the zlib License", "the Boost Software License 1.0", "the Artistic License 2.0", "the PostgreSQL License", "the Common Development and Distribution License, version 1.0", "the Microsoft Public License", "the SIL Open Font License, Version 1.1", "a proprietary license"]
#: How a licence is spoken of without being granted; these are `unknown`.
DENIALS = ["This is not licensed under {}.", "Not released under {}.", "This work is not available under {}.", "We never used {} for this project."]
#: Sentences about licences that name none: they are `unknown`.
OTHERS = ["A driving license was issued in the version of the form.", "All rights reserved.", "The license fee is paid under the terms of the contract.", "Public records are released under the rule.", "The general public may use this work.", "This program was distributed to the public.", "Version 3 of the program was released.", "Permission was granted to use the software.", "See the license agreement.", "The work is licensed.", "Released under pressure.", "He works at the MIT laboratory.", "The Apache helicopter, version 2.", "Creative work in the commons."]
UNKNOWN = "unknown"
WORD = r"[a-z0-9]+"
#: Paragraphs of the corpus that training takes as `unknown`.
SAMPLE_PARAGRAPHS = 3000
#: N-grams of more than this share of the sampled paragraphs are no features, nor are those of such words only.
COMMON = 0.005
#: Share of the bigrams of the smaller of paragraph and template that the other must have to confirm a prediction,
#: share of a name's bigrams that a paragraph must have, and fewest that it must share with a text.
CONFIRM, NAMED, SHARED = 0.5, 0.8, 6


def words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def grams(ws: list[str], orders: tuple[int, ...] = (1, 2, 3)) -> set[str]:
    return {" ".join(ws[i : i + n]) for n in orders for i in range(len(ws) - n + 1)}


def notices() -> list[tuple[str, str, bool]]:
    """(family, paragraph, kept for calibration) of all notices. Two of the ten ways to speak of a licence, and a
    quarter of the denials, are never learnt from; texts are all learnt from, three times."""
    out = []
    named = [(f, n) for f, parts in FAMILIES.items() for n in parts["names"]]
    for family, name in [*named, *((UNKNOWN, n) for n in STRANGERS)]:
        out += [(family, notice.format(name), k % 5 == 4) for k, notice in enumerate(NOTICES)]
    out += [(UNKNOWN, denial.format(name), k % 4 == 3) for _, name in named for k, denial in enumerate(DENIALS)]
    out += [(family, t, False) for family, parts in FAMILIES.items() for t in parts["texts"] for _ in range(3)]
    return out + [(UNKNOWN, t, False) for t in OTHERS]


class Classifier:
    """Weights of every n-gram, in the order of `classes`; the last class is unknown."""

    def __init__(self, sample: list[str]):
        self.classes = [*FAMILIES, UNKNOWN]
        templates = {f: [grams(words(n), (2,)) for n in parts["names"]] + [grams(words(t), (2,)) for t in parts["texts"]] for f, parts in FAMILIES.items()}
        known = set().union(*(t for ts in templates.values() for t in ts))
        own = [grams(words(p)) for p in sample]
        clean = [g for g in own if len(g & known) < 3]  # a sampled paragraph may itself be a notice
        df: dict[str, int] = {}
        for g in clean:
            for x in g:
                df[x] = df.get(x, 0) + 1
        rows = [(grams(words(p)), f, held) for f, p, held in notices()]
        rare = {x for g, _, _ in rows for x in g if df.get(x, 0) <= COMMON * len(clean)}
        #: Words of which every feature has at least one.
        self.anchors = sorted(x for x in rare if " " not in x)
        held_by = set(self.anchors)
        vocabulary = sorted(x for x in rare if held_by.intersection(x.split(" ")))
        self.index = {x: k + 1 for k, x in enumerate(vocabulary)}  # 0 is the bias
        rows += [(g, UNKNOWN, k % 5 == 4) for k, g in enumerate(clean)]
        data = [(np.array([0, *sorted(self.index[x] for x in g if x in self.index)]), self.classes.index(f), held) for g, f, held in rows]
        held, fit = ([(i, np.ones(len(i)), y) for i, y, own in data if own == kept] for kept in (True, False))
        self.weights = ftrl(fit, len(self.classes), len(vocabulary) + 1, alpha=0.3, l1=0.05, l2=0.05, epochs=8)
        z = np.array([self.weights[i].sum(axis=0) for i, _, _ in held])
        y = np.array([c for *_, c in held])
        self.temperature = temperature(z, y)
        p = np.exp(z / self.temperature - (z / self.temperature).max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        top = p.max(axis=1)
        named = best < len(FAMILIES)

        def f1(least: float) -> float:
            said = named & (top >= least)
            right = (said & (best == y)).sum()
            return 2 * right / max(1, said.sum() + (y < len(FAMILIES)).sum())

        #: The least score of a family: the one with the best F1 apart from training, the lowest of equals.
        self.least = max((k / 20 for k in range(6, 19)), key=lambda t: (round(f1(t), 6), -t))
        self.f1 = f1(self.least)

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """(gram, weights) without those that are all zero, and (family, template, bigram, size)."""
        weights = [{"gram": g, "w": [round(float(x), 6) for x in self.weights[k]]} for g, k in self.index.items() if self.weights[k].any()]
        templates = []
        for family, parts in FAMILIES.items():
            for t, text in enumerate(parts["names"] + parts["texts"]):
                own = grams(words(text), (2,)) or grams(words(text), (1,))
                need = math.ceil(NAMED * len(own)) if t < len(parts["names"]) else min(SHARED, len(own))
                templates += [{"family": family, "template": t, "gram": g, "size": len(own), "need": need} for g in sorted(own)]
        table = lambda rows, kind: spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kind}>>")).alias("r")).select("r.*")
        return table(weights, "gram:string,w:array<double>"), table(templates, "family:string,template:int,gram:string,size:int,need:int")


def _ngrams(ws: Column, n: int) -> Column:
    return F.when(F.size(ws) >= n, F.transform(F.sequence(F.lit(0), F.size(ws) - n), lambda i: F.array_join(F.slice(ws, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))


def sample_paragraphs(docs: DataFrame, key: str, text: str, n: int = SAMPLE_PARAGRAPHS) -> list[str]:
    """About n paragraphs, picked over the whole table by a hash."""
    lines = docs.select(F.posexplode(F.split(text, "\n")).alias("at", "line"), key).filter("line <> ''")
    total = lines.count()
    share = min(1.0, n / total) if total else 1.0
    chance = F.pmod(F.xxhash64(F.col(key), "at", "line"), F.lit(1 << 30)) / float(1 << 30)
    return sorted(r[0] for r in lines.filter(chance <= share).select("line").limit(2 * n).collect())


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_PARAGRAPHS) -> DataFrame:
    """doc_id, n_paragraphs, n_predicted, n_confirmed, families, top_family, top_score, top_similarity of every row.

    A paragraph is a line that isn't empty. families: the confirmed ones, sorted and comma-joined, '' if none;
    the top columns are those of the confirmed paragraph with the best score (ties: the earlier), null
    without one. Null and empty texts have no paragraphs. Rows with equal ids are rows of their own. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    base = numbered(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    model = Classifier(sample_paragraphs(base, "rid", "text", sample))
    weights, templates = model.tables(spark)
    # A paragraph without a feature is unknown (the bias says so), and every feature has an anchor word.
    lines = base.select("rid", F.posexplode(F.split("text", "\n")).alias("at", "line")).filter("line <> ''")
    split = lines.select("rid", "at", F.filter(F.split(F.lower("line"), "[^a-z0-9]+"), lambda w: w != "").alias("ws"))
    # the few paragraphs that may be notices are stored, so texts are split once
    near = stored(split.filter(F.arrays_overlap("ws", F.array(*[F.lit(a) for a in model.anchors]))), "paragraphs")
    every = F.array_distinct(F.concat("ws", _ngrams(F.col("ws"), 2), _ngrams(F.col("ws"), 3)))
    hits = near.select("rid", "at", F.explode(every).alias("gram")).join(F.broadcast(weights), "gram")
    k = len(model.classes)
    logits = hits.groupBy("rid", "at").agg(*[F.sum(F.col("w")[c]).alias(f"z{c}") for c in range(k)])
    z = [(F.col(f"z{c}") + float(model.weights[0, c])) / model.temperature for c in range(k)]
    logits = logits.select("rid", "at", F.array(*z).alias("z")).withColumn("top", F.array_max("z"))
    family = F.element_at(F.array(*[F.lit(c) for c in model.classes]), F.array_position("z", F.col("top")).cast("int"))
    total = F.aggregate("z", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    predicted = logits.select("rid", "at", family.alias("family"), (1 / total).alias("score")).filter((F.col("family") != UNKNOWN) & (F.col("score") >= model.least))
    bigrams = near.join(predicted, ["rid", "at"]).select("rid", "at", "family", "score", F.explode(F.array_distinct(F.when(F.size("ws") > 1, _ngrams(F.col("ws"), 2)).otherwise(F.col("ws")))).alias("gram"), F.greatest(F.lit(1), F.size(F.array_distinct(_ngrams(F.col("ws"), 2)))).alias("own"))
    shared = bigrams.join(F.broadcast(templates), ["family", "gram"], "left").groupBy("rid", "at", "family", "score", "own", "template").agg(F.count("size").alias("both"), F.max("size").alias("size"), F.max("need").alias("need"))
    compared = shared.withColumn("similarity", F.when(F.col("both") >= F.col("need"), F.col("both") / F.least("own", "size")).otherwise(F.lit(0.0))).groupBy("rid", "at", "family", "score").agg(F.max("similarity").alias("similarity"))
    sure = F.col("similarity") >= CONFIRM
    best = F.max(F.when(sure, F.struct("score", (-F.col("at")).alias("at"), "family", "similarity")))
    per_doc = compared.groupBy("rid").agg(F.count("*").alias("n_predicted"), F.count(F.when(sure, 1)).alias("n_confirmed"), F.array_join(F.array_sort(F.collect_set(F.when(sure, F.col("family")))), ",").alias("families"), best.alias("best"))
    count = F.size(F.filter(F.split("text", "\n"), lambda x: x != "")).cast("long")
    return base.select("rid", "doc_id", count.alias("n_paragraphs")).join(per_doc, "rid", "left").select(
        "doc_id", "n_paragraphs", F.coalesce("n_predicted", F.lit(0)).alias("n_predicted"), F.coalesce("n_confirmed", F.lit(0)).alias("n_confirmed"), F.coalesce("families", F.lit("")).alias("families"),
        F.col("best.family").alias("top_family"), F.round("best.score", 6).alias("top_score"), F.round("best.similarity", 6).alias("top_similarity"),
    )
