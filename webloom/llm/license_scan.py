"""Licence scans with a trained paragraph classifier; documents are scanned with DataFrame functions only.

A text's units are its lines and its paragraphs of several lines (between blank lines), so that a hard-wrapped
notice is read as a whole. A unit's word 1- to 3-grams are looked up in the sparse weights of a multinomial
logistic regression over licence families, an ``unknown`` class (terms of no known licence) and ``none`` (other
prose). The regression is trained on the driver on ``examples``: the notices below and altered copies of them,
the licences' names in the usual forms of words, made-up names in the same forms, and other prose. A fifth of
the examples, whole notices and whole forms of a name with all their copies, is held back; on it the temperature
is calibrated and ``held_out_accuracy`` measured. A predicted family is confirmed where the unit also resembles
one of that family's templates: distinct common n-grams over the smaller number of n-grams, the unit's or the template's.

Only n-grams with a telling word (see ``telling_words``: more frequent in notices than in other prose) have
weights. A unit without such a word would be ``none`` whatever it says, so it is passed over before its n-grams are
made: this changes no answer.

A document's answer is its surest confirmed unit's family; ``unknown`` where a unit is a licence's but no family
is confirmed; ``none`` otherwise.

Weights and template n-grams are a few thousand rows by construction and are broadcast. Per unit sums are taken
before anything is shuffled.

Cases: null or empty text is ``none``; ties go to the first family in name order; rows that share a doc_id
share the answer, which is that of the surest of their units; a null doc_id is ``none``. Repeated rows
get equal answers. Empty tables give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Short notices by which each family's authors ask their works to be marked.
NOTICES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Distributed under the terms of the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Licensed under the GPL v3 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "You should have received a copy of the GNU General Public License along with this program.",
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Licensed under the BSD 3-Clause License.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "Available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
        "Available under the Creative Commons Attribution-NonCommercial-NoDerivatives License.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, you can obtain one at mozilla.org.",
    ],
    "public-domain": [
        "This work is in the public domain.",
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
    ],
    "proprietary": [
        "All rights reserved. No part of this publication may be reproduced without permission of the copyright holder.",
        "Copyright. All rights reserved.",
        "This software is proprietary and confidential; unauthorized copying is prohibited.",
    ],
}
#: The licences' names.
NAMES = {
    "apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0", "Apache Software License"],
    "mit": ["MIT License", "MIT", "MIT licence", "Expat License"],
    "gpl": ["GNU General Public License, version 3", "GNU General Public License", "GNU GPL", "GPL v3", "GPLv3", "GPLv2", "GPL-3.0", "LGPL-2.1", "LGPLv3", "GNU Lesser General Public License", "AGPLv3", "GNU Affero General Public License"],
    "bsd": ["BSD 3-Clause License", "BSD 2-Clause License", "BSD license", "BSD-3-Clause", "BSD-2-Clause"],
    "mpl": ["Mozilla Public License", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0"],
    "cc-by": ["Creative Commons Attribution 4.0 International License", "Creative Commons Attribution", "CC BY 4.0", "CC BY 3.0", "CC BY-SA 4.0", "CC-BY-4.0", "CC-BY-SA", "Creative Commons Attribution-ShareAlike License"],
    "cc-by-nc": ["Creative Commons Attribution-NonCommercial 4.0 International", "CC BY-NC 4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives License"],
    "public-domain": ["public domain", "CC0 1.0 Universal", "CC0", "CC0-1.0", "Unlicense"],
}
#: The usual forms of words around a licence's name.
FORMS = [
    "Released under the {}.", "Licensed under the {}.", "Licensed under {}.", "Available under {}.", "Distributed under the terms of the {}.", "Distributed under {} terms.",
    "This work is licensed under the {}.", "This work is under {}.", "This project is licensed under the terms of the {}.", "Code released under {}.", "Dual licensing: {} or commercial.",
    "SPDX-License-Identifier: {}", "{} applies to this file.", "{}", "See the {} for details.", "Its licenses include {}.", "Redistributions fall under {}.", "Free software, {} or later.",
]
#: Terms of no known licence.
TERMS = [
    "Permission to copy this text for private study is granted by the author.", "Use of this file is subject to the terms of the agreement.", "You may share copies with credit to the author.",
    "The licensee shall not sublicense the material.", "This licence ends when its terms are broken.", "Redistribution needs the written permission of the owner.", "Provided without warranty of any kind.", "See the LICENSE file.",
]
#: Prose, some of it with words of licences that is no licence.
PROSE = [
    "The driver showed a license and the officer gave permission to go.", "A public meeting on human rights was held in the town hall.", "He asked for permission to use the public library in the morning.",
    "The redistribution of wealth was discussed at length by both parties.", "She lost her fishing license on the way to the lake.", "The copyright office is closed on public holidays.", "No warranties were offered with the used car.",
    "A public library in the town is open today.", "Permission to speak was given.", "She studied physics at MIT for four years.", "The license plate was gone, and the public laughed.", "Public transport is free on Sundays.",
    "An Apache helicopter flew over the desert.", "The creative team met the commons committee.", "Parking here is not permitted without a permit.", "The terms of the loan were fair.", "It was released in the spring and sold well.",
    "All of them had the same rights in the house.", "The software was slow and the file was lost.", "Use the source, he said, and form your own opinion.", "The conditions on the road were bad in the winter.", "This is the work of many people over ten years.",
    "You can see the details in the next chapter of this book.", "The project is under way and will be done by May.", "They walked along the river and talked about the weather.", "A copy of the letter is in the file on the desk.", "We have found that the new version applies to most cases.",
    "The notice on the door said that the shop was closed.", "He was free to go or to stay.", "Three children played with a ball in the garden.", "The council will provide a form for this at no charge.", "In 2.0 seconds the car was gone, at 4.0 it was out of sight.",
    "The author of the story lives by the sea.", "International flights are late today.", "Its domain is the night, and the owl knows it.", "The general told the public nothing about the war.", "Or later, if you like, we can eat at the station.", "The commercial was loud and far too long.", "Das Haus steht am Fluss und ist alt.", "La casa de la plaza es blanca y grande.", "Le chien dort devant la porte de la maison.",
]

#: Words of any English text; none of them is telling.
COMMON = (
    "a an all and any are as at be been but by can each either every few for from had has have he her his how i if in into is it its may more most must no not "
    "of on one only or other our out over own see shall she should so some such than that the their them then there these they this those three to two up upon us "
    "was we were what when where which who will with without would you your"
).split()

_WORD = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _grams(text: str) -> list[str]:
    w = _words(text)
    return sorted({" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)})


def classes() -> tuple[str, ...]:
    return (*sorted(NOTICES), "none", "unknown")


def examples(seed: int = 3, copies: int = 8) -> list[tuple[str, str, int]]:
    """(text, class, group): texts of one group are held back together."""
    rng = random.Random(seed)
    out, group = [], 0
    made_up = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randrange(2, 4))).capitalize()
    for name in sorted(NOTICES):
        for notice in NOTICES[name]:
            out.append((notice, name, group))
            for _ in range(copies):  # altered copies: words lost, a stretch of the notice, words of prose around it
                w = [x for x in notice.split() if rng.random() > 0.08]
                if len(w) > 12 and rng.random() < 0.5:
                    at = rng.randrange(len(w) - 10)
                    w = w[at : at + 10 + rng.randrange(8)]
                pad = [rng.choice(rng.choice(PROSE).split()) for _ in range(rng.randrange(6))]
                out.append((" ".join([*pad, *w] if rng.random() < 0.5 else [*w, *pad]), name, group))
            group += 1
        for own in NAMES.get(name, []):
            for form in FORMS:
                out.append((form.format(own), name, group))
                group += 1
    for form in FORMS[:-1]:
        for kind in ("License", "Public License", "Software Licence", "Software License", "Open License 1.1", "License 2.0", "terms of use"):
            if form != "{}":
                out.append((form.format(f"{made_up()} {kind}"), "unknown", group))
                group += 1
    for text in [*TERMS, "license", "copyright notice", "licensed"] * 3:
        pad = [rng.choice(rng.choice(PROSE).split()) for _ in range(rng.randrange(6))]
        out.append((" ".join([text, *pad]), "unknown", group))
        group += 1
    for text in PROSE:
        for _ in range(4):
            out.append((" ".join(x for x in text.split() if rng.random() > 0.1), "none", group))
        group += 1
    for _ in range(250):
        out.append((" ".join(rng.choice(rng.choice(PROSE).split()) for _ in range(rng.randrange(12))), "none", group))
        group += 1
    return out


@lru_cache(maxsize=1)
def telling_words(least: float = 4.0) -> tuple[str, ...]:
    """Words that stand in notices at least so many times as often as in prose; counts are smoothed by a half."""
    texts = examples()
    count = {True: {}, False: {}}
    for text, kind, _ in texts:
        for w in set(_words(text)):
            own = count[kind != "none"]
            own[w] = own.get(w, 0) + 1
    n = {k: sum((kind != "none") == k for _, kind, _ in texts) for k in (True, False)}
    source = {w for own in (NOTICES, NAMES) for texts_ in own.values() for t in texts_ for w in _words(t)} | {w for t in (*FORMS, *TERMS) for w in _words(t.replace("{}", ""))}
    return tuple(sorted(w for w in source.difference(COMMON) if count[True].get(w, 0) / n[True] >= least * (count[False].get(w, 0) + 0.5) / n[False] and count[True].get(w, 0) >= 2))


def _telling_pattern() -> str:
    """One of the telling words as a word, by first letter: text is lower-cased."""
    by: dict[str, list[str]] = {}
    for w in telling_words():
        by.setdefault(w[0], []).append(re.escape(w[1:]))
    return "(?<![a-z0-9])(?:" + "|".join(f"{a}(?:{'|'.join(sorted(own, reverse=True))})" for a, own in sorted(by.items())) + ")(?![a-z0-9])"


@lru_cache(maxsize=1)
def train(steps: int = 160) -> tuple[tuple[str, ...], dict[str, np.ndarray], np.ndarray, float, float]:
    """(classes, weights by n-gram, intercepts, temperature, held-out accuracy) of the unit classifier."""
    names, told = classes(), set(telling_words())
    texts = examples()
    random.Random(1).shuffle(texts)
    groups = sorted({g for _, _, g in texts})
    away = set(random.Random(2).sample(groups, len(groups) // 5))
    held = np.array([g in away for _, _, g in texts])
    found = [[g for g in _grams(t) if told.intersection(g.split())] for t, _, _ in texts]
    index = {g: i for i, g in enumerate(sorted({g for own, h in zip(found, held) if not h for g in own}))}
    x = np.zeros((len(texts), len(index)), np.float32)
    for r, own in enumerate(found):
        at = [index[g] for g in own if g in index]
        x[r, at] = 1 / np.sqrt(max(1, len(at)))
    y = np.array([names.index(k) for _, k, _ in texts])
    target = np.eye(len(names), dtype=np.float32)[y]
    share = (1 / np.bincount(y[~held], minlength=len(names)))[y[~held], None].astype(np.float32) / len(names)  # classes weigh alike
    w = v = np.zeros((len(index), len(names)), np.float32)
    b = np.zeros(len(names), np.float32)
    for step in range(steps):  # accelerated, with a soft threshold that keeps the weights sparse
        p = np.exp(x[~held] @ v + b)
        p /= p.sum(1, keepdims=True)
        g = (p - target[~held]) * share
        new = v - 12 * (x[~held].T @ g)
        new = np.sign(new) * np.maximum(0, np.abs(new) - 12 * 1e-5)
        v = new + step / (step + 3) * (new - w)
        w = new
        b -= 4 * g.sum(0)
    b[names.index("none")] = max(b[names.index("none")], b.max() + 0.1)  # nothing telling: none
    z = x[held] @ w + b

    def loss(t):
        q = z / t
        q = q - q.max(1, keepdims=True)
        return -np.mean(q[np.arange(held.sum()), y[held]] - np.log(np.exp(q).sum(1)))

    temperature = min((0.3, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=loss)
    weights = {g: w[i] for g, i in index.items() if np.abs(w[i]).max() > 0}
    return names, weights, b, float(temperature), float(np.mean(z.argmax(1) == y[held]))


def held_out_accuracy() -> float:
    return train()[4]


def _weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(g, [float(v) for v in w]) for g, w in sorted(train()[1].items())], "gram string, w array<double>")


def templates() -> list[tuple[str, list[str]]]:
    """(family, n-grams) of the notices and of the names."""
    return [(name, _grams(t)) for name in sorted(NOTICES) for t in [*NOTICES[name], *NAMES.get(name, [])]]


def _templates(spark: SparkSession) -> DataFrame:
    rows = [(g, family, number, len(grams)) for number, (family, grams) in enumerate(templates()) for g in grams]
    return spark.createDataFrame(rows, "gram string, family string, template int, size int")


def _unit_grams(words: str) -> Column:
    """Distinct 1- to 3-grams of a column of words; a column, as an expression would be evaluated for each word."""

    def of(n: int) -> Column:
        # Runs by neighbours: a word, the next, the one after; beyond the last word a run is null.
        joined = F.transform(words, lambda w, i: F.concat(w, *[x for k in range(1, n) for x in (F.lit(" "), F.get(F.col(words), i + k))]))
        return F.filter(joined, lambda g: g.isNotNull())

    return F.array_distinct(F.concat(of(1), of(2), of(3)))


def units(docs: DataFrame) -> DataFrame:
    """doc_id, th, whole, line, words: lines and paragraphs of several lines (then whole is true) with a telling word."""
    pattern = _telling_pattern()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null").filter(F.lower("text").rlike(pattern))
    # Rows that share a doc_id stay apart by their text's hash; repeated rows fall together.
    parts = lambda c, whole: F.transform(c, lambda p, i: F.struct(F.lit(whole).alias("whole"), i.alias("line"), p.alias("p")))
    several = F.filter(parts(F.split("text", r"\n[ \t\r]*\n"), True), lambda u: F.trim(u["p"]).contains("\n"))
    every = F.filter(F.concat(parts(F.split("text", "\n"), False), several), lambda u: F.lower(u["p"]).rlike(pattern))
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9]+(?:[.\-][a-z0-9]+)*)"), F.lit(1))
    # The words are made where the units are exploded: no later expression can take them in and repeat the work.
    split = F.transform(every, lambda u: F.struct(u["whole"].alias("whole"), u["line"].alias("line"), words(u["p"]).alias("words")))
    return rows.select("doc_id", F.xxhash64("text").alias("th"), F.explode(split).alias("u")).select("doc_id", "th", "u.*")


def paragraphs(docs: DataFrame, similarity: float = 0.6) -> DataFrame:
    """doc_id, whole, line, family, probability, similarity, confirmed of every unit of docs(doc_id, text) that is a
    licence's; family may be `unknown`."""
    spark = docs.sparkSession
    names, _, intercepts, temperature, _ = train()
    key = ["doc_id", "th", "whole", "line"]
    # Only n-grams with a weight or of a template leave their task; repeated rows give each as often, a unit's sums
    # count it once.
    n = F.size("words")
    size = (n + F.greatest(n - 1, F.lit(0)) + F.greatest(n - 2, F.lit(0))).alias("size")
    grams = units(docs).select(*key, size, "words").select(*key, "size", F.explode(_unit_grams("words")).alias("gram"))
    known = _templates(spark).select("gram").union(_weights(spark).select("gram")).distinct()
    met = grams.join(F.broadcast(known), "gram").distinct()
    sums = [F.coalesce(F.sum(F.get("w", F.lit(k))), F.lit(0.0)).alias(f"s{k}") for k in range(len(names))]
    hits = met.join(F.broadcast(_weights(spark)), "gram").groupBy(*key, "size").agg(F.count("*").alias("known"), *sums)
    logits = F.array(*[(F.col(f"s{k}") / F.sqrt("known") + F.lit(float(intercepts[k]))) / F.lit(temperature) for k in range(len(names))])
    best = F.array_max("z")
    # A unit whose telling words were never learned has no row here: it is `none`, as the intercepts say.
    scored = hits.select(*key, "size", logits.alias("z")).select(
        *key, "size", F.get(F.array(*map(F.lit, names)), (F.array_position("z", best) - 1).cast("int")).alias("family"),
        (1 / F.aggregate("z", F.lit(0.0), lambda a, v: a + F.exp(v - F.array_max("z")))).alias("probability"),
    ).filter("family <> 'none'")
    shared = met.join(F.broadcast(_templates(spark).withColumnRenamed("size", "tsize")), "gram").groupBy(*key, "family", "template", "tsize").agg(F.count("*").alias("common"))
    close = scored.join(shared, [*key, "family"], "left").groupBy(*key, "family", "probability").agg(F.coalesce(F.max(F.col("common") / F.least("size", "tsize")), F.lit(0.0)).alias("similarity"))
    return close.select("doc_id", "whole", "line", "family", "probability", "similarity", (~F.col("family").isin("unknown", "none") & (F.col("similarity") >= similarity)).alias("confirmed"))


def scan(docs: DataFrame, similarity: float = 0.6) -> DataFrame:
    """doc_id, license, probability, similarity, n_paragraphs (units that are a licence's) of every row of docs."""
    rank = F.array_position(F.array(*map(F.lit, classes())), F.col("family"))
    order = F.struct(F.col("confirmed").cast("int"), F.when(F.col("confirmed"), F.col("probability")).otherwise(0.0), -rank, -F.col("line"), "family", "probability", "similarity", "confirmed")
    found = paragraphs(docs, similarity).groupBy("doc_id").agg(F.max(order).alias("b"), F.count("*").alias("n"))
    best = found.select("doc_id", F.when(F.col("b.confirmed"), F.col("b.family")).otherwise("unknown").alias("license"), F.when(F.col("b.confirmed"), F.col("b.probability")).alias("probability"), F.when(F.col("b.confirmed"), F.col("b.similarity")).alias("similarity"), "n")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(best, "doc_id", "left")
    return out.select("doc_id", F.coalesce("license", F.lit("none")).alias("license"), F.coalesce("probability", F.lit(0.0)).alias("probability"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.coalesce("n", F.lit(0)).cast("long").alias("n_paragraphs"))
