"""Licence scanning by a trained paragraph classifier, in DataFrame functions only.

A multinomial logistic regression over sparse word n-grams (one to three words, at least one of them a content
word of the notices below) is trained on the driver from the notices, from cropped and thinned copies of
them, and from ordinary sentences that use the same words: the class ``unknown``. What passes as a
licence is calibrated on sentences that were never trained on. A text without any content word of the notices has no
feature and is unknown, so only lines with one are looked at: consecutive ones make a paragraph, which keeps
notices whole that are wrapped over lines. A paragraph's n-grams meet the trained weights in one join; the weights
are as many as the notices have n-grams, so their size is fixed. A family is confirmed if a notice of it is
found in the paragraph by at least ``CONFIRM`` of the notice's n-grams.
"""

from __future__ import annotations

import json
import re
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN, CONFIRM = "unknown", 0.8
#: Short notices of each licence family.
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "you may not use this file except in compliance with the License", "SPDX-License-Identifier: Apache-2.0",
                   "Apache License Version 2.0, January 2004", "Apache 2.0"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            "Use of this source code is governed by a BSD-style license", "SPDX-License-Identifier: BSD-3-Clause", "Released under the BSD 3-Clause License.", "Licensed under the BSD License."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related rights to this work", "Dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only", "GPL v2", "GPLv2", "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only", "GPL v3", "GPLv3", "under the terms of the GNU General Public License version 3 as published by the Free Software Foundation"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "SPDX-License-Identifier: ISC", "Released under the ISC License."],
    "LGPL": ["under the terms of the GNU Lesser General Public License", "This library is licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
            "SPDX-License-Identifier: MIT"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."],
    "proprietary": ["All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited.", "No part of this publication may be reproduced without prior written permission of the publisher"],
}
#: Sentences that use licence words without granting anything.
OTHER = [
    "the license of the driver was renewed last year", "he was granted permission to use the software at work", "the public library has a general version of the source",
    "version 2.0 of the program was released under a new name", "a copy of the file is in the folder", "the work of the author is a source of joy", "the apache people live in the south",
    "conditions are met when the public is free", "she teaches at mit and has a license to practise", "all copyright questions go to the general office", "this license plate is from the year 2004",
    "the foundation published a free version of its form", "rights and terms of use differ between versions", "commercial and creative work is permitted in common rooms",
    "der hund ist mit der katze im haus", "sie kommt mit dem zug und geht mit ihm", "mit einem wort", "wir fahren mit den anderen", "es ist mit uns", "tanz mit mir", "mit und ohne", "was ist mit dem werk",
    "token password key secret value of the file", "provided that the following form is used", "please copy and distribute this note to any person in the office",
]
#: Sentences that use licence words without granting anything, kept apart to calibrate what is unknown.
UNTRAINED = [
    "the license office opens at nine and closes at four", "copyright law was the subject of the lecture", "all rights and duties of members are in the statute", "the software was released in spring",
    "permission to enter the building is given at the gate", "the general public likes free concerts", "version 3 of the report replaces version 2", "the author of this work lives by the sea",
    "he studied at mit before he joined the foundation", "apache helicopters flew over the town", "source and binary stars differ in colour", "the library keeps old copies of the code",
    "conditions in the mine were met with protest", "no part of the house was without damage", "a creative commons room is open to all", "the publisher asked for written comments",
    "he was licensed as a pilot under the old rules", "please use the following form to modify your order", "the charge was paid by the associated company", "documentation of the dig fills many files",
]
#: Function words, which make no feature alone.
FUNCTION_WORDS = frozenset("a all and any are as at be been by each for from had has have he if in into is it its may no not of on or other shall she that the their they this to under use used was will with without you your".split())
_GRAMS = (1, 2, 3)


def grams(text: str) -> list[str]:
    """The word n-grams of a paragraph; the same rule as ``_gram_column``."""
    words = [w for w in re.split(r"[^a-z0-9.-]+", text.lower()) if w.strip(".-")]
    words = [w.strip(".-") for w in words]
    return [" ".join(words[i:i + n]) for n in _GRAMS for i in range(len(words) - n + 1)]


@cache
def content_words() -> list[str]:
    """Words of the notices that say something about licences."""
    return sorted({w for ts in NOTICES.values() for t in ts for g in grams(t) for w in g.split()} - FUNCTION_WORDS)


def features(text: str) -> set[str]:
    """The n-grams with a content word."""
    known = set(content_words())
    return {g for g in grams(text) if known & set(g.split())}


def gate() -> str:
    """A pattern for texts with a content word; without one there is no feature."""
    by_letter: dict[str, list[str]] = {}
    for w in content_words():
        by_letter.setdefault(w[0], []).append(re.escape(w[1:]))
    parts = [f"{first}(?:{'|'.join(rest)})" for first, rest in by_letter.items()]
    return rf"(?i)(?<![a-z0-9.-])[.-]*(?:{'|'.join(parts)})[.-]*(?![a-z0-9.-])"


def paragraphs(text, pattern: str):
    """(first line, lines, text) of the runs of consecutive lines that the pattern finds, as an array."""

    def runs(lines, hits):
        starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(hits, i) & ~F.coalesce(F.get(hits, i - 1), F.lit(False)))

        def run(i):
            stop = F.array_position(F.slice(hits, i + 1, F.size(lines)), F.lit(False)).cast("int")
            n = F.when(stop > 0, stop - 1).otherwise(F.size(lines) - i)
            return F.struct(i.alias("paragraph"), n.alias("lines"), F.array_join(F.slice(lines, i + 1, n), " ").alias("text"))

        return F.transform(starts, run)

    # an array is bound once as a lambda's variable
    return F.transform(F.array(F.split(text, "\n")), lambda lines: F.transform(F.array(F.transform(lines, lambda x: x.rlike(pattern))), lambda hits: runs(lines, hits))[0])[0]


def _gram_column(text):
    """A paragraph's n-grams, each once; the same rule as ``grams``."""

    def runs(words, n):
        starts = F.filter(F.sequence(F.lit(1), F.size(words) + 1), lambda i: i + n - 1 <= F.size(words))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))

    words = F.transform(F.split(F.lower(text), r"[^a-z0-9.-]+"), lambda w: F.regexp_replace(w, r"^[.-]+|[.-]+$", ""))
    bound = F.array(F.filter(words, lambda w: w != ""))  # an array is bound once as a lambda's variable
    return F.array_distinct(F.transform(bound, lambda w: F.concat(*[runs(w, n) for n in _GRAMS]))[0])


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


@cache
def model(copies: int = 24, rounds: int = 300, ridge: float = 1e-3) -> dict:
    """Train; returns classes, offsets, a weight list for every n-gram, notices and threshold."""
    rng = np.random.default_rng(5)
    classes = [*NOTICES, UNKNOWN]
    texts, labels = [], []
    for y, family in enumerate(classes):
        for t in NOTICES.get(family, OTHER):
            words = t.split()
            texts.append(t)
            labels.append(y)
            for _ in range(copies):
                keep = [w for w in words if rng.random() > 0.1] or words
                pad = [str(w) for w in rng.choice(OTHER, 1)] if rng.random() < 0.5 else []
                texts.append(" ".join([*pad, *keep] if rng.random() < 0.5 else [*keep, *pad]))
                labels.append(y)
    vocabulary = sorted({g for t in [t for ts in NOTICES.values() for t in ts] + OTHER for g in features(t)})
    at = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(texts), len(vocabulary)), np.float32)
    for i, t in enumerate(texts):
        x[i, [at[g] for g in features(t) if g in at]] = 1
    y = np.array(labels)
    goal = np.eye(len(classes), dtype=np.float32)[y]
    w, b = np.zeros((len(vocabulary), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    for _ in range(rounds):
        p = _softmax(x @ w + b)
        p = (p - goal) / len(x)
        w, b = w - 2.0 * (x.T @ p + ridge * w / len(classes)), b - 2.0 * p.sum(axis=0)
    unseen = np.zeros((len(UNTRAINED), len(vocabulary)), np.float32)
    for i, t in enumerate(UNTRAINED):
        unseen[i, [at[g] for g in features(t) if g in at]] = 1
    threshold = float(max(0.5, _softmax(unseen @ w + b)[:, :-1].max(axis=1).max()))
    notices = [(family, i, t, sorted(features(t))) for family, ts in NOTICES.items() for i, t in enumerate(ts)]
    return {"classes": classes, "offsets": [float(v) for v in b], "threshold": threshold, "notices": notices,
            "weights": {g: [round(float(v), 5) for v in w[i]] for g, i in at.items()}}


def scan(docs: DataFrame) -> DataFrame:
    """One row for every paragraph (run of lines) with a content word of the notices and a licence, or a licence's words.

    Result: doc_id, paragraph (number of its first line, from 0), lines, family (``unknown`` below the threshold), score (its
    probability), notice (the closest notice of that family), coverage (share of the notice's n-grams found) and confirmed.
    Paragraphs whose score for ``unknown`` is that of a text without any feature or more are left out. Null and empty texts have
    no paragraphs; repeated rows give repeated findings. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    m = model()
    k = len(m["classes"])
    held: dict[str, list[int]] = {}
    for n, (_, _, _, gs) in enumerate(m["notices"]):
        for g in gs:
            held.setdefault(g, []).append(n)
    rows = json.dumps([{"g": g, "w": w, "n": held.get(g, [])} for g, w in m["weights"].items()])
    weights = spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<g string, w array<double>, n array<int>>>")))
    text, pattern = F.col("text").cast("string"), gate()
    found = docs.where(text.rlike(pattern)).select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(paragraphs(text, pattern)).alias("p"))
    rows_ = found.select("doc_id", "p.paragraph", "p.lines", "p.text").withColumn("row", F.monotonically_increasing_id())
    spread = rows_.select("doc_id", "paragraph", "lines", "row", F.explode(_gram_column(F.col("text"))).alias("g"))
    met = spread.join(F.broadcast(weights), "g")
    # one notice number for every n-gram found in it: as many as the paragraph's distinct n-grams have
    found = met.groupBy("doc_id", "paragraph", "lines", "row").agg(F.array(*[F.sum(F.get("w", F.lit(i))) + m["offsets"][i] for i in range(k)]).alias("z"), F.flatten(F.collect_list("n")).alias("hits"))
    exps = lambda z: F.transform(F.array(F.array_max(z)), lambda top: F.transform(z, lambda v: F.exp(v - top)))[0]
    share = lambda e: F.transform(F.array(F.aggregate(e, F.lit(0.0), lambda s, v: s + v)), lambda total: F.transform(e, lambda v: v / total))[0]
    odds = found.withColumn("p", F.transform(F.array(exps(F.col("z"))), share)[0])
    names = F.from_json(F.lit(json.dumps(m["classes"])), "array<string>")
    odds = odds.withColumn("best", F.array_max(F.arrays_zip(F.col("p").alias("p"), names.alias("c"))))
    sure = (F.col("best.p") >= m["threshold"]) & (F.col("best.c") != UNKNOWN)
    odds = odds.withColumn("family", F.when(sure, F.col("best.c")).otherwise(UNKNOWN))
    empty = float(_softmax(np.array([m["offsets"]]))[0, -1])
    odds = odds.where((F.col("family") != UNKNOWN) | (F.get("p", F.lit(k - 1)) < empty))
    notices = F.from_json(F.lit(json.dumps([{"f": f, "i": i, "n": len(gs), "t": t} for i, (f, _, t, gs) in enumerate(m["notices"])])), "array<struct<f:string,i:int,n:int,t:string>>")
    of_family = F.filter(notices, lambda x: x["f"] == F.col("family"))
    cover = F.transform(of_family, lambda x: F.struct((F.size(F.filter("hits", lambda h: h == x["i"])) / x["n"]).alias("c"), x["t"].alias("t")))
    out = odds.withColumn("near", F.coalesce(F.array_max(cover), F.struct(F.lit(0.0).alias("c"), F.lit("").alias("t"))))
    return out.select("doc_id", "paragraph", "lines", "family", F.col("best.p").alias("score"), F.when(F.col("near.c") > 0, F.col("near.t")).alias("notice"),
                      F.col("near.c").alias("coverage"), ((F.col("family") != UNKNOWN) & (F.col("near.c") >= CONFIRM)).alias("confirmed"))
