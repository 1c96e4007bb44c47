"""Licence scans with a trained paragraph classifier.

A paragraph ends at a blank line or at a line that ends a sentence; a line that
does not is continued by the next one (a comment's marks left out), so wrapped
notices are read whole.  Paragraphs that speak of rights are split into words;
word 1- to 3-grams with a weight are looked up, and a softmax over summed
weights gives a licence family or ``unknown``.  The model is a sparse logistic
regression, trained on the driver on variants of the notices below (words
dropped and doubled, text before and after) and on sentences about rights that
grant no licence; its unknown class is calibrated by a temperature fitted on
held-out variants.  A prediction is confirmed only if the paragraph holds
enough of the n-grams of one of the family's notices, and no other family has a
notice that the paragraph holds more of.

Scanning is DataFrame expressions only: one pass over the texts leaves the
paragraphs that speak of rights, written once; then explode, a join with the
weights (a few thousand, bounded by the notices), and sums.

Edge cases: a NULL or empty text has no licence; repeated rows are each scanned;
a text in one very long line is one paragraph; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, staged

#: Fixed notices of common licences.
NOTICES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0", "This project is released under the Apache License 2.0", "Available under Apache-2.0", "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "mit": [
        "Released under the MIT License", "Licensed under the MIT License", "Available under the MIT license", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3", "Licensed under the GPL version 3", "Available under GPLv3", "Released under the GPL-3.0 license", "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "gpl-2.0": [
        "Licensed under the GNU General Public License, version 2", "Licensed under the GPL version 2", "Available under GPLv2", "Released under the GPL-2.0 license", "SPDX-License-Identifier: GPL-2.0-only",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License", "Available under LGPLv3", "Released under the LGPL", "SPDX-License-Identifier: LGPL-2.1-only",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License", "Available under AGPLv3", "SPDX-License-Identifier: AGPL-3.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "bsd": [
        "Released under the BSD License", "Licensed under the 3-Clause BSD License", "Licensed under the BSD 2-Clause License", "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "isc": ["Licensed under the ISC License", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "mpl-2.0": ["Licensed under the Mozilla Public License, Version 2.0", "SPDX-License-Identifier: MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "epl-2.0": ["Licensed under the Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"],
    "unlicense": ["Released under the Unlicense", "SPDX-License-Identifier: Unlicense", "This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Text is available under the Creative Commons Attribution-ShareAlike License"],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "This is an open access article distributed under the terms of the Creative Commons Attribution License"],
    "cc0": ["Released under CC0 1.0 Universal", "dedicated to the public domain under CC0", "No rights reserved, CC0 public domain dedication", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
}
#: Sentences of the same vocabulary that grant no licence.
OTHERS = [
    "All rights reserved", "Copyright 2020 by the authors, all rights reserved", "he renewed his driving license last year", "the license fee is due in March", "permission to enter was granted by the guard", "the public library is open to the general public", "a licensed electrician must do the work", "terms and conditions apply",
    "the version 2.0 release fixes many errors", "the software was released in May", "used with permission of the publisher", "no warranty is given for the goods sold here", "the license plate of the car", "copyright law differs between countries", "licensed premises close at ten", "this material may not be published or redistributed",
    "the GNU project was announced in 1983 and its General Public License followed later", "many firms avoid the GPL for fear of its terms", "he studied at MIT and later released a book", "the Apache helicopter was licensed for production abroad", "Mozilla and the Free Software Foundation published a statement", "please read the license before you install this software",
    "your license key is printed on the back of the box", "we do not grant permission to copy, modify or distribute the work", "this software is proprietary and may not be redistributed in source or binary form", "the court held that the license was not violated", "works in the public domain are not protected by copyright", "see the General Public License for more details",
    "a commercial license can be bought from the vendor", "the end user license agreement forbids reverse engineering", "the fishing license is valid for one year, with or without a boat", "creative people and the commons they share", "attribution of the painting is disputed", "the conditions of the grant are met", "either version of the story may be true",
]
#: Words of plain prose: they stand around notices in training, and n-grams of them alone have no weight.
PROSE = "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so what up said about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many off before must well back through years where much your way down should because long each just state people those too mr how little good world make very year still see own work men day get here between both life being under three never know same last another while us might great go come since against right came take used himself few house use during without again place around however home found part".split()
#: What a paragraph must speak of to be scanned; every notice does.
CUES = r"(?i)licen[sc]e|permission|redistribut|public domain|copyright notice|required by applicable law|copy, modify, publish|waived all copyright|creative commons|cc0|cc by|gpl|apache-2"
#: A line that is continued by the next, whose mark of a comment is left out; and what ends a paragraph for good.
WRAPPED, BLANK = r"([A-Za-z0-9,;/()\"-])[\x20\t\r]*\n[\x20\t]*(?:[*#/;]+[\x20\t]+)?", r"\n[*#/\x20\t\r]*\n"
#: As ``CUES`` in a text whose lines are not joined yet: a cue may be broken over two, with a mark of a comment between.
CUES_IN_LINES = CUES.replace(" ", r"[\s*#/;]+")
UNKNOWN = "unknown"
#: Share of a notice's n-grams that confirms it, and the least calibrated probability.
CONFIRM, LEAST = 0.6, 0.5


def words_of(text: str) -> list[str]:
    return [w for w in re.sub(r"[^a-z0-9]+", " ", text.lower()).split(" ") if w]


def grams_of(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)}


def _variants(rng: np.random.Generator, words: list[str], fill: list[str], n: int) -> list[list[str]]:
    out = [words]
    for k in range(n):
        kept = [w for w in words for _ in range(1 + (rng.random() < 0.03)) if rng.random() > 0.08]
        around = [[fill[i] for i in rng.integers(0, len(fill), rng.integers(0, (8, 60)[k % 2]))] for _ in range(2)]
        out.append(around[0] + kept + around[1])
    return out


@lru_cache
def model(seed: int = 3) -> tuple[list[str], dict[str, list[float]], float]:
    """(classes, weights of each n-gram by class, temperature); the last class is unknown and the n-gram "" is the bias."""
    rng = np.random.default_rng(seed)
    classes = [*NOTICES, UNKNOWN]
    plain = set(PROSE)
    fill = sorted({w for t in OTHERS for w in words_of(t)} | plain)
    rows: list[tuple[list[str], int]] = []
    for c, notices in enumerate(NOTICES.values()):
        for t in notices:
            rows += [(w, c) for w in _variants(rng, words_of(t), fill, 20)]
    for t in OTHERS:
        rows += [(w, len(classes) - 1) for w in _variants(rng, words_of(t), fill, 10)]
    rows += [([fill[i] for i in rng.integers(0, len(fill), 10 + 2 * k)], len(classes) - 1) for k in range(80)]
    known = {"": 0} | {g: i + 1 for i, g in enumerate(sorted({g for ts in [*NOTICES.values(), OTHERS] for t in ts for g in grams_of(words_of(t)) if not plain.issuperset(g.split(" "))}))}
    x = np.zeros((len(rows), len(known)))
    for i, (w, _) in enumerate(rows):
        x[i, [known[g] for g in grams_of(w) if g in known]] = 1
    x[:, 0] = 1
    y, held = np.eye(len(classes))[[c for _, c in rows]], np.arange(len(rows)) % 5 == 4
    weights = np.zeros((len(known), len(classes)))
    velocity = np.zeros_like(weights)
    for _ in range(500):
        z = x[~held] @ weights
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        velocity = 0.9 * velocity - 0.05 * (x[~held].T @ (p - y[~held]) / (~held).sum() * 10 + 1e-3 * weights)
        weights += velocity
    weights[np.abs(weights) < 0.02] = 0
    z = x[held] @ weights

    def loss(t: float) -> float:
        s = z / t
        return float((np.log(np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)) + s.max(axis=1) - (s * y[held]).sum(axis=1)).mean())

    temperature = min(np.geomspace(0.25, 4, 33), key=loss)
    rounded = {g: [round(float(v), 6) for v in weights[i]] for g, i in known.items()}
    return classes, {g: w for g, w in rounded.items() if any(w)}, float(temperature)


def _literal_table(spark, rows: list, schema: str) -> DataFrame:
    """A small constant table, as a literal in the plan."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("x")).select("x.*")


def _grams(text: Column) -> Column:
    """The distinct word 1- to 3-grams of a paragraph."""
    words = F.array_remove(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), "")

    def every(w: Column) -> Column:
        def of(k: int) -> Column:
            places = F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k)).otherwise(F.array().cast("array<int>"))
            return F.transform(places, lambda i: F.concat_ws(" ", *[w[i + j] for j in range(k)]))

        return F.array_distinct(F.concat(of(1), of(2), of(3)))

    return let(words, every)


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text, in order."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, "\x1e")
    return F.split(F.regexp_replace(t, WRAPPED, "$1 "), "[\n\x1e]")


def license_paragraphs(df: DataFrame, text_col: str = "text", key: str = "row_id") -> DataFrame:
    """(key, paragraph, family, probability, confirmed): the paragraphs of ``df`` that speak of rights; ``key`` is a unique column.

    ``df`` is read more than once, so ``key`` must come out the same each time.
    """
    every = F.when(F.col(text_col).rlike(CUES_IN_LINES), paragraphs(F.col(text_col)))
    return judged_paragraphs(df.select(F.col(key).alias("key"), F.posexplode(every).alias("paragraph", "said")).where(F.col("said").rlike(CUES))).withColumnRenamed("key", key)


def judged_paragraphs(said: DataFrame) -> DataFrame:
    """(key, paragraph, family, probability, confirmed) of rows (key, paragraph, said)."""
    spark, at = said.sparkSession, ["key", "paragraph"]
    classes, weights, temperature = model()
    ws = [f"w{i}" for i in range(len(classes))]
    table = F.broadcast(_literal_table(spark, [{"g": g} | dict(zip(ws, w)) for g, w in weights.items() if g], "g:string," + ",".join(f"{w}:double" for w in ws)))
    notices = [(family, i, grams_of(words_of(t))) for family, ts in NOTICES.items() for i, t in enumerate(ts)]
    known = F.broadcast(_literal_table(spark, [{"g": g, "of": family, "notice": i, "size": len(gs)} for family, i, gs in notices for g in sorted(gs)], "g:string,of:string,notice:int,size:int"))
    grams = said.select(*at, F.explode(_grams(F.col("said"))).alias("g"))
    sums = grams.join(table, "g").groupBy(*at).agg(*[F.sum(w).alias(w) for w in ws])
    bias = weights.get("", [0.0] * len(classes))
    scores = F.array(*[(F.col(w) + b) / temperature for w, b in zip(ws, bias)])
    best = let(scores, lambda s: F.struct(F.array_position(s, F.array_max(s)).alias("at"), (F.lit(1.0) / F.aggregate(s, F.lit(0.0), lambda a, v: a + F.exp(v - F.array_max(s)))).alias("p")))
    judged = sums.select(*at, best.alias("b")).select(*at, F.element_at(F.array(*map(F.lit, classes)), F.col("b.at").cast("int")).alias("family"), F.round("b.p", 6).alias("probability"))
    shares = grams.join(known, "g").groupBy(*at, F.col("of").alias("family"), "notice").agg((F.count("*") / F.first("size")).alias("share"))
    like = shares.groupBy(*at, "family").agg(F.max("share").alias("share")).groupBy(*at).agg(F.map_from_entries(F.collect_list(F.struct("family", "share"))).alias("like"))
    joined = judged.join(like, at, "left")
    own, top = F.coalesce(F.col("like")[F.col("family")], F.lit(0.0)), F.array_max(F.map_values("like"))
    sure = (F.col("family") != UNKNOWN) & (F.col("probability") >= LEAST) & (own >= CONFIRM) & (own >= top)
    return joined.select(*at, "family", "probability", F.coalesce(sure, F.lit(False)).alias("confirmed"))


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_paragraphs, families): for each document its confirmed licence paragraphs and their families, joined by a comma."""
    text = F.col(text_col)
    cued = F.when(text.rlike(CUES_IN_LINES), F.filter(F.transform(paragraphs(text), lambda x, i: F.struct(i.alias("paragraph"), x.alias("said"))), lambda x: x["said"].rlike(CUES)))
    rows = staged(df.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("doc_id"), cued.alias("cued")), "paragraphs")
    found = judged_paragraphs(rows.select("key", F.inline("cued"))).where("confirmed")
    found = found.groupBy("key").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("family")), ",").alias("families"))
    return rows.select("key", "doc_id").join(found, "key", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n_paragraphs"), F.coalesce("families", F.lit("")).alias("families"))
