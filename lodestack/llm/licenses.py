"""Licence scan: a trained paragraph classifier over word n-grams, confirmed by comparison with templates.

Training is small and local: the templates below, alone and several of a family in a row, and damaged versions of them
against plain sentences fit a sparse multinomial logistic regression in numpy (L1, so most n-grams get no weight) whose
temperature is set on other damaged versions, so that the probability of the class ``unknown`` is calibrated.

The scan itself is DataFrame expressions only. Paragraphs end at blank lines. In each, the lines that hold a word of a
weighted n-gram and lie at most one line apart are joined into one text, so a notice that is wrapped over several lines
is read as a whole; its lines are read one by one as well. Distinct texts are scored by a join with the weights. A
predicted family counts as confirmed when enough three-word shingles of one of its templates stand in the text; what is
not confirmed is ``unknown``.
"""

from __future__ import annotations

import json
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.llm.common import checkpoint, hot_lookup

# Short public notices by licence family.
TEMPLATES: dict[str, list[str]] = {
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Affero General Public License, version 3.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "boost": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES.",
        "Licensed under the BSD 3-Clause License.",
    ],
    "cc-by": [
        "This work is licensed under the Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ],
    "cc-by-nc": [
        "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC-ND 4.0, non-commercial use only.",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released under CC0 1.0 Universal Public Domain Dedication.",
        "This work is dedicated to the public domain.",
    ],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution.",
        "The accompanying materials are made available under the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
        "Licensed under the Eclipse Public License, version 2.0.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU GPL version 2 or later.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
        "Licensed under the ISC License.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 3.",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "proprietary": [
        "All rights reserved.",
        "No part of this publication may be reproduced or transmitted in any form without prior written permission of the publisher.",
        "This document is confidential and proprietary and may not be copied or distributed without permission.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    ],
}
# Plain sentences with words that licences use.
PLAIN = [
    "You must renew your driver's license before the end of the year.", "The court heard a copyright dispute between two studios.",
    "All the rights of the workers were reserved for later talks.", "The warranty of the car covers parts and labour for two years.",
    "Students may use the software in the library free of charge.", "She studied at MIT before she moved to the coast.",
    "The Apache helicopter landed near the village in the morning.", "A public meeting is held in the town hall every month.",
    "The foundation gave permission to build a free school.", "Conditions of any kind may change without prior notice.",
    "The general terms of the contract are listed in the following table.", "His work is known to the public and to any person who reads.",
    "The version of the story that was published first is the shorter one.", "Creative people share common rooms in this building.",
    "The author has kept all copies of the letters in a box.", "Source and binary stars are observed with the same tool.",
    "The names of the contributors are printed on the last page.", "Use of the road is permitted only with a written pass.",
    "The dealer was licensed under an old law of the state.", "Most of the documents were released last week.",
]
# Words too common to be a feature by themselves.
COMMON = "a all an and any are as at be but by can for from has have if in is it may more most not of on only or other shall that the their this to under was were which will with without you your".split()
UNKNOWN = "unknown"
WORD = r"[a-z0-9]+"
#: Longest n-gram; damaged versions of each template; shingle length and share of a template's shingles that confirm.
LONGEST, VERSIONS, SHINGLE, CONFIRM = 3, 14, 3, 0.6
#: Examples that an n-gram has to stand in to be a feature.
SEEN = 4
#: Least calibrated probability of a family.
LEAST = 0.5


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def grams_of(words: list[str]) -> set[str]:
    """All n-grams of 1..LONGEST words but those of common words only."""
    made = (words[i : i + n] for n in range(1, LONGEST + 1) for i in range(len(words) - n + 1))
    return {" ".join(g) for g in made if any(w not in COMMON for w in g)}


def damaged(words: list[str], rng: random.Random) -> list[str]:
    """A template as it turns up: words lost, changed or cut off, other text around."""
    out = [w for w in words if rng.random() > 0.08]
    if len(out) > 12 and rng.random() < 0.5:
        at = rng.randrange(len(out) - 8)
        out = out[at : at + rng.randrange(8, 24)]
    extra = lambda: words_of(rng.choice(PLAIN))[: rng.randrange(8)] if rng.random() < 0.5 else []
    return extra() + out + extra()


def examples(seed: int) -> list[tuple[set[str], int]]:
    rng = random.Random(seed)
    families = sorted(TEMPLATES)
    rows = [(grams_of(words_of(t)), k) for k, f in enumerate(families) for t in TEMPLATES[f]]
    rows += [(grams_of(damaged(words_of(t), rng)), k) for k, f in enumerate(families) for t in TEMPLATES[f] for _ in range(VERSIONS)]
    for k, f in enumerate(families):  # a whole notice: neighbouring templates in a row
        for at in range(len(TEMPLATES[f]) - 1):
            rows += [(grams_of(damaged(words_of(" ".join(TEMPLATES[f][at : at + n])), rng)), k) for n in (2, 3, 4)]
    rows += [(grams_of(words_of(p)), len(families)) for p in PLAIN for _ in range(4)]
    for _ in range(40 * VERSIONS):  # plain words in any order, and nothing at all
        rows.append((grams_of([rng.choice(words_of(rng.choice(PLAIN))) for _ in range(rng.randrange(20))]), len(families)))
    return rows


@lru_cache(maxsize=1)
def trained() -> tuple[dict[str, list[float]], list[float], float]:
    """Weights of the n-grams by class (families in order, then unknown), the classes' offsets, and the temperature."""
    rows, n_classes = examples(0), len(TEMPLATES) + 1
    seen = Counter(g for gs, _ in rows for g in gs)
    vocabulary = {g: i for i, g in enumerate(sorted(g for g, n in seen.items() if n >= SEEN))}
    x = np.zeros((len(rows), len(vocabulary)), dtype=np.float32)
    for i, (gs, _) in enumerate(rows):
        x[i, [vocabulary[g] for g in gs if g in vocabulary]] = 1
    y = np.eye(n_classes, dtype=np.float32)[[k for _, k in rows]]
    w, b = np.zeros((len(vocabulary), n_classes), dtype=np.float32), np.zeros(n_classes, dtype=np.float32)
    rate, l1 = 2.0, 4e-4
    for _ in range(150):  # proximal gradient steps
        p = soft(x @ w + b)
        w -= rate * x.T @ (p - y) / len(rows)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
        b -= rate * (p - y).mean(axis=0)
    held = examples(1)
    score = np.array([sum((w[vocabulary[g]] for g in sorted(gs) if g in vocabulary), b.copy()) for gs, _ in held])
    truth = np.array([k for _, k in held])
    losses = {t: -np.log(soft(score / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in np.linspace(0.2, 3, 57)}
    kept = {g: [round(float(v), 6) for v in w[i]] for g, i in vocabulary.items() if np.abs(w[i]).sum() > 1e-6}
    return kept, [round(float(v), 6) for v in b], round(float(min(losses, key=losses.get)), 3)


def soft(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def constant(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small frame of constants, as a literal."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def paragraph_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def runs(words: Column, n: int) -> Column:
    """All runs of n words, space-joined."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def anchored_grams(paragraphs: DataFrame, anchors: list[str]) -> DataFrame:
    """(paragraph, gram): the distinct n-grams that hold an anchor word; every weighted n-gram does."""
    at = paragraphs.select("paragraph", F.split("paragraph", " ").alias("ws"))
    at = at.withColumn("held", F.array_intersect("ws", F.array(*[F.lit(a) for a in anchors]))).withColumn("size", F.size("ws"))
    spots = F.filter(F.transform("ws", lambda w, i: F.when(F.array_contains(F.col("held"), w), i + 1)), lambda i: i.isNotNull())

    def around(i: Column) -> Column:
        made = [F.when((i - b >= 1) & (i - b + n - 1 <= F.col("size")), F.array_join(F.slice("ws", i - b, n), " ")) for n in range(1, LONGEST + 1) for b in range(n)]
        return F.array(*made)

    return at.select("paragraph", F.explode(F.array_distinct(F.array_compact(F.flatten(F.transform(spots, around))))).alias("gram"))


def texts_of(docs: DataFrame, id_col: str, text_col: str, anchors: list[str]) -> DataFrame:
    """(id_col, row, part, line, last_line, paragraph): of every row each line that holds an anchor word, and the joined
    words of lines with such words that lie at most one line apart in one paragraph, where there are several. row
    numbers the rows; part is the first line of the stretch that a line is in."""
    worded = F.transform(F.split(F.col(text_col), "\n", -1), paragraph_words)
    lines = docs.select(F.col(id_col), F.monotonically_increasing_id().alias("row"), worded.alias("lines"))
    holds = lambda ws: F.arrays_overlap(ws, F.array(*[F.lit(a) for a in anchors]))
    marked = F.filter(F.transform("lines", lambda ws, i: F.when(holds(ws), F.struct(i.alias("line"), ws.alias("ws")))), lambda x: x.isNotNull())
    lines = lines.withColumn("marked", marked).filter(F.size("marked") > 0)

    def begins(x: Column, i: Column) -> Column:
        """The line itself where a stretch begins, else null."""
        before = F.get(F.col("marked"), i - 1)["line"]
        near = (x["line"] - before == 1) | ((x["line"] - before == 2) & (F.size(F.get("lines", x["line"] - 1)) > 0))
        return F.when(~F.coalesce(near, F.lit(False)), x["line"])

    starts = F.array_compact(F.transform("marked", begins))
    lines = lines.select(id_col, "row", "lines", "marked", starts.alias("starts"))
    nth = F.sequence(F.lit(0), F.size("starts") - 1)

    def stretch(k: Column) -> Column:
        first, after = F.get("starts", k), F.coalesce(F.get("starts", k + 1), F.lit(2**31 - 1))
        own = F.filter("marked", lambda x: (x["line"] >= first) & (x["line"] < after))
        last = F.element_at(own, -1)["line"]
        single = F.transform(own, lambda x: F.struct(first.alias("part"), x["line"].alias("line"), x["line"].alias("last_line"), F.array_join(x["ws"], " ").alias("paragraph")))
        whole = F.struct(first.alias("part"), first.alias("line"), last.alias("last_line"), F.array_join(F.flatten(F.slice("lines", first + 1, last - first + 1)), " ").alias("paragraph"))
        return F.when(last > first, F.array_append(single, whole)).otherwise(single)

    return lines.select(id_col, "row", F.inline(F.flatten(F.transform(nth, stretch))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """One row for each licence notice: id, line and last_line (from 0), family, predicted, probability, similarity
    (largest share of a template's shingles in it) and confirmed.

    Every line whose predicted family has a probability of ``least`` or more and is confirmed is a notice; so is a stretch
    of several lines (see :func:`texts_of`) unless one of its lines is confirmed with the same family. A line whose
    prediction is not confirmed, in a stretch where nothing is, is a row of family ``unknown``. Texts without any
    weighted n-gram give no row, so null, empty and other texts give none. Repeated rows and notices each give their
    rows. Other columns are not read.
    """
    spark = docs.sparkSession
    weights, offsets, temperature = trained()
    families = sorted(TEMPLATES)
    anchors = sorted({w for g in weights for w in g.split() if w not in COMMON})
    held = checkpoint(texts_of(docs, id_col, text_col, anchors))
    distinct = checkpoint(held.groupBy("paragraph").agg(F.count("*").alias("n")))
    table = constant(spark, [{"gram": g, "w": w} for g, w in sorted(weights.items())], "gram:string,w:array<double>")
    met = anchored_grams(distinct, anchors).join(F.broadcast(table), "gram")
    n = len(families) + 1
    sums = met.groupBy("paragraph").agg(*[F.sum(F.get("w", k).cast("decimal(18,6)")).cast("double").alias(f"s{k}") for k in range(n)])
    logits = [(F.col(f"s{k}") + F.lit(offsets[k])) / F.lit(temperature) for k in range(n)]
    sums = sums.withColumn("z", F.array(*logits)).withColumn("most", F.array_max("z"))
    sums = sums.withColumn("e", F.transform("z", lambda v: F.exp(v - F.col("most")))).withColumn("z", F.aggregate("e", F.lit(0.0), lambda a, v: a + v))
    top = F.array_max(F.transform("e", lambda v, k: F.struct(v.alias("e"), (-k).alias("k"))))
    ranked = sums.withColumn("top", top).select("paragraph", F.element_at(F.array(*[F.lit(f) for f in [*families, UNKNOWN]]), (1 - F.col("top.k")).cast("int")).alias("predicted"), F.round(F.col("top.e") / F.col("z"), 6).alias("probability"))
    named = ranked.filter((F.col("predicted") != UNKNOWN) & (F.col("probability") >= least))
    shapes = [{"predicted": f, "shape": sorted({" ".join(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))})} for f in families for t in TEMPLATES[f] for w in [words_of(t)]]
    templates = constant(spark, shapes, "predicted:string,shape:array<string>")
    own = F.array_union(runs(F.split("paragraph", " "), SHINGLE), F.array("paragraph"))
    alike = named.withColumn("own", own).join(F.broadcast(templates), "predicted")
    alike = alike.groupBy("paragraph", "predicted", "probability").agg(F.round(F.max(F.size(F.array_intersect("own", "shape")) / F.size("shape")), 6).alias("similarity"))
    dims = checkpoint(alike.join(distinct, "paragraph").select("paragraph", "predicted", "probability", "similarity", (F.col("similarity") >= CONFIRM).alias("confirmed"), "n"))
    found = hot_lookup(held, dims, "paragraph", "n", held.count()).filter(F.col("predicted").isNotNull()).drop("paragraph")
    part = Window.partitionBy("row", "part")
    whole = F.col("last_line") > F.col("line")
    found = found.withColumn("any", F.max("confirmed").over(part))
    found = found.withColumn("line_has_it", F.max(F.col("confirmed") & ~whole).over(Window.partitionBy("row", "part", "predicted")))
    stays = F.when(F.col("confirmed"), ~whole | ~F.col("line_has_it")).otherwise(~whole & ~F.col("any"))
    family = F.when(F.col("confirmed"), F.col("predicted")).otherwise(UNKNOWN)
    out = found.filter(stays)
    return out.select(id_col, F.col("line").cast("int").alias("line"), F.col("last_line").cast("int").alias("last_line"), family.alias("family"), "predicted", "probability", "similarity", "confirmed")


def op6(docs: DataFrame) -> DataFrame:
    """All licence notices in all documents; nulls, empty texts and repeats as in :func:`scan`."""
    return scan(docs.select("doc_id", "text"))
