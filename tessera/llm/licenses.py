"""License scans: a trained paragraph classifier with an unknown class, confirmed against templates; DataFrame functions only.

Model. Multinomial logistic regression on the word 1- to 3-grams of a paragraph, trained on the driver on SAMPLES
altered copies of each template line (words dropped, cut short, surrounded by other prose) against as many rows of the
unknown class: sentences that use the same words otherwise, prose of common words, and words of templates in random
order. Its temperature is fitted on held-out copies, so that probabilities are calibrated; what the unknown class or no
class wins at FLOOR is unknown. The model is sparse: grams are features if training rows have them twice and they hold a
word of the licence rows other than the COMMON ones of prose. A paragraph without such a word has no feature and is
unknown, so that only paragraphs with one are scored.

Confirmation. The share of the word pairs of a family's template that the paragraph has, at best over its templates;
CONFIRMED or more confirms the prediction.

Paragraphs are lines, and, for notices that are wrapped, the joined runs of lines of up to WRAPPED characters between
blank or longer ones. Joined lines say nothing more where one of them is confirmed for their family. Each different
paragraph is scored once. Null and empty texts have no findings; rows that repeat (id and text) have the findings of
each; other columns stay out of it.
"""

from __future__ import annotations

import collections
import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut

SAMPLES = 12
FLOOR = 0.5
CONFIRMED = 0.5
#: Characters of a line that may be part of a wrapped paragraph.
WRAPPED = 160

#: Lines by which licences are told, by family (fixed values).
TEMPLATES = {
    "agpl": ["This program is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "boost": ["Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"],
    "bsd": ["Released under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "Text is available under the Creative Commons Attribution-ShareAlike License."],
    "cc0": ["Dedicated to the public domain under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "Dieses Programm ist freie Software und steht unter der GNU General Public License, Version 3.", "Ce programme est un logiciel libre sous la GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License.", "SPDX-License-Identifier: ISC"],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only"],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "SPDX-License-Identifier: MIT"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "proprietary": ["All rights reserved.", "Copyright (c) 2021 Example Corporation. All rights reserved.", "No part of this publication may be reproduced without the prior written permission of the publisher."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
    "zlib": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", "SPDX-License-Identifier: Zlib"],
}

#: Sentences that use the words otherwise (fixed values).
OTHERWISE = [
    "He renewed his driver license last week and paid the fee.",
    "A fishing license costs ten dollars in this county.",
    "The court discussed copyright law at length in the ruling.",
    "Please ask for permission before you enter the room.",
    "The car comes with a two year warranty on all parts.",
    "She studied physics at MIT and moved to Boston.",
    "The apache helicopter landed on the public road.",
    "The bar lost its license to sell beer and wine.",
    "Their version of the story was free of charge and terms.",
    "The gnu is a large antelope found in the general region.",
    "Civil rights groups said the table was reserved for them.",
    "The permission slip must be signed by a parent.",
    "Mozilla released a new version of its browser today.",
    "The pilot got a commercial license and related papers.",
    "Creative people share common ideas about the work.",
    "Copyright is one of the rights which students learn about.",
    "The software was redistributed among the members of the club.",
    "The land is in the public domain and open to visitors.",
]

#: Common words of English, German, French and Spanish (fixed values).
COMMON = (
    "a about after all an and any are as at be been but by can do first for from had has have he her his how if in into is it its may more no not of on one only or other our out she so some than that the their them then there these they this to up was we were what when which who will with would you "
    "als auch auf aus bei das dem den der des die ein eine einer es für hat ich im in ist mit nach nicht nur oder sich sie sind so und von war wie wird zu zum "
    "au aux avec ce cette dans de des du elle en est et il la le les mais ne ou par pas plus pour que qui se son sont sur un une vous "
    "al como con de del el en es esta la las lo los más no para pero por que se su sus un una y"
).split()
_LETTERS = re.compile(r"(?:[^\w.+]|_)+|\.(?!\w)")


def _words(text: str) -> list[str]:
    """As ``words`` does on columns."""
    return [w for w in _LETTERS.sub(" ", text.lower()).split(" ") if w]


def _grams(words: list[str], telling: frozenset[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1) if not telling.isdisjoint(words[i : i + n])}


@lru_cache(maxsize=1)
def trained() -> tuple[list[str], dict[str, list[float]], list[float], list[str]]:
    """Families (unknown last), weights of each gram by family, and biases, temperature taken in; and the telling words."""
    rng = random.Random(11)
    families = [*TEMPLATES, "unknown"]
    unknown = len(families) - 1
    lines = [(line, c) for c, f in enumerate(families[:-1]) for line in TEMPLATES[f]]
    pool = [w for line, _ in lines for w in line.split()]

    def prose(n: int) -> list[str]:
        return rng.choices(COMMON, k=n) if rng.random() < 0.5 else rng.choices(" ".join(OTHERWISE).split(), k=n)

    def altered(line: str) -> str:
        words = [w for w in line.split() if rng.random() > 0.06]
        if len(words) > 8 and rng.random() < 0.3:
            words = words[: rng.randrange(6, len(words))]
        return " ".join(prose(rng.choice((0, 0, 0, 4, 10))) + words + prose(rng.choice((0, 0, 0, 4, 10))))

    rows = [(altered(line), c) for line, c in lines for _ in range(SAMPLES)]
    # the templates as they stand weigh half as much as their altered copies
    rows += [row for row in lines for _ in range(SAMPLES // 2)]
    others = [lambda: altered(rng.choice(OTHERWISE)), lambda: " ".join(prose(rng.randrange(5, 40))), lambda: " ".join(rng.choices(pool, k=rng.randrange(3, 25)))]
    rows += [(others[i % 3](), unknown) for i in range(len(rows))]

    telling = frozenset(w for line, _ in lines for w in _words(line)) - set(COMMON)
    rng.shuffle(rows)
    held = len(rows) // 5
    found = [_grams(_words(t), telling) for t, _ in rows]
    often = collections.Counter(g for grams in found for g in grams)
    # a gram of a single row would only learn that row by heart
    grams = sorted(g for g, n in often.items() if n > 1)
    place = {g: i for i, g in enumerate(grams)}
    x = np.zeros((len(rows), len(grams) + 1), np.float32)
    for r, own in enumerate(found):
        x[r, [place[g] for g in own if g in place]] = 1
    x[:, -1] = 1
    y = np.eye(len(families), dtype=np.float32)[[c for _, c in rows]]

    def soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    w = np.zeros((x.shape[1], len(families)), np.float32)
    a, b = x[held:], y[held:]
    for _ in range(250):
        w -= 2.0 * (a.T @ (soft(a @ w) - b) / len(a) + 1e-4 * w)
    z = x[:held] @ w
    temperature = min((t for t in np.geomspace(0.2, 5, 60)), key=lambda t: -np.log(np.maximum(1e-12, (soft(z / t) * y[:held]).sum(1))).mean())
    w /= temperature
    return families, {g: w[i].tolist() for g, i in place.items()}, w[-1].tolist(), sorted(telling)


def words(text: Column) -> Column:
    """Lower-case words of letters, digits, pluses and inner dots."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}.+]+|\.(?![\p{L}\p{N}])", " "), " "), lambda w: w != "")


def _model_frame(spark: SparkSession) -> DataFrame:
    """(gram, weights) of the model; it has the grams of its training rows, so its size doesn't grow with the corpus."""
    _, weights, _, _ = trained()
    return spark.createDataFrame([(g, w) for g, w in weights.items()], "gram string, weights array<double>")


def findings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, line, paragraph, family, probability, likeness, confirmed) of the paragraphs told to be licence lines.

    h is a hash of the whole text, line the position from 0 of the paragraph's first line.
    """
    spark = docs.sparkSession
    families, _, bias, telling = trained()
    tells = lambda text: F.exists(words(text), lambda w: w.isin(telling))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("h"), F.split("text", "\n").alias("lines"))
    rows = rows.withColumn("told", F.transform("lines", tells)).filter(F.exists("told", lambda t: t))
    none = F.array().cast("array<string>")
    single = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("line"), x.alias("paragraph"), none.alias("parts"))), lambda s: F.element_at("told", s["line"] + 1))
    # lines get their position and whether they tell in front; a line of \x01 alone ends a run
    ends = lambda x: (F.trim(F.translate(x, "\r\t", "  ")) == "") | (F.length(x) > WRAPPED)
    marked = F.transform("lines", lambda x, i: F.when(ends(x), F.lit("\x01")).otherwise(F.concat(i.cast("string"), F.when(F.element_at("told", i + 1), F.lit("\x03")).otherwise(F.lit("\x02")), x)))
    blocks = F.filter(F.transform(F.split(F.array_join(marked, "\n"), "(?m)^\x01$"), lambda b: F.filter(F.split(b, "\n"), lambda x: x != "")), lambda b: (F.size(b) > 1) & F.exists(b, lambda x: x.rlike("^[0-9]+\x03")))
    bare = lambda b: F.transform(b, lambda x: F.regexp_replace(x, "^[0-9]+[\x02\x03]", ""))
    blocks = F.transform(blocks, lambda b: F.struct(F.regexp_extract(b[0], "^([0-9]+)", 1).cast("int").alias("line"), F.array_join(bare(b), " ").alias("paragraph"), bare(b).alias("parts")))
    lines = cut(rows.select("doc_id", "h", F.inline(F.concat(single, blocks))).distinct())

    # of few bytes, which would be left to one task
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = lines.select("paragraph").repartition(parts, "paragraph").distinct().withColumn("w", words(F.col("paragraph")))
    grams = F.array_distinct(F.flatten(F.transform(F.array(*map(F.lit, (1, 2, 3))), lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))).otherwise(F.array().cast("array<string>")))))
    k = len(families)
    scored = each.select("paragraph", F.explode(grams).alias("gram")).join(F.broadcast(_model_frame(spark)), "gram")
    scored = scored.groupBy("paragraph").agg(F.array(*[F.sum(F.col("weights")[c]) + F.lit(bias[c]) for c in range(k)]).alias("z"))
    likely = F.transform("z", lambda z: F.exp(z - F.array_max("z")))
    total = F.aggregate(likely, F.lit(0.0), lambda s, e: s + e)
    best = F.array_max(F.transform(likely, lambda e, i: F.struct((e / total).alias("probability"), F.element_at(F.array(*map(F.lit, families)), i + 1).alias("family"))))
    told = scored.select("paragraph", best.alias("b")).select("paragraph", "b.family", "b.probability").filter((F.col("family") != "unknown") & (F.col("probability") >= FLOOR))

    templates = [(f, [list(p) for p in zip(w, w[1:])]) for f, given in TEMPLATES.items() for w in map(_words, given)]
    templates = spark.createDataFrame([(f, sorted({" ".join(p) for p in pairs})) for f, pairs in templates], "family string, pairs array<string>")
    w = words(F.col("paragraph"))
    own = F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.array_join(F.slice(w, i, F.lit(2)), " "))).otherwise(F.array().cast("array<string>"))
    told = told.withColumn("own", own).join(F.broadcast(templates), "family")
    told = told.groupBy("paragraph", "family", "probability").agg(F.max(F.size(F.array_intersect("pairs", "own")) / F.greatest(F.size("pairs"), F.lit(1))).alias("likeness"))
    told = told.withColumn("confirmed", F.col("likeness") >= CONFIRMED)
    found = cut(lines.join(told, "paragraph").select("doc_id", "h", "line", "paragraph", "family", "probability", "likeness", "confirmed", "parts"))
    known = found.filter((F.size("parts") == 0) & F.col("confirmed")).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.col("family").alias("_family"), F.col("paragraph").alias("_line")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")) & (F.col("family") == F.col("_family")) & F.array_contains("parts", F.col("_line"))
    return found.join(known, same, "left_anti").drop("parts")


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_paragraphs, families, probability) per row: confirmed licence lines, their families in order joined by commas, and the best probability (0 if none)."""
    found = findings(docs, id_col=id_col, text_col=text_col).filter("confirmed")
    found = found.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("f"), F.max("probability").alias("p"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("h"))
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    return rows.select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_paragraphs"), F.coalesce("f", F.lit("")).alias("families"), F.round(F.coalesce("p", F.lit(0.0)), 6).alias("probability"))
