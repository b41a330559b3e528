"""Licence scans by a trained paragraph classifier, in DataFrame functions only.

Sparse multinomial logistic regression over the words and word pairs that occur in a paragraph tells licence families from
the class `unknown`. It is fitted on the driver: on sentences that name a family's licences in the ways of GRANTS, on the notices of
PASSAGES, and, as unknown, on sentences that only mention licences and on a bounded sample of the corpus's own paragraphs. Proximal
gradient steps with an L1 penalty leave few weights; a temperature then calibrates the probabilities on sentences and
paragraphs held out of the fit. A prediction stands if a licence is likelier than unknown and a template of the
predicted family confirms it: the paragraph holds most of the template's word pairs.

A paragraph is a run of lines: a line that doesn't end a sentence goes on in the next line, so wrapped notices stay whole.
A paragraph that a template can confirm holds one of a few words, which become a pattern
that filters the texts, so little else is split into words. Weights and template pairs are one small table, bounded by the
templates and the sample, that is broadcast.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmend.llm.columns import keyed_text

UNKNOWN = "unknown"
# What licences are called, by family; the first is the identifier of the SPDX list.
NAMES = {
    "agpl-3.0": ("AGPL-3.0", "GNU Affero General Public License", "GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPLv3"),
    "apache-2.0": ("Apache-2.0", "Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache Software License"),
    "artistic-2.0": ("Artistic-2.0", "Artistic License 2.0", "Artistic License"),
    "bsd-2-clause": ("BSD-2-Clause", "BSD 2-Clause License", "Simplified BSD License", "FreeBSD License"),
    "bsd-3-clause": ("BSD-3-Clause", "BSD 3-Clause License", "New BSD License", "Modified BSD License", "BSD License"),
    "bsl-1.0": ("BSL-1.0", "Boost Software License, Version 1.0", "Boost Software License"),
    "cc-by": ("CC-BY-4.0", "CC BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License"),
    "cc-by-nc": ("CC-BY-NC-4.0", "CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution NonCommercial License"),
    "cc-by-nc-sa": ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "cc-by-nd": ("CC-BY-ND-4.0", "CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "cc-by-sa": ("CC-BY-SA-4.0", "CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution ShareAlike License"),
    "cc0": ("CC0-1.0", "CC0 1.0 Universal", "CC0 1.0 Universal Public Domain Dedication", "CC0 license"),
    "epl": ("EPL-2.0", "Eclipse Public License", "Eclipse Public License 2.0", "Eclipse Public License v2.0"),
    "gpl-2.0": ("GPL-2.0", "GNU General Public License, version 2", "GNU General Public License v2", "GNU GPL v2", "GPLv2"),
    "gpl-3.0": ("GPL-3.0", "GNU General Public License, version 3", "GNU General Public License v3", "GNU GPL v3", "GPLv3"),
    "isc": ("ISC", "ISC License", "Internet Systems Consortium License"),
    "lgpl": ("LGPL-3.0", "GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "GNU LGPL", "LGPLv3", "LGPL-2.1"),
    "mit": ("MIT", "MIT License", "Expat License", "MIT Licence"),
    "mpl-2.0": ("MPL-2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "Mozilla Public License, version 2.0"),
    "ofl-1.1": ("OFL-1.1", "SIL Open Font License, Version 1.1", "SIL Open Font License"),
    "unlicense": ("Unlicense", "Unlicense License"),
    "wtfpl": ("WTFPL", "Do What The Fuck You Want To Public License"),
    "zlib": ("Zlib", "zlib License", "zlib/libpng License"),
    "proprietary": ("LicenseRef-Proprietary",),
}
# Passages of the licences' own texts and notices.
PASSAGES = (
    ("agpl-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-2-clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsl-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    ("gpl-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("gpl-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mit", "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("ofl-1.1", "This Font Software is licensed under the SIL Open Font License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("proprietary", "All rights reserved"),
    ("proprietary", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential"),
)
# How a licence is granted, and how it is only mentioned. Each third sentence is held out of the fit, to calibrate.
GRANTS = (
    "Released under the {}.", "Licensed under the {}.", "This work is licensed under the {}.", "Licensed under {}.", "Distributed under the terms of the {}.", "It is available under the {}.",
    "This project is licensed under the terms of the {}.", "Released under {}.", "This library is free software under the {}.", "The code may be used under the {}.", "Made available under the {}.", "License: {}",
    "This project uses the {}.", "Published under the {} by its authors.", "Use of this file is governed by the {}.",
)
MENTIONS = (
    "An article about the {}.", "He compared the {} with others in his talk.", "The {} was written by lawyers.", "Is the {} a good choice?", "History of the {}", "She doesn't like the {}, as everybody knows.",
)
LOOKALIKES = (
    "He lost his driving license in May.", "The license plate was found under the bridge.", "A professor at MIT released a paper under her own name.", "The Apache helicopter was hit under fire.",
    "The general public may use this door.", "This work is for the public and for general use.", "The software was released in version 3 under a new name.", "You may obtain a copy of the paper at the library.",
    "The conditions are met with or without your permission.", "See the license for details.", "The GNU project is old.", "The following version of this work is under review.",
    "Under the law she reserved a table for all.", "The rights of the public are reserved for members.", "The file was released under pressure.", "A boost for software makers came from the new public fund.",
)


class Licences(NamedTuple):
    families: list[str]
    bias: list[float]  # unknown's is the last
    weights: dict[str, list[float]]  # by word or pair; unknown's are the last
    triggers: list[str]
    least_cover: float


def words_of(paragraph: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", paragraph.lower()) if w]


def pairs_of(words: list[str]) -> set[str]:
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


def features_of(paragraph: str) -> list[str]:
    words = words_of(paragraph)
    return sorted({*words} | pairs_of(words))


def templates() -> list[tuple[str, frozenset[str]]]:
    """Family and word pairs of each text that can confirm it."""
    out = []
    for family, (spdx, *names) in NAMES.items():
        texts = [f"SPDX-License-Identifier: {spdx}", *(f"{before} {name}" for name in (spdx, *names) if len(names) for before in ("under", "under the", "license"))]
        out += [(family, frozenset(pairs_of(words_of(t)))) for t in texts]
    return out + [(family, frozenset(pairs_of(words_of(t)))) for family, t in PASSAGES]


def sentences(held_out: bool) -> list[tuple[str, str]]:
    """Family and text of what the model learns from, or of what calibrates it."""
    out = []
    for family, (spdx, *names) in NAMES.items():
        every = [g.format(n) for n in (*names, spdx) if names for g in GRANTS]
        out += [(family, t) for k, t in enumerate(every) if (k % 3 == 2) == held_out]
        out += [(UNKNOWN, m.format(n)) for k, n in enumerate(names) for j, m in enumerate(MENTIONS) if ((j + k) % 3 == 2) == held_out]
        out.append((family, f"SPDX-License-Identifier: {spdx}"))
    out += [(UNKNOWN, t) for k, t in enumerate(LOOKALIKES) if (k % 3 == 2) == held_out]
    return out + ([] if held_out else list(PASSAGES))


def softmax(scores: np.ndarray) -> np.ndarray:
    parts = np.exp(scores - scores.max())
    return parts / parts.sum()


def train(rows: list[tuple[np.ndarray, int]], features: int, classes: int, rounds: int = 16, rate: float = 0.8, penalty: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Bias and weights by stochastic proximal gradient; rows in the order given, so runs are alike."""
    weights, bias = np.zeros((features, classes)), np.zeros(classes)
    bias[-1] = 1.0
    for t in range(rounds):
        step = rate / (1 + t / 8)
        for at, label in rows:
            errors = softmax(bias + weights[at].sum(axis=0))
            errors[label] -= 1
            if np.abs(errors).max() < 0.01:
                continue
            bias -= 0.1 * step * errors
            weights[at] -= step * errors / math.sqrt(len(at) + 1)
        weights = np.sign(weights) * np.maximum(0.0, np.abs(weights) - step * penalty)
    return bias, weights


def temperature(rows: list[tuple[np.ndarray, int]], bias: np.ndarray, weights: np.ndarray) -> float:
    """By what to divide scores so that held-out rows have the least loss."""
    scores = [(bias + weights[at].sum(axis=0), label) for at, label in rows]
    grid = [2 ** (k / 4) for k in range(-8, 13)]
    return min(grid, key=lambda t: (sum(-math.log(max(1e-12, softmax(s / t)[label])) for s, label in scores), t))


def covering(common: dict[str, int], least_cover: float) -> list[str]:
    """Words one of which every paragraph has that holds a share of least_cover of a template's pairs: fewer of its pairs than that are
    without them. Words that are long and rare in the corpus are preferred."""
    open_ = [(pairs, least_cover * len(pairs) - 1e-6) for _, pairs in templates()]  # pairs without a chosen word, and how many are too many
    chosen: list[str] = []
    while open_:
        worth: dict[str, float] = {}
        for pairs, bound in open_:
            for w in {w for p in pairs for w in p.split()}:
                worth[w] = worth.get(w, 0) + sum(w in p.split() for p in pairs) / len(pairs)
        best = min(worth, key=lambda w: ((1 + common.get(w, 0)) * (1 if len(w) > 5 else 30 / len(w)) / worth[w], w))
        chosen.append(best)
        left = [(frozenset(p for p in pairs if best not in p.split()), bound) for pairs, bound in open_]
        open_ = [(pairs, bound) for pairs, bound in left if len(pairs) >= bound]
    return sorted(chosen)


def paragraphs_of(text: Column) -> Column:
    """An array of paragraphs: a line break between a character that ends no sentence and one that is not blank is no border."""
    return F.split(F.regexp_replace(text, r"(?<![.!?:;\s])[ \t]*\n(?=\S)", " "), "\n")


def fit(docs: DataFrame, sample_rows: int = 400, unknown_rows: int = 2_000, least_cover: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> Licences:
    """Fits on the sentences above and, as unknown, on unknown_rows paragraphs at most of about sample_rows documents, both chosen by a hash.

    Half of those paragraphs calibrates. A paragraph that holds half of a template is taken for neither. least_cover is the share of a
    template's pairs that confirms.
    """
    rows = keyed_text(docs, id_col, text_col).where(F.col("text").isNotNull())
    there, grain = rows.select("doc_id").count(), 1 << 30
    share = min(1.0, sample_rows / max(1, there))
    sample = rows.where(F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0))), F.lit(grain)) < int(share * grain))
    drawn = sample.select(F.explode(paragraphs_of(F.col("text"))).alias("p")).where(F.trim("p") != "").distinct().orderBy(F.xxhash64("p"), "p").limit(unknown_rows)
    confirming = templates()
    corpus = []
    for (paragraph,) in drawn.toLocalIterator():
        found = features_of(paragraph)
        pairs = {f for f in found if " " in f}
        if found and not any(len(t & pairs) >= 0.5 * len(t) for _, t in confirming):
            corpus.append(found)
    seen: dict[str, int] = {}
    for found in corpus:
        for f in found:
            seen[f] = seen.get(f, 0) + 1
    learnt, held = sentences(False), sentences(True)
    # a feature needs a word that is rare in the corpus, so that the filter stays selective
    rare = {w for _, t in learnt for w in words_of(t) if len(w) > 1 and seen.get(w, 0) <= 0.002 * len(corpus)}
    known = sorted(f for f in {f for _, t in learnt for f in features_of(t)} if rare & set(f.split()))
    number = {f: i for i, f in enumerate(known)}
    families = sorted(NAMES)
    label = {f: k for k, f in enumerate([*families, UNKNOWN])}

    def row(found: list[str], family: str) -> tuple[np.ndarray, int]:
        return np.array([number[f] for f in found if f in number], np.int64), label[family]

    spoken = [row(features_of(t), f) for f, t in learnt]
    plain = [row(f, UNKNOWN) for f in corpus[::2]]
    mixed = []
    for i in range(max(len(spoken), len(plain))):  # each among the other
        mixed += spoken[i : i + 1] + plain[i : i + 1]
    bias, weights = train(mixed, len(known), len(label))
    heat = temperature([row(features_of(t), f) for f, t in held] + [row(f, UNKNOWN) for f in corpus[1::2]], bias, weights)
    bias, weights = bias / heat, weights / heat
    if bias[:-1].max() >= bias[-1]:
        raise ValueError("a paragraph without evidence must be unknown")
    model = {f: weights[i].tolist() for f, i in number.items() if np.abs(weights[i]).max() > 0}
    return Licences(families, bias.tolist(), model, covering(seen, least_cover), least_cover)


def trie_pattern(words: list[str]) -> str:
    """One expression for many words that looks at each letter once."""
    by: dict[str, list[str]] = {}
    for w in words:
        if w:
            by.setdefault(w[0], []).append(w[1:])
    parts = [c + trie_pattern(rest) for c, rest in sorted(by.items())]
    if not parts:
        return ""
    inner = parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"
    return f"(?:{inner})?" if "" in words else inner


def filter_of(lowered: Column, triggers: list[str]) -> Column:
    """Whether a text has one of the words, between other characters than letters and digits."""
    return F.rlike(lowered, F.lit(f"(?<![a-z0-9])(?:{trie_pattern(triggers)})(?![a-z0-9])")) if triggers else F.lit(False)


def table_of(spark: SparkSession, model: Licences) -> DataFrame:
    """feature, slot, value: a feature's weights by class (slots from 0) and its share of each template that has it as a pair (slots behind)."""
    rows = [(f, k, float(x)) for f, ws in model.weights.items() for k, x in enumerate(ws) if x]
    first = len(model.families) + 1
    rows += [(p, first + i, 1.0 / len(pairs)) for i, (_, pairs) in enumerate(templates()) for p in sorted(pairs)]
    return spark.createDataFrame(rows, "feature string, slot int, value double")


def slots_of(spark: SparkSession, model: Licences) -> DataFrame:
    """slot, family, bias: the bias of classes, null for templates."""
    rows = [(k, f, b) for k, (f, b) in enumerate(zip([*model.families, UNKNOWN], model.bias))]
    rows += [(len(rows) + i, f, None) for i, (f, _) in enumerate(templates())]
    return spark.createDataFrame(rows, "slot int, family string, bias double")


def licence_paragraphs(docs: DataFrame, model: Licences, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a paragraph that grants a licence: doc_id, paragraph_no (from 0), family, probability, coverage (0 to 1, of the family's best template).

    Null, empty and other texts without a licence give no row. Null ids stay. Rows equal in id and text give their
    paragraphs once; rows of one id and other texts each give theirs. Of equally probable families the first by name is taken. Only the id and the
    text are read, so names of other columns don't matter; an empty table gives an empty result. A word counts once in
    a paragraph however often it is there, so notices are found in long paragraphs too.
    """
    spark, key = docs.sparkSession, ["doc_id", "paragraph_no", "h"]
    rows = keyed_text(docs, id_col, text_col).where(filter_of(F.lower("text"), model.triggers))
    paragraphs = rows.select("doc_id", F.posexplode(paragraphs_of(F.lower("text"))).alias("paragraph_no", "paragraph")).where(filter_of(F.col("paragraph"), model.triggers))
    # dealt out before the words are split, in as many parts as the session says: there is little to read and much to do
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    paragraphs = paragraphs.withColumn("h", F.xxhash64("paragraph")).repartition(parts, *key).dropDuplicates(key)
    words = paragraphs.select(*key, F.filter(F.split("paragraph", "[^a-z0-9]+"), lambda w: w != "").alias("words"))
    pairs = F.zip_with("words", F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    features = F.array_distinct(F.concat("words", F.filter(pairs, lambda p: p.isNotNull())))
    found = words.select(*key, F.explode(features).alias("feature")).join(F.broadcast(table_of(spark, model)), "feature")
    sums = found.groupBy(*key, "slot").agg(F.sum("value").alias("value")).join(F.broadcast(slots_of(spark, model)), "slot")
    by_family = sums.groupBy(*key, "family").agg(F.max(F.when(F.col("bias").isNotNull(), F.exp(F.col("value") + F.col("bias")) - F.exp("bias"))).alias("more"), F.max(F.when(F.col("bias").isNull(), F.col("value"))).alias("cover"))
    bias = F.element_at(F.create_map(*(F.lit(x) for f, b in zip([*model.families, UNKNOWN], model.bias) for x in (f, math.exp(b)))), F.col("family"))
    weighed = by_family.select(*key, "family", F.coalesce("more", F.lit(0.0)).alias("more"), (F.coalesce("more", F.lit(0.0)) + bias).alias("e"), F.coalesce("cover", F.lit(0.0)).alias("cover"))
    licence = F.when(F.col("family") != UNKNOWN, F.struct("e", "cover", "family"))
    first_by_name = F.max_by("family", F.when(F.col("family") != UNKNOWN, F.struct("e", F.expr(f"-array_position(array({', '.join(repr(f) for f in model.families)}), family)"))))
    told = weighed.groupBy(*key).agg(F.sum("more").alias("more"), F.max(F.when(F.col("family") == UNKNOWN, F.col("e"))).alias("none"), first_by_name.alias("family"), F.collect_list(licence).alias("all"))
    whole = F.col("more") + F.lit(sum(map(math.exp, model.bias)))
    mine = F.element_at(F.filter("all", lambda x: x["family"] == F.col("family")), 1)
    told = told.where(F.col("family").isNotNull()).select(*key, "family", (mine["e"] / whole).alias("probability"), mine["cover"].alias("coverage"), (F.coalesce("none", F.lit(math.exp(model.bias[-1]))) / whole).alias("unknown"))
    told = told.where((1 - F.col("unknown") >= least) & (F.col("probability") > F.col("unknown")) & (F.col("coverage") >= model.least_cover - 1e-9))
    return told.select("doc_id", F.col("paragraph_no").cast("long").alias("paragraph_no"), "family", F.round("probability", 6).alias("probability"), F.round(F.least("coverage", F.lit(1.0)), 6).alias("coverage"))
