"""Licence notices found by a trained paragraph classifier, in DataFrame operations alone.

A paragraph is a line of a text. Its features are the distinct words, word pairs and triples of its normal
form (lower case, each number one 0, anything but letters a gap). A multinomial logistic regression with an L1
penalty, fitted on the driver to perturbed pieces of the ``TEMPLATES`` and to prose, tells licence families
from the class ``unknown``; a temperature and the least probability of a family are calibrated on pieces that
training has not seen. The paragraph is then compared with the templates of the predicted family: only where
enough of the shorter one's features are in the other is the prediction confirmed.

The weights are sparse. A paragraph in which no feature speaks for any family gets the class ``unknown`` by
the biases alone, so a pattern made of the words of such features tells exactly which paragraphs need no scoring.
Scoring is one expression a row: nothing shuffles and nothing is joined.
"""

from __future__ import annotations

import json
import random
import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.llm.text import whole

# The usual wording of public licence notices, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0.",
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
        "Released under the 3-clause BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License",
        "Licensed under CC BY-SA 4.0.",
        "https://creativecommons.org/licenses/by/4.0/",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "Released under CC BY-NC-SA 4.0 for non-commercial use only.",
        "https://creativecommons.org/licenses/by-nc/4.0/",
    ),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal.",
        "Dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication.",
        "This work is released into the public domain under CC0.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GPL version 2 or any later version.",
        "Licensed under the GPLv3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "Released under the LGPL version 3.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "proprietary": (
        "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher.",
        "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "Proprietary license. All rights reserved.",
    ),
}
# Prose that shares words with notices, and function words that are no feature by themselves.
PROSE = (
    "The officer asked for a driving license and the license plate number of the car.",
    "Students at MIT and other universities met to discuss the public library.",
    "The Apache helicopter flew over the general area for a version of the exercise.",
    "The company released a new version of its software under budget this year.",
    "She has permission to copy the file and work at the public office.",
    "A commercial fishing license is required by law in this region of the country.",
    "The work of the foundation is free and open to any person in the community.",
    "They licensed the technology to several partners for use in their products.",
    "The copyright debate went on in parliament, and the notice was published later.",
    "He was the author of the terms used in this form of public domain mapping.",
    "Attribution of the painting to the master is subject to international dispute.",
    "Mozilla hired people to work on the source code of the browser.",
    "All the conditions were met and the following list was included in the project.",
    "The names of contributors and the holder of the record are known to the general public.",
    "The restriction on redistribution of land was not part of the original declaration.",
    "Reserved seats and rights of way were obtained along with copies of the map.",
)
STOP = frozenset("a above all along an and any any are as at be by can for form forms from has have http https if in into is it its may must no not of on one only or other part should that the their this to under was were with without www you your file list one received shall use used".split())
UNKNOWN, BUCKETS, LEAST_OVERLAP = "unknown", 1024, 0.6
FAMILIES = (UNKNOWN, *sorted(TEMPLATES))
NUMBER = r"[0-9]+(?:\.[0-9]+)*"


def normal_words(paragraph: str) -> list[str]:
    """The words of the normal form."""
    text = re.sub(r"[0-9]+(\.[0-9]+)*", "0", paragraph.lower())
    return [w for w in re.sub(r"[\W1-9_]+", " ", text).split(" ") if w]


def grams(words: list[str]) -> set[str]:
    """Words and runs of two and three words."""
    return set(words) | set(map(" ".join, zip(words, words[1:]))) | set(map(" ".join, zip(words, words[1:], words[2:])))


def speaks(gram: str) -> bool:
    """Whether a gram is a feature: function words and numbers alone are none."""
    return any(w not in STOP and w != "0" for w in gram.split(" "))


@dataclass(frozen=True)
class Model:
    """weights[gram] holds the families' log-odds against ``unknown``, in the order of FAMILIES[1:]."""

    weights: dict[str, tuple[float, ...]]
    bias: tuple[float, ...]
    least: float  # calibrated probability from which a family is predicted

    def cues(self) -> str:
        """A pattern that every paragraph matches in which some feature speaks for a family."""
        words = {max(g.split(" "), key=lambda w: (w not in STOP, len(w), w)) for g, w in self.weights.items() if max(w) > 0}
        return r"(?<![a-z])" + trie_pattern(sorted(words)) + r"(?![a-z])"

    def buckets(self) -> list[list[dict]]:
        """Features by CRC-32 bucket, for look-ups that take constant time."""
        out: list[list[dict]] = [[] for _ in range(BUCKETS)]
        for gram, w in sorted(self.weights.items()):
            out[zlib.crc32(gram.encode()) % BUCKETS].append({"gram": gram, "w": list(w)})
        return out


def trie_pattern(words: list[str]) -> str:
    """A pattern of alternatives that share their first letters; 0 stands for any number."""
    heads: dict[str, list[str]] = {}
    for w in filter(None, words):
        heads.setdefault(w[0], []).append(w[1:])
    parts = [(NUMBER if c == "0" else re.escape(c)) + trie_pattern(rest) for c, rest in sorted(heads.items())]
    return "" if not parts else "(?:" + "|".join(parts) + ")" + "?" * ("" in words)


def examples(seed: int, each: int = 60, prose: int = 900) -> list[tuple[list[str], int]]:
    """Pieces of templates with words lost and strange words around, and prose; each with its class."""
    r = random.Random(seed)
    strange = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(1, 9)))
    common = sorted(STOP) + sorted({w for p in PROSE for w in normal_words(p)})
    out = []
    for k, family in enumerate(FAMILIES[1:], 1):
        own = set().union(*(grams(normal_words(t)) for t in TEMPLATES[family]))
        others = set().union(*(grams(normal_words(t)) for f, ts in TEMPLATES.items() if f != family for t in ts))
        telling = {g for g in own - others if speaks(g)}
        for template in TEMPLATES[family]:
            words = normal_words(template)
            for i in range(each):
                n = len(words) if i % 2 else r.randint(min(5, len(words)), len(words))
                at = r.randrange(len(words) - n + 1)
                piece = [w for w in words[at : at + n] if i % 4 == 1 or r.random() > 0.04]
                if not grams(piece) & telling:  # a piece that says nothing of its family
                    continue
                around = [strange() if r.random() < 0.7 else r.choice(common) for _ in range(r.choice((0, 0, 3, 12)))]
                cut = r.randint(0, len(around))
                out.append((around[:cut] + piece + around[cut:], k))
    for i in range(prose):
        words = normal_words(PROSE[i % len(PROSE)])
        if i % 3 == 0:
            words = [strange() for _ in range(r.randint(1, 40))]
        elif i % 3 == 1:
            words = [r.choice(common) if r.random() < 0.8 else strange() for _ in range(r.randint(3, 40))]
        else:
            words = [w for w in words if r.random() > 0.1]
        out.append((words, 0))
    return out


@lru_cache(maxsize=2)
def train(seed: int = 11, penalty: float = 2e-4, rounds: int = 400) -> Model:
    """Fit by accelerated proximal gradient steps; the same seed gives the same model."""
    seen = examples(seed)
    known = sorted({g for words, k in seen if k for g in grams(words)} & {g for ts in TEMPLATES.values() for t in ts for g in grams(normal_words(t))})
    column = {g: i for i, g in enumerate(g for g in known if speaks(g))}

    def matrix(rows: list[tuple[list[str], int]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(rows), len(column) + 1), np.float64)
        x[:, -1] = 1
        for i, (words, _) in enumerate(rows):
            x[i, [column[g] for g in grams(words) if g in column]] = 1
        return x, np.array([k for _, k in rows])

    def chances(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    x, y = matrix(seen)
    goal = np.eye(len(FAMILIES))[y]
    w = ahead = np.zeros((x.shape[1], len(FAMILIES)))
    step = 2 * len(x) / np.linalg.norm(x, 2) ** 2
    t = 1.0
    for _ in range(rounds):
        moved = ahead - step * (x.T @ (chances(x @ ahead) - goal)) / len(x)
        moved[:-1] = np.sign(moved[:-1]) * np.maximum(np.abs(moved[:-1]) - step * penalty, 0)
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        ahead, w = moved + (before - 1) / t * (moved - w), moved
    xc, yc = matrix(examples(seed + 1))
    z = xc @ w
    heats = np.geomspace(0.25, 4, 41)
    heat = heats[np.argmin([-np.log(chances(z * h)[np.arange(len(yc)), yc]).mean() for h in heats])]
    odds = np.round((w[:, 1:] - w[:, :1]) * heat, 6)
    bias = np.minimum(odds[-1], -0.1)  # unknown is what stands without evidence
    p = chances(z * heat)
    # The least threshold at which at most 1 in 500 pieces of prose passes for a family.
    least = float(np.clip(np.quantile(p[yc == 0][:, 1:].max(1), 0.998), 0.5, 0.9))
    weights = {g: tuple(odds[i].tolist()) for g, i in column.items() if np.abs(odds[i]).max() > 0}
    return Model(weights, tuple(bias.tolist()), round(least, 6))


def literal(value: object, schema: str) -> Column:
    """A nested constant; it is parsed once, when the plan is optimised."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def judge_paragraph(paragraph: Column, model: Model) -> Column:
    """Struct of family, probability and confirmed; ``family`` is ``unknown`` without a prediction."""
    text = F.regexp_replace(F.regexp_replace(F.lower(paragraph), r"[0-9]+(\.[0-9]+)*", "0"), r"[^\p{L}0]+", " ")
    words = F.filter(F.split(text, " "), lambda w: w != "")
    table = literal(model.buckets(), "array<array<struct<gram:string,w:array<double>>>>")

    def runs(some: Column, tails: Column, n: int) -> Column:
        """Each of ``some`` (runs of n - 1 words) followed by the word after it."""
        many = F.greatest(F.size(tails) - n + 1, F.lit(0))
        return F.zip_with(F.slice(some, 1, many), F.slice(tails, n, many), lambda a, b: F.concat_ws(" ", a, b))

    pairs = runs(words, words, 2)
    all_grams = F.array_distinct(F.concat(words, pairs, runs(pairs, words, 3)))
    templates = literal([[sorted(grams(normal_words(t))) for t in TEMPLATES[f]] for f in FAMILIES[1:]], "array<array<array<string>>>")
    found = lambda gs: F.flatten(F.transform(gs, lambda g: F.filter(F.element_at(table, (F.crc32(g.cast("binary")) % BUCKETS).cast("int") + 1), lambda e: e["gram"] == g)))
    odds = lambda gs: F.aggregate(found(gs), literal(list(model.bias), "array<double>"), lambda a, e: F.zip_with(a, e["w"], lambda x, y: x + y))

    def conclude(gs: Column, z: Column) -> Column:
        top = F.array_max(z)
        total = F.aggregate(z, F.exp(-F.greatest(top, F.lit(0.0))), lambda s, x: s + F.exp(x - F.greatest(top, F.lit(0.0))))
        chance = F.exp(top - F.greatest(top, F.lit(0.0))) / total
        at = F.array_position(z, top).cast("int")
        share = lambda t: F.size(F.array_intersect(t, gs)) / F.least(F.size(t), F.greatest(F.size(gs), F.lit(1)))
        alike = F.array_max(F.transform(F.element_at(templates, at), share))
        known = chance >= model.least
        return F.struct(
            F.when(known, F.element_at(F.array(*[F.lit(f) for f in FAMILIES[1:]]), at)).otherwise(UNKNOWN).alias("family"),
            F.when(known, chance).otherwise(1 - chance).alias("probability"), (known & (alike >= LEAST_OVERLAP)).alias("confirmed"),
        )

    one = F.transform(F.array(all_grams), lambda gs: F.struct(gs.alias("gs"), odds(gs).alias("z")))  # named once, used often
    return F.element_at(F.transform(one, lambda s: conclude(s["gs"], s["z"])), 1)


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """doc_id, n_paragraphs and notices (array of paragraph, family, probability, confirmed) of each row.

    ``notices`` holds the paragraphs, numbered from 0, that are predicted to be of a licence family. A null or empty text is one empty
    paragraph and has no notice. Repeated rows are scanned each; null ids stay null; an
    empty table gives no rows. Other columns are not read.
    """
    model = model or train()
    cue = model.cues()
    rows = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    lines = F.filter(F.transform(F.split("text", "\n"), lambda p, i: F.struct(i.alias("paragraph"), p.alias("text"))), lambda s: F.lower(s["text"]).rlike(cue))
    some = F.when(F.lower("text").rlike(cue), lines)
    judged = F.transform(some, lambda s: F.struct(s["paragraph"].alias("paragraph"), judge_paragraph(s["text"], model).alias("v")))
    flat = F.transform(F.filter(judged, lambda s: s["v"]["family"] != UNKNOWN), lambda s: F.struct(s["paragraph"].alias("paragraph"), s["v"]["family"].alias("family"), s["v"]["probability"].alias("probability"), s["v"]["confirmed"].alias("confirmed")))
    none = F.array().cast("array<struct<paragraph:int,family:string,probability:double,confirmed:boolean>>")
    return rows.select("doc_id", (F.length("text") - F.length(F.translate("text", "\n", "")) + 1).cast("long").alias("n_paragraphs"), F.coalesce(flat, none).alias("notices"))


def license_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_paragraphs, n_notices, family, families, probability and confirmed.

    Confirmed notices decide where there are any; ``family`` is that of the likeliest of them (the first on
    ties), ``unknown`` without a notice. ``families`` joins all found families in order.
    """
    scanned = scan_documents(docs, id_col, text_col)
    sure = F.filter("notices", lambda s: s["confirmed"])
    deciding = F.when(F.size(sure) > 0, sure).otherwise(F.col("notices"))
    first = F.array_sort(F.transform(deciding, lambda s: F.struct((-s["probability"]).alias("p"), s["paragraph"].alias("paragraph"), s["family"].alias("family"), s["confirmed"].alias("confirmed"))))
    scanned = scanned.withColumns({"__top": F.try_element_at(first, F.lit(1)), "families": F.array_join(F.array_sort(F.array_distinct(F.transform(deciding, lambda s: s["family"]))), ",")})
    return scanned.select(
        "doc_id", "n_paragraphs", F.size("notices").cast("long").alias("n_notices"), F.coalesce("__top.family", F.lit(UNKNOWN)).alias("family"), "families",
        F.round(F.coalesce(-F.col("__top.p"), F.lit(0.0)), 6).alias("probability"), F.coalesce("__top.confirmed", F.lit(False)).alias("confirmed"),
    )


def license_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per notice: doc_id, paragraph, family, probability, confirmed."""
    return scan_documents(docs, id_col, text_col).select("doc_id", F.explode("notices").alias("n")).select("doc_id", "n.*")
