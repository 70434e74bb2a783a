r"""Licence scan: a trained paragraph classifier, confirmed by template comparison, in DataFrame functions only.

A sparse logistic regression over word 1- to 3-grams is trained on the driver from licence templates (varied by dropping
and adding words), the same with their names masked and notices of other licences (both ``unknown``), sentences that
speak of licences without granting one, and a bounded sample of ordinary paragraphs (both ``none``). Its features are the
grams of the templates that ordinary paragraphs hardly have, so its weight table has a fixed size and is broadcast.

Texts are cut into paragraphs: lines, with wrapped ones joined, and long ones cut at sentence ends. Every paragraph is
classified. One that holds no feature in favour of a licence is ``none`` by the classifier itself, whose bias is
highest there; those that hold none of the words of such features are seen to be so without a score for each family.
Others get the family of highest probability; below a threshold, calibrated on whole templates and whole families that
training has not seen, the family is ``unknown``. A prediction is confirmed if a template of that family shares enough of
its grams.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_sample, materialize, pieces_over, text_or_empty

# Licence families and the notices that name or grant them.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "SPDX-License-Identifier: MIT",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "BSD": (
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "Public-Domain": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work (CC0).",
    ),
}
# Notices of licences that are no family here; the first are trained as unknown, the others calibrate.
OTHER_LICENCES = (
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0.",
    "Licensed under the Educational Community License, Version 2.0.",
    "This file is part of a package distributed under the Artistic License 2.0.",
    "Distributed under the Boost Software License, Version 1.0.",
    "Released under the Open Software License.",
    "SPDX-License-Identifier: EPL-1.0",
    "SPDX-License-Identifier: Artistic-2.0",
)
UNSEEN_LICENCES = (
    "Released under the Zlib License.",
    "Licensed under the European Union Public Licence, Version 1.2.",
    "This work is licensed under the Academic Free License, version 3.",
    "This font is licensed under the SIL Open Font License, Version 1.1.",
    "SPDX-License-Identifier: Zlib",
    "Subject to the terms of the Common Development and Distribution License.",
    "Released under the Beerware License.",
)
# The words that name a family, masked to make notices of no family.
SPEAKS = r"(?i)licen[cs]|spdx|copyright|\bwarrant|redistribut|all rights reserved|public domain"
NAMES = r"(?i)\b(apache|mit|gnu|gpl|lgpl|agpl|general|lesser|affero|bsd|mozilla|mpl|isc|cc|by|by-nc|by-sa|creative|commons|attribution\S*|noncommercial|sharealike|apache-\S+|gpl-\S+|lgpl-\S+|agpl-\S+|bsd-\S+|mpl-\S+|cc-\S+|cc0|version \d\S*|v\. \S+|4\.0|www\.\S+|http\S+)(?!\w)"
# Sentences that speak of licences and grant none.
NO_GRANT = (
    "See the license for details.",
    "He lost his driving licence last year.",
    "The warranty of this device covers two years.",
    "You need permission to enter the building.",
    "The copyright office opens at nine.",
    "A fishing license is required in this state.",
    "The licence was revoked by the court.",
    "Poetic license allows for much.",
    "Please read the terms of the license before use.",
    "Any version of the work may be used under these terms.",
)
#: Characters of a line from which it may be wrapped; after which a paragraph is cut at a sentence end, and at the latest.
WRAP_FROM, CUT_FROM, CUT_AT = 40, 200, 2000
#: Documents of which ordinary paragraphs are taken; pieces of a long one, evenly spread, and characters of a piece; paragraphs learnt from; filler words.
SAMPLE_DOCS, SAMPLE_PIECES, PIECE_CHARS, ORDINARY, FILLER = 300, 8, 512, 800, 2000
#: Varied copies of a template; share of ordinary paragraphs that may have a feature; folds of whole templates for the threshold; share of a template's grams that confirms.
VARIANTS, COMMON, FOLDS, CONFIRM = 10, 0.005, 3, 0.6
#: Share of right predictions for unseen templates that the threshold lets pass.
PASS_SHARE = 0.95
#: Letters of a word that may make a feature though it names no family.
TELLING = 5
#: Rounds, step, momentum, and shrinkage of the fit.
ROUNDS, STEP, MOMENTUM, SHRINK = 100, 2.0, 0.9, 6e-4
NONE, UNKNOWN = "none", "unknown"
WORD = r"[a-z0-9][a-z0-9.+-]*[a-z0-9+]|[a-z0-9]"


class Model(NamedTuple):
    """``gate``: of each gram whose weight speaks for a licence, the word that ordinary paragraphs have least."""

    families: tuple[str, ...]
    weights: dict[str, tuple[float, ...]]
    bias: tuple[float, ...]
    threshold: float
    gate: tuple[str, ...]


def grams(text: str) -> set[str]:
    words = re.findall(WORD, text.lower())
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def telling(gram: str) -> list[str]:
    """The words of a gram that may say something of a licence: names of families, and words of ``TELLING`` letters or more. A gram without one that ordinary paragraphs hardly have is no feature."""
    return [w for w in gram.split() if len(w) >= TELLING or re.fullmatch(NAMES, w)]


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _grams(words: Column) -> Column:
    """The same grams as a set, in DataFrame functions."""
    last = F.size(words)

    def runs(n: int) -> Column:
        starts = F.when(last >= n, F.sequence(F.lit(1), last - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))

    return F.array_distinct(F.concat(*map(runs, (1, 2, 3))))


def _varied(text: str, rng: random.Random, filler: list[str]) -> str:
    words = [w for w in text.split() if rng.random() > 0.1] or text.split()
    for _ in range(rng.randint(0, 6)):
        words.insert(rng.choice((0, len(words))), rng.choice(filler))
    return " ".join(words)


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _design(texts: list[str], place: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(texts), len(place)), np.float32)
    for i, t in enumerate(texts):
        x[i, [place[g] for g in grams(t) if g in place]] = 1
    return x


def fit(x: np.ndarray, y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Sparse weights and biases by gradient descent with momentum, each class of equal weight; that of ``none``, the last, is at least as large as any other."""
    target = np.eye(classes, dtype=np.float32)[y]
    share = (1 / np.bincount(y, minlength=classes).clip(1))[y][:, None].astype(np.float32) / classes
    w, b, mw, mb = np.zeros((x.shape[1], classes), np.float32), np.zeros(classes, np.float32), 0.0, 0.0
    for _ in range(ROUNDS):
        d = (_softmax(x @ w + b) - target) * share
        mw, mb = MOMENTUM * mw + x.T @ d, MOMENTUM * mb + d.sum(0)
        w, b = w - STEP * mw, b - STEP * mb
        w = np.sign(w) * np.maximum(np.abs(w) - STEP * SHRINK, 0)
        b[-1] = max(b)
    return w, b


def ordinary_paragraphs(docs: DataFrame, seed: int = 0) -> list[str]:
    """Paragraphs of a bounded sample of ``docs``, drawn at random, without those that speak of licences (``SPEAKS``) or share a run of three words with a notice.

    So no licence of the corpus, however short its line, is learnt as ``none`` or makes a licence's words seem common.
    """
    text = pieces_over(text_or_empty(), SAMPLE_PIECES, PIECE_CHARS)
    rows = bounded_sample(docs.select("doc_id", text.alias("text")), "doc_id", SAMPLE_DOCS).select(paragraphs(F.col("text")).alias("p")).collect()
    known = {g for ts in (*TEMPLATES.values(), OTHER_LICENCES, UNSEEN_LICENCES) for t in ts for g in grams(t) if g.count(" ") == 2}
    found = sorted({p for r in rows for p in r.p if p.strip() and not re.search(SPEAKS, p) and not known & grams(p)})
    random.Random(seed).shuffle(found)
    return found[:ORDINARY]


def calibrate(known: list[float], unknown: list[float]) -> float:
    """The threshold that refuses most wrong predictions for unseen families among those that let ``PASS_SHARE`` of right ones for unseen templates pass; the lowest of equals."""
    most = float(np.quantile(known, 1 - PASS_SHARE)) if known else 0.5
    options = sorted({most, *(float(np.nextafter(u, 1)) for u in unknown if u < most)})
    return max(options, key=lambda t: sum(u < t for u in unknown))


def train(docs: DataFrame, seed: int = 0) -> Model:
    """Train on varied templates, masked and other notices, sentences without grant, and ordinary paragraphs of a bounded sample of ``docs``."""
    return train_on(ordinary_paragraphs(docs, seed), seed)


def train_on(ordinary: list[str], seed: int = 0) -> Model:
    rng = random.Random(seed)
    common = Counter(g for p in ordinary for g in grams(p))
    filler = rng.sample(words, min(FILLER, len(words))) if (words := sorted({w for p in ordinary for w in p.split()})) else ["word"]
    families = (*TEMPLATES, UNKNOWN, NONE)
    notices = [(t, f, i % FOLDS) for f, ts in TEMPLATES.items() for i, t in enumerate(ts)]
    mask = lambda t: re.sub(NAMES, lambda m: rng.choice(filler), t)

    def rows(held: int | None) -> tuple[list[str], list[int]]:
        """Training texts and classes, without the templates of fold ``held`` and what is made of them."""
        out = []
        for t, f, part in notices:
            if part != held:
                out += [(t, f)] * 3 + [(_varied(t, rng, filler), f) for _ in range(VARIANTS)]
                if re.search(NAMES, t):
                    out += [(_varied(mask(t), rng, filler), UNKNOWN) for _ in range(VARIANTS // 2)]
        out += [(_varied(t, rng, filler), UNKNOWN) for t in OTHER_LICENCES for _ in range(VARIANTS)]
        out += [(_varied(t, rng, filler), NONE) for t in NO_GRANT for _ in range(VARIANTS)] + [(p, NONE) for p in ordinary]
        return [t for t, _ in out], [families.index(f) for _, f in out]

    most = COMMON * len(ordinary)
    rare = lambda g: [w for w in telling(g) if common[w] <= most]
    features = sorted({g for ts in (*TEMPLATES.values(), OTHER_LICENCES, NO_GRANT) for t in ts for g in grams(t) if common[g] <= most and rare(g)})
    place = {g: i for i, g in enumerate(features)}
    right, wrong = [], []
    for held in range(FOLDS):
        texts, classes = rows(held)
        w, b = fit(_design(texts, place), np.array(classes), len(families))
        unseen = [(t, families.index(f)) for t, f, part in notices if part == held] + [(t, -1) for t in UNSEEN_LICENCES]
        p = _softmax(_design([t for t, _ in unseen], place) @ w + b)
        for row, (_, c) in zip(p, unseen, strict=True):
            if c == -1 and row.argmax() < len(TEMPLATES):
                wrong.append(float(row.max()))
            elif row.argmax() == c:
                right.append(float(row.max()))
    texts, classes = rows(None)
    w, b = fit(_design(texts, place), np.array(classes), len(families))
    speaks = [g for g, i in place.items() if (w[i, :-1] > w[i, -1]).any()]
    gate = sorted({min(rare(g), key=lambda x: (common[x], -len(x), x)) for g in speaks})
    return Model(families, {g: tuple(map(float, w[i])) for g, i in place.items() if np.abs(w[i]).max() > 0}, tuple(map(float, b)), calibrate(right, wrong), tuple(gate))


def probabilities(text: str, model: Model) -> np.ndarray:
    """Of each family, for one paragraph; what ``classify`` gives, in numpy."""
    z = np.array(model.bias) + sum((np.array(model.weights[g]) for g in grams(text) if g in model.weights), np.zeros(len(model.bias)))
    return _softmax(z[None])[0]


#: What may stand before the text of a line in a comment or an indented block.
COMMENT = r"[\x20\t]*(?:(?:\*|#|//|--|;|%)[*#/;%-]*[\x20\t]+)?"


def paragraphs(text: Column) -> Column:
    """Lines, where one of ``WRAP_FROM`` characters or more that ends without a stop goes on in the next; those of over ``CUT_FROM`` characters are cut at a sentence end.

    The next line may be indented or start with the mark of a comment. (A wrapped line that happens to end with a stop is an end.)
    """
    joined = F.regexp_replace(text, rf"(?<=[^\n]{{{WRAP_FROM}}})(?<![.!?:;])\n{COMMENT}(?=[^\s])", " ")
    return F.regexp_extract_all(joined, F.lit(rf"[^\n]{{{CUT_FROM},{CUT_AT}}}?[.!?](?=[ \n])|[^\n]{{1,{CUT_AT}}}"), F.lit(0))


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """(blob, pos, paragraph, family, probability, overlap, confirmed) of every paragraph of the distinct texts of ``docs(text)`` that is not ``none``."""
    spark = docs.sparkSession
    cut = docs.select(F.sha2(text_or_empty(), 256).alias("blob"), F.posexplode(paragraphs(text_or_empty())).alias("pos", "paragraph"))
    gate = F.array(*map(F.lit, model.gate)) if model.gate else F.array().cast("array<string>")
    found = cut.where(F.arrays_overlap(_words(F.col("paragraph")), gate)).dropDuplicates(["blob", "pos"])
    found = materialize(found, "paragraphs")
    rows = found.select("blob", "pos", _words(F.col("paragraph")).alias("words")).select("blob", "pos", F.explode(_grams(F.col("words"))).alias("gram"))
    # Both tables are as long as the templates have grams.
    weights = F.broadcast(spark.createDataFrame([(g, list(w)) for g, w in model.weights.items()], "gram string, w array<double>"))
    templates = [(f, t, grams(t)) for f, ts in TEMPLATES.items() for t in ts]
    parts = F.broadcast(spark.createDataFrame([(g, f, i, 1.0 / len(gs)) for i, (f, _, gs) in enumerate(templates) for g in sorted(gs)], "gram string, of string, template int, share double"))
    sums = rows.join(weights, "gram").groupBy("blob", "pos").agg(*(F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(len(model.families))))
    scores = F.array(*(F.col(f"s{i}") + b for i, b in enumerate(model.bias)))
    best = F.array_max("scores")
    share = 1 / F.aggregate("scores", F.lit(0.0), lambda acc, s: acc + F.exp(s - best))
    names = F.array(*map(F.lit, model.families))
    named = sums.select("blob", "pos", scores.alias("scores")).select("blob", "pos", F.element_at(names, F.array_position("scores", best).cast("int")).alias("top"), share.alias("probability")).where(F.col("top") != NONE)
    overlaps = rows.join(parts, "gram").groupBy("blob", "pos", "of", "template").agg(F.sum("share").alias("share")).groupBy("blob", "pos", F.col("of").alias("top")).agg(F.max("share").alias("overlap"))
    sure = (F.col("probability") >= model.threshold) & (F.col("top") != UNKNOWN)
    full = named.join(overlaps, ["blob", "pos", "top"], "left").join(found, ["blob", "pos"])
    return full.select("blob", "pos", "paragraph", F.when(sure, F.col("top")).otherwise(UNKNOWN).alias("family"), "probability", F.coalesce("overlap", F.lit(0.0)).alias("overlap"), (sure & (F.coalesce("overlap", F.lit(0.0)) >= CONFIRM)).alias("confirmed"))


def license_scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, licences, n_confirmed, n_unconfirmed, n_unknown for each row of ``docs(doc_id, text)``.

    ``licences`` lists the confirmed families, sorted, comma-joined, each once; the counts are of paragraphs. A null
    or empty text has none. Equal texts get one result, and each row, repeated ones too, gets it. Other
    columns are ignored. An empty table gives an empty result.
    """
    found = classify(docs.select("text"), model or train(docs))
    known = F.col("family") != UNKNOWN
    by_blob = found.groupBy("blob").agg(
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("licences"),
        F.count_if("confirmed").alias("n_confirmed"),
        F.count_if(known & ~F.col("confirmed")).alias("n_unconfirmed"),
        F.count_if(~known).alias("n_unknown"),
    )
    by_blob = materialize(by_blob, "licences")  # so that a join can split a hot blob
    zero = F.lit(0).cast("long")
    joined = docs.select("doc_id", F.sha2(text_or_empty(), 256).alias("blob")).join(by_blob, "blob", "left")
    return joined.select("doc_id", F.coalesce("licences", F.lit("")).alias("licences"), *(F.coalesce(c, zero).alias(c) for c in ("n_confirmed", "n_unconfirmed", "n_unknown")))
