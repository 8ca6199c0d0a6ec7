"""Licence scans with a trained paragraph classifier, in DataFrame operations.

A paragraph's features are word 1- to 3-grams of licence notices.  A sparse softmax
regression (L1 penalty) over the licence families, ``unknown`` (licensed, but in no
known way) and ``none`` is fitted on a bounded training set: the notices, sentences
that name the licences, noisy copies of both, ordinary sentences, and a bounded
sample of the corpus.  A temperature, fitted on notices and paragraphs that a first
fit has not seen, calibrates the probabilities.  A family counts only if its
probability passes a threshold and a comparison with its notices confirms it (the
share of a notice's 3-grams that the paragraph holds); otherwise the paragraph is
``unknown``.

Long paragraphs are judged in overlapping windows, so that words of licences
scattered over much text do not add up.
A paragraph may hold several notices, or one amid much text.  So the words near the
grams that paragraphs are compared with are judged apart as well: the best class is
taken, its grams go, and the rest is judged again, as long as any are left.  Every
family counts that passes both tests, the comparison by grams of its own.

Every paragraph is classified, but most need no arithmetic: from the weights follows
a set of words, the anchors, without which ``none`` is sure to win, as the weights
of all other grams together cannot make up for its start (:func:`anchors_of`).
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, let, materialize

NONE, UNKNOWN = "none", "unknown"
#: Notices by family, from the public texts of the licences.
NOTICES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "AGPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "BSD": [
        "Released under the BSD License.",
        "Licensed under the 3-Clause BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "CC0": [
        "To the extent possible under law, the authors have dedicated all copyright and related rights to the public domain worldwide, CC0 1.0 Universal.",
        "Licensed under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 2.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Released under the Unlicense.",
        "SPDX-License-Identifier: Unlicense",
    ],
    UNKNOWN: [
        "All rights reserved. This software is licensed under the terms of our licence agreement.",
        "Use of this material is subject to a proprietary license; redistribution is not permitted.",
        "Copyright the authors. Licensed for internal use only.",
        "Released under the license of the project, see the file LICENSE for details.",
        "This document is licensed under the terms described below.",
    ],
}
#: Short names of the licences; paragraphs are compared with them too.
NAMES: dict[str, list[str]] = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache License"],
    "AGPL": ["GNU Affero General Public License", "AGPL-3.0-or-later", "AGPL"],
    "BSD": ["BSD License", "BSD-3-Clause", "3-Clause BSD License", "BSD-2-Clause"],
    "CC-BY": ["CC BY 4.0", "Creative Commons Attribution 4.0"],
    "CC-BY-NC": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0"],
    "CC0": ["CC0 1.0", "CC0-1.0", "CC0"],
    "CC-BY-SA": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0"],
    "GPL": ["GNU General Public License", "GPL-3.0-or-later", "GPL-2.0-only", "GPL"],
    "ISC": ["ISC License", "License-Identifier: ISC"],
    "LGPL": ["GNU Lesser General Public License", "LGPL-3.0-or-later", "LGPL"],
    "MIT": ["MIT License", "License-Identifier: MIT", "MIT OR", "OR MIT", "under MIT", "and MIT", "MIT and"],
    "MPL-2.0": ["Mozilla Public License", "MPL-2.0"],
    "Unlicense": ["the Unlicense", "License-Identifier: Unlicense"],
}
#: How a licence is named in a sentence.
PHRASES = [
    "Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "Available under {}.", "Distributed under the {}.", "Published under the terms of the {}.",
    "This project is licensed under {}.", "Dual-licensed under {} and {}.", "The code is under the {}, see the file.", "It may be used under {} or {}.",
]
#: Ordinary sentences that hold words of the notices.
ORDINARY = [
    "She got her driving license in the spring and drove to the coast.",
    "The city may license street vendors who work near the harbour.",
    "A license fee was due at the end of every year.",
    "He asked for permission to leave the room and free the prisoners.",
    "The general public was allowed to see the version in the museum.",
    "The foundation published the work of a creative group in common use.",
    "You may use the file as you like, but a copy stays at the office.",
    "The album was released under the name of a friend.",
    "Copyright law was discussed in the second version of the lecture.",
    "The conditions are met when source and form agree.",
    "Her poetic license made the story longer than it was.",
    "The Apache helicopter landed near the MIT campus.",
    "He taught at Harvard and MIT before the war.",
    "The software is free for students, and any version of the file may be used.",
    "Under the terms of the treaty the public domain was to be common land.",
    "The program was distributed in the cinema, with or without a fee, for a good purpose.",
    "Creative people share an attribution that is not commercial.",
    "All rights of the public are reserved in the constitution.",
    "The source of the river and the clause of the lease were disputed.",
    "The record was released under a new label in the spring.",
    "Seats were available under the balcony of the hall.",
    "Leaflets were distributed under the doors of the street.",
    "The novel was published under the name of her sister.",
    "The pump may be used under water or under the project house.",
    "The code of the building was under review, and the copy was permitted.",
    "Version 2.0 of the engine came in 4.0 seconds, 3.0 later than the first.",
]
#: Function words; a gram of these alone is no feature.
FUNCTION_WORDS = frozenset(
    "a all an and any are as at be been but by can do for from had has have he her his how i if in into is it its may no not of on or our out she so some such "
    "than that the their them then there these they this to up upon was we were what when which who will with within without would you your".split()
)
#: Corpus paragraphs with one of these are no examples of ``none``.
STEMS = ("licen", "copyright", "permission", "redistribut")
#: A paragraph ends at a blank line, or at a line break after the end of a sentence.
BREAK = r"\n[ \t\r]*\n|(?<=[.!?:;])[ \t\r]*\n"
COPIES = 4
STEPS = 60
PENALTY = 4e-4
#: Bounds of the corpus paragraphs in the training set: their number, and the characters of each.
SAMPLE_PARAGRAPHS = 400
SAMPLE_CHARS = 4000
MIN_PROBABILITY = 0.5
MIN_OVERLAP = 0.6
#: Words around the grams of notices that are judged with them.
NEAR = 3
#: Words of a window, and from one window to the next, in which longer paragraphs are judged.
WINDOW, STRIDE = 96, 48
GAP = "|"
TEMPERATURES = (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0)
#: Buckets of the table of weights, so that a gram is looked up among a few.
BUCKETS = 512


def words_in(text: Column) -> Column:
    """Words of a paragraph, in lower case and without punctuation."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9.+]+|[.](?![0-9])", " "), " "), "")


def known_words(words: Column, known: list[str]) -> Column:
    """The words that are known; GAP stands for each run of others behind one, so that the known grams stay what they are."""
    marked = F.transform(words, lambda w: F.when(w.isin(known), w).otherwise(GAP))
    return let(marked, lambda m: F.filter(m, lambda w, i: (w != GAP) | (F.coalesce(F.get(m, i - 1), F.lit(GAP)) != GAP)))


def grams_of(words: Column) -> Column:
    """Distinct 1- to 3-grams of words."""
    none = F.array().cast("array<string>")

    def of(words: Column, n: int) -> Column:
        return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(none)

    return let(words, lambda w: F.array_distinct(F.concat(of(w, 1), of(w, 2), of(w, 3))))


def grams(text: Column) -> Column:
    """Distinct word 1- to 3-grams of a paragraph."""
    return grams_of(words_in(text))


def _literal(value: object, schema: str) -> Column:
    """A bounded driver value as a constant of the plan."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    return spark.range(1).select(F.inline(_literal(rows, f"array<struct<{schema}>>")))


@dataclass(frozen=True)
class Model:
    """Weights by gram (one a class), as fitted; ``classes`` ends with ``none``."""

    classes: list[str]
    weights: dict[str, list[float]]
    bias: list[float]
    temperature: float


def anchors_of(model: Model) -> list[str] | None:
    """Words without one of which ``none`` wins: the positive margins of all grams without an anchor, summed, stay below its bias.

    None if there is no such set, as ``none`` does not win without any gram.
    """
    start = [b - model.bias[-1] for b in model.bias[:-1]]
    if max(start, default=0.0) >= 0:
        return None
    margins = {g: [max(0.0, x - w[-1]) for x in w[:-1]] for g, w in model.weights.items()}
    anchors: list[str] = []
    while True:
        total = [s + sum(m[k] for m in margins.values()) for k, s in enumerate(start)]
        over = [k for k, t in enumerate(total) if t >= -1e-6]
        if not over:
            return sorted(anchors)
        gain: dict[str, float] = {}
        for g, m in margins.items():
            for w in set(g.split(" ")) - FUNCTION_WORDS:
                gain[w] = gain.get(w, 0.0) + sum(m[k] for k in over)
        best = max(gain, key=lambda w: (gain[w], w))
        anchors.append(best)
        margins = {g: m for g, m in margins.items() if best not in g.split(" ")}


def sentences() -> list[tuple[str, str, int]]:
    """(family, text, fold) of the notices and of sentences that name licences; two names in a sentence of one family."""
    out = [(f, t, i % 3) for f, ts in NOTICES.items() for i, t in enumerate(ts)]
    for f, names in NAMES.items():
        for i, name in enumerate(n for n in names if not {"or", "and", "under"}.intersection(n.lower().split())):
            for k, phrase in enumerate(PHRASES):
                bare = name.removeprefix("the ").removeprefix("License-Identifier: ")
                out.append((f, phrase.replace("{}", bare), (i + k) % 3))
    return out


def examples(ordinary: list[str], seed: int = 13) -> list[dict]:
    """Training rows (text, y, fold): notices, noisy copies, and ordinary paragraphs."""
    rng = random.Random(seed)
    filler = [w for t in ordinary for w in t.split()] or ["text"]
    rows = []
    for family, notice, fold in sentences():
        rows.append({"text": notice, "y": family, "fold": fold})
        for _ in range(COPIES):
            words = [w for w in notice.split() if rng.random() > 0.08]
            around = [[rng.choice(filler) for _ in range(rng.choice((0, 0, 4, 12)))] for _ in range(2)]
            rows.append({"text": " ".join(around[0] + words + around[1]), "y": family, "fold": fold})
    for i, text in enumerate(ordinary):
        words = text.split()
        rows.append({"text": text, "y": NONE, "fold": i % 3})
        rows.append({"text": " ".join(rng.sample(words, len(words))), "y": NONE, "fold": i % 3})
        if i < len(ORDINARY):
            rows += [{"text": " ".join(w for w in words if rng.random() > 0.08), "y": NONE, "fold": i % 3} for _ in range(2 * COPIES)]
    return rows


def _notices(spark: SparkSession) -> DataFrame:
    return _table(spark, [{"f": f, "text": t} for f, ts in NOTICES.items() for t in [*ts, *NAMES.get(f, [])]], "f string, text string")


def shapes_of(spark: SparkSession) -> dict[str, list[list[str]]]:
    """What a paragraph is compared with: the 3-grams of each notice and name (its longest gram if it has fewer words)."""
    most = lambda gs: F.filter(gs, lambda g: F.size(F.split(g, " ")) == F.array_max(F.transform(gs, lambda x: F.size(F.split(x, " ")))))
    shapes: dict[str, list[list[str]]] = {}
    for r in _notices(spark).select("f", most(grams(F.col("text"))).alias("t")).collect():
        shapes.setdefault(r["f"], []).append(r["t"])
    return shapes


def _fit(rows: DataFrame, classes: list[str], vocabulary: list[str], steps: int) -> tuple[list[list[float]], list[float]]:
    """Weights (one row a gram) and bias of a softmax regression with an L1 penalty; rows have g and y (place of the class)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel

    counted = CountVectorizerModel.from_vocabulary(vocabulary, "g", "features").setBinary(True)
    lr = LogisticRegression(family="multinomial", labelCol="y", maxIter=steps, regParam=PENALTY, elasticNetParam=1.0, standardization=False)
    fitted = lr.fit(counted.transform(rows).select("features", F.col("y").cast("double").alias("y")))
    return fitted.coefficientMatrix.toArray().T.tolist(), fitted.interceptVector.toArray().tolist()


def train(docs: DataFrame, sample: int = SAMPLE_PARAGRAPHS, steps: int = STEPS) -> Model:
    """Fit the classifier; at most ``sample`` corpus paragraphs without a stem join the ordinary ones.

    The sample is picked by hashes of doc_id and of the text, so it does not depend
    on partitioning.  An empty table gives a model of the notices alone.
    """
    spark = docs.sparkSession
    classes = [*NOTICES, NONE]
    total = docs.count()
    share = max(1, min(1_000_000, 2 * sample * 1_000_000 // max(1, total)))
    text = F.col("text").cast("string")
    part = docs.where(text.isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)).select(F.substring(F.element_at(F.split(text, BREAK), -1), 1, SAMPLE_CHARS).alias("text"))
    # Nor are paragraphs that compare with a notice, whatever their words.
    templates = _literal([t for ts in shapes_of(spark).values() for t in ts], "array<array<string>>")
    alike = let(grams(F.col("text")), lambda g: F.exists(templates, lambda t: F.size(F.array_intersect(t, g)) >= MIN_OVERLAP * F.size(t)))
    corpus = sorted(r[0] for r in part.where(~_has_stem(F.col("text")) & ~alike).orderBy(F.xxhash64("text"), "text").limit(sample).collect())
    rows = _table(spark, examples(ORDINARY + corpus), "text string, y string, fold int")
    own = _table(spark, [{"text": t} for _, t, _ in sentences()], "text string").select(F.explode(grams(F.col("text"))).alias("g")).distinct()
    vocabulary = sorted(r[0] for r in own.collect() if not FUNCTION_WORDS.issuperset(r[0].split(" ")))
    # A written table: the training rows are few, and fitting reads them again and again.
    known = F.filter(grams(F.col("text")), lambda g: g.isin(vocabulary))
    features = materialize(rows.select(known.alias("g"), (F.array_position(F.array(*map(F.lit, classes)), F.col("y")) - 1).cast("int").alias("y"), "fold").coalesce(1))
    # Probabilities are calibrated on a third that the first fit has not seen.
    weights, bias = _fit(features.where("fold <> 2"), classes, vocabulary, steps)
    at = dict(zip(vocabulary, weights, strict=True))
    held = []
    for r in features.where("fold = 2").collect():
        z = list(bias)
        for g in r["g"]:
            z = [a + b for a, b in zip(z, at[g], strict=True)]
        held.append((z, r["y"]))

    def loss(t: float) -> float:
        out = 0.0
        for z, y in held:
            top = max(z)
            out += math.log(sum(math.exp((x - top) / t) for x in z)) - (z[y] - top) / t
        return out

    temperature = min(TEMPERATURES, key=loss)
    weights, bias = _fit(features, classes, vocabulary, steps)
    discard(features)
    kept = {g: [round(x, 4) for x in w] for g, w in zip(vocabulary, weights, strict=True) if max(map(abs, w)) >= 5e-5}
    return Model(classes, kept, [round(b, 4) for b in bias], temperature)


def _has_stem(text: Column) -> Column:
    low = F.lower(text)
    found = F.lit(False)
    for stem in STEMS:
        found = found | low.contains(stem)
    return F.coalesce(found, F.lit(False))


def _buckets(spark: SparkSession, weights: dict[str, list[float]]) -> Column:
    """The weights as an array of BUCKETS short arrays of (g, w), by the grams' hash."""
    place = F.pmod(F.xxhash64("g"), F.lit(BUCKETS)).cast("int")
    table: list[list[dict]] = [[] for _ in range(BUCKETS)]
    for r in _table(spark, [{"g": g} for g in weights], "g string").select("g", place.alias("at")).collect():
        table[r["at"]].append({"g": r["g"], "w": weights[r["g"]]})
    return _literal(table, "array<array<struct<g:string,w:array<double>>>>")


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """Add licences: array of (paragraph, text, family, probability, overlap) of each whole text.

    family is a known one or ``unknown``; a paragraph with several has one entry for
    each, and paragraphs of class ``none`` are left out.  Of classes with equal
    scores the first in ``model.classes`` is taken.
    Null text has none.  A column named licences is replaced; repeated rows get
    equal results; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    shapes = shapes_of(spark)
    # The grams of each family, of all, and those whose surroundings are judged apart.
    own = {r["f"]: sorted(r["g"]) for r in _notices(spark).select("f", F.explode(grams(F.col("text"))).alias("g")).groupBy("f").agg(F.collect_set("g").alias("g")).collect()}
    vocabulary = sorted({g for gs in own.values() for g in gs}.union(model.weights))
    known = sorted({w for g in vocabulary for w in g.split(" ")})
    places = sorted({g for f, ts in shapes.items() if f != UNKNOWN for t in ts for g in t})
    names = [c for c in docs.columns if c not in ("licences", "_text")]
    table, notices_of, grams_of_family = _buckets(spark, model.weights), _literal(shapes, "map<string,array<array<string>>>"), _literal(own, "map<string,array<string>>")
    labels = F.array(*map(F.lit, model.classes))
    anchors = anchors_of(model)
    may = lambda words: F.lit(True) if anchors is None else F.arrays_overlap(words, F.lit(anchors))

    def logits(found: Column) -> Column:
        """Sum of the weights of the grams found, and the bias."""
        def add(a: Column, g: Column) -> Column:
            hits = F.filter(F.element_at(table, F.pmod(F.xxhash64(g), F.lit(BUCKETS)).cast("int") + 1), lambda x: x["g"] == g)
            return let(hits, lambda h: F.when(F.size(h) == 0, a).otherwise(F.zip_with(a, h[0]["w"], lambda x, y: x + y)))

        return F.aggregate(found, F.array(*map(F.lit, model.bias)), add)

    def softmax(z: Column) -> Column:
        norm = lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, b: a + b), lambda s: F.transform(e, lambda x: x / s))
        return let(z, lambda y: let(F.array_max(y), lambda m: let(F.transform(y, lambda x: F.exp(x - m)), norm)))

    def best_of(g: Column, then: Callable[[Column, Column], Column], licensed: Column | None = None) -> Column:
        """``then`` of the best class of grams and its probability; ``none`` is left out where ``licensed`` holds."""
        last = len(model.classes) - 1
        score = lambda z: z if licensed is None else F.transform(z, lambda x, k: F.when(licensed & (k == last), -1e9).otherwise(x))
        probability = lambda z: F.array_max(softmax(F.transform(z, lambda x: x / model.temperature)))
        best = lambda z: F.element_at(labels, F.array_position(z, F.array_max(z)).cast("int"))
        return let(let(score(logits(g)), lambda z: F.struct(best(z).alias("best"), probability(z).alias("probability"))), lambda c: then(c["best"], c["probability"]))

    def overlap(family: Column, g: Column, left: Column | None = None) -> Column:
        """Largest share of a notice that the grams hold; of notices with a gram in ``left`` only, if given."""
        of = F.element_at(notices_of, family)
        if left is not None:
            of = F.filter(of, lambda t: F.arrays_overlap(t, left))
        return F.coalesce(F.array_max(F.transform(of, lambda t: F.size(F.array_intersect(t, g)) / F.size(t))), F.lit(0.0))

    def sure(x: Column) -> Column:
        return (x["probability"] >= MIN_PROBABILITY) & (x["overlap"] >= MIN_OVERLAP)

    entry = "struct<family:string,probability:double,overlap:double>"
    found = lambda words: F.filter(grams_of(words), lambda x: x.isin(vocabulary))

    def whole(words: Column) -> Column:
        """The verdict on all of a window: an array of one family, or none."""
        def named(best: Column, probability: Column, g: Column) -> Column:
            one = lambda o: F.struct(F.when((best != UNKNOWN) & (probability >= MIN_PROBABILITY) & (o >= MIN_OVERLAP), best).otherwise(UNKNOWN).alias("family"), probability.alias("probability"), o.alias("overlap"))
            return F.when(best == NONE, F.array().cast(f"array<{entry}>")).otherwise(F.array(let(F.when(best == UNKNOWN, 0.0).otherwise(overlap(best, g)), one).cast(entry)))

        return let(found(words), lambda g: best_of(g, lambda b, p: named(b, p, g)))

    def apart(words: Column) -> Column:
        """All families that the words near notices' grams confirm, one after another."""
        starts = F.transform(words, lambda w, i: w.isin(places) | F.array_join(F.slice(words, i + 1, 2), " ").isin(places) | F.array_join(F.slice(words, i + 1, 3), " ").isin(places))
        near = lambda h: F.transform(words, lambda w, i: F.when(F.exists(F.slice(h, F.greatest(i - NEAR - 1, F.lit(1)), i + NEAR + 2 - F.greatest(i - NEAR - 1, F.lit(1))), lambda x: x), w).otherwise(GAP))

        def peeled(g: Column) -> Column:
            # What is left beside a notice is too little to weigh against ``none``, so only the first step does.
            def step(s: Column, i: Column) -> Column:
                def after(best: Column, probability: Column) -> Column:
                    got = F.struct(best.alias("family"), probability.alias("probability"), overlap(best, g, s["left"]).alias("overlap")).cast(entry)
                    rest = F.when(best == NONE, F.array().cast("array<string>")).otherwise(F.array_except(s["left"], F.element_at(grams_of_family, best)))
                    out = let(got, lambda x: F.when((best != NONE) & sure(x), F.array_append(s["out"], x)).otherwise(s["out"]))
                    return F.struct(rest.alias("left"), out.alias("out"))

                return F.when(F.size(s["left"]) > 0, best_of(s["left"], after, i > 1)).otherwise(s)

            first = F.struct(g.alias("left"), F.array().cast(f"array<{entry}>").alias("out"))
            return F.aggregate(F.sequence(F.lit(1), F.lit(len(model.classes))), first, step)["out"]

        none = F.array().cast(f"array<{entry}>")
        return let(starts, lambda h: F.when(F.exists(h, lambda x: x), let(found(near(h)), peeled)).otherwise(none))

    def judged(p: Column, i: Column) -> Column:
        """What a paragraph holds: families confirmed apart, then those of its windows; ``unknown`` only without any."""
        def both(one: Column, many: Column) -> Column:
            alone = (F.size(many) == 0) & ~F.exists(one, lambda x: x["family"] != UNKNOWN)
            more = F.filter(one, lambda x: F.when(x["family"] == UNKNOWN, alone).otherwise(~F.exists(many, lambda y: y["family"] == x["family"])))
            return F.concat(many, more)

        none = F.array().cast(f"array<{entry}>")

        def windows(words: Column) -> Column:
            """The verdicts on windows with an anchor, the first of each family."""
            starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (WINDOW - STRIDE), F.lit(1)), F.lit(STRIDE))
            verdict = lambda w: F.when(may(w), let(known_words(w, known), whole)).otherwise(none)
            every = F.flatten(F.transform(starts, lambda at: let(F.slice(words, at, WINDOW), verdict)))
            return let(every, lambda e: F.filter(e, lambda x, k: ~F.exists(F.slice(e, 1, k), lambda y: y["family"] == x["family"])))

        def of(words: Column) -> Column:
            return let(windows(words), lambda one: let(let(known_words(words, known), apart), lambda many: both(one, many)))

        found = let(words_in(p), lambda w: F.when(may(w), of(w)).otherwise(none))
        return F.transform(found, lambda x: F.struct(i.alias("paragraph"), p.alias("text"), x["family"].alias("family"), x["probability"].alias("probability"), x["overlap"].alias("overlap")))

    named = F.flatten(F.transform(F.split(F.col("_text"), BREAK), judged))
    empty = F.array().cast("array<struct<paragraph:int,text:string,family:string,probability:double,overlap:double>>")
    return docs.select(*names, F.col("text").cast("string").alias("_text")).select(*names, F.when(may(words_in(F.col("_text"))), named).otherwise(empty).alias("licences"))
