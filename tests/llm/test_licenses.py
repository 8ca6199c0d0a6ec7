import random
import re

import numpy as np
import pytest
from fixtures import documents, odd

from millrace.llm import licenses as lc


@pytest.fixture(scope="module")
def model(spark):
    return lc.train(documents(spark))


def families(spark, model, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [[x.family for x in r.licences] for r in lc.scan(d, model).orderBy("doc_id").collect()]


def words_in(p):
    return [w for w in re.sub(r"[^a-z0-9.+]+|[.](?![0-9])", " ", p.lower()).split(" ") if w]


def grams(words):
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


class Brute:
    """The rules stated in the module, over plain sets, for every paragraph and without anchors."""

    def __init__(self, model):
        self.m, self.own, self.shapes = model, {}, {}
        for f, ts in lc.NOTICES.items():
            for t in [*ts, *lc.NAMES.get(f, [])]:
                g = grams(words_in(t))
                most = max(len(x.split()) for x in g)
                self.own.setdefault(f, set()).update(g)
                self.shapes.setdefault(f, []).append({x for x in g if len(x.split()) == most})
        self.vocabulary = set(model.weights).union(*self.own.values())
        self.known = {w for g in self.vocabulary for w in g.split()}
        self.places = {g for f, ts in self.shapes.items() if f != lc.UNKNOWN for t in ts for g in t}

    def judge(self, g, licensed=False):
        z = np.array(self.m.bias) + sum((np.array(self.m.weights[x]) for x in g if x in self.m.weights), np.zeros(len(self.m.bias)))
        if licensed:
            z[-1] = -1e9
        p = np.exp((z - z.max()) / self.m.temperature)
        return self.m.classes[int(z.argmax())], float(p.max() / p.sum())

    def overlap(self, family, g, left=None):
        return max((len(t & g) / len(t) for t in self.shapes.get(family, []) if left is None or t & left), default=0.0)

    def compressed(self, given):
        words = []
        for w in given:
            if w in self.known or (words and words[-1] != lc.GAP):
                words.append(w if w in self.known else lc.GAP)
        return words

    def window(self, given):
        g = grams(self.compressed(given)) & self.vocabulary
        best, prob = self.judge(g)
        if best == lc.NONE:
            return []
        o = 0.0 if best == lc.UNKNOWN else self.overlap(best, g)
        return [(best if best != lc.UNKNOWN and prob >= lc.MIN_PROBABILITY and o >= lc.MIN_OVERLAP else lc.UNKNOWN, prob, o)]

    def paragraph(self, p):
        given, one = words_in(p), []
        for at in range(0, max(len(given) - (lc.WINDOW - lc.STRIDE), 1), lc.STRIDE):
            one += [x for x in self.window(given[at : at + lc.WINDOW]) if x[0] not in {y[0] for y in one}]
        words = self.compressed(given)
        hit = [any(" ".join(words[i : i + n]) in self.places for n in (1, 2, 3)) for i in range(len(words))]
        many = []
        if any(hit):
            near = [w if any(hit[max(0, i - lc.NEAR - 2) : i + lc.NEAR + 1]) else lc.GAP for i, w in enumerate(words)]
            g = grams(near) & self.vocabulary
            left, first = set(g), True
            while left:
                best, prob = self.judge(left, not first)
                first = False
                if best == lc.NONE:
                    break
                o = self.overlap(best, g, left)
                if prob >= lc.MIN_PROBABILITY and o >= lc.MIN_OVERLAP:
                    many.append((best, prob, o))
                after = left - self.own[best]
                if after == left:
                    break
                left = after
        known = [x for x in one if x[0] != lc.UNKNOWN and x[0] not in {y[0] for y in many}]
        return many + (known if many or known else one)

    def scan(self, text):
        paragraphs = re.split(lc.BREAK, text) if text is not None else []
        return [(k, p, *x) for k, p in enumerate(paragraphs) for x in self.paragraph(p)]


def test_scan_against_brute_force(spark, model):
    brute = Brute(model)
    notices = [t for ts in lc.NOTICES.values() for t in ts]
    rng = random.Random(8)
    words = [w for r in documents(spark).select("text").collect() for w in (r.text or "").split()] + [w for t in lc.ORDINARY for w in t.split()]
    mixed = [" ".join(rng.choices(words, k=rng.randint(0, 40)) + [w for w in rng.choice(notices).split() if rng.random() < 0.8] + rng.choices(words, k=rng.randint(0, 9))) for _ in range(150)]
    mixed += [" ".join(rng.choices(words, k=n) + rng.choice(notices).split() + rng.choices(words, k=m)) for n, m in ((95, 0), (96, 1), (40, 60), (300, 300), (2000, 10))]
    mixed += ["\n".join(rng.sample(notices, 3)) for _ in range(40)] + ["\n\n".join(rng.sample(notices + lc.ORDINARY, 4)) for _ in range(40)] + [*lc.ORDINARY, *lc.STEMS, "", " \n\n \n"]
    d = spark.createDataFrame(list(enumerate(mixed)), "doc_id long, text string").union(documents(spark).select("doc_id", "text")).union(odd(spark).select("doc_id", "text"))
    found = 0
    for r in lc.scan(d, model).collect():
        want = brute.scan(r.text)
        assert [(x.paragraph, x.text, x.family) for x in r.licences] == [x[:3] for x in want]
        assert [v for x in r.licences for v in (x.probability, x.overlap)] == pytest.approx([v for x in want for v in x[3:]])
        found += len(want)
    assert found > 200


def test_no_class_beats_none_without_an_anchor(model):
    anchors = set(lc.anchors_of(model))
    assert anchors
    for k in range(len(model.classes) - 1):
        best = model.bias[k] + sum(max(0.0, w[k] - w[-1]) for g, w in model.weights.items() if not anchors.intersection(g.split()))
        assert best < model.bias[-1]
    # A model in which ``none`` does not win by itself has no anchors: every paragraph is worked out.
    assert lc.anchors_of(lc.Model(model.classes, model.weights, [0.0] * len(model.bias), 1.0)) is None


def test_scan_without_anchors_agrees(spark, model, monkeypatch):
    d = documents(spark).select("doc_id", "text")
    with_anchors = {(r.doc_id, str(r.licences)) for r in lc.scan(d, model).collect()}
    monkeypatch.setattr(lc, "anchors_of", lambda m: None)
    assert {(r.doc_id, str(r.licences)) for r in lc.scan(d, model).collect()} == with_anchors


def test_every_notice_has_its_family(spark, model):
    given = [(f, t) for f, ts in lc.NOTICES.items() for t in ts]
    assert families(spark, model, [t for _, t in given]) == [[f] for f, _ in given]


def test_sentences_that_are_not_in_the_training_set(spark, model):
    given = {
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.": {"ISC"},
        "This program is distributed under the GPL.": {"GPL"},
        "Dual-licensed under MIT and Apache-2.0.": {"MIT", "Apache-2.0"},
        "All files here are licensed under the terms of the Mozilla Public License, version 2.0, see below.": {"MPL-2.0"},
        "Except where otherwise noted, content on this site is licensed under a Creative Commons Attribution 4.0 International license.": {"CC-BY"},
        "You can use this package under the BSD License.": {"BSD"},
        "The photographs are published under CC BY-SA 4.0, the maps are not.": {"CC-BY-SA"},
        "This library is distributed under the GNU Lesser General Public License.": {"LGPL"},
    }
    assert [set(g) for g in families(spark, model, list(given))] == list(given.values())


def test_model_does_not_depend_on_partitioning(spark, model):
    assert lc.train(documents(spark).repartition(7)) == model


def test_ordinary_and_unknown(spark, model):
    assert families(spark, model, lc.ORDINARY) == [[] for _ in lc.ORDINARY]
    assert families(spark, model, ["This file is licensed under the Foo Bar terms.", "Licensed under the Zebra License, Version 9."]) == [["unknown"], ["unknown"]]


def test_noisy_held_out_copies(spark, model):
    rng = random.Random(77)
    given = []
    for f, ts in lc.NOTICES.items():
        for t in ts:
            if f != lc.UNKNOWN:
                pad = " ".join(rng.choice(["thea", "oner", "inre", "stand"]) for _ in range(rng.randint(0, 15)))
                given.append((f, f"{pad} {t.upper() if rng.random() < 0.3 else t} {pad}"))
    got = families(spark, model, [t for _, t in given])
    assert sum(g == [f] for g, (f, _) in zip(got, given, strict=True)) >= 0.9 * len(given)


def test_paragraphs_in_whole_texts(spark, model):
    far = "word and more words.\n" * 3000 + "Released under the MIT License.\nLicensed under CC BY-NC 4.0.\n\nThis program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License."
    assert families(spark, model, [far, None, "", "no notice"]) == [["MIT", "CC-BY-NC", "GPL"], [], [], []]


def test_odd_rows(spark, model):
    d = odd(spark)
    rows = lc.scan(d, model).collect()
    assert len(rows) == d.count() and [x.family for r in rows for x in r.licences] == ["MIT"]
    assert lc.scan(d.where("false"), model).count() == 0
    empty = lc.train(d.where("false"))
    assert empty.classes[-1] == lc.NONE and families(spark, empty, ["Released under the MIT License.", "no notice here"]) == [["MIT"], []]


def test_notices_without_a_stem(spark, model):
    texts = ["Available under CC BY-SA 4.0.", "Available under CC BY 4.0.", "Text under CC BY-NC 4.0, ask for more."]
    assert not any(s in t.lower() for t in texts for s in lc.STEMS)
    assert families(spark, model, texts) == [["CC-BY-SA"], ["CC-BY"], ["CC-BY-NC"]]


def test_several_licences_in_a_paragraph(spark, model):
    given = {
        "SPDX-License-Identifier: MIT\nSPDX-License-Identifier: Apache-2.0": {"MIT", "Apache-2.0"},
        "SPDX-License-Identifier: Apache-2.0 OR MIT": {"MIT", "Apache-2.0"},
        "Released under the MIT License\nLicensed under CC BY-NC 4.0": {"MIT", "CC-BY-NC"},
        "Licensed under either of the Apache License, Version 2.0 or the MIT License.": {"MIT", "Apache-2.0"},
        "Text under CC BY 4.0, images under CC BY-NC 4.0.": {"CC-BY", "CC-BY-NC"},
        "Licensed under CC BY-NC 4.0.": {"CC-BY-NC"},
        "SPDX-License-Identifier: LGPL-3.0-or-later": {"LGPL"},
    }
    got = families(spark, model, list(given))
    assert [set(g) for g in got] == list(given.values()) and all(len(g) == len(set(g)) for g in got)


def test_notices_amid_many_words(spark, model):
    rng = random.Random(3)
    words = [w for r in documents(spark).select("text").collect() for w in (r.text or "").split()]
    given = [(f, t) for f, ts in lc.NOTICES.items() if f != lc.UNKNOWN for t in ts]
    for n in (100, 500):
        got = families(spark, model, [" ".join([*rng.choices(words, k=n), t, *rng.choices(words, k=n)]) for _, t in given])
        assert [g for g, (f, _) in zip(got, given, strict=True) if f not in g] == []
