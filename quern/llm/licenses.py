"""Licence scans: a trained paragraph classifier whose findings template comparison confirms.

Everything that touches documents is an expression of built-in functions in one projection. The training paragraphs are
composed from the phrases below; fitting on them is some seconds of driver work that does not depend on the data.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# family: what its licences are called
NAMES: dict[str, list[str]] = {
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPL-3.0", "AGPLv3", "Affero General Public License", "AGPL-3.0-or-later"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache-2.0", "Apache Software License, version 2.0", "Apache License v2.0", "Apache License"],
    "BSD": ["BSD License", "3-clause BSD license", "BSD-3-Clause", "BSD-2-Clause", "two clause BSD license", "New BSD License", "BSD-style license", "Simplified BSD License", "Berkeley Software Distribution license"],
    "CC-BY": ["CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License", "CC BY 3.0"],
    "CC-BY-NC": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution NonCommercial License"],
    "CC-BY-NC-ND": ["CC BY-NC-ND 4.0", "CC-BY-NC-ND-4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA": ["CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-ND": ["CC BY-ND 4.0", "CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-SA": ["CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution ShareAlike License", "CC BY-SA 3.0"],
    "CC0": ["CC0", "CC0 1.0", "CC0-1.0", "CC0 1.0 Universal Public Domain Dedication", "Creative Commons Zero"],
    "GPL": ["GNU General Public License", "GNU GPL", "GPL", "GPL license"],
    "GPL-2.0": ["GNU General Public License, version 2", "GPL-2.0", "GPLv2", "GNU GPL version 2", "GNU General Public License v2.0", "GPL-2.0-only", "GPL version 2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GPL-3.0", "GPLv3", "GNU GPL version 3", "GNU General Public License v3.0", "GPL-3.0-or-later", "GPL version 3"],
    "ISC": ["ISC License", "ISC", "ISC licence"],
    "LGPL": ["GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "LGPL", "LGPL-2.1", "LGPLv3", "GNU Library General Public License", "GNU LGPL version 3", "LGPL-3.0-or-later"],
    "MIT": ["MIT License", "MIT license", "MIT", "MIT software license", "MIT/Expat license", "Expat License"],
    "MPL-2.0": ["Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL-2.0", "MPL 2.0", "Mozilla Public License"],
    "Unlicense": ["Unlicense", "The Unlicense"],
}
# a grant by a licence's name
GRANTS: list[str] = [
    "Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "Released under {}", "Distributed under the {}, see the file LICENSE.",
    "This project is licensed under the terms of the {}.", "This work is licensed under the {}.", "This work is made available under the {}.",
    "The code is available under {}.", "Code is available under the {}.", "Text is available under the {}; additional terms may apply.",
    "You may use this file under the terms of the {}.", "Published under the {}", "License: {}", "SPDX-License-Identifier: {}",
    "Use of this source code is governed by the {} that can be found in the LICENSE file.", "This package is subject to the terms of the {}.",
    "This program is free software; you can redistribute it and/or modify it under the terms of the {} as published by its authors.",
    "All files in this directory are covered by the {}", "This library is provided under the {}", "Copyright 2021 the authors, {}", "{} licensed",
    "Unless stated otherwise, the content of this page is licensed under a {}", "The software is offered under the {}", "Permission is granted under the {}",
]
# a grant of two licences at once
PAIRS: list[str] = ["Dual licensed under the {} or the {}.", "Licensed under either of the {} or the {} at your option.", "Available under the {} and the {}"]
# (family, words of the licence itself): found without its name
SIGNATURES: list[tuple[str, str]] = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPL-2.0", "GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("LGPL", "GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("AGPL-3.0", "GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("public-domain", "This work is in the public domain."),
    ("public-domain", "The author has placed this file in the public domain"),
    ("public-domain", "Released into the public domain"),
    ("public-domain", "Dedicated to the public domain by its authors"),
    ("proprietary", "All rights reserved."),
    ("proprietary", "All rights are reserved by the publisher"),
    ("proprietary", "No part of this publication may be reproduced or transmitted in any form without the prior written permission of the publisher"),
    ("proprietary", "This software is confidential and proprietary; unauthorised copying, distribution or use is prohibited without permission"),
]
# a licence's name without a grant
MENTIONS: list[str] = [
    "Not licensed under the {}.", "This is not released under the {}.", "This work is not available under the {}.", "It is no longer licensed under the {}.", "It was never distributed under the {}.",
    "The {} was written by lawyers.", "Unlike the {}, this text explains nothing.", "We compared the {} with other licenses.", "Read about the history of the {}.",
    "Is this compatible with the {}?", "The {} is a popular license.", "He prefers the {} to others.", "Code under the {} cannot be used here.", "The terms of the {} do not apply.",
    "This software isn't licensed under the {}.", "The permissions of the {} are discussed in chapter 4.", "Questions about the {} are answered by the license committee.", "Nothing here is covered by the {}.",
    "Lawyers discuss the {} in this article.", "What does the {} say about patents?", "A talk about the {} was held in May.", "My favourite is the {}.", "Choose between the {} and others.", "The text of the {} is long.",
    "Every developer knows the {}.", "The {} allows commercial use.", "Some companies avoid the {}.", "An introduction to the {}", "The court ruled on the {} in 2010.", "The {} appeared in 1991.", "The {} versus other licenses",
    "Is {} better?", "We do not use the {}.", "We never chose the {}.", "These files are excluded from the {}.", "Neither this nor that is distributed under the {}.", "It cannot be released under the {}.", "How the {} came to be",
    "The book explains the {} to beginners.", "Critics of the {} say it is too strict.", "Many projects moved away from the {}.", "A survey of the {} and its users",
]
# licence words of other meanings
OTHER: list[str] = [
    "You need a driving licence and a license plate to use the road.", "A driving licence is needed to drive.", "The restaurant lost its liquor license after version 2 of the inspection.",
    "The committee reserved the right to amend the general public notice.", "He was given permission to leave, free of charge.", "She was granted permission to use the source of the river for any purpose.",
    "The apache helicopter landed under the bridge.", "Students at MIT released a paper under the supervision of their teacher.", "Copyright law is a field of study with its own courts.",
    "All seats were reserved under the name of the author.", "The hotel reserved all rooms for the guests.", "The software was distributed with a manual in the box.", "The park is open to the public; its domain is large.",
    "A fishing license is required and no part of the fee is returned.", "The work is in progress and this file is being written.", "The bank is licensed by the state authority.",
    "Version 3 of the plan was published with corrections.", "See the attached document for the terms of the contract.", "Creative writing is common in this attribution of the text.",
    "Redistribution of wealth and use of resources are topics of the book.", "The fee was waived by the author of the report.", "Doctors are licensed to practise medicine in this state under the law.",
    "The marriage license was signed.", "A licensed electrician checked the house.", "The permission slip must be signed by a parent.", "Parking is by permission of the owner only.", "The show was released under a new name in 2004.",
    "The license agreement was reviewed by the board.", "See LICENSE for details.", "The licensing committee meets on Monday.", "License and registration, please.", "The club held a license to sell wine until version 3.0 of the law.",
]
# every training grant holds one of these words: what holds none is no finding, and is not classified
GATE = ["licen", "gpl", "rights", "public domain", "permission", "redistribution", "waived", "cc0", "cc by", "cc-by", "creative commons", "copyright", "mozilla public", "affero", "compliance", "proprietary", "available under", "distribut", "released under", "published under", "subject to the", "covered by", "provided under", "offered under", "terms of"]
# words that say nothing by themselves: neither they nor pairs of them are features
STOP = "a all an and any are as at be by can for from has in is it its of on or so that the this to us was were will with you".split()
_FOLDS = 4
_FALSE = 0.05  # share of held-out unknown paragraphs that may reach the bound
_SHARE = 0.03  # of the probability of all families, what one of two licences granted at once must have


# words that deny what they stand by, as one word
_NOT = r"\b(?:no longer|never|cannot|nothing|neither|nor|excluded|(?:is|was|are|were|do|does|did|ca|wo)n['\u2019]t)\b"


def grams_py(text: str) -> list[str]:
    """Distinct words and word pairs of a paragraph without empty words, as the expression in :func:`_grams` sees them."""
    w = re.findall(r"[a-z0-9]+", re.sub(_NOT, "not", text.lower().replace("licence", "license"), flags=re.ASCII))
    single = {x for x in w if x not in STOP}
    pairs = zip(w, w[1:], strict=False)
    return sorted({*single, *(f"{a} {b}" for a, b in pairs if a in single or b in single)})


def training(skip: frozenset[str] = frozenset()) -> list[tuple[str, tuple[str, ...], int]]:
    """(paragraph, families, fold): every name in several grants and mentions; phrases in ``skip`` are left out.

    A fold leaves out whole phrases, so that what is calibrated on it is unseen wording.
    """
    out = []
    families = sorted(NAMES)
    for kind, phrases in (("grant", GRANTS), ("mention", MENTIONS)):
        for i, p in enumerate(phrases):
            for j, f in enumerate(families):
                for name in {NAMES[f][(i + j + k) % len(NAMES[f])] for k in (0, 3)} if p not in skip else ():
                    out.append((p.format(name), (f,) if kind == "grant" else (), i % _FOLDS))
    for f in families:
        for k, name in enumerate(NAMES[f]):
            out.append((GRANTS[(k * 7) % len(GRANTS)].format(name), (f,), k * 7 % len(GRANTS) % _FOLDS))
    for i, p in enumerate(PAIRS):
        for j, f in enumerate(families):
            g = families[(j + 5 + 3 * i) % len(families)]
            if f != g and p not in skip:
                out.append((p.format(NAMES[f][(i + j) % len(NAMES[f])], NAMES[g][j % len(NAMES[g])]), (f, g), i % _FOLDS))
    for i, (f, s) in enumerate(SIGNATURES):
        if s not in skip:
            out += [(s, (f,), -1), ("Copyright 2020 " + s, (f,), -1), (f"{s[: 2 * len(s) // 3]}", (f,), i % _FOLDS)]
    out += [(t, (), i % _FOLDS) for i, t in enumerate(OTHER) if t not in skip]
    return [r for r in out if not (skip and any(re.fullmatch(re.escape(p).replace(r"\{\}", ".*"), r[0]) for p in skip))]


class LicenceModel:
    """Multinomial logistic regression on sparse word 1- and 2-gram indicators, and the templates that confirm it.

    ``families[0]`` is the unknown class. ``weight``: per n-gram and class; ``least``: the calibrated probability of any
    family at all under which a paragraph is unknown; ``templates``: (family, n-grams, share of them that must be there).
    """

    def __init__(self, families: list[str], weight: dict[str, np.ndarray], bias: np.ndarray, least: float, recall: float):
        self.families, self.weight, self.bias, self.least, self.recall = families, weight, bias, least, recall
        names = [(f, grams_py(n), 1.0) for f in families for n in NAMES.get(f, ())]
        signs = [(f, grams_py(s), 0.6 if len(s) > 60 else 1.0) for f, s in SIGNATURES]
        self.templates = [t for t in names + signs if all(g in weight for g in t[1])]

    def judge(self, text: str) -> dict[str, float]:
        """The families that count, with their probabilities: the reference for the expression."""
        grams = [g for g in grams_py(text) if g in self.weight]
        z = self.bias + sum((self.weight[g] for g in grams), np.zeros(len(self.families)))
        p = np.exp(z - z.max())
        p, held = p / p.sum(), set(grams)
        sure = {f for f, t, share in self.templates if sum(g in held for g in t) >= share * len(t) - 1e-9}
        if 1 - p[0] < self.least:
            return {}
        return {f: float(x) for f, x in zip(self.families[1:], p[1:], strict=True) if f in sure and x >= _SHARE * (1 - p[0])}


def _fit(x: np.ndarray, y: np.ndarray, rounds: int = 200, decay: float = 3e-4):
    """Gradient descent with momentum on the multinomial loss."""
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    v, c = np.zeros_like(w), np.zeros_like(b)
    # the unknown class weighs as much as all families together
    none = y[:, 0] > 0
    side = np.where(none, 0.5 / max(1, none.sum()), 0.5 / max(1, (~none).sum())).astype(np.float32)[:, None] * len(y)
    rate = np.float32(6 / len(y))
    for _ in range(rounds):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        g = (y - p / p.sum(1, keepdims=True)) * side
        v = np.float32(0.9) * v + rate * (x.T @ g - np.float32(decay * len(y)) * w)
        c = np.float32(0.9) * c + rate * g.sum(0) / 10
        w, b = w + v, b + c
    return w, b


def _any(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    z = x @ w + b
    p = np.exp(z - z.max(1, keepdims=True))
    return 1 - p[:, 0] / p.sum(1)


_MODELS: dict[frozenset, LicenceModel] = {}


def trained(skip: frozenset[str] = frozenset()) -> LicenceModel:
    """The model of the phrases above but ``skip`` (fitted once a process).

    Each fold of phrases is judged by a model of the others. The bound is the probability that all but one in twenty of
    the unknown paragraphs in such unseen wordings stay under; the share of grants in them that reach it is ``recall``.
    """
    if skip not in _MODELS:
        rows = training(skip)
        families = ["unknown", *sorted({f for _, fs, _ in rows for f in fs})]
        grams = [grams_py(t) for t, _, _ in rows]
        names = sorted({g for gs in grams for g in gs})
        at = {g: i for i, g in enumerate(names)}
        x = np.zeros((len(rows), len(names)), np.float32)
        y = np.zeros((len(rows), len(families)), np.float32)
        for i, gs in enumerate(grams):
            x[i, [at[g] for g in gs]] = 1
            y[i, [families.index(f) for f in rows[i][1] or ("unknown",)]] = 1 / max(1, len(rows[i][1]))
        fold = np.array([r[2] for r in rows])
        none = y[:, 0] > 0
        seen = np.zeros(len(rows))
        for k in range(_FOLDS):
            seen[fold == k] = _any(x[fold == k], *_fit(x[fold != k], y[fold != k]))
        least = float(np.quantile(seen[none], 1 - _FALSE))
        w, b = _fit(x, y)
        weight = {g: np.round(w[i], 3) for g, i in at.items()}
        _MODELS[skip] = LicenceModel(families, weight, np.round(b, 3), round(least, 4), float(np.mean(seen[~none & (fold >= 0)] >= least)))
    return _MODELS[skip]


def _grams(paragraph: Column) -> Column:
    plain = F.regexp_replace(F.replace(F.lower(paragraph), F.lit("licence"), F.lit("license")), _NOT, "not")
    words = F.filter(F.split(plain, "[^a-z0-9]+"), lambda w: w != "")
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.when(~a.isin(STOP) | ~b.isin(STOP), F.concat(a, F.lit(" "), b)))
    return F.array_distinct(F.filter(F.concat(F.filter(words, lambda w: ~w.isin(STOP)), pairs), lambda p: p.isNotNull()))


def _literal(values, kind: str) -> Column:
    """An array as one literal, which the optimizer folds."""
    return F.split(F.lit(" ".join(map(str, values))), " ").cast(f"array<{kind}>")


def _table(grams: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash table of n-grams, each in one of two slots: hashes and n-gram numbers (0 if free)."""
    size = 1 << max(4, (4 * len(grams)).bit_length())
    keys, number = np.zeros(size, np.int64), np.zeros(size, np.int32)
    for i, g in enumerate(grams):
        h, n = xxhash.xxh64_intdigest(g.encode(), seed=42), i + 1
        slot = h % size
        for turn in range(1000):
            signed = h - (1 << 64) if h >> 63 else h
            old, m = int(keys[slot]), int(number[slot])
            keys[slot], number[slot] = signed, n
            if not m:
                break
            h, n = old % (1 << 64), m
            other = (h >> 32) % size
            slot = other if slot == h % size else h % size
        else:
            raise ValueError("the table is too full")
    return keys, number


def _judge(grams: Column, model: LicenceModel) -> Column:
    """``array<struct<family, score, contained>>`` of a paragraph's n-grams, for the families that count."""
    names, fams = sorted(model.weight), model.families
    keys, number = _table(names)
    size, n_f, n_t = len(keys), len(fams), len(model.templates)
    rows = np.zeros((len(names) + 1, n_f + n_t), np.float32)
    rows[1:, :n_f] = np.stack([model.weight[g] for g in names])
    place = {g: i + 1 for i, g in enumerate(names)}
    for j, (_, t, _) in enumerate(model.templates):
        rows[[place[g] for g in t], n_f + j] = 1
    width = n_f + n_t
    table, numbers = _literal(keys, "bigint"), _literal(number, "int")
    values = _literal([f"{v:g}" for v in rows.ravel()], "float")

    def look(g: Column) -> Column:
        h = F.xxhash64(g)  # XXH64 with seed 42, as in _table
        a, b = (F.pmod(x, F.lit(size)).cast("int") + 1 for x in (h, F.shiftrightunsigned(h, 32)))
        return F.when(F.element_at(table, a) == h, F.element_at(numbers, a)).when(F.element_at(table, b) == h, F.element_at(numbers, b))

    known = F.filter(F.transform(grams, look), lambda i: i.isNotNull() & (i > 0))
    start = _literal([*(f"{v:g}" for v in model.bias), *[0] * n_t], "double")
    sums = F.aggregate(known, start, lambda acc, i: F.zip_with(acc, F.slice(values, i * width + 1, F.lit(width)), lambda a, b: a + b))
    fits = [[(n_f + j, len(t), share) for j, (g, t, share) in enumerate(model.templates) if g == f] for f in fams]

    def decide(z: Column) -> Column:
        # exp(z - z of the unknown class): the classes' odds against it; their sum bounds the probability of any family
        odds = F.transform(F.slice(z, 2, n_f - 1), lambda v: F.exp(v - F.get(z, F.lit(0))))
        return F.transform(F.array(F.struct(odds.alias("o"), F.aggregate(odds, F.lit(0.0), lambda a, b: a + b).alias("all"), z.alias("z"))), count)[0]

    def count(x: Column) -> Column:
        each = []
        for k, f in enumerate(fams[1:]):
            held = F.greatest(*[F.get(x["z"], F.lit(j)) / F.lit(float(n) * share) for j, n, share in fits[k + 1]], F.lit(0.0))
            each.append(F.struct(F.lit(f).alias("family"), (F.get(x["o"], F.lit(k)) / (1.0 + x["all"])).alias("score"), F.least(held, F.lit(1.0)).alias("contained")))
        sure = F.filter(F.array(*each), lambda e: (e["contained"] >= 1 - 1e-6) & (e["score"] * (1.0 + x["all"]) >= _SHARE * x["all"]))
        return F.when(x["all"] >= model.least * (1.0 + x["all"]), sure).otherwise(F.array().cast("array<struct<family:string,score:double,contained:double>>"))

    return F.flatten(F.transform(F.array(sums), decide))


# a paragraph ends at a blank line, one of its sentences before a capital; both keep what stands between them
_CUT = r"(?<=\n[ \t]{0,8}\n)|(?<=[.;!?][)\"' ]{0,2}[ \t\n])(?=[ \t\n#*/]{0,8}[A-Z(\"\[])"


def scan_licences(df: DataFrame, key: str = "doc_id", text: str = "text", model: LicenceModel | None = None) -> DataFrame:
    """Licence findings of every row: ``key``, ``families`` (sorted, distinct), ``findings``:
    ``array<struct<line, family, score, contained>>``, and ``n_unknown`` (passages with licence words of no known family).

    The whole text is cut into paragraphs at blank lines, and these into sentences; a sentence may run over any number
    of lines (comment signs at their starts are no words). One that holds a word of the gate is classified. It is
    unknown unless the probability of all families together passes the calibrated bound. A family then counts if it has
    ``_SHARE`` of that probability (a sentence may grant two licences), and if a template of the family, one of its names or the words of
    the licence itself, stands in the sentence: all n-grams of a name, 0.6 of those of a long passage. ``line`` (from 0)
    is the line on which the sentence begins.

    Null and empty texts have no finding; very long texts are read whole; repeated rows and ties get equal values, as
    families are judged each for itself; other columns are not read; an empty table gives no rows. One projection, no
    shuffle.
    """
    model = model or trained()

    def gated(c: Column) -> Column:
        out = F.contains(c, F.lit(GATE[0]))
        for a in GATE[1:]:
            out = out | F.contains(c, F.lit(a))
        return out

    cut = F.split(text, _CUT)
    looked = F.filter(F.transform(cut, lambda p, i: F.struct(i.alias("i"), p.alias("p"))), lambda x: gated(F.lower(x["p"])))
    judged = F.transform(looked, lambda x: F.struct(x["i"].alias("i"), F.regexp_count(F.regexp_extract(x["p"], r"^\s*", 0), F.lit("\n")).alias("skip"), _judge(_grams(x["p"]), model).alias("j")))
    none = F.array().cast("array<struct<i:int,skip:int,j:array<struct<family:string,score:double,contained:double>>>>")
    out = df.select(F.col(key), F.col(text).alias("x"), F.when(gated(F.lower(F.col(text))), judged).otherwise(none).alias("all")).toDF("key", "x", "all")
    good = F.filter("all", lambda x: F.size(x["j"]) > 0)
    newlines = lambda p: F.length(p) - F.length(F.replace(p, F.lit("\n")))
    line = lambda x: newlines(F.array_join(F.slice(F.split("x", _CUT), F.lit(1), x["i"]), "")) + x["skip"]
    found = F.flatten(
        F.transform(good, lambda x: F.transform(x["j"], lambda j: F.struct(line(x).cast("int").alias("line"), j["family"].alias("family"), j["score"].alias("score"), j["contained"].alias("contained"))))
    )
    out = out.select(
        "key",
        F.array_sort(F.array_distinct(F.flatten(F.transform(good, lambda x: F.transform(x["j"], lambda j: j["family"]))))).alias("families"),
        found.alias("findings"),
        (F.size("all") - F.size(good)).cast("long").alias("n_unknown"),
    )
    return out.withColumnRenamed("key", key)
