"""Operator 9, licence scans: logistic regression on hashed word n-grams names the licence family of a paragraph.

A paragraph is a run of lines up to a blank line. Each of its lines with a cue is looked at together with its neighbours
in the paragraph, as many words on either side as the longest template has, so a notice is found at any line wrapping and
anywhere in a long line. Every stretch of a template's length is compared with the template: it must hold enough of its
words, all of the words that name the licence, and in templates of up to three words just these words in their order. The
best stretch of each template is scored: its words' 1- and 2-grams, hashed into BUCKETS, carry the weights; the scores of
the families and of the class ``unknown`` go through a softmax with a fitted temperature, and below FLOOR the answer is
``unknown``. Every family counts of which a stretch of its own template gets its name; the surest is the document's. A line without such a stretch is scored as a
whole, for the confidence of ``unknown``.

Cues are no list of their own: what misses over 0.25 of a template's words can't be confirmed by it, so of every template
that many words, the rarest in the corpus's sample, are cues, and a line without any cue is never needed to confirm a
family. Scanning uses Spark's functions only; weights, cues and templates travel as folded literals. Training, on the
driver, sees templates with words dropped or added, and as ``unknown`` notices of other licences in the same phrases, and
the lines of a bounded sample of texts, half of them texts with cues, that no template confirms.

Cases: null and empty texts and texts without a cue have no licence paragraph: null family, confidence 0; ties go to the
last family by name; repeated rows get equal answers; very long texts and lines are read whole; other columns are neither
read nor returned; an empty table gives none.
"""

from __future__ import annotations

import math
import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import table, written

BUCKETS, FLOOR, CONFIRM = 4096, 0.6, 0.75
#: bound of the sample of corpus texts, and of what training takes of it: rows of any text, and as many with a cue
POOL, SAMPLE_ROWS = 2000, 150
# Notices of licences, by family.
#: what ends a run of neighbouring lines
BLANK = r"\n[ \t\x0B\f\r]*(?=\n)"
TEMPLATES = {
    "apache": ("Licensed under the Apache License, Version 2.0.", "you may not use this file except in compliance with the License. You may obtain a copy of the License at", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND", "Apache License 2.0", "Apache-2.0"),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under the BSD 3-Clause License.", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "BSD License", "BSD-3-Clause", "BSD-2-Clause"),
    "cc": ("Licensed under CC BY-NC 4.0.", "Licensed under CC BY-SA 4.0.", "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC BY-SA 4.0", "CC BY-NC 4.0", "CC BY 4.0"),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "Licensed under the GNU GPL, version 2 or later.", "GPLv3", "GPLv2", "GNU GPL", "GPL-3.0", "GPL-2.0"),
    "mit": ("Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "MIT License", "SPDX-License-Identifier: MIT"),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "Mozilla Public License", "MPL 2.0"),
}
STRANGERS = ("All rights reserved.", "Copyright by the authors.", "He lost his driving licence last year.", "A fishing licence is required here.", "Licence number on request.", "With the kind permission of the museum.", "The warranty ends after two years.", "Licensed to sell alcohol on these premises.", "Ask for permission before entering.", "This text is in the public domain.", "The licence fee was raised again.")
#: words that name a family; a template's own ones can't be missing
NAMES = {"apache": {"apache"}, "bsd": {"bsd"}, "cc": {"cc", "creative", "commons"}, "gpl": {"gnu", "gpl", "gplv2", "gplv3"}, "mit": {"mit"}, "mpl": {"mozilla", "mpl"}}
#: names of licences outside the families, and phrases that they stand in, for the class unknown
OTHERS = ("Academic Free", "Artistic", "Boost Software", "Common Development and Distribution", "Eclipse Public", "European Union Public", "ISC", "JSON", "Microsoft Public", "NCSA", "Open Font", "OpenSSL", "PostgreSQL", "Python Software Foundation", "Sleepycat", "Unlicense", "University of Illinois", "WTFPL", "Zlib", "Zope Public")
PHRASES = ("Licensed under the {} License.", "Released under the {} License.", "This work is licensed under the {} License, version 3.", "Licensed under the {} License 2.0.", "{} License", "SPDX-License-Identifier: {}")
#: templates of up to so many words count only word by word
SHORT = 3
WORD = r"[^a-z0-9.]+"


def words(text: str) -> list[str]:
    return [w.strip(".") for w in re.split(WORD, text.lower()) if w.strip(".")]


def grams(text: str) -> list[str]:
    w = words(text)
    return list(dict.fromkeys([*w, *(f"{a} {b}" for a, b in zip(w[:-1], w[1:], strict=True))]))


def bucket(gram: str) -> int:
    return xxhash.xxh64_intdigest(gram.encode(), 42) & (BUCKETS - 1)


def naming(family: str, text: str) -> set[str]:
    return set(words(text)) & NAMES[family]


TEMPLATE_WORDS = [(set(words(t)), naming(family, t)) for family, texts in TEMPLATES.items() for t in texts]


def confirmed_by(line: list[str]) -> bool:
    """Whether any template has enough of its words, and those that name it, in a line's words."""
    there = set(line)
    return any(len(there & own) >= CONFIRM * len(own) and name <= there for own, name in TEMPLATE_WORDS)


def cues_of(texts: list[str]) -> tuple[str, ...]:
    """Of each template as many words as it can't miss: those that are cues of another already, then those that stand in
    the fewest texts, the longest first. Templates of few words, which leave no choice, come first."""
    low = [x.lower() for x in texts]
    rare = {w: (sum(w in x for x in low), -len(w), w) for family in TEMPLATES.values() for t in family for w in words(t)}
    out: set[str] = set()
    for own in sorted((sorted(set(words(t))) for family in TEMPLATES.values() for t in family), key=lambda ws: (len(ws), ws)):
        out.update(sorted(own, key=lambda w: (w not in out, rare[w]))[: len(own) - math.ceil(CONFIRM * len(own)) + 1])
    return tuple(sorted(out, key=lambda w: rare[w], reverse=True))


class Model:
    def __init__(self, classes: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float, cues: tuple[str, ...]):
        self.classes, self.weights, self.bias, self.temperature, self.cues = classes, weights, bias, temperature, cues

    def scores(self, text: str) -> np.ndarray:
        z = (self.bias + sum((self.weights[bucket(g)] for g in grams(text)), np.zeros(len(self.classes)))) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()


def examples(lines: list[str], rng: np.random.Generator, copies: int = 40) -> list[tuple[str, int]]:
    """Templates in variations, by class number; class 0 is unknown."""
    extra = np.array([w for x in lines for w in x.split()] or ["note"], dtype=object)
    out = [(x, 0) for x in (*STRANGERS, *lines)] + [(p.format(name), 0) for p in PHRASES for name in OTHERS]
    for k, family in enumerate(sorted(TEMPLATES), 1):
        for text in TEMPLATES[family]:
            for i in range(copies):
                w = [x for x in text.split() if i == 0 or rng.random() > 0.08] or text.split()
                if i % 3 == 1:
                    w = [*rng.choice(extra, 4).tolist(), *w]
                if i % 3 == 2:
                    w = [*w, *rng.choice(extra, 4).tolist()]
                out.append((" ".join(w), k))
    for x in STRANGERS:
        out += [(" ".join([*rng.choice(extra, 5).tolist(), x, *rng.choice(extra, 5).tolist()]), 0) for _ in range(12)]
    return out


def train(texts: list[str], cues: tuple[str, ...] | None = None, seed: int = 5, epochs: int = 60, rate: float = 0.3) -> Model:
    """From texts of the corpus, whose lines that no template confirms are the class unknown."""
    lines = [x for t in texts for x in t.split("\n") if words(x) and not confirmed_by(words(x))]
    rng = np.random.default_rng(seed)
    classes = ["unknown", *sorted(TEMPLATES)]
    data = examples(lines, rng)
    rows = [np.array([bucket(g) for g in grams(x)], dtype=np.int64) for x, _ in data]
    size = np.array([len(r) for r in rows])
    of, at, y = np.repeat(np.arange(len(rows)), size), np.concatenate(rows), np.array([k for _, k in data])
    held = rng.random(len(rows)) < 0.2
    w, b, k = np.zeros((BUCKETS, len(classes))), np.zeros(len(classes)), len(classes)
    goal = np.eye(k)[y]
    fit = ~held / max(1, (~held).sum())
    squares = np.full_like(w, 1e-8)

    begin, order = np.cumsum(size) - size, np.argsort(at, kind="stable")
    used, edge = np.unique(at[order], return_index=True)

    def margin():
        return b + np.add.reduceat(w[at], begin, axis=0)

    def softmax(z):
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    for _ in range(epochs):
        error = (goal - softmax(margin())) * fit[:, None]
        g = -1e-5 * w
        g[used] += np.add.reduceat(error[of[order]], edge, axis=0)
        squares += g * g
        w += rate * g / np.sqrt(squares)
        b += rate * error.sum(axis=0)
    z = margin()[held]
    nll = lambda t: -np.log(np.maximum(softmax(z / t)[np.arange(len(z)), y[held]], 1e-12)).mean()
    temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=nll) if held.any() else 1.0
    return Model(classes, np.round(w, 3), np.round(b, 3), temperature, cues_of(texts) if cues is None else cues)


def sample(docs: DataFrame) -> DataFrame:
    """The text with the least hash in each of POOL slots: a bounded sample of whole texts, in the shared folder."""
    hashed = docs.where("text is not null").select("text", F.xxhash64("text").alias("h"))
    small = hashed.groupBy(F.pmod("h", F.lit(POOL)).alias("slot")).agg(F.min(F.struct("h", "text")).alias("x"))
    return written(small.select("slot", "x.text"), "licence-sample")


def fitted(docs: DataFrame) -> Model:
    """Learned from SAMPLE_ROWS texts of the sample, and as many that have a cue."""
    pool = sample(docs)
    first = lambda rows: [r.text for r in rows.orderBy("slot").limit(SAMPLE_ROWS).collect()]
    texts = first(pool)
    cues = cues_of(texts)
    return train([*texts, *first(pool.where(has_cue(F.col("text"), cues)))], cues)


def has_cue(x: Column, cues: tuple[str, ...]) -> Column:
    """Whether a text holds a cue; the outer transform lowers it once for all cues."""
    own = F.array(*[F.lit(c) for c in cues])
    return F.transform(F.array(F.lower(x)), lambda low: F.exists(own, lambda c: low.contains(c)))[0]


def literal(values: np.ndarray) -> Column:
    """An array of numbers that the optimizer folds into one literal."""
    return F.split(F.lit(",".join(f"{x:g}" for x in values.ravel())), ",").cast("array<double>")


def paragraphs(model: Model, text: Column) -> Column:
    """An array of the text's cued lines, each with its own confidence and the confirmed (confidence, family) around it, by
    Spark functions alone."""
    k = len(model.classes)
    weights, bias = literal(model.weights), literal(model.bias)
    names = F.array(*[F.lit(c) for c in model.classes])

    def tokens(line):
        return F.filter(F.transform(F.split(F.lower(line), WORD), lambda w: F.regexp_replace(w, r"^\.+|\.+$", "")), lambda w: w != "")

    def judged(w):
        pairs = F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
        seen = F.array_distinct(F.concat(w, pairs))
        at = lambda g: (F.xxhash64(g).bitwiseAND(F.lit(BUCKETS - 1)) * k + 1).cast("int")
        z = F.aggregate(seen, bias, lambda acc, g: F.zip_with(acc, F.slice(weights, at(g), k), lambda a, b: a + b))
        e = F.transform(F.array(z), lambda own: F.transform(own, lambda x: F.exp((x - F.array_max(own)) / model.temperature)))[0]
        total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
        return F.struct(w.alias("w"), e.alias("e"), total.alias("total"))

    def answer(x):
        top = F.array_max(x["e"])
        p = top / x["total"]
        name = F.when(p >= FLOOR, F.element_at(names, F.array_position(x["e"], top).cast("int"))).otherwise("unknown")
        return F.struct(name.alias("family"), p.alias("confidence"), x["w"].alias("w"))

    own = [(family, list(dict.fromkeys(words(t))), sorted(naming(family, t)), words(t)) for family, texts in sorted(TEMPLATES.items()) for t in texts]
    strings = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    templates = F.array(*[F.struct(F.lit(f).alias("family"), strings(w).alias("words"), strings(n).alias("names"), F.lit(len(t)).alias("span"), F.lit(" ".join(t) if len(t) <= SHORT else None).cast("string").alias("exact")) for f, w, n, t in own])
    reach = max(len(t) for *_, t in own)

    def holds(w, t):
        return (F.size(F.array_intersect(w, t["names"])) == F.size(t["names"])) & (F.size(F.array_intersect(w, t["words"])) >= CONFIRM * F.size(t["words"]))

    def cued(units):
        """The words of a run's lines with a cue, and those words with their neighbours."""
        ahead = lambda i: F.slice(F.reverse(F.flatten(F.transform(F.slice(units, F.greatest(i - reach, F.lit(1)), F.least(i - 1, F.lit(reach))), lambda u: u["w"]))), 1, reach)
        behind = lambda i: F.slice(F.flatten(F.transform(F.slice(units, i + 1, reach), lambda u: u["w"])), 1, reach)
        at = F.filter(F.transform(units, lambda u, i: F.when(u["cue"], i + 1)), lambda i: i.isNotNull())
        return F.transform(at, lambda i: F.struct(F.element_at(units, i)["w"].alias("w"), F.concat(F.reverse(ahead(i)), F.element_at(units, i)["w"], behind(i)).alias("near")))

    def alone(x):
        return F.struct(answer(judged(x["w"])).alias("a"), x["near"].alias("near"))

    def stretches(near):
        """For each template whose words are near, the stretch of its length that holds most of them."""

        def hits(t):
            at = F.transform(F.sequence(F.lit(1), F.greatest(F.size(near) - t["span"] + 1, F.lit(1))), lambda p: F.struct(F.slice(near, p, t["span"]).alias("w"), (-p).alias("p")))
            fits = F.filter(at, lambda s: holds(s["w"], t) & (t["exact"].isNull() | (F.array_join(s["w"], " ") == t["exact"])))
            return F.transform(fits, lambda s: F.struct(F.size(F.array_intersect(s["w"], t["words"])).alias("hit"), s["p"].alias("p"), s["w"].alias("w")))

        best = F.transform(F.filter(templates, lambda t: holds(near, t)), lambda t: F.struct(t["family"].alias("own"), F.array_max(hits(t)).alias("best")))
        return F.filter(best, lambda x: x["best"].isNotNull())

    def joined(x):
        """The families that stretches around the line confirm."""
        scored = F.transform(F.transform(stretches(x["near"]), lambda s: F.struct(s["own"].alias("own"), judged(s["best"]["w"]).alias("j"))), lambda s: F.struct(s["own"].alias("own"), answer(s["j"]).alias("a")))
        sure = F.transform(F.filter(scored, lambda s: s["a"]["family"] == s["own"]), lambda s: F.struct(s["a"]["confidence"].alias("confidence"), s["own"].alias("family")))
        return F.struct(x["a"]["confidence"].alias("confidence"), sure.alias("sure"))

    runs = F.filter(F.split(text, BLANK, -1), lambda x: has_cue(x, model.cues))
    lines = F.transform(runs, lambda x: F.filter(F.transform(F.split(x, "\n", -1), lambda y: F.struct(tokens(y).alias("w"), has_cue(y, model.cues).alias("cue"))), lambda u: F.size(u["w"]) > 0))
    found = F.flatten(F.transform(lines, cued))
    for step in (alone, joined):
        found = F.transform(found, step)
    return F.when(has_cue(F.coalesce(text, F.lit("")), model.cues), found)


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, n_paragraphs, family (confirmed by a template, else unknown; null without a paragraph), its
    confidence, and all confirmed families."""
    found = docs.select("doc_id", paragraphs(model, F.col("text")).alias("p")).withColumn("p", F.coalesce("p", F.array().cast("array<struct<confidence: double, sure: array<struct<confidence: double, family: string>>>>")))
    found = found.withColumn("sure", F.flatten(F.transform("p", lambda x: x["sure"])))
    best = F.array_max("sure")
    family = F.when(F.size("p") == 0, F.lit(None)).when(F.size("sure") == 0, "unknown").otherwise(best["family"])
    confidence = F.when(F.size("p") == 0, 0.0).when(F.size("sure") == 0, F.array_max(F.transform("p", lambda x: x["confidence"]))).otherwise(best["confidence"])
    return found.select("doc_id", F.size("p").alias("n_paragraphs"), family.alias("family"), F.round(confidence, 6).alias("confidence"), F.array_join(F.array_sort(F.array_distinct(F.transform("sure", lambda x: x["family"]))), ",").alias("families"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, fitted(docs))
