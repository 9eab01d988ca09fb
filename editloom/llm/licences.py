"""Licence scans: a trained paragraph classifier, confirmed by templates; DataFrame functions only on the main path.

A multinomial logistic regression with few non-zero weights reads words, pairs and triples of words of a paragraph and
gives the probability of each licence family and of the class unknown. It is trained on the driver, on variations of
public notices and on other paragraphs that use the same words; a temperature fitted on variations held back calibrates
it. A prediction counts only if the paragraph has most word pairs of one of the family's templates.
"""

from __future__ import annotations

import functools
import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from editloom.llm.common import cut, table

#: Notices by which works are put under a licence, by family.
TEMPLATES = {
    "agpl-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "Licensed under the GNU Affero General Public License, version 3."),
    "apache-2.0": ("Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0', "Released under the Apache License 2.0."),
    "bsd-3-clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Use of this source code is governed by a BSD-style license.", "Released under the BSD 3-Clause License."),
    "cc-by-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-sa-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc0-1.0": ("Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "This work is dedicated to the public domain under the Creative Commons CC0 1.0 Universal license."),
    "gpl-2.0": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "This work is licensed under the GNU General Public License, version 2."),
    "gpl-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This work is licensed under the GNU General Public License, version 3."),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License."),
    "lgpl-3.0": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.", "Licensed under the GNU Lesser General Public License, version 3."),
    "mit": ("Released under the MIT License.", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction', "Licensed under the MIT license."),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "Released under the Unlicense."),
}
#: Names of the families in tags that stand for a notice (SPDX), which are templates, too.
TAGS = {
    "agpl-3.0": ("AGPL-3.0-only", "AGPL-3.0-or-later"), "apache-2.0": ("Apache-2.0",), "bsd-3-clause": ("BSD-3-Clause",), "cc-by-4.0": ("CC-BY-4.0",), "cc-by-nc-4.0": ("CC-BY-NC-4.0",),
    "cc-by-sa-4.0": ("CC-BY-SA-4.0",), "cc0-1.0": ("CC0-1.0",), "gpl-2.0": ("GPL-2.0-only", "GPL-2.0-or-later"), "gpl-3.0": ("GPL-3.0-only", "GPL-3.0-or-later"), "isc": ("ISC",),
    "lgpl-3.0": ("LGPL-3.0-only", "LGPL-3.0-or-later"), "mit": ("MIT",), "mpl-2.0": ("MPL-2.0",), "unlicense": ("Unlicense",),
}
for _family, _names in TAGS.items():
    TEMPLATES[_family] += tuple(f"SPDX-License-Identifier: {name}" for name in _names)
#: Paragraphs with the same words that put nothing under a licence.
OTHERS = (
    "All rights reserved. No part of this publication may be reproduced without permission of the publisher.",
    "You need a driving license to rent a car, and a copy of it must be sent to the office.",
    "The city council issued a license to the restaurant under the terms of the new law.",
    "He lost his fishing license, and his permission to use the harbour was withdrawn.",
    "The company offers a commercial license with support; contact sales for the terms and conditions.",
    "This software is proprietary and confidential; its use is governed by a separate license agreement.",
    "Copyright of the photographs remains with the photographers.",
    "The museum asks for permission before any picture is copied or published.",
    "Version 3 of the program was released under a new name in spring.",
    "The apache helicopter was licensed for production under an agreement with the government.",
    "Students of MIT released a statement under the title free and open.",
    "The general public may use the library free of charge with a valid license.",
    "The software license key is printed on the back of the box.",
    "A warranty is granted for two years under the conditions that the dealer publishes.",
)
#: A paragraph with one of these words is scanned. Every template has one.
ANCHORS = ("license", "licensed", "licence", "licenced", "licenses", "licences", "copyright", "permission", "redistribution", "warranty", "unencumbered", "unlicense", "cc0")
WORDS = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: A word that a line's end breaks behind a hyphen: what leads the next line, and the rest of the word.
BROKEN = r"(?<=[A-Za-z0-9])-\n([^A-Za-z0-9\n]*)([A-Za-z0-9]+(?:[.-][A-Za-z0-9]+)*)"
UNKNOWN = "unknown"
#: What a family must have: probability, and share of the word pairs of a template.
PROBABLE, SIMILAR = 0.5, 0.8
SEED = 42


def words_of(text: str) -> list[str]:
    return re.findall(WORDS, text.lower())


def grams(words: list[str], longest: int = 3) -> list[str]:
    """Distinct runs of one to ``longest`` words."""
    return list(dict.fromkeys(" ".join(words[k : k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)))


def _variations(random: np.random.Generator) -> list[tuple[list[str], str]]:
    """Training paragraphs: notices with other words around, words lost or replaced; and paragraphs of class unknown."""
    names = list(TEMPLATES)
    filler = [w for t in OTHERS for w in words_of(t)]
    some = lambda most: list(random.choice(filler, random.integers(0, most)))
    out = []
    for family in names:
        for text in TEMPLATES[family]:
            for _ in range(24):
                words = words_of(text)
                if len(words) > 2:  # a tag is a tag only as it is
                    words = [w if random.random() > 0.03 else random.choice(filler) for w in words if random.random() > 0.03]
                out.append((some(8) + words + some(8), family))
    pool = [w for texts in TEMPLATES.values() for t in texts for w in words_of(t)]
    for text in OTHERS:
        for _ in range(16):
            out.append((some(5) + [w for w in words_of(text) if random.random() > 0.05] + some(5), UNKNOWN))
    for _ in range(200):  # words of notices out of order, and pieces of them
        n = int(random.integers(3, 30))
        out.append((list(random.choice(pool, n)), UNKNOWN))
        k = int(random.integers(0, len(filler) - n))
        out.append((filler[k : k + n], UNKNOWN))
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


@functools.cache
def train(rounds: int = 400, rate: float = 1.0, sparse: float = 3e-4, seed: int = SEED) -> tuple[tuple[str, ...], dict[str, tuple[float, ...]], tuple[float, ...], float]:
    """Classes, weights of each n-gram, biases, and the share of held-back paragraphs that are told right.

    Proximal gradient steps on the mean log loss with a penalty on absolute weights; a temperature, which is divided into
    the weights, makes the held-back loss least.
    """
    random = np.random.default_rng(seed)
    rows = _variations(random)
    classes = (*TEMPLATES, UNKNOWN)
    vocabulary = {g: k for k, g in enumerate(sorted({g for texts in TEMPLATES.values() for t in texts for g in grams(words_of(t))} | {w for t in OTHERS for w in words_of(t)}))}
    x = np.zeros((len(rows), len(vocabulary)))
    for k, (words, _) in enumerate(rows):
        x[k, [vocabulary[g] for g in grams(words) if g in vocabulary]] = 1
    y = np.array([classes.index(c) for _, c in rows])
    held = random.random(len(rows)) < 0.25
    xt, yt = x[~held], np.eye(len(classes))[y[~held]]
    w, b = np.zeros((x.shape[1], len(classes))), np.zeros(len(classes))
    b[-1] = 1.0
    for _ in range(rounds):
        off = _softmax(xt @ w + b) - yt
        w -= rate * xt.T @ off / len(xt)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * sparse, 0)
        b -= rate * off.mean(axis=0)
    z = x[held] @ w + b
    loss = lambda t: -np.log(_softmax(z / t)[np.arange(len(z)), y[held]] + 1e-12).mean()
    t = min(np.geomspace(0.2, 5, 41), key=loss)
    right = float((z.argmax(axis=1) == y[held]).mean())
    return classes, {g: tuple(np.round(w[k] / t, 6).tolist()) for g, k in vocabulary.items() if np.any(w[k])}, tuple(np.round(b / t, 6).tolist()), right


def template_pairs() -> list[tuple[str, int, str, int]]:
    """(family, template, word pair, number of pairs of the template)."""
    out, at = [], 0
    for family, texts in TEMPLATES.items():
        for text in texts:
            words = words_of(text)
            pairs = sorted({f"{a} {b}" for a, b in zip(words, words[1:])})
            out += [(family, at, p, len(pairs)) for p in pairs]
            at += 1
    return out


def _runs(n: int):
    """Runs of ``n`` words of the array w."""
    return F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda k: F.array_join(F.slice("w", k, n), " "))).otherwise(F.array().cast("array<string>"))


def _apart(begin: str, end: str):
    """Of the spans in the array all, each that no span kept before it meets."""
    meets = lambda x: lambda y: (x[begin] <= y[end]) & (y[begin] <= x[end])
    return F.aggregate(F.slice("all", 2, F.size("all")), F.slice("all", 1, 1), lambda out, x: F.when(F.exists(out, meets(x)), out).otherwise(F.concat(out, F.array(x))))


def _judged(once: DataFrame) -> DataFrame:
    """(key, family, probability, similarity) for the distinct paragraphs ``once`` (key, text)."""
    spark = once.sparkSession
    classes, weights, bias, _ = train()
    words = once.select("key", F.regexp_extract_all(F.lower("text"), F.lit(f"({WORDS})")).alias("w"))
    # a bounded model: one row per n-gram with a weight, and one per pair of a template
    model = spark.createDataFrame([(g, list(w)) for g, w in weights.items()], "gram string, weights array<double>")
    pairs = spark.createDataFrame(template_pairs(), "family string, template int, pair string, pairs int")
    found = words.select("key", F.explode(F.array_distinct(F.concat(_runs(1), _runs(2), _runs(3)))).alias("gram")).join(F.broadcast(model), "gram")
    sums = found.groupBy("key").agg(*(F.sum(F.col("weights")[k]).alias(f"z{k}") for k in range(len(classes))))
    scored = once.select("key").join(sums, "key", "left")
    scores = F.array(*(F.coalesce(F.col(f"z{k}"), F.lit(0.0)) + F.lit(b) for k, b in enumerate(bias)))
    scored = scored.select("key", scores.alias("z")).withColumn("top", F.array_max("z"))
    total = F.aggregate("z", F.lit(0.0), lambda a, z: a + F.exp(z - F.col("top")))
    best = F.element_at(F.array(*map(F.lit, classes)), F.array_position("z", F.col("top")).cast("int"))
    judged = scored.select("key", best.alias("best"), F.round(1 / total, 6).alias("probability"))
    alike = words.select("key", F.explode(F.array_distinct(_runs(2))).alias("pair")).join(F.broadcast(pairs), "pair")
    alike = alike.groupBy("key", "family", "template").agg((F.count("*") / F.first("pairs")).alias("share")).groupBy("key", "family").agg(F.max("share").alias("share"))
    joined = judged.join(alike.withColumnRenamed("family", "best"), ["key", "best"], "left").withColumn("similarity", F.round(F.coalesce("share", F.lit(0.0)), 6))
    sure = (F.col("probability") >= PROBABLE) & (F.col("similarity") >= SIMILAR)
    return joined.select("key", F.when(sure, F.col("best")).otherwise(UNKNOWN).alias("family"), "probability", "similarity")


def _wrapped(texts: DataFrame) -> DataFrame:
    """(of, first, last, text, shown): runs of two or more lines of the distinct ``texts`` (of, text) that have enough word
    pairs of a template within twice its words, wherever its lines are broken. A word broken behind a hyphen is whole in text, not in shown.
    """
    spark = texts.sparkSession
    texts = texts.select("of", F.col("text").alias("shown"), F.regexp_replace("text", BROKEN, "-$2\n$1").alias("text"))
    sizes = [len(words_of(t)) for ts in TEMPLATES.values() for t in ts]
    pairs = spark.createDataFrame([(t, p, n, 2 * sizes[t]) for _, t, p, n in template_pairs()], "template int, pair string, pairs int, reach int")
    split = F.transform(F.split("text", "\n"), lambda line, k: F.transform(F.regexp_extract_all(F.lower(line), F.lit(f"({WORDS})")), lambda w: F.struct(k.alias("line"), w.alias("word"))))
    words = texts.select("of", F.flatten(split).alias("w")).where(F.size("w") > 1)
    two = F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda k: F.struct(k.alias("at"), F.col("w")[k]["line"].alias("begin"), F.col("w")[k + 1]["line"].alias("end"), F.concat_ws(" ", F.col("w")[k]["word"], F.col("w")[k + 1]["word"]).alias("pair")))
    hits = words.select("of", F.explode(two).alias("h")).select("of", "h.*").join(F.broadcast(pairs), "pair")
    # positions in units of a template's reach, so that one range fits all
    hits = hits.withColumn("place", F.floor(F.col("at") * 10_000 / F.col("reach")).cast("long"))
    by = Window.partitionBy("of", "template").orderBy("place")
    ahead = by.rangeBetween(0, 10_000)
    runs = hits.select("of", "template", "place", "at", F.col("begin").alias("first"), (F.size(F.collect_set("pair").over(ahead)) / F.col("pairs")).alias("share"))
    runs = runs.where(F.col("share") >= SIMILAR)
    # a run ends where the last of its pairs is first seen; of those with a word in common the most alike stays, then the shortest
    inside = hits.select("of", "template", F.col("place").alias("p"), F.col("at").alias("a"), "end", "pair").join(runs, ["of", "template"]).where("a >= at and p <= place + 10000")
    by = ["of", "template", "at", "first", "share"]
    runs = inside.groupBy(*by, "pair").agg(F.min(F.struct("a", "end")).alias("z")).groupBy(*by).agg(F.max("z").alias("z"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("s"), (F.col("z.a") - F.col("at")).alias("n"), F.col("at").alias("x"), F.col("z.a").alias("y"), "first", F.col("z.end").alias("last"))))
    runs = runs.groupBy("of", "template").agg(order.alias("all")).select("of", F.explode(_apart("x", "y")).alias("r")).select("of", "r.first", "r.last")
    runs = runs.where(F.col("last") > F.col("first")).distinct()
    lines = lambda c: F.array_join(F.slice(F.split(c, "\n"), F.col("first") + 1, F.col("last") - F.col("first") + 1), "\n").alias(c)
    return runs.join(texts, "of").select("of", "first", "last", lines("text"), lines("shown"))


def scan_licences(docs: DataFrame) -> DataFrame:
    """One row per paragraph of ``docs`` (doc_id, text) with a word of ANCHORS: doc_id, paragraph (its first line, from
    0), family, probability, similarity and text.

    A paragraph is a line; but lines over which a notice is wrapped are one paragraph, if they are judged to be of a
    family and none of them is alone. family is the likeliest if its probability and its similarity to a template of its
    own suffice, else unknown; probability is of the likeliest class, similarity of the likeliest family's best
    template. Both are rounded to six places. Equal paragraphs are judged once, whatever the number of documents that
    share them.

    Null and empty texts have no paragraphs; very long ones are scanned whole; repeated rows and null doc_ids give their
    rows like any other; an empty table gives no rows; further columns are ignored.
    """
    anchor = r"(?i)\b(?:" + "|".join(ANCHORS) + r")\b"
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").rlike(anchor))
    lines = kept.withColumn("of", F.sha2("text", 256)).select("doc_id", "of", F.posexplode(F.split("text", "\n")).alias("paragraph", "text")).where(F.col("text").rlike(anchor))
    lines = cut(lines.select("doc_id", "of", "paragraph", "text", F.sha2("text", 256).alias("key")))
    texts = kept.groupBy(F.sha2("text", 256).alias("of")).agg(F.first("text").alias("text"))
    runs = cut(_wrapped(texts).where(F.col("text").rlike(anchor)).withColumn("key", F.sha2("text", 256)))
    once = cut(lines.select("key", "text").unionByName(runs.select("key", "text")).groupBy("key").agg(F.first("text").alias("text")))
    named = cut(_judged(once))
    alone = lines.join(named.where(F.col("family") != UNKNOWN), "key").select("of", F.col("paragraph").alias("line")).distinct()
    inside = lambda line: (F.col(line) >= F.col("first")) & (F.col(line) <= F.col("last"))
    runs = runs.join(named.where(F.col("family") != UNKNOWN), "key").join(alone.withColumnRenamed("of", "_of"), (F.col("of") == F.col("_of")) & inside("line"), "left_anti")
    # of runs with a line in common the one most alike stays, then the longest
    order = F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("a"), (F.col("first") - F.col("last")).alias("b"), "first", "last", "key", "family", "probability", "similarity", F.col("shown").alias("text"))))
    runs = cut(runs.groupBy("of").agg(order.alias("all")).select("of", F.explode(_apart("first", "last")).alias("x")).select("of", "x.*"))
    covered = runs.select(F.col("of"), F.explode(F.sequence("first", "last")).alias("paragraph"))
    single = lines.join(covered, ["of", "paragraph"], "left_anti").join(named, "key")
    several = kept.select("doc_id", F.sha2("text", 256).alias("of")).join(runs.withColumnRenamed("first", "paragraph"), "of")
    cols = ["doc_id", "paragraph", "family", "probability", "similarity", "text"]
    return single.select(*cols).unionByName(several.select(*cols))


def op6(spark, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


def op6_sql() -> str:
    """The same over a view ``documents``, for DuckDB; lines only, so without notices that are wrapped."""
    classes, weights, bias, _ = train()
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    model = ",".join(f"({quote(g)},[{','.join(map(repr, w))}]::double[])" for g, w in weights.items())
    pairs = ",".join(f"({quote(f)},{t},{quote(p)},{n})" for f, t, p, n in template_pairs())
    anchor = r"\b(" + "|".join(ANCHORS) + r")\b"
    runs = lambda n: f"list_transform(range(1, greatest(len(w) - {n - 2}, 1)), lambda k: array_to_string(w[k:k + {n - 1}], ' '))"
    return f"""
with model(gram, weights) as (values {model}),
pairs(family, template, pair, pairs) as (values {pairs}),
split as (select doc_id, string_split(text, chr(10)) l from documents),
lines as (select * from (select doc_id, unnest(range(len(l))) paragraph, unnest(l) as text from split) where regexp_matches(text, '{anchor}', 'i')),
words as (select text, regexp_extract_all(lower(text), '{WORDS}') w from (select distinct text from lines)),
found as (select text, unnest(list_distinct(list_concat(list_concat({runs(1)}, {runs(2)}), {runs(3)}))) gram from words),
sums as (select text, {', '.join(f'sum(weights[{k + 1}]) z{k}' for k in range(len(classes)))} from found join model using (gram) group by text),
scored as (select w.text, [{', '.join(f'coalesce(z{k}, 0.0) + {b!r}' for k, b in enumerate(bias))}]::double[] z from words w left join sums s on s.text = w.text),
judged as (select text, ([{', '.join(map(quote, classes))}])[list_position(z, list_max(z))] best,
  round(1 / list_sum(list_transform(z, lambda x: exp(x - list_max(z)))), 6) probability from scored),
alike as (select text, family best, max(share) share from (
  select text, family, template, count(*)::double / any_value(pairs) share
  from (select text, unnest(list_distinct({runs(2)})) pair from words) join pairs using (pair) group by all) group by all)
select l.doc_id, l.paragraph::int paragraph,
  case when probability >= {PROBABLE} and round(coalesce(share, 0.0), 6) >= {SIMILAR} then j.best else '{UNKNOWN}' end family,
  probability, round(coalesce(share, 0.0), 6) similarity, l.text
from lines l join judged j on j.text = l.text left join alike a on a.text = j.text and a.best = j.best"""
