"""Licence scan by the Dice coefficient over word bigrams, in DataFrame functions only.

Units of a text are its lines, its paragraphs (between blank lines) and the whole; units of one text that read alike are
one. A unit and a template are compared as sets of word bigrams of their normalised text (lower case, ASCII letters and
digits, single blanks): Dice = 2 * common / (a + b).

Notices that stand inside other words or run over marked or wrapped lines are in no such unit. They are looked for as
windows of words anywhere in the text, whose marks and line ends are no words; a notice that a unit already shows is not
counted again.

Two lossless bounds prune. Dice >= t needs a between b * t / (2 - t) and b * (2 - t) / t. And of a template's b bigrams
at least b * t / (2 - t) must be common, so one of any b - that + 1 of them is: only units that hold one of these, the
longest words first, are taken apart at all.
"""

from __future__ import annotations

import json
import math
import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.functions.text import let
from offerlens.llm.common import op, probe, table
from offerlens.session import staged

THRESHOLD = 0.8

# Short notices and characteristic paragraphs of common licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "MIT": "Released under the MIT License.",
    "MIT-licensed": "This project is licensed under the terms of the MIT license.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
    "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "All-rights-reserved": "Copyright. All rights reserved.",
}


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a template, in order."""
    words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def _least_common(b: int, threshold: float) -> int:
    """Fewest common bigrams that a template of ``b`` can have with a unit at the threshold."""
    return max(1, math.ceil(threshold * b / (2 - threshold) - 1e-9))


def telling(text: str, threshold: float) -> list[str]:
    """Bigrams of a template of which every similar unit has at least one; those of long words are preferred as rare."""
    all_ = sorted(bigrams(text), key=lambda g: (-len(g), g))
    return all_[: len(all_) - _least_common(len(all_), threshold) + 1]


def _may_match(low: Column, grams: list[str], threshold: float) -> Column:
    """A lossless test on the lower-cased text: False only if no unit can reach the template.

    A similar unit lacks at most b - common of the bigrams, so it has one of any b - common + 1; a word of five letters
    or more of each is looked for. With too few such bigrams the unit may lack all of them, and then has all others.
    """
    spare = len(grams) - _least_common(len(grams), threshold)
    word = {g: max(g.split(), key=lambda w: (len(w), w)) for g in grams}
    ranked = sorted(grams, key=lambda g: (-len(word[g]), g))
    strong = [g for g in ranked if len(word[g]) >= 5]
    has = lambda w: F.contains(low, F.lit(w))
    if len(strong) > spare or len(strong) < spare:
        return reduce(or_, [has(w) for w in sorted({word[g] for g in ranked[: spare + 1]})])
    others = reduce(and_, [has(w) for w in sorted({w for g in ranked[spare:] for w in g.split()})])
    return reduce(or_, [has(w) for w in sorted({word[g] for g in strong})], others)


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def _pairs(words: Column) -> Column:
    pairs = F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>"))


def _bigrams(words: Column) -> Column:
    return F.array_distinct(_pairs(words))


def _windows(some: DataFrame, templates: dict[str, str], sets: dict[str, list[str]], threshold: float) -> DataFrame:
    """(doc_id, row, unit, license, dice): of each stretch of overlapping similar windows of words the most similar one.

    ``some``: doc_id, row, text. Without the bigrams at its ends that the template lacks a window is not less similar, so
    windows from one bigram of the template to another are enough. A window has up to (2 - t) / t times the bigrams of
    the template, repeated ones included.
    """
    size = {k: len(re.sub("[^a-z0-9]+", " ", templates[k].lower()).split()) - 1 for k in sets}
    about = [{"license": k, "gram": g, "theirs": len(sets[k]), "least": _least_common(len(sets[k]), threshold), "reach": math.floor(size[k] * (2 - threshold) / threshold + 1e-9)} for k in sets for g in sets[k]]
    listed = F.from_json(F.lit(json.dumps(about)), "array<struct<license: string, gram: string, theirs: int, least: int, reach: int>>")
    grams = some.sparkSession.range(1).select(F.inline(listed))
    words = some.select("doc_id", "row", F.split(_normal(F.col("text")), " ").alias("words"))
    hits = words.select("doc_id", "row", F.posexplode(_pairs(F.col("words"))).alias("pos", "gram")).join(grams, "gram")
    hits = hits.groupBy("doc_id", "row", "license", "theirs", "least", "reach").agg(F.array_sort(F.collect_set(F.struct("pos", "gram"))).alias("hits"))
    hit = lambda i: F.get("hits", i)
    close = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("hits") - F.col("least"))), lambda i: hit(i + F.col("least") - 1)["pos"] - hit(i)["pos"] < F.col("reach"))
    places = hits.withColumn("i", F.explode(close)).withColumn("first", hit(F.col("i"))["pos"])
    places = places.withColumn("near", F.filter(F.slice("hits", F.col("i") + 1, F.col("reach")), lambda x: x["pos"] < F.col("first") + F.col("reach"))).drop("hits", "i")
    places = staged(places.filter(F.size(F.array_distinct("near.gram")) >= F.col("least")), "licence-places").withColumnsRenamed({"doc_id": "_id", "row": "_row"})
    found = words.join(probe(places), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")))
    found = found.withColumn("part", F.slice("words", F.col("first") + 1, F.col("reach") + 1)).drop("words").distinct()
    width = lambda x: x["pos"] - F.col("first") + 2
    common = lambda x: F.size(F.array_distinct(F.transform(F.filter("near", lambda y: y["pos"] <= x["pos"]), lambda y: y["gram"])))
    dice = lambda x: 2.0 * common(x) / (F.size(_bigrams(F.slice("part", F.lit(1), width(x)))) + F.col("theirs"))
    found = found.withColumn("best", F.array_min(F.transform("near", lambda x: F.struct((-dice(x)).alias("d"), width(x).alias("width"))))).filter(-F.col("best.d") >= threshold)
    found = found.select("doc_id", "row", "license", "first", (F.col("first") + F.col("best.width")).alias("end"), "best.d", F.array_join(F.slice("part", F.lit(1), F.col("best.width")), " ").alias("unit"))
    along = Window.partitionBy("doc_id", "row").orderBy("first", "end", "license")
    before = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("apart", F.coalesce(F.col("first") >= before, F.lit(True)).cast("int")).withColumn("stretch", F.sum("apart").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    found = found.groupBy("doc_id", "row", "stretch").agg(F.min(F.struct("d", "license", "unit")).alias("best"))
    return found.select("doc_id", "row", "best.unit", "best.license", (-F.col("best.d")).alias("dice"))


def license_units(docs: DataFrame, templates: dict[str, str], threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, row, unit, license, dice) for every unit of a text and template at the threshold, and for notices outside such units; ``row`` as xxhash64(doc_id, text)."""
    if not 0 < threshold <= 1:
        raise ValueError("the bounds need a threshold above 0")
    sets = {k: bigrams(t) for k, t in templates.items() if bigrams(t)}
    keys = [(k, g, sets[k]) for k in sets for g in telling(templates[k], threshold)]
    listed = F.from_json(F.lit(json.dumps([{"license": k, "mark": g, "theirs": t} for k, g, t in keys])), "array<struct<license: string, mark: string, theirs: array<string>>>")
    marks = docs.sparkSession.range(1).select(F.inline(listed))  # as large as the templates given
    some = docs.select("doc_id", "text").filter(let(F.lower("text"), lambda low: reduce(or_, [_may_match(low, s, threshold) for s in sets.values()], F.lit(False))))
    units = F.concat(F.split("text", "\n", -1), F.split("text", r"\n[ \t\r]*\n", -1), F.array("text"))
    shortest = min([_least_common(len(s), threshold) for s in sets.values()], default=1)
    longest = max([math.floor(len(s) * (2 - threshold) / threshold + 1e-9) for s in sets.values()], default=0)
    whole = some.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    some = some.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.explode(F.array_distinct(F.transform(units, _normal))).alias("unit"))
    some = some.withColumn("own", _bigrams(F.split("unit", " "))).filter(F.size("own").between(shortest, longest))
    some = some.withColumn("mark", F.explode("own")).join(marks, "mark")
    a, b = F.size("own"), F.size("theirs")
    some = some.filter((a >= b * threshold / (2 - threshold) - 1e-9) & (a <= b * (2 - threshold) / threshold + 1e-9))
    dice = 2.0 * F.size(F.array_intersect("own", "theirs")) / (a + b)
    found = some.select("doc_id", "row", "unit", "license", dice.alias("dice")).filter(F.col("dice") >= threshold).distinct()
    found = staged(found, "licence-units")
    known = found.groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(F.collect_set("unit").alias("known"))
    more = _windows(whole, templates, sets, threshold).join(known, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left")
    inside = lambda a, b: F.contains(F.concat(F.lit(" "), b, F.lit(" ")), F.concat(F.lit(" "), a, F.lit(" ")))
    shown = F.exists("known", lambda u: inside(F.col("unit"), u) | inside(u, F.col("unit")))
    return found.unionByName(more.filter(~F.coalesce(shown, F.lit(False))).select(*found.columns))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, dice, n_notices) for every row of ``docs``.

    ``license``: the template of the highest Dice over all units (ties: first by name), null below the threshold;
    ``n_notices``: distinct units that reach it for some template. Null and empty texts have none; rows that are equal in
    id and text get equal results.
    """
    found = license_units(docs, templates or TEMPLATES, threshold)
    best = F.min(F.struct((-F.col("dice")).alias("d"), "license")).alias("best")
    found = found.groupBy("doc_id", "row").agg(best, F.count_distinct("unit").alias("n_notices")).withColumnRenamed("doc_id", "_id").withColumnRenamed("row", "_row")
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"))
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left")
    return rows.select("doc_id", F.col("best.license").alias("license"), (-F.col("best.d")).alias("dice"), F.coalesce("n_notices", F.lit(0)).alias("n_notices"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_GRAMS = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
_SQL = f"""
WITH t AS (SELECT license, {_GRAMS} AS theirs FROM (SELECT license,
    string_split(trim(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g')), ' ') AS w
  FROM (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in TEMPLATES.items())}) v(license, t))),
parts AS (SELECT doc_id, unnest(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '\\n[ \\t\\r]*\\n'), [text])) AS u FROM documents),
units AS (SELECT DISTINCT doc_id, trim(regexp_replace(lower(u), '[^a-z0-9]+', ' ', 'g')) AS unit FROM parts),
short AS (SELECT doc_id, unit, string_split(unit, ' ') AS w FROM units WHERE length(unit) BETWEEN 3 AND 2000),
own AS (SELECT doc_id, unit, {_GRAMS} AS own FROM short WHERE len(w) > 1),
hits AS (SELECT doc_id, unit, license, 2.0::DOUBLE * len(list_intersect(own, theirs)) / (len(own) + len(theirs)) AS dice FROM own, t
  WHERE len(own) BETWEEN len(theirs) * 0.6 AND len(theirs) * 1.6),
best AS (SELECT doc_id, arg_min(license, (-dice, license)) AS license, max(dice) AS dice, count(DISTINCT unit) AS n_notices
  FROM hits WHERE dice >= {THRESHOLD} GROUP BY doc_id)
SELECT d.doc_id, license, dice, coalesce(n_notices, 0) AS n_notices FROM documents d LEFT JOIN best USING (doc_id)"""


@op("op8_license_scan", _SQL)
def op8_license_scan(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))
