"""License scans: texts, their lines and their windows against licence templates by Dice
coefficient.

A unit is a line of a document, its whole text, or a window: as many words in a row of the
whole text as the template has, line breaks ignored, so a notice that is wrapped over lines
or stands inside a paragraph is found.  A unit is normalised (runs of ASCII
letters and digits, lower case) and compared to each template over sets of word bigrams:
``2 * common / (size + template size) >= LEAST``.  Sizes bound this from above, so a unit
meets only templates whose size is between ``LEAST / (2 - LEAST)`` and its inverse times
its own; and a unit with fewer words, or fewer bigrams of any template, than the smallest
template allows is dropped before its own set is built.  The least number of common
bigrams also means that a unit must hold one of a few marker words (``markers``): texts
and lines without any are dropped by one scan, before they are cut into words.

Windows begin where a bigram of the template stands (or end with the text): any other
window has one of these that holds the same bigrams of the template.  A text meets a
template by windows only if it has enough of its bigrams, and a window is scored only if
enough of them stand in it.

Only built-in functions are used; the templates are constants, and rows move once, as
ids and their few matches.

Windows only add: the ``dice`` of a licence that a line or the whole text matches is theirs.
``ORACLE_SQL`` scores every window of every text that holds enough of a template's bigrams.

Defined results: null, empty and wordless texts have no units and match nothing; rows
with a null id take no part; rows that share an id are one document (one result row, the
matches of all their lines); ties go to the licence first in alphabetical order; an empty
table gives no rows; texts of any length are scanned whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 0.8

# Licence notices as their publishers word them.
TEMPLATES = [
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                   "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                   "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
                   "permissions and limitations under the License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met:"),
    ("bsd", "Released under the BSD License."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("public-domain", "This work is dedicated to the public domain."),
]


# Words of the templates that are common in any text.
COMMON = frozenset("a all and any as at be by for from in is it may not of on or that the this to under you".split())


def template_words(text: str) -> list[str]:
    """The words of a text, by the normalisation of the scan."""
    return [w.lower() for w in re.findall("[A-Za-z0-9]+", text)]


def template_bigrams(text: str) -> list[str]:
    """The distinct word bigrams of a text, by the normalisation of the scan."""
    words = template_words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def unit_bigrams(words: Column) -> Column:
    return F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1),
                      lambda a, b: F.concat_ws(" ", a, b))


def _once(value: Column, name: str) -> Column:
    """A column computed once, whatever reads it: a generator's output is never inlined
    into the expressions and filters above it."""
    return F.explode(F.array(value)).alias(name)


def markers(sets: list[list[str]], least: float) -> list[str]:
    """A few words of which every unit that reaches ``least`` with some template holds one:
    the bigrams without a marker are too few to reach it.  Words shared by many templates
    come first, then long ones; a marker may be part of a longer word."""
    chosen: list[str] = []

    def open_bigrams(bigrams: list[str]) -> list[str]:
        left = [b for b in bigrams if not any(m in b for m in chosen)]
        return left if 2 * len(left) >= least * (len(left) + len(bigrams)) - 1e-9 else []

    while rest := [left for b in sets if (left := open_bigrams(b))]:
        held = Counter(w for left in rest for w in {w for b in left for w in b.split(" ")})
        chosen.append(max(held, key=lambda w: (w not in COMMON, len(w) > 4, held[w], len(w), w)))
    return chosen


def matches(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """``doc_id``, ``unit`` (0 the whole text, -1 the best window, else the line),
    ``license`` and ``dice`` of every unit and template with a Dice coefficient of ``least``
    or more."""
    spark = docs.sparkSession
    sets = [(name, template_bigrams(text)) for name, text in templates]
    widths = [len(template_words(text)) - 1 for _, text in templates]  # bigrams of a window
    known = sorted({b for _, bigrams in sets for b in bigrams})
    smallest = min(len(b) for _, b in sets)
    words = markers([b for _, b in sets], least)

    def marked(text: str) -> Column:  # the lower-case text is made once
        return F.exists(F.array(F.lower(text)), lambda t: reduce(or_, [t.contains(F.lit(w)) for w in words]))

    units = (docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").filter(marked("text"))
             .select(F.col("doc_id").cast("long").alias("doc_id"),
                     F.posexplode(F.concat(F.array("text"), F.split("text", "\n"))).alias("unit", "line"))
             .filter(marked("line"))
             .select("doc_id", "unit", _once(F.split(F.trim(F.lower(F.regexp_replace("line", "[^A-Za-z0-9]+", " "))), " "), "words")))
    # dice >= least needs size >= least / (2 - least) * template, and as many common bigrams.
    bound = least / (2 - least) - 1e-9
    floor = bound * smallest
    some = (units.filter(F.size("words") - 1 >= floor)
            .select("doc_id", "unit", _once(unit_bigrams(F.col("words")), "own"))
            .select("doc_id", "unit", "own", _once(F.array_distinct(F.filter("own", lambda b: b.isin(known))), "common"))
            .filter(F.size("common") >= floor)
            .select("doc_id", "unit", F.when(F.col("unit") == 0, F.col("own")).alias("own"), "common",
                    _once(F.size(F.array_distinct("own")), "size")))
    rows = [(n, b, len(b), width, math.ceil(bound * len(b))) for (n, b), width in zip(sets, widths)]
    table = F.broadcast(spark.createDataFrame(
        rows, "license string, bigrams array<string>, template int, width int, need int"))
    inside = (F.col("size") >= bound * F.col("template")) & (F.col("size") * bound <= F.col("template"))
    # A window has at least as many words as its template; a text of fewer is one unit.
    wide = ((F.col("unit") == 0) & (F.size("own") >= F.col("width")) & (F.size("common") >= F.col("need"))
            & (F.size(F.array_intersect("common", "bigrams")) >= F.col("need")))
    met = some.join(table, inside | wide).select(
        "doc_id", "unit", "license", "template", "width", "need", "own",
        F.when(inside, 2.0 * F.size(F.array_intersect("common", "bigrams")) / (F.col("size") + F.col("template"))).alias("dice"),
        _once(F.when(wide, _places(F.col("own"), F.col("bigrams"), known)), "hits"))
    return (met.select("doc_id", "license", F.inline(F.array(
                F.struct("unit", "dice"), F.struct(F.lit(-1).alias("unit"), _window_dice().alias("dice")))))
            .filter(F.col("dice") >= least).select("doc_id", "unit", "license", "dice"))


def _places(own: Column, bigrams: Column, known: list[str]) -> Column:
    """Place and bigram of each bigram of a text that the template has."""
    return F.filter(F.transform(own, lambda b, i: F.struct(i.alias("i"), b.alias("b"))),
                    lambda x: x["b"].isin(known) & F.array_contains(bigrams, x["b"]))


def _window_dice() -> Column:
    """The largest Dice coefficient of a text's windows with a template, from ``hits``, their
    places; null if no window has the bigrams that are needed."""
    hits, own, width, need = F.col("hits"), F.col("own"), F.col("width"), F.col("need")
    last = F.size(own) - width  # where the last window begins

    def promising(x: Column) -> Column:
        # The last window stands for all places after its begin: only the first is scored.
        inner = F.get(hits, x["k"] + need - 1)["i"] < x["i"] + width
        first = (x["k"] == 0) | (F.get(hits, x["k"] - 1)["i"] < last)
        return F.when(x["i"] < last, inner).otherwise(first)

    def dice(x: Column) -> Column:
        begin = F.least(x["i"], last)
        # A window holds no more hits than places, and begins at one or just before it.
        near = F.filter(F.slice(hits, x["k"] + 1, width), lambda h: h["i"] < begin + width)
        common = F.size(F.array_distinct(F.transform(near, lambda h: h["b"])))
        return 2.0 * common / (F.size(F.array_distinct(F.slice(own, begin + 1, width))) + F.col("template"))

    numbered = F.transform(hits, lambda h, k: F.struct(k.alias("k"), h["i"].alias("i")))
    return F.array_max(F.transform(F.filter(numbered, promising), dice))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: ``licenses`` (sorted, joined by commas), ``n_lines`` that match
    one, the ``best`` licence and its ``dice`` (null without a match).  A licence that the
    text or a line matches has their ``dice``, any other that of its best window."""
    match = F.struct((-F.col("dice")).alias("d"), "license")
    window = F.col("unit") < 0
    # Of a document: at most one name a licence and one best window a template.
    found = (matches(docs).groupBy("doc_id").agg(
        F.array_sort(F.collect_set("license")).alias("names"),
        F.collect_set(F.when(~window, F.col("license"))).alias("in_units"),
        F.countDistinct(F.when(F.col("unit") > 0, F.col("unit"))).alias("n_lines"),
        F.min(F.when(~window, match)).alias("unit"), F.collect_set(F.when(window, match)).alias("windows"))
        .select("doc_id", F.array_join("names", ",").alias("licenses"), "n_lines", F.least("unit", F.array_min(F.filter(
            "windows", lambda w: ~F.array_contains("in_units", w["license"])))).alias("best")))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    return ids.join(found, "doc_id", "left").select(
        "doc_id", F.coalesce("licenses", F.lit("")).alias("licenses"),
        F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"),
        F.col("best.license").alias("best"), F.round(-F.col("best.d"), 6).alias("dice"))


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLE_SQL = f"""
WITH templates(license, body) AS (VALUES {', '.join(f'({_literal(n)}, {_literal(t)})' for n, t in TEMPLATES)}),
units AS (
  SELECT doc_id, 0 AS unit, text AS body FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
  UNION ALL
  SELECT doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) AS unit,
         unnest(string_split(text, chr(10))) AS body
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
unit_words AS (SELECT doc_id, unit, regexp_extract_all(body, '[A-Za-z0-9]+') AS w FROM units),
unit_sets AS (
  SELECT doc_id, unit, list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: lower(w[i]) || ' ' || lower(w[i + 1]))) AS b
  FROM unit_words WHERE len(w) > 1),
template_words AS (SELECT license, regexp_extract_all(body, '[A-Za-z0-9]+') AS w FROM templates),
template_sets AS (
  SELECT license, len(w) - 1 AS width,
         list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: lower(w[i]) || ' ' || lower(w[i + 1]))) AS b
  FROM template_words),
text_bigrams AS (
  SELECT doc_id, list_transform(generate_series(1, len(w) - 1), lambda i: lower(w[i]) || ' ' || lower(w[i + 1])) AS seq
  FROM unit_words WHERE unit = 0 AND len(w) > 1),
wide AS (
  SELECT doc_id, license, width, b, seq FROM text_bigrams JOIN template_sets ON len(seq) >= width
  WHERE len(list_intersect(list_distinct(seq), b)) * (2 - {LEAST}) >= {LEAST} * len(b) - 1e-9),
window_sets AS (
  SELECT doc_id, license, b, list_distinct(seq[i:i + width - 1]) AS own
  FROM (SELECT *, unnest(generate_series(1, len(seq) - width + 1)) AS i FROM wide)),
window_dice AS (
  SELECT doc_id, license, max(2.0::DOUBLE * len(list_intersect(own, b)) / (len(own) + len(b))) AS dice FROM window_sets GROUP BY ALL),
pairs AS (
  SELECT u.doc_id, u.unit, t.license, 2.0::DOUBLE * len(list_intersect(u.b, t.b)) / (len(u.b) + len(t.b)) AS dice
  FROM unit_sets u JOIN template_sets t ON len(u.b) <= 2 * len(t.b) AND len(t.b) <= 2 * len(u.b)),
in_units AS (SELECT * FROM pairs WHERE dice >= {LEAST}),
found AS (
  SELECT * FROM in_units
  UNION ALL
  SELECT doc_id, -1 AS unit, license, dice FROM window_dice ANTI JOIN in_units USING (doc_id, license) WHERE dice >= {LEAST}),
best AS (SELECT doc_id, license, dice, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, license) AS r FROM found)
SELECT d.doc_id, coalesce(f.licenses, '') AS licenses, coalesce(f.n_lines, 0)::BIGINT AS n_lines,
       best.license AS best, round(best.dice, 6) AS dice
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d
LEFT JOIN (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses,
                  count(DISTINCT CASE WHEN unit > 0 THEN unit END) AS n_lines
           FROM found GROUP BY doc_id) f USING (doc_id)
LEFT JOIN best ON best.doc_id = d.doc_id AND best.r = 1
"""
