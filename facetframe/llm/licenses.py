"""License scan: units of a text against licence notices by Dice over word bigrams.

A text is cut into units at line ends and after sentence ends. A unit is normalised to
lower-case words of letters and digits; its distinct word bigrams (the word itself for a
single word) are compared to those of every template whose size allows the threshold:
``Dice >= t`` needs ``min / max >= t / (2 - t)`` of the two sizes, and at least that part of the template's bigrams
must be in the unit. So some words of every template, its anchors, cover enough of its bigrams
that a match holds one of them: texts, and then units, without any anchor as a whole word are
passed over before they are cut and normalised.

All of it is one projection per row in built-in functions: no shuffle, no join, and no group
that could be skewed; the templates are a literal bounded by the fixed list below.

Edge cases: null or empty text has no unit and no match; text without letters or digits
neither; a repeated row is scanned again and gives its own matches; a null id is kept; extra
columns are ignored; long texts are scanned whole; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence notices by SPDX identifier.
TEMPLATES = [
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
             "without fee is hereby granted."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
                   "file except in compliance with the License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are "
                     "permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights "
                "to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of "
                "the GNU General Public License as published by the Free Software Foundation, either version "
                "3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
            "and associated documentation files, to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
]


# Fixed value: words too common in running text to be anchors where another will do.
COMMON = frozenset("a and any are as by for from has in is it may not of or that the this to under with you".split())


def units(text: Column) -> Column:
    """The text's lines, cut again after sentence ends that white space follows."""
    return F.split(F.regexp_replace(text, r"([.!?])[ \t]+", "$1\n"), "\n", -1)


def _words(unit: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.lower(unit), r"[^\p{L}\p{N}]+", " "))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def _bigrams(words: Column) -> Column:
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1),
                       lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.when(F.size(words) < 2, words).otherwise(pairs))


def _template_bigrams(text: str) -> list[str]:
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return list(dict.fromkeys(" ".join(p) for p in zip(words, words[1:])))


def anchors(threshold: float) -> list[str]:
    """Words one of which is in every unit that reaches the threshold with any template."""
    out: list[str] = []
    for _, text in TEMPLATES:
        left = _template_bigrams(text)
        needed = threshold / (2 - threshold) * len(left)
        while len(left) >= needed - 1e-9:  # what is left could still make up a match
            words = {w for g in left for w in g.split()}
            covers = {w: sum(w in g.split() for g in left) for w in words}
            word = max(words, key=lambda w: (w in out, len(w) > 1 and w not in COMMON, covers[w], len(w), w))
            out += [] if word in out else [word]
            left = [g for g in left if word not in g.split()]
    return out


def _holds_anchor(text: Column, words: list[str]) -> Column:
    whole = "|".join(sorted(words, key=len, reverse=True))
    return F.lower(text).rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{whole})(?![\p{{L}}\p{{N}}])")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         threshold: float = 0.8) -> DataFrame:
    """One row per unit that matches: (id_col, unit, license, template, n_bigrams, dice) with its
    best template (the first of equals). ``unit`` counts a text's units from 0."""
    known = [(i, name, _template_bigrams(text)) for i, (name, text) in enumerate(TEMPLATES)]
    every = F.array(*[F.lit(g) for g in sorted({g for _, _, grams in known for g in grams})])
    templates = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(name).alias("license"),
                                   F.array(*[F.lit(g) for g in grams]).alias("grams"),
                                   F.lit(len(grams)).alias("size")) for i, name, grams in known])
    ratio = threshold / (2 - threshold)
    words = anchors(threshold)
    u = (docs.where(_holds_anchor(F.col(text_col), words))
         .select(F.col(id_col), F.posexplode(units(F.col(text_col))).alias("unit", "__unit"))
         .where(_holds_anchor(F.col("__unit"), words))
         .select(id_col, "unit", _words(F.col("__unit")).alias("__words"))
         .select(id_col, "unit", _bigrams(F.col("__words")).alias("__grams"))
         .where(F.arrays_overlap("__grams", every))
         .withColumn("n_bigrams", F.size("__grams")))
    fits = F.filter(templates, lambda t: (F.least(t["size"], F.col("n_bigrams"))
                                          >= F.lit(ratio) * F.greatest(t["size"], F.col("n_bigrams"))))
    scored = F.transform(fits, lambda t: F.struct(
        (F.lit(2.0) * F.size(F.array_intersect(t["grams"], F.col("__grams")))
         / (t["size"] + F.col("n_bigrams"))).alias("dice"),
        (-t["template"]).alias("back"), t["license"].alias("license")))
    return (u.withColumn("m", F.array_max(scored)).where(F.col("m.dice") >= threshold)
            .select(id_col, "unit", "m.license", (-F.col("m.back")).alias("template"), "n_bigrams", "m.dice"))


def oracle_sql(threshold: float = 0.8) -> str:
    """The scan of ``documents`` as DuckDB SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quote(n)}, [{', '.join(quote(g) for g in _template_bigrams(t))}])"
                     for i, (n, t) in enumerate(TEMPLATES))
    return f"""
WITH templates(template, license, grams) AS (VALUES {rows}),
lines AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), chr(10)) AS units
          FROM documents WHERE text IS NOT NULL),
unit AS (SELECT doc_id, unnest(units) AS txt, unnest(range(len(units))) AS unit FROM lines),
norm AS (SELECT doc_id, unit, string_split(trim(regexp_replace(lower(txt), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM unit),
gram AS (SELECT doc_id, unit, CASE WHEN len(w) < 2 THEN w
         ELSE list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) END AS g FROM norm
         WHERE w <> ['']),
pair AS (SELECT doc_id, unit, license, template, len(g) AS n_bigrams,
         CAST(2 AS DOUBLE) * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice
         FROM gram, templates WHERE list_has_any(g, grams))
SELECT doc_id, CAST(unit AS INTEGER) AS unit, license, template, CAST(n_bigrams AS INTEGER) AS n_bigrams, dice
FROM pair WHERE dice >= {threshold}
QUALIFY row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, template) = 1"""
