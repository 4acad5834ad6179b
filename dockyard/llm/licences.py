"""License scans: Dice coefficient over word bigrams against templates, in DataFrame functions only.

Each text, each paragraph, line and sentence of it is a segment. A segment is normalised (lower case, words of
letters and digits) and compared with each template whose number of bigrams allows a Dice coefficient of at
least ``least``: with n bigrams against m, the coefficient is at most 2 * min(n, m) / (n + m). Before that, a
segment must hold one of a few words of each template: they are chosen so that without them even a segment
made of all other bigrams of the template would stay below ``least``. Both bounds are exact, so nothing that
matches is missed. The templates are a short fixed list, so there is no join and no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dockyard.llm.shared import table

# Notices and licence texts in public use.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "This software is released under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "This project is licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
LEAST = 0.8


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def bigrams_of(text: str) -> list[str]:
    w = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def needed_words(templates: Sequence[tuple[str, str]], least: float) -> list[str]:
    """Words of which a segment must hold one to reach ``least`` with any template."""
    out: set[str] = set()
    for _, text in templates:
        grams = bigrams_of(text)
        left, chosen = list(grams), set()
        for word in sorted(set(words_of(text)), key=lambda w: (w not in out, -len(w), w)):
            if 2 * len(left) < least * (len(left) + len(grams)):
                break
            chosen.add(word)
            left = [g for g in left if word not in g.split()]
        out |= chosen
    return sorted(out)


def _normal(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " "))


def _bigrams(words: Column) -> Column:
    return F.array_distinct(
        F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b))
    )


def scan_licences(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    least: float = LEAST,
    text: str = "text",
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """Columns ``keep``, then ``matches``: structs of ``licence``, ``dice`` and ``segment`` (normalised), best first.

    Each matching segment counts once for each licence, with its best template; ties of the coefficient go to
    the licence that sorts first, then to the segment. A null or empty text, or one without a match, has no
    matches. Templates of one word can't match. Repeated rows are each scanned; an empty table gives an empty
    result; other columns are not read.
    """
    kept = [(n, bigrams_of(t)) for n, t in templates if len(bigrams_of(t))]
    shortest = min(len(g) for _, g in kept) * least / (2 - least)
    longest = max(len(g) for _, g in kept) * (2 - least) / least
    known = F.array(
        *[F.struct(F.lit(n).alias("name"), F.lit(len(g)).alias("n"), F.array(*map(F.lit, g)).alias("grams")) for n, g in kept]
    )
    needed = rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{'|'.join(needed_words(templates, least))})(?![\p{{L}}\p{{N}}])"
    t = F.col("_t")
    cut = F.regexp_replace(t, r"([.!?])[ \t\r]+", "$1\n")
    pieces = F.concat(F.array(t), F.split(t, r"\n[ \t\r]*\n"), F.split(t, r"\n"), F.split(cut, r"\n"))
    near = F.filter(pieces, lambda s: s.rlike(needed))
    words = F.transform(F.array_distinct(F.transform(near, _normal)), lambda s: F.split(s, " "))
    sized = F.filter(words, lambda w: (F.size(w) > shortest) & (F.size(w) >= 2))
    grams = F.filter(
        F.transform(sized, lambda w: F.struct(w.alias("w"), _bigrams(w).alias("g"))),
        lambda s: F.size(s["g"]).between(shortest - 1e-9, longest + 1e-9),
    )

    def against(s: Column) -> Column:
        size = F.size(s["g"])
        fits = F.filter(known, lambda k: 2 * F.least(size, k["n"]) >= F.lit(least) * (size + k["n"]) - 1e-9)
        return F.transform(
            fits,
            lambda k: F.struct(
                (2.0 * F.size(F.array_intersect(s["g"], k["grams"])) / (size + k["n"])).alias("dice"),
                k["name"].alias("licence"),
                F.array_join(s["w"], " ").alias("segment"),
            ),
        )

    found = F.filter(F.flatten(F.transform(F.col("_grams"), against)), lambda m: m["dice"] >= least)
    # Of one licence and segment only the best template stays: sorted by name and segment, the coefficient falling.
    ordered = F.array_sort(
        F.transform(found, lambda m: F.struct((-m["dice"]).alias("worse"), m["licence"].alias("licence"), m["segment"].alias("segment")))
    )
    best = F.filter(
        ordered,
        lambda m, i: ~F.exists(F.slice(ordered, F.lit(1), i), lambda o: (o["licence"] == m["licence"]) & (o["segment"] == m["segment"])),
    )
    rows = docs.select(*keep, F.col(text).alias("_t"))
    matches = F.transform(
        best, lambda m: F.struct(m["licence"].alias("licence"), (-m["worse"]).alias("dice"), m["segment"].alias("segment"))
    )
    return (
        rows.withColumn("_grams", F.when(t.rlike(needed), grams))
        .withColumn("_found", found)
        .select(*keep, F.coalesce(matches.alias("m"), F.array().cast("array<struct<licence:string,dice:double,segment:string>>")).alias("matches"))
    )


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its best licence (null if none), that coefficient and the number of matches."""
    found = scan_licences(table(spark, sf_dir, "documents"))
    first = F.get("matches", F.lit(0))
    return found.select(
        "doc_id",
        first["licence"].alias("licence"),
        F.round(first["dice"], 6).alias("dice"),
        F.size("matches").cast("long").alias("n_matches"),
    )


def _values() -> str:
    return ", ".join("('{}', {})".format(n, "[" + ", ".join(f"'{g}'" for g in bigrams_of(t)) + "]") for n, t in TEMPLATES)


OP1_SQL = rf"""
WITH templates(name, grams) AS (VALUES {_values()}),
d AS (SELECT doc_id, row_number() OVER () AS n, coalesce(text, '') AS t FROM documents),
pieces AS (SELECT n, unnest(list_distinct([t] || string_split_regex(t, '\n[ \t\r]*\n') || string_split(t, chr(10))
             || string_split(regexp_replace(t, '([.!?])[ \t\r]+', '\1' || chr(10), 'g'), chr(10)))) AS s FROM d
           WHERE length(t) - length(replace(replace(lower(t), 'licens', ''), 'permi', '')) > 0
              OR regexp_matches(lower(t), 'public|software|copyright|redistribution|commons|released')),
normal AS (SELECT DISTINCT n, trim(regexp_replace(lower(s), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS s FROM pieces),
words AS (SELECT n, s, string_split(s, ' ') AS w FROM normal WHERE length(s) < 5000),
grams AS (SELECT n, s, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM words WHERE len(w) > 1),
dice AS (SELECT n, s, name, max(2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + len(grams))) AS dice
         FROM grams, templates GROUP BY ALL),
best AS (SELECT n, max(dice) AS dice, arg_min(name, (-dice, name, s)) AS licence, count(*) AS n_matches FROM dice WHERE dice >= {LEAST} GROUP BY n)
SELECT doc_id, licence, round(dice, 6) AS dice, coalesce(n_matches, 0) AS n_matches FROM d LEFT JOIN best USING (n)
"""
