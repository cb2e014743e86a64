"""Licence scan: units of normalised text against templates by Dice coefficient.

A unit is a line, or a block of several lines between blank lines (wrapped notices).
Units and templates are lower-cased, everything but letters and digits becomes one space,
and each is the set of its pairs of neighbouring words. A unit matches a template if the
Dice coefficient 2 |A n B| / (|A| + |B|) reaches the threshold t. That needs
|B| t / (2 - t) <= |A| <= |B| (2 - t) / t, so units and templates of other sizes are not
compared; nor are units that share too few pairs with all templates together.

All of it is one projection over the row: no shuffle and no user function.

Defined results: a null or empty text matches nothing; units of one word have no pairs
and match nothing; repeated rows are each scanned; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

THRESHOLD = 0.8
#: Keeps rounding from pruning a pair that is exactly at a bound.
SLACK = 1e-9

# Published licence notices and permission texts.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version.",
    ),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
)


def pairs_of(text: str) -> list[str]:
    """Distinct word pairs of a template."""
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def normalised(text: Column) -> Column:
    """Lower case; all but letters, digits and line ends become one space."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " ")


def units(text: Column) -> Column:
    """Lines, and blocks of two lines or more, of a normalised text."""
    lines = F.split(text, "\n")
    blocks = F.filter(F.split(text, "\n *\n[ \n]*"), lambda b: F.contains(F.btrim(b, F.lit(" \n")), F.lit("\n")))
    return F.transform(F.concat(lines, blocks), lambda u: F.btrim(F.translate(u, "\n", " ")))


def _matches(unit: Column, threshold: float) -> Column:
    """Array of (license, dice) of the templates that a unit matches."""
    table = [(name, pairs_of(text)) for name, text in TEMPLATES]
    every = sorted({p for _, pairs in table for p in pairs})
    low = min(len(p) for _, p in table) * threshold / (2 - threshold) - SLACK
    high = max(len(p) for _, p in table) * (2 - threshold) / threshold + SLACK
    none = F.array().cast("array<struct<license:string,dice:double>>")

    def of_pairs(pairs: Column) -> Column:
        def compare(shared: Column) -> Column:
            found = []
            for name, own in table:
                near = (F.size(pairs) >= len(own) * threshold / (2 - threshold) - SLACK) & (F.size(pairs) <= len(own) * (2 - threshold) / threshold + SLACK)
                dice = 2.0 * F.size(F.array_intersect(shared, F.array(*map(F.lit, own)))) / (F.size(pairs) + len(own))
                found.append(F.struct(F.lit(name).alias("license"), F.when(near, dice).alias("dice")))
            return F.filter(F.array(*found), lambda m: F.coalesce(m["dice"] >= threshold, F.lit(False)))

        near_any = (F.size(pairs) >= low) & (F.size(pairs) <= high)
        hits = F.filter(pairs, lambda p: p.isin(every))
        least = min(len(p) for _, p in table)
        # 2 |A n B| >= t (|A| + |B|) for some template: at least for the smallest one.
        enough = lambda h: 2.0 * F.size(h) >= threshold * (F.size(pairs) + least) - SLACK
        return F.when(near_any, let(hits, lambda h: F.when(enough(h), compare(h)).otherwise(none))).otherwise(none)

    def of_words(words: Column) -> Column:
        neighbours = F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1)))
        return let(F.array_distinct(neighbours), of_pairs)

    # A unit's distinct pairs are fewer than its words: a unit of few words is out by its size alone.
    return F.when(F.length(unit) >= low, let(F.split(F.regexp_replace(unit, " +", " "), " "), of_words)).otherwise(none)


def scan(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_matches, licenses (sorted, comma-joined), best_license, best_dice of every row.

    ``best_license`` is null without a match; ties go to the name that sorts first.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = documents.select("doc_id", units(normalised(text)).alias("_units"))
    found = cut.select("doc_id", F.flatten(F.transform("_units", lambda u: _matches(u, threshold))).alias("_found"))
    best = F.get(F.sort_array(F.transform("_found", lambda m: F.struct((-m["dice"]).alias("d"), m["license"].alias("n")))), F.lit(0))
    return found.select(
        "doc_id",
        F.size("_found").cast("long").alias("n_matches"),
        F.array_join(F.sort_array(F.array_distinct(F.transform("_found", lambda m: m["license"]))), ",").alias("licenses"),
        best["n"].alias("best_license"),
        (-best["d"]).alias("best_dice"),
    )
