"""Find licence notices by the Dice coefficient over word bigrams.

Each line of a document, and the document as a whole, is normalised (A-Z lower-cased,
runs of other characters than letters and digits become one space) and compared to
licence templates by 2 * shared / (its bigrams + the template's bigrams), over distinct
bigrams of words. Only templates whose number of bigrams allows the threshold are
compared: Dice >= t needs sizes within a factor of (2 - t) / t. Templates are a fixed
list, found by the number of bigrams of the line; the scan is one pass without a shuffle.

Defined results: null and empty texts, and lines of fewer than two words, have no
bigrams and never match; ties between templates go to the name that comes first;
repeated rows are each scanned; a document of a single line is scanned as that line.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.texts import ascii_lower

# Short notices and opening paragraphs of public licences.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "BSD redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met"
    ),
    "BSD notice": "Released under the BSD License.",
    "CC0 notice": "This work is dedicated to the public domain under CC0 1.0 Universal.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 notice": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."
    ),
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "MIT notice": "Released under the MIT License.",
    "MIT permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction"
    ),
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary notice": "All rights reserved.",
    "ISC permission": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
}


def template_bigrams(text: str) -> list[str]:
    """Distinct bigrams of a template, normalised like a line."""
    lowered = re.sub(r"[A-Z]", lambda m: m[0].lower(), text)
    found = re.findall(r"[^\W_]+", lowered)
    return sorted({f"{a} {b}" for a, b in zip(found, found[1:], strict=False)})


def _by_size(sizes: list[int], threshold: float) -> list[list[int]]:
    """For each number of bigrams, the templates that could reach the threshold."""
    reach = (2 - threshold) / threshold
    most = math.floor(max(sizes) * reach + 1e-9)
    return [
        [i for i, b in enumerate(sizes) if a and a <= b * reach + 1e-9 and b <= a * reach + 1e-9]
        for a in range(most + 1)
    ]


def _normalised(text: Column) -> Column:
    """A-Z lower-cased, runs of other characters than letters and digits one space; lines
    stay. Plain ASCII texts have the same result by a cheaper pattern."""
    plain = F.regexp_replace(F.lower(text), r"[^a-z0-9\n]+", " ")
    other = F.regexp_replace(ascii_lower(text), r"[^\p{L}\p{N}\n]+", " ")
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), plain).otherwise(other)


def _bigrams(words: str) -> Column:
    """Distinct bigrams of an array column of at least two words."""
    pairs = F.zip_with(words, F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))
    # The last word is zipped with null.
    return F.array_distinct(F.slice(pairs, 1, F.size(words) - 1))


def scan_licenses(
    docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = 0.8
) -> DataFrame:
    """doc_id, line (1-based; 0 is the whole document), license and dice of each match."""
    names = sorted(templates)
    grams = [template_bigrams(templates[name]) for name in names]
    fit = _by_size([len(g) for g in grams], threshold)
    table = F.array(*[F.array(*map(F.lit, g)) for g in grams])
    candidates = F.array(*[F.array(*map(F.lit, found)).cast("array<int>") for found in fit])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # Each step is projected, so that the next one uses it without computing it again.
    clean = docs.select("doc_id", _normalised(text).alias("clean"))
    lines = clean.select("doc_id", "clean", F.split("clean", "\n").alias("lines"))
    whole = F.when(F.size("lines") > 1, F.regexp_replace("clean", "[ \n]+", " ")).otherwise(F.lit(""))
    listed = lines.select("doc_id", F.concat(F.array(whole), "lines").alias("units"))
    # Outer, though no list is empty: else the optimizer filters on the list's size below
    # the projections, which computes all of them a second time.
    units = listed.select("doc_id", F.posexplode_outer("units").alias("line", "unit"))
    tidy = units.select("doc_id", "line", F.btrim("unit").alias("unit"))
    split = tidy.where(F.instr("unit", " ") > 0).select("doc_id", "line", F.split("unit", " ").alias("words"))
    counted = split.select("doc_id", "line", _bigrams("words").alias("grams"))
    near = counted.select("doc_id", "line", "grams", F.get(candidates, F.size("grams")).alias("near"))

    def dice(i: Column) -> Column:
        template = F.get(table, i)
        shared = F.size(F.array_intersect(F.col("grams"), template))
        # Among equals the first name wins: its negated number is the larger.
        return F.struct(
            (F.lit(2.0) * shared / (F.size("grams") + F.size(template))).alias("dice"), (-i).alias("order")
        )

    best = near.select("doc_id", "line", F.array_max(F.transform("near", dice)).alias("best"))
    # Matches are generated, not filtered, for the same reason as above.
    reached = F.filter(F.array("best"), lambda b: b["dice"] >= threshold)
    matched = best.select("doc_id", "line", F.explode_outer(reached).alias("match")).where("match is not null")
    return matched.select(
        "doc_id",
        F.col("line").cast("long").alias("line"),
        F.get(F.array(*map(F.lit, names)), -F.col("match.order")).alias("license"),
        F.round("match.dice", 4).alias("dice"),
    )
