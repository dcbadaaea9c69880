"""Licence texts in documents by Dice similarity over word bigrams (DataFrame functions only).

A unit of a document (each line, each paragraph between blank lines, and the
whole text) is lower-cased and split into words of letters and digits; its set
of word bigrams ``A`` is compared with the set ``B`` of every template:
``2 |A & B| / (|A| + |B|)``. A score of ``percent`` % or more needs
``|A| >= percent / (200 - percent) |B|`` and the reverse, so templates outside
these size bounds are never intersected. Notices of related licences differ in a
word or two: a template's marks (version, Lesser, Affero, ShareAlike, ...) must be
among the bigrams of what it is found in.

A notice may also stand among other words of its line or paragraph. So every
stretch of the whole text that starts and ends at a bigram of a template and is
no longer than the size bound allows is compared with it in the same way; only
templates with enough bigrams anywhere in the text are tried. The best score of
a licence counts where no unit reaches as much. A licence that holds the whole
notice of another (``INCLUDES``) takes its place.

The same bound says which words a text must hold to score at all: without any
of a few words of a template (those that its other bigrams cannot make up for),
or without a word of its marks, it cannot. Texts that fail this for all templates
are told by substring search and never split into words. Everything is an
expression over one row: no shuffle, no join, nothing to skew.

Defined cases: null or empty texts have no licences; units of fewer than two
words have no bigrams and match nothing; repeated rows are judged one by one;
other columns pass through, but one named ``matches`` is replaced.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Opening or reference texts of public licences, as their stewards recommend them.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "BSD-3-Clause": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "CC0-1.0": ["To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

# Bigrams that tell a licence from its relatives (those of them that a template holds are its marks).
MARKS = {
    "Apache-2.0": ["apache license"], "MIT": ["mit license"], "GPL-3.0": ["gnu general", "version 3"], "GPL-2.0": ["gnu general", "version 2"],
    "LGPL-2.1": ["gnu lesser", "version 2"], "LGPL-3.0": ["gnu lesser", "version 3"], "AGPL-3.0": ["gnu affero", "version 3"],
    "CC-BY-4.0": ["cc by", "by 4", "attribution 4"], "CC-BY-NC-4.0": ["cc by", "by nc", "attribution noncommercial"],
    "CC-BY-SA-4.0": ["cc by", "by sa", "attribution sharealike"], "EPL-2.0": ["eclipse public"], "MPL-2.0": ["mozilla public"],
}
#: Licences whose notice holds the whole notice of another one.
INCLUDES = {"BSD-3-Clause": "BSD-2-Clause"}


def words(column):
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(column), "[^a-z0-9]+"), lambda w: w != "")


def bigrams(w):
    """Distinct bigrams of an array of words."""
    return F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b)))


def stretches(raw, known, percent: int):
    """Array of (licence, permille): the best score of each template over stretches of the text, nulls where it is too low."""
    def best(b, name, marks, grams, hits):
        need, span = -(-percent * len(b) // (200 - percent)), len(b) * (200 - percent) // percent

        def score(own, s, e):
            size = F.size(F.array_distinct(F.slice(grams, own[s]["at"] + 1, own[e]["at"] - own[s]["at"] + 1)))
            held = F.array_distinct(F.transform(F.slice(own, s + 1, e - s + 1), lambda x: x["gram"]))
            value = F.transform(F.array(held), lambda h: F.when(_all([F.array_contains(h, m) for m in marks]), F.floor(2000 * F.size(h) / (size + len(b))).cast("int")).otherwise(0))
            return value[0]

        def top(own):
            ends = lambda s: F.filter(F.sequence(s + (need - 1), F.least(F.size(own) - 1, s + (span - 1))), lambda e: own[e]["at"] - own[s]["at"] < span)
            every = F.transform(F.sequence(F.lit(0), F.size(own) - need), lambda s: F.array_max(F.transform(ends(s), lambda e: score(own, s, e))))
            return F.when(F.size(own) >= need, F.array_max(every))

        found = F.transform(F.array(F.filter(hits, lambda x: x["gram"].isin(b))), top)[0]
        return F.when(found >= 10 * percent, F.struct(F.lit(name).alias("licence"), found.alias("permille")))

    every = sorted({g for _, b, _ in known for g in b})
    least = min(-(-percent * len(b) // (200 - percent)) for _, b, _ in known)
    pairs = lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    places = lambda grams: F.filter(F.transform(grams, lambda g, i: F.when(g.isin(every), F.struct(g.alias("gram"), i.alias("at")))), lambda x: x.isNotNull())
    tried = lambda grams, hits: F.when(F.size(hits) >= least, F.array(*[best(b, name, marks, grams, hits) for name, b, marks in known]))
    # arrays of one element bind a value to a name, so that it is computed once
    bound = F.transform(F.array(words(raw)), lambda w: F.transform(F.array(pairs(w)), lambda g: F.transform(F.array(places(g)), lambda h: tried(g, h))[0])[0])[0]
    return F.filter(F.coalesce(bound, F.array().cast("array<struct<licence: string, permille: int>>")), lambda x: x.isNotNull())


def _all(conditions):
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def template_bigrams() -> list[tuple[str, list[str], list[str]]]:
    """(name, sorted bigrams, marks) of every template."""
    import re

    out = []
    for name, texts in TEMPLATES.items():
        for text in texts:
            w = [x for x in re.split("[^a-z0-9]+", text.lower()) if x]
            grams = sorted({f"{a} {b}" for a, b in zip(w, w[1:])})
            out.append((name, grams, [m for m in MARKS.get(name, []) if m in grams]))
    return out


def telling_words(grams: list[str], marks: list[str], percent: int) -> tuple[list[str], bool]:
    """(words, whether a text must hold all of them or only one) without which no unit or stretch reaches ``percent``."""
    if marks:
        return sorted({w for m in marks for w in m.split()}), True
    left, chosen = list(grams), []
    while len(left) * (200 - percent) >= percent * len(grams):  # the bigrams left could still make it
        count = Counter(w for g in left for w in set(g.split()) if len(w) > 4) or Counter(w for g in left for w in set(g.split()))
        word = max(count, key=lambda w: (count[w], len(w), w))
        chosen.append(word)
        left = [g for g in left if word not in g.split()]
    return chosen, False


def possible(raw, known, percent: int):
    """Whether a text holds the telling words of any template."""
    low = F.lower(raw)
    tests = {}
    for _, b, marks in known:
        told, whole = telling_words(b, marks, percent)
        tests[tuple(told), whole] = reduce(lambda x, y: x & y if whole else x | y, [F.contains(low, F.lit(w)) for w in told])
    return reduce(lambda x, y: x | y, tests.values())


def scan(docs: DataFrame, text: str = "text", percent: int = 80) -> DataFrame:
    """``docs`` and matches: sorted array of the distinct (licence, permille) that its units reach, and of better ones of stretches."""
    known = template_bigrams()
    least = min(len(b) for _, b, _ in known) * percent // (200 - percent)
    most = max(len(b) for _, b, _ in known) * (200 - percent) // percent + 1
    raw = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    units = F.array_distinct(F.flatten(F.array(F.split(raw, "\n"), F.split(raw, "\n[\\x20\\x09-\\x0D]*\n"), F.array(raw))))
    # bigrams of the units that any template's size allows; a set is no larger than its words
    sized = F.filter(F.transform(units, words), lambda w: F.size(w) > least)
    sets = F.transform(sized, lambda w: F.when(F.size(w) > 1, bigrams(w)))
    sets = F.array_distinct(F.filter(sets, lambda s: (F.size(s) >= least) & (F.size(s) <= most)))

    def against(s):
        tests = [F.when((F.size(s) * (200 - percent) >= percent * len(b)) & (len(b) * (200 - percent) >= percent * F.size(s)) & _all([F.array_contains(s, m) for m in marks]),
                        F.struct(F.lit(name).alias("licence"), F.floor(2000 * F.size(F.array_intersect(F.array(*map(F.lit, b)), s)) / (F.size(s) + len(b))).cast("int").alias("permille")))
                 for name, b, marks in known]
        return F.filter(F.array(*tests), lambda x: x.isNotNull() & (x["permille"] >= 10 * percent))

    def joined(of_units, of_stretches):
        better = F.filter(of_stretches, lambda x: ~F.exists(F.concat(of_units, of_stretches), lambda y: (y["licence"] == x["licence"]) & (y["permille"] > x["permille"])))
        every = F.array_sort(F.array_distinct(F.concat(of_units, better)))
        for whole, part in INCLUDES.items():
            every = F.transform(F.array(every), lambda m: F.when(F.exists(m, lambda x: x["licence"] == whole), F.filter(m, lambda x: x["licence"] != part)).otherwise(m))[0]
        return every

    found = F.transform(F.array(F.flatten(F.transform(sets, against))), lambda u: F.transform(F.array(stretches(raw, known, percent)), lambda s: joined(u, s))[0])[0]
    return docs.withColumn("matches", F.when(possible(raw, known, percent), found).otherwise(F.array().cast("array<struct<licence: string, permille: int>>")))
