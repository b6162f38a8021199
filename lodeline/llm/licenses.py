"""License scans in SQL functions: sparse TF-IDF cosine to templates, then
inheritance from the nearest directory above.

Lines, sentences, SPDX tags and paragraphs of a file are each compared with notice
templates.  A unit's vector has a weight for every term of it; terms that no
template has count for its length only.  All of that is worked out within the
file's row, so no text is shuffled.  A unit that reaches the threshold with a
template has one of the template's needed terms: those without which the others'
weights stay below it, the rarest of the corpus first.  Units that have one, few
in prose, are bounded by the weights of their known terms, and built in full if
that may suffice.  Both bounds hold for all units, so none is lost.

Files without a notice of their own get the license of the license file in the
nearest ancestor directory, by joining their ancestor paths with the directories
of license files.  License files are told by name; where files have no names, by
text: a notice in full and hardly anything beside it.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import small, stage, table

THRESHOLD = 0.6
#: The least cosine at which a unit counts as a notice in full.
FULL = 0.9
#: Notices by license; fixed wording of the licenses' own notices.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License. See the LICENSE file for details."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("Proprietary", "Copyright. All rights reserved."),
]
_TAG = r"(?i)\bSPDX-License-Identifier:[ \t]*[A-Za-z0-9.+\-]+"
_FILE_NAME = r"(?i)(^|/)(un)?(licen[cs]e|copying|notice|copyright)([._\-][^/]*)?$"


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def units(text: Column | str = "text") -> Column:
    """Lines, sentences, SPDX tags and paragraphs, each once."""
    lines = F.split(text, r"\r?\n")
    sentences = F.flatten(F.transform(lines, lambda x: F.split(x, r"(?<=[.!?|])\s+")))
    tags = F.regexp_extract_all(text, F.lit(_TAG), F.lit(0))
    paragraphs = F.split(text, r"\r?\n[ \t]*\r?\n")
    return F.array_distinct(F.transform(F.concat(lines, sentences, tags, paragraphs), F.trim))


class Weights:
    """Template vectors of length one, scaled by the terms' idf, and the idf of other terms."""

    def __init__(self, templates: list[tuple[str, str]]):
        counts = [Counter(re.findall("[a-z0-9]+", notice.lower())) for _, notice in templates]
        df = Counter(t for c in counts for t in c)
        self.names = [name for name, _ in templates]
        self.other = math.log(1.0 + len(templates)) + 1
        self.idf = {t: math.log((1.0 + len(templates)) / (1.0 + n)) + 1 for t, n in df.items()}
        norms = [math.sqrt(sum((n * self.idf[t]) ** 2 for t, n in c.items())) for c in counts]
        self.counts, self.norms = counts, norms
        #: For each term, its idf and what one occurrence adds to the product with each template.
        self.of = {t: {"idf": i, "adds": [c[t] * i * i / m if c[t] else 0.0 for c, m in zip(counts, norms)]} for t, i in sorted(self.idf.items())}

    def needed(self, frequent: dict[str, int], threshold: float) -> list[str]:
        """Terms of which a unit has one if its cosine to a template reaches the threshold."""
        out: set[str] = set()
        for c, norm in zip(self.counts, self.norms):
            left = 1.0
            for t in sorted(c, key=lambda t: (frequent.get(t, 0), -len(t), t)):
                if left < threshold**2 - 1e-9:
                    break
                out.add(t)
                left -= (c[t] * self.idf[t] / norm) ** 2
        return sorted(out)


def _with(value: Column, body) -> Column:
    """body(value) with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _runs(values: Column) -> Column:
    """Sum of the squared numbers of equal values."""
    state = "struct<last:string,n:bigint,total:double>"

    def add(s: Column, x: Column) -> Column:
        same = s["last"].eqNullSafe(x)
        n = F.when(same, s["n"] + 1).otherwise(F.lit(1))
        # (n + 1)^2 is 2n + 1 more than n^2.
        return F.struct(x.alias("last"), n.alias("n"), (s["total"] + 2.0 * n - 1.0).alias("total")).cast(state)

    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("total")).cast(state)
    return F.aggregate(F.array_sort(values), start, add, lambda s: s["total"])


def document_counts(files: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How many files have each term; one count for each term reaches the driver."""
    said = files.select(F.explode(F.array_distinct(F.filter(terms(F.col("text")), lambda t: t.isin(vocabulary)))).alias("term"))
    return {r["term"]: r["n"] for r in said.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}


def score(unit: Column, weights: Weights, needed: list[str], threshold: float = THRESHOLD) -> Column:
    """The best (score, license) of a unit as a struct, null if its cosine to no
    template reaches the threshold; ties go to the license first by name."""
    best = "struct<score:double,license:string>"
    if not needed:
        return F.lit(None).cast(best)
    rows = (f"'{t}', named_struct('idf', {k['idf']!r}D, 'adds', array({', '.join(f'{x!r}D' for x in k['adds'])}))" for t, k in weights.of.items())
    known = F.expr(f"map({', '.join(rows)})")  # constant: folded when the query is planned
    names, vocabulary = F.array(*map(F.lit, weights.names)), list(weights.of)
    # cosine^2 <= own / (own + rest), and rest has at least one idf^2 for each other term.
    least = threshold**2 / (1 - threshold**2) * weights.other**2 if threshold < 1 else float("inf")

    def exact(w: Column, v: Column) -> Column:
        counted = F.transform(F.array_distinct(v), lambda t: F.struct(F.size(F.filter(v, lambda x: x == t)).cast("double").alias("n"), F.element_at(known, t).alias("k")))
        return _with(counted, lambda c: _with(F.aggregate(c, F.lit(0.0), lambda s, x: s + F.pow(x["n"] * x["k"]["idf"], F.lit(2.0))), lambda own: F.when(own + 1e-9 >= least * (F.size(w) - F.size(v)), whole(w, c, own))))

    def whole(w: Column, c: Column, own: Column) -> Column:
        rest = _runs(F.filter(w, lambda t: ~t.isin(vocabulary))) * weights.other**2
        zeros = F.array_repeat(F.lit(0.0), len(weights.names))
        dots = F.aggregate(c, zeros, lambda s, x: F.zip_with(s, x["k"]["adds"], lambda a, b: a + x["n"] * b))
        found = lambda norm: F.zip_with(dots, names, lambda d, name: F.struct((-F.round(d / norm, 6)).alias("score"), name.alias("license")))
        top = _with(F.sqrt(own + rest), lambda norm: F.array_min(F.filter(found(norm), lambda x: x["score"] <= -threshold)))
        return _with(top, lambda x: F.when(x.isNotNull(), F.struct((-x["score"]).alias("score"), x["license"].alias("license")).cast(best)))

    known_terms = lambda w: _with(F.filter(w, lambda t: t.isin(vocabulary)), lambda v: exact(w, v))
    return _with(terms(unit), lambda w: F.when(F.exists(w, lambda t: t.isin(needed)), known_terms(w)))


_FOUND = "array<struct<s:double,license:string,whole:boolean>>"


def own_licenses(text: Column, weights: Weights, needed: list[str], threshold: float = THRESHOLD, by_text: bool = False) -> Column:
    """Scores of a text's units that reach the threshold, best first; null if none can.
    By text, the whole text is a unit too, and marked."""
    if not needed:
        return F.lit(None).cast(_FOUND)

    def found(every: Column, whole: Column) -> Column:
        scored = F.transform(every, lambda u: F.struct(score(u, weights, needed, threshold).alias("best"), F.coalesce(u == whole, F.lit(False)).alias("whole")))
        reached = F.filter(scored, lambda x: x["best"].isNotNull())
        return F.array_sort(F.transform(reached, lambda x: F.struct((-x["best"]["score"]).alias("s"), x["best"]["license"].alias("license"), x["whole"].alias("whole"))))

    if by_text:
        ordered = _with(F.trim(text), lambda whole: found(F.array_union(units(text), F.array(whole)), whole))
    else:
        ordered = found(units(text), F.lit(None).cast("string"))
    return F.when(F.exists(terms(text), lambda t: t.isin(needed)), ordered)


def stated(own: Column, named: Column) -> Column:
    """What a file states for its directory: all that it has if it is a license file by
    name, else the licenses of its whole text that a unit of it has in full."""
    full = lambda x: F.exists(own, lambda y: (y["license"] == x["license"]) & (y["s"] <= -FULL))
    return F.when(named, own).otherwise(F.filter(own, lambda x: x["whole"] & full(x)))


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, by_text: bool = False) -> DataFrame:
    """files(path, text, ...) -> all columns but text, with license, score,
    origin (own, inherited or null), licenses (all of the file's own, else all of
    the directory that it inherits from; sorted).

    by_text takes license files by their text too, for tables whose paths have no
    file names; elsewhere a source file with nothing but a notice would be one.

    Edges: a null or empty text has no license of its own but inherits; a text with
    an SPDX tag that is like no template has an unknown license and inherits none; a
    null path has no directory, so inherits nothing; ties go to the license first by
    name; repeated rows are kept and equal; columns named as results are replaced,
    others may have any name; an empty table gives an empty result.
    """
    kept = [c for c in files.columns if c not in ("text", "license", "score", "origin", "licenses")]
    path = files["path"]
    start = F.when(path.isNotNull(), folder(path))
    named = F.coalesce(path.rlike(_FILE_NAME), F.lit(False))
    tagged = F.coalesce(files["text"].rlike(_TAG), F.lit(False))
    weights = Weights(templates)
    needed = weights.needed(document_counts(files, list(weights.of)), threshold) if templates else []
    own = F.coalesce(own_licenses(files["text"], weights, needed, threshold, by_text), F.array().cast(_FOUND))
    rows = files.select(F.struct(*kept).alias("kept"), start.alias("start"), named.alias("named"), tagged.alias("tagged"), own.alias("own"))
    rows = stage(rows, "licensed")
    every = rows.where(F.size("own") > 0).select(F.col("start").alias("folder"), F.explode(stated(F.col("own"), F.col("named"))).alias("x"))
    above = every.groupBy("folder").agg(F.min("x").alias("b"), F.array_sort(F.collect_set("x.license")).alias("names"))
    above = small(stage(above, "folders"))
    # Ancestor folders of files that have none of their own, with their depth; distinct folders, not files, are joined.
    has = F.size("own") > 0
    bare = ~has & ~F.col("tagged")
    starts = rows.where(bare & F.col("start").isNotNull()).select("start").distinct().withColumn("parts", F.split("start", "/"))
    depth = F.sequence(F.lit(0), F.size("parts"))
    up = starts.select("start", F.explode(F.transform(depth, lambda i: F.struct(F.array_join(F.slice("parts", F.lit(1), i), "/").alias("folder"), i.alias("depth")))).alias("a"))
    nearest = up.select("start", "a.folder", "a.depth").join(above, "folder").groupBy("start").agg(F.max_by(F.struct("b", "names"), "depth").alias("n"))
    out = rows.join(small(stage(nearest, "nearest")), "start", "left")
    inherits = bare & F.col("n").isNotNull()
    found = F.when(has, F.get("own", 0)).when(inherits, F.col("n.b"))
    origin = F.when(has, "own").when(inherits, "inherited")
    names = F.when(inherits, F.col("n.names")).otherwise(F.array_sort(F.array_distinct(F.transform("own", lambda x: x["license"]))))
    return out.select("kept.*", found["license"].alias("license"), (-found["s"]).alias("score"), origin.alias("origin"), names.alias("licenses"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source is the directory of its documents; its license files are told by their
    text, as documents have no file names.  A document without a source has no path."""
    docs = table(spark, sf_dir, "documents")
    path = F.when(F.col("source") != "", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")))
    return scan(docs.select("doc_id", path.alias("path"), "text"), by_text=True)
