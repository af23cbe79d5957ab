"""License scans (10), native: a positional rare-token index over licence notices.

Everything is an expression over the JVM's string and array functions, besides
one aggregate: no Python, and no row is exploded or shuffled in the scan, so hot
sources, repeated rows and groups of copies cost no more than other rows.

* Text is lower-cased for A-Z, runs of separators become one blank, and words
  are what lies between blanks.
* Base: every place where a phrase's words stand consecutively.
* Index: licence words are weighed by their IDF over all documents (a count of
  the templates' words, so at most as many rows as they have words).  Of each
  template the ``RARE`` words of highest IDF are indexed with all their
  positions.  The index is a literal of the plan: a few dozen entries a
  template, whatever the length of the licence and of the corpus.
* Scan: of a file, the index words that it holds are looked up, highest IDF
  first.  A template of whose words it has ``min_share`` is a candidate; every
  place of one of these words votes for (place - template position), and the
  words that agree on the best relative position must be ``min_share`` of the
  template's.  Then the mandatory key phrases are verified.

Defined cases: null or wordless text has no words, labels or places and score
0; overlapping places all count; a phrase at the very start or end counts; texts
of any length are read whole; repeated rows each give a row; an empty table
gives none; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ODD = "[\\x00-\\x1F\\x21-\\x2F\\x3A-\\x60\\x7B-\\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Fixed values: (label, notice as it is usually written, mandatory key phrases in normal form).
TEMPLATES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("mit", "Released under the MIT License", ("mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without "
     "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("permission is hereby granted", "free of charge", "associated documentation files")),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license", "version 2 0")),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("apache license", "in compliance with the license")),
    ("gpl-3.0", "This work is licensed under the GNU General Public License version 3", ("general public license", "version 3")),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or "
     "(at your option) any later version", ("gnu general public license", "version 3 of the license")),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or "
     "(at your option) any later version", ("gnu general public license", "version 2 of the license")),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
     "(at your option) any later version", ("gnu lesser general public license", "version 2 1 of the license")),
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or "
     "(at your option) any later version", ("gnu affero general public license", "version 3 of the license")),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide", ("related and neighboring rights", "public domain")),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
     "conditions and the following disclaimer", ("redistribution and use in source and binary forms", "following conditions are met")),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ("mozilla public license", "v 2 0")),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee is hereby granted",)),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", ("provided as is without any express or implied warranty", "authors be held liable")),
    ("bsl-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("any person or organization", "accompanying documentation covered by this license")),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ("eclipse public license 2 0",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)
RARE, MIN_SHARE = 12, 0.6


def lowered(text: Column) -> Column:
    """Lower case beyond ASCII as well, which is several times faster and changes no word's place: the one letter there that would become one of A-Z, the Kelvin sign, is exchanged before."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212A"), F.lit("\u00B5")))


def normalised(text: Column) -> Column:
    """Words with one blank between them; only runs that are not one blank already are replaced."""
    return F.trim(F.regexp_replace(lowered(text), f"{ODD}{SEPARATORS[:-1]}*|\\x20{SEPARATORS}", " "))


def n_blanks(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def plain(text: str) -> list[str]:
    """The words of a template."""
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(UPPER, LOWER)))


def document_counts(words: DataFrame, wanted: list[str]) -> dict[str, int]:
    """In how many rows (a column ``w`` of words) each wanted word occurs: one row a wanted word comes back."""
    if not wanted:
        return {}
    held = words.select(F.explode(F.array_intersect(F.array(*map(F.lit, wanted)), "w")).alias("x"))
    return {r["x"]: r["n"] for r in held.groupBy("x").agg(F.count("*").alias("n")).collect()}


def index_of(templates, df: dict[str, int], rare: int = RARE) -> list[tuple[str, list[str], list[tuple[str, int]], tuple[str, ...]]]:
    """(label, its words of highest IDF, their postings (word, position), key phrases) of each template."""
    out = []
    for label, text, keys in templates:
        w = plain(text)
        top = sorted(set(w), key=lambda x: (df.get(x, 0), x))[:rare]
        out.append((label, top, [(x, i) for i, x in enumerate(w) if x in set(top)], keys))
    return out


def _literal(index) -> Column:
    strings = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    return F.array(*[F.struct(F.lit(label).alias("label"), strings(top).alias("rare"), F.array(*[F.struct(F.lit(x).alias("w"), F.lit(i).alias("p")) for x, i in posts]).alias("post"), strings(keys).alias("keys"))
                     for label, top, posts, keys in index])


def agreement(template: Column, hits: Column) -> Column:
    """Of a template's rare words the share that agree on the best relative position; hits: (word, place) of the file."""
    votes = F.flatten(F.transform(hits, lambda h: F.transform(F.filter(template["post"], lambda q: q["w"] == h["w"]), lambda q: F.struct((h["i"] - q["p"]).alias("o"), h["w"].alias("w")))))
    # sorted by relative position, the distinct words of each are a run: one pass counts them
    zero = F.struct(F.lit(None).cast("int").alias("o"), F.lit(0).alias("n"), F.lit(0).alias("best"))

    def step(acc: Column, v: Column) -> Column:
        n = F.when(acc["o"] == v["o"], acc["n"] + 1).otherwise(1)
        return F.struct(v["o"].alias("o"), n.alias("n"), F.greatest(acc["best"], n).alias("best"))

    return F.aggregate(F.array_sort(F.array_distinct(votes)), zero, step, lambda acc: acc["best"] / F.size(template["rare"]))


def scan(documents: DataFrame, *, phrases: dict[str, str] = PHRASES, templates=TEMPLATES, rare: int = RARE, min_share: float = MIN_SHARE, text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row."""
    out = documents.select("doc_id", normalised(F.col(text_col)).alias("s"))
    df = document_counts(documents.select(F.split(lowered(F.col(text_col)), SEPARATORS).alias("w")), sorted({x for _, text, _ in templates for x in plain(text)}))
    index = index_of(templates, df, rare)
    ranked = sorted({x for _, top, _, _ in index for x in top}, key=lambda x: (df.get(x, 0), x))
    fewest = min((len(top) for _, top, _, _ in index), default=0) * min_share

    any_phrase = "(?<![^ ])(?:" + "|".join(sorted(phrases, key=len, reverse=True)) + ")(?![^ ])"
    # words of the phrases decide by plain search whether the regular expressions run at all
    maybe = F.lit(False)
    for p in phrases:
        maybe = maybe | F.contains("s", F.lit(p))
    n_base = sum((F.regexp_count("s", F.lit(f"(?<![^ ])(?={p}(?![^ ]))")) for p in phrases), F.lit(0))
    has = {p: F.col("s").rlike(f"(?<![^ ]){p}(?![^ ])") for p in phrases}
    first = n_blanks(F.substring(F.col("s"), F.lit(1), F.regexp_instr("s", F.lit(any_phrase)) - 1))
    last = n_blanks(F.regexp_extract("s", f"(?s)^(.*){any_phrase}", 1))
    base = F.array_compact(F.array(*[F.when(has[p], F.lit(v)) for p, v in phrases.items()]))
    out = out.select("doc_id", "s", F.when(F.col("s") == "", 0).otherwise(n_blanks(F.col("s")) + 1).cast("long").alias("n_words"), maybe.alias("maybe"), F.split("s", " ").alias("w"))
    out = out.select("doc_id", "s", "n_words", "w", F.when(F.col("maybe"), n_base).otherwise(0).cast("long").alias("n_base"),
                     F.when(F.col("maybe"), base).otherwise(F.array().cast("array<string>")).alias("b"),
                     # the file's index words, highest IDF first
                     F.array_intersect(F.array(*map(F.lit, ranked)).cast("array<string>"), "w").alias("mine"))
    enough = F.filter(_literal(index), lambda t: F.size(F.array_intersect(t["rare"], F.col("mine"))) >= min_share * F.size(t["rare"]))
    out = out.withColumn("t", F.when(F.size("mine") >= fewest, enough))
    places = F.filter(F.transform("w", lambda x, i: F.struct(x.alias("w"), i.alias("i"))), lambda h: F.array_contains("mine", h["w"]))
    out = out.withColumn("h", F.when(F.size("t") > 0, places))
    voted = F.transform("t", lambda t: F.struct(t["label"].alias("label"), t["keys"].alias("keys"), agreement(t, F.col("h")).alias("share")))
    out = out.withColumn("v", F.when(F.size("t") > 0, F.filter(voted, lambda v: v["share"] >= min_share)))
    spaced = F.concat(F.lit(" "), F.col("s"), F.lit(" "))
    verified = F.filter("v", lambda v: F.forall(v["keys"], lambda k: F.contains(spaced, F.concat(F.lit(" "), k, F.lit(" ")))))
    none = F.array().cast("array<struct<label:string,share:double>>")
    out = out.withColumn("v", F.coalesce(F.when(F.size("v") > 0, F.transform(verified, lambda v: F.struct(v["label"].alias("label"), v["share"].alias("share")))), none))
    return out.select(
        "doc_id", "n_words", "n_base",
        F.when(F.col("n_base") > 0, first).cast("long").alias("first_word"),
        F.when(F.col("n_base") > 0, last).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("b")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("b", F.transform("v", lambda v: v["label"])))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("v", lambda v: v["share"])), F.lit(0.0))).cast("double").alias("score"))
