"""License scans: exact phrases, and an exact set-similarity join of text blocks with notice templates; DataFrame only.

Words: A-Z lower-cased, then runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`.  A text block is a line, or a passage: consecutive
words, over line ends, `PASSAGE` times as many as the template has, so that wrapped notices are found.  A block matches a
template if it holds at least `threshold` of the template's distinct words.  Words of all templates are ordered by the
number of documents that hold them, rarest first; a match of at least `need` words must share one of the template's
first `size - need + 1` words (prefix filter), the block must have `need` template words (length filter), and at the
shared word `1 + min(rest of block, rest of template)` must reach `need` (positional filter); then the overlap is
counted.  Passages start at template words and are looked at where the whole document has `need` of the template's words.
The order only decides how much is looked at, not what is found.  Templates are a parameter and few, so each
document meets them within its own row: no shuffle of texts, whatever their skew.

Null and empty texts have no words and no labels; repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import ascii_lower

#: Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Public notices by label.
TEMPLATES = (
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)
THRESHOLD = 0.9
#: Words of a passage for each word of the template: notices have words between (comment marks, "the Software").
PASSAGE = 1.25
SEPARATORS_RE = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_words(text: str) -> list[str]:
    """The distinct words of a template, which is ASCII, in order of occurrence."""
    return list(dict.fromkeys("".join(c if c.isalnum() else " " for c in text.lower()).split()))


def passage_length(text: str) -> int:
    return math.ceil(PASSAGE * len("".join(c if c.isalnum() else " " for c in text).split()))


def spaced(text: Column) -> Column:
    """The words of text, each between two spaces; empty without words."""
    inner = F.btrim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS_RE, "  "))
    return F.when(inner == "", "").otherwise(F.concat(F.lit(" "), inner, F.lit(" ")))


def n_spaced(col: Column) -> Column:
    return ((F.length(col) - F.length(F.replace(col, F.lit(" "), F.lit("")))) / 2).cast("long")


def word_ranks(docs: DataFrame, templates: tuple[tuple[str, str], ...], words: str = "words") -> dict[str, int]:
    """Rank of each template word by the number of documents that hold it, counted over all documents; at most one row a word."""
    vocabulary = sorted({w for _, t in templates for w in template_words(t)})
    held = docs.select(F.explode(F.array_intersect(words, F.array(*map(F.lit, vocabulary)))).alias("word")).groupBy("word").count()
    counts = {r["word"]: r["count"] for r in held.collect()}
    return {w: i + 1 for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}


def scan_licenses(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels (arrays), score (the best containment that meets the threshold, 1 for a phrase)."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), spaced(F.col(text)).alias("spaced"))
    ranks = word_ranks(base.select(F.split(F.btrim("spaced"), "  ").alias("words")), templates)
    sets = [(label, sorted(ranks[w] for w in template_words(t))) for label, t in templates]
    needs = [math.ceil(threshold * len(x) - 1e-9) for _, x in sets]
    names = {r: w for w, r in ranks.items()}
    prefixes = sorted({r for (_, x), need in zip(sets, needs, strict=True) for r in x[: len(x) - need + 1]})

    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    ranked = F.create_map(*[F.lit(y) for w, r in ranks.items() for y in (w, r)])
    known = F.array(*[F.lit(w) for w in ranks])
    words = lambda line: F.split(F.btrim(F.regexp_replace(ascii_lower(line), SEPARATORS_RE, " ")), " ")
    whole = F.split(F.btrim("spaced"), "  ")
    candidate = F.arrays_overlap(whole, F.array(*[F.lit(names[r]) for r in prefixes]))
    out = base.withColumn("blocks", F.when(candidate, F.transform(lines, lambda x: F.array_sort(F.transform(F.array_intersect(words(x), known), lambda w: F.try_element_at(ranked, w))))))
    out = out.withColumn("held", F.when(F.col("blocks").isNotNull(), F.transform(F.array_intersect(whole, known), lambda w: F.try_element_at(ranked, w))))
    out = out.withColumns({f"near{i}": F.coalesce(F.size(F.array_intersect("held", F.array(*map(F.lit, t)))) >= need, F.lit(False)) for i, ((_, t), need) in enumerate(zip(sets, needs, strict=True))})
    spots = F.filter(F.transform(whole, lambda w, i: F.struct(i.alias("at"), F.try_element_at(ranked, w).alias("rank"))), lambda x: x["rank"].isNotNull())
    out = out.withColumn("spots", F.when(_any([F.col(f"near{i}") for i in range(len(sets))]), spots))
    out = out.withColumns({f"own{i}": F.when(F.col(f"near{i}"), F.filter("spots", _of(t))) for i, (_, t) in enumerate(sets)})
    found = []
    for i, ((_, t), need) in enumerate(zip(sets, needs, strict=True)):
        in_line = F.array_max(F.transform(F.filter("blocks", _may_reach(t, need)), _overlap(t)))
        in_passage = F.array_max(F.transform(F.col(f"own{i}"), _passage_overlap(F.col(f"own{i}"), passage_length(templates[i][1]))))
        overlap = F.coalesce(F.greatest(in_line, in_passage), F.lit(0))
        found.append(F.when(F.col("blocks").isNotNull(), F.when(overlap >= need, overlap / F.lit(float(len(t))))))
    out = out.withColumns({f"t{i}": c for i, c in enumerate(found)})
    by_phrase = {p: f" {'  '.join(p.split())} " for p in PHRASES}
    n = {p: ((F.length("spaced") - F.length(F.replace(F.col("spaced"), F.lit(s), F.lit("")))) / len(s)).cast("long") for p, s in by_phrase.items()}
    before = {p: n_spaced(F.substring_index("spaced", s, 1)) for p, s in by_phrase.items()}
    after = {p: n_spaced(F.col("spaced")) - n_spaced(F.substring_index("spaced", s, -1)) - len(p.split()) for p, s in by_phrase.items()}
    out = out.withColumns({"n_words": n_spaced(F.col("spaced")), **{f"n{i}": n[p] for i, p in enumerate(PHRASES)}})
    has = [F.col(f"n{i}") > 0 for i in range(len(PHRASES))]
    base_labels = [F.when(h, label) for h, label in zip(has, PHRASES.values(), strict=True)]
    more = [F.when(F.col(f"t{i}").isNotNull(), label) for i, (label, _) in enumerate(sets)]
    distinct = lambda x: F.array_sort(F.array_distinct(F.array_compact(F.array(*x))))
    return out.select(
        "doc_id",
        "n_words",
        sum((F.col(f"n{i}") for i in range(1, len(PHRASES))), F.col("n0")).alias("n_base"),
        F.least(*[F.when(h, before[p]) for h, p in zip(has, PHRASES, strict=True)]).alias("first_word"),
        F.greatest(*[F.when(h, after[p]) for h, p in zip(has, PHRASES, strict=True)]).alias("last_word"),
        distinct(base_labels).alias("base_labels"),
        distinct(base_labels + more).alias("labels"),
        F.when(_any(has), F.lit(1.0)).otherwise(F.coalesce(F.greatest(*[F.col(f"t{i}") for i in range(len(sets))]), F.lit(0.0))).alias("score"),
    )


def _may_reach(template: list[int], need: int) -> Callable[[Column], Column]:
    """Length, prefix and positional filters of a block against a template, both as ranks in ascending order."""

    def test(block: Column) -> Column:
        at = [F.array_position(block, F.lit(r)) for r in template[: len(template) - need + 1]]
        ways = [(p > 0) & (F.least(F.size(block) - p, F.lit(len(template) - i - 1)) + 1 >= need) for i, p in enumerate(at)]
        return (F.size(block) >= need) & _any(ways)

    return test


def _overlap(template: list[int]) -> Callable[[Column], Column]:
    every = F.array(*map(F.lit, template))
    return lambda block: F.size(F.array_intersect(block, every))


def _of(template: list[int]) -> Callable[[Column], Column]:
    return lambda x: x["rank"].isin(template)


def _passage_overlap(own: Column, length: int) -> Callable[[Column, Column], Column]:
    """Distinct words of a template in the passage that starts at an element of own, the template's words in the text."""
    return lambda x, i: F.size(F.array_distinct(F.transform(F.filter(F.slice(own, i + 1, length), lambda y: y["at"] < x["at"] + length), lambda y: y["rank"])))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out
