"""Licence scans by an exact set-similarity join of text blocks with licence templates.

Blocks are lines and, since notices are wrapped at any column, windows of words that don't heed line feeds: a template
of up to ``half`` words (a power of two) is looked for in windows of ``2 * half`` words that begin every ``half`` words,
so each run of as many words as the template lies whole in one of them. A block matches a template if it holds at least
CONTAINMENT of the template's distinct words. The words of all templates are ordered by their frequency over all lines,
rarest first. A template's prefix is so long
that a match must share a word with it (prefix filter); a block needs as many template words as a match (length
filter); and from the places of the shared word on enough words must be left on both sides (positional filter). What
passes is verified exactly. Words that no template has cannot add to an overlap and are left out from the start, and so are texts
that hold too few words of each template as a whole.

Broadcast are only the templates: their words and prefixes, a size that the templates given bound.

Defined cases: null and empty texts have no words, labels or places; ties in frequency go by the word; repeated rows
get equal results; texts of any length are taken whole; an empty table gives an empty table; extra columns are unused.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldlog.llm.common import LOWER, UPPER, ascii_lower, quoted, shared_dir, word_string, written

CONTAINMENT = 0.8
BROADCAST_ROWS = 200_000

#: Phrases whose words stand consecutively, and their labels (fixed values).
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Labels and wording of well-known licence notices.
TEMPLATES = (
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("mit-notice", "Released under the MIT License."),
    ("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)

#: Like WORD_GAP, but a line feed stays: it ends a block.
_GAP = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"


def _count(text: Column, part: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))


def template_tokens(text: str) -> list[str]:
    lowered = text.translate(str.maketrans(UPPER, LOWER))
    return "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in lowered).split()


def template_words(text: str) -> list[str]:
    return sorted(set(template_tokens(text)))


def window_words(text: str) -> int:
    """Words of the windows in which a template is looked for."""
    half = 1
    while half < len(template_tokens(text)):
        half *= 2
    return 2 * half


def _needed(words: Sequence[str], containment: float) -> int:
    return math.ceil(containment * len(words) - 1e-9)


def _strings(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _once(value: Column, name: str) -> Column:
    """A column computed once: as the output of a generator the optimizer doesn't repeat it in each place that uses it."""
    return F.explode_outer(F.array(value)).alias(name)


def _spaced(text_col: str) -> Column:
    """The text in lower case with spaces for all that separates words but line feeds."""
    return F.regexp_replace(ascii_lower(F.coalesce(quoted(text_col), F.lit(""))), _GAP, " ")


def _lines(spaced: Column, vocabulary: Sequence[str]) -> Column:
    """Each line's distinct words that a template has, in the order of the line."""
    return F.transform(F.split(spaced, "\n"), lambda line: F.array_intersect(F.split(line, " "), _strings(vocabulary)))


def _windows(words: Column, vocabulary: Sequence[str], size: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - size // 2 + 1), F.lit(size // 2))
    return F.transform(starts, lambda at: F.array_intersect(F.slice(words, at, F.lit(size)), _strings(vocabulary)))


def frequencies(docs: DataFrame, text_col: str, vocabulary: Sequence[str]) -> dict[str, int]:
    """In how many lines of all documents each word of the templates stands. As many rows as the templates have words."""
    # The outer form: for the plain one the optimizer adds a filter that splits the texts a second time.
    lines = docs.select(F.explode_outer(_lines(_spaced(text_col), vocabulary)).alias("words")).where(F.size("words") > 0)
    counted = lines.select(F.explode("words").alias("word")).groupBy("word").count()
    return {r["word"]: r["count"] for r in counted.collect()}


def matches(docs: DataFrame, id_col: str, text_col: str, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """Matching blocks: ``doc``, ``text_key``, ``text_key2``, ``label`` and the greatest ``containment``, once a label."""
    spark = docs.sparkSession
    sets = [(label, template_words(text), window_words(text)) for label, text in templates]
    vocabulary = sorted({w for _, words, _ in sets for w in words})
    count = frequencies(docs, text_col, vocabulary)
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (count.get(w, 0), w)))}
    index = []
    for k, (label, words, size) in enumerate(sets):
        ranks, need = sorted(rank[w] for w in words), _needed(words, containment)
        index += [(r, k, label, i, need, size, ranks) for i, r in enumerate(ranks[: len(ranks) - need + 1])]
    prefixes = F.broadcast(spark.createDataFrame(index, "rank int, template int, label string, i int, need int, size int, ranks array<int>"))
    numbers = F.create_map(*[F.lit(x) for w, r in rank.items() for x in (w, r)])
    leading = F.array(*[F.lit(r) for r in sorted({x[0] for x in index})])
    key = [quoted(id_col).alias("doc"), F.xxhash64(quoted(text_col)).alias("text_key"), F.hash(quoted(text_col)).alias("text_key2")]
    least = min(x[4] for x in index)
    names = ["doc", "text_key", "text_key2"]
    whole = docs.select(*key, _once(_spaced(text_col), "spaced"))
    whole = whole.select("*", _once(F.split(F.translate("spaced", "\n", " "), " +"), "all"))
    known = whole.select("*", _once(F.array_intersect("all", _strings(vocabulary)), "known"))
    enough = [F.size(F.array_intersect("known", _strings(words))) >= _needed(words, containment) for _, words, _ in sets]
    likely = known.where(reduce(lambda a, b: a | b, enough)).select(*names, "spaced", "all")
    kinds = [F.struct(F.lit(0).alias("of"), _lines(F.col("spaced"), vocabulary).alias("found"))]
    kinds += [F.struct(F.lit(size).alias("of"), _windows(F.col("all"), vocabulary, size).alias("found")) for size in sorted({size for *_, size in sets})]
    each = likely.select(*names, F.explode_outer(F.array(*kinds)).alias("kind")).select(*names, F.col("kind.of").alias("of"), F.explode_outer("kind.found").alias("words"))
    blocks = each.where(F.size("words") >= least)
    ordered = blocks.withColumn("have", F.array_sort(F.transform("words", lambda w: numbers[w]))).drop("words")
    shared = F.filter(F.transform("have", lambda r, j: F.struct(j.alias("j"), r.alias("rank"))), lambda x: F.array_contains(leading, x["rank"]))
    probes = ordered.withColumn("x", F.explode(shared)).select(*names, "of", "have", F.col("x.j").alias("j"), F.col("x.rank").alias("rank"))
    left = F.least(F.size("ranks") - F.col("i"), F.size("have") - F.col("j"))
    found = probes.join(prefixes, "rank").where((F.col("of") == 0) | (F.col("of") == F.col("size"))).where((F.size("have") >= F.col("need")) & (left >= F.col("need")))
    overlap = F.size(F.array_intersect("have", "ranks"))
    found = found.where(overlap >= F.col("need")).withColumn("containment", overlap / F.size("ranks"))
    return found.groupBy("doc", "text_key", "text_key2", "label").agg(F.max("containment").alias("containment"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """One row for each document: words, places of the phrases, labels of phrases and templates, and a score.

    ``score`` is 1 with a phrase, else the greatest containment of a matching template, else 0.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    padded = docs.select(
        quoted(id_col).alias("doc"), F.xxhash64(quoted(text_col)).alias("text_key"), F.hash(quoted(text_col)).alias("text_key2"), F.concat(F.lit(" "), word_string(quoted(text_col), exact=False), F.lit(" ")).alias("s")
    )
    places, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases:
        part = f" {phrase} "
        has = F.col("s").contains(part)
        places.append(F.when(has, F.regexp_count("s", F.lit(f"(?<= ){phrase}(?= )"))).otherwise(0))
        word_at = lambda at: _count(F.substring(F.col("s"), F.lit(1), at), " ") - 1
        firsts.append(F.when(has, word_at(F.locate(part, F.col("s")))))
        lasts.append(F.when(has, word_at(F.length("s") - F.locate(part[::-1], F.reverse("s")) - len(part) + 2)))
        labels.append(F.when(has, F.lit(label)))
    base = padded.select(
        "doc", "text_key", "text_key2",
        F.when(F.col("s") == "  ", 0).otherwise(_count(F.col("s"), " ") - 1).cast("long").alias("n_words"),
        reduce(lambda a, b: a + b, places).cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("base"),
    )
    found = matches(docs, id_col, text_col, templates).groupBy(F.col("doc").alias("m_doc"), F.col("text_key").alias("m_key"), F.col("text_key2").alias("m_key2"))
    found = written(spark, found.agg(F.collect_set("label").alias("more"), F.max("containment").alias("containment")), "licence-matches")
    few = found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    same = F.col("doc").eqNullSafe(F.col("m_doc")) & (F.col("text_key") == F.col("m_key")) & (F.col("text_key2") == F.col("m_key2"))
    both = base.join(F.broadcast(found) if few else found, same, "left")
    every = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))))
    return both.select(
        F.col("doc").alias(id_col), "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).cast("double").alias("score"),
    )
