"""License scans in DataFrame functions only: phrases, and an exact containment join of text blocks with templates.

A block is a window of words, SPAN times as long as the template, wherever lines break.  A template is found in a text if
one of its blocks holds at least THRESHOLD of the template's distinct tokens.  Tokens are ordered by their document frequency
over the whole corpus, rare ones first; of a template with n tokens that needs a = ceil(THRESHOLD x n) of them, a text must
hold one of the n - a + 1 rarest (prefix filter), hold a template tokens at all (length filter), and from that first common
token on still have a tokens in its own order (positional filter).  In what passes, the window from each template token on
is counted.

The templates are the bounded side: a fixed list, so their tables and the frequencies of their tokens may be broadcast.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, functions as F

THRESHOLD = 0.8
#: Words of a block for each word of the template.
SPAN = 1.5

#: Phrases of the base labels.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

#: Sentences of well-known license notices.
TEMPLATES = {
    "mit": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "cc": [
        "Licensed under CC BY 4.0",
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words before A-Z are lowered.
_SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, _SEPARATOR), lambda w: w != "")


def _tokens(sentence: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"[0-9a-z]+", sentence.lower())))


def span_of(sentence: str) -> int:
    """Words of a block for a template."""
    return math.ceil(SPAN * len(re.findall(r"[0-9a-z]+", sentence.lower())))


def _most(words: Column, tokens: Column, span: Column) -> Column:
    """The most distinct tokens in a window of `span` words; null where there is none."""
    at = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: F.array_contains(tokens, x["w"]))
    held = lambda a, s, k: F.size(F.array_distinct(F.transform(F.filter(F.slice(a, k + 1, span), lambda x: x["i"] < s["i"] + span), lambda x: x["w"])))
    # the outer array binds `at`, so that it is made once a row
    return F.array_max(F.flatten(F.transform(F.array(at), lambda a: F.transform(a, lambda s, k: held(a, s, k)))))


def _places(label: str, parts: list[str]) -> Column:
    """Structs (at, label) of the places in `words` where the parts stand one after the other."""

    def here(i):
        hit = F.coalesce(F.get("words", i) == parts[0], F.lit(False))
        for k in range(1, len(parts)):
            hit = hit & F.coalesce(F.get("words", i + k) == parts[k], F.lit(False))
        return hit

    starts = F.when(F.size("words") > 0, F.filter(F.sequence(F.lit(0), F.size("words") - 1), here))
    return F.transform(starts, lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))


def base_figures(docs: DataFrame) -> DataFrame:
    """doc_id, same, n_words, n_base, first_word, last_word, base (labels) of every row."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(
        "doc_id",
        F.xxhash64("text").alias("same"),
        F.size(words_of(F.col("text"))).cast("long").alias("n_words"),
        # all phrases hold this word, so other texts need no word array
        F.when(F.col("text").rlike("(?i)license"), words_of(lowered(F.col("text")))).alias("words"),
    )
    found = [_places(label, phrase.split()) for label, phrase in PHRASES.items()]
    none = F.array().cast("array<struct<at:bigint,label:string>>")
    rows = rows.withColumn("base", F.concat(*[F.coalesce(x, none) for x in found])).drop("words")
    return rows.select(
        "doc_id",
        "same",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["at"])).alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["at"])).alias("last_word"),
        F.array_sort(F.array_distinct(F.transform("base", lambda x: x["label"]))).alias("base"),
    )


def contained(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, same, label, score: the best containment of a label's templates in a block of the text, where it meets the threshold."""
    spark = docs.sparkSession
    sets = [(f"{label}/{k}", label, _tokens(s), span_of(s)) for label, all_ in templates.items() for k, s in enumerate(all_)]
    vocabulary = sorted({t for *_, tokens, _ in sets for t in tokens})
    known = F.array(*map(F.lit, vocabulary))
    rows = docs.where("text is not null").select("doc_id", "text")
    words = lambda text: F.split(F.lower(text), _SEPARATOR)
    # words of a text that some template has; the others change no count
    held = lambda text: F.array_intersect(known, words(text))
    frequency = dict(rows.select(F.explode(held(F.col("text"))).alias("token")).groupBy("token").count().collect())  # a row for each template token
    prefixes = []
    for name, label, tokens, span in sets:
        tokens = sorted(tokens, key=lambda t: (frequency.get(t, 0), t))
        need = math.ceil(threshold * len(tokens) - 1e-9)
        prefixes += [(t, name, label, at, need, span, tokens) for at, t in enumerate(tokens[: len(tokens) - need + 1])]
    table = F.broadcast(spark.createDataFrame(prefixes, "token string, template string, label string, at int, need int, span int, tokens array<string>"))
    least = min(p[4] for p in prefixes)
    rare = F.array(*[F.lit(t) for t in sorted({p[0] for p in prefixes})])
    known = F.array(*[F.lit(t) for t in sorted(vocabulary, key=lambda t: (frequency.get(t, 0), t))])  # array_intersect keeps this order
    texts = rows.select("doc_id", F.xxhash64("text").alias("same"), "text", held(F.col("text")).alias("held")).where(F.size("held") >= least)
    hits = texts.withColumn("token", F.explode(F.array_intersect("held", rare))).join(table, "token")
    # length and position: the tokens that the text holds at all, and from this one on
    hits = hits.where((F.size("held") >= F.col("need")) & (F.size("held") - F.array_position("held", F.col("token")) + 1 >= F.col("need")))
    both = F.array_intersect("tokens", "held")  # a text meets a template by its rarest common token only
    hits = hits.where((F.size(both) >= F.col("need")) & (F.get(both, F.lit(0)) == F.col("token")))
    hits = hits.withColumn("overlap", _most(words(F.col("text")), F.col("tokens"), F.col("span"))).where("overlap >= need")
    return hits.groupBy("doc_id", "same", "label").agg(F.max(F.col("overlap") / F.size("tokens")).alias("score"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row.

    A null text is empty.  first_word and last_word are null without a base place.  The score is 1 where a base phrase
    stands, else the best containment that meets the threshold, else 0.  Rows with a null doc_id are judged like others.
    """
    more = contained(docs).groupBy(F.col("doc_id").alias("_id"), F.col("same").alias("_same")).agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    base = base_figures(docs)
    out = base.join(more, base["doc_id"].eqNullSafe(more["_id"]) & (base["same"] == more["_same"]), "left")
    none = F.array().cast("array<string>")
    return out.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
