"""License scans with DataFrame functions only.

Templates are short notices.  For each template length, every text is cut into overlapping windows a quarter longer than the template,
a quarter of it apart, so a notice always lies whole within one window.  A window that holds four fifths
of a template's five-word shingles has a Jaccard similarity of at least one half
with it; with ``COORDINATES`` bands of one MinHash coordinate such a pair meets in none of them
once in 2**24.  Pairs that meet are verified by counting the template's shingles in the window.

Only windows that contain one of a few words are made: for each template, words are
chosen that stand in more than a fifth of its shingles, so a window without any of
them cannot hold four fifths of the shingles.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import with_types

WIDTH, COORDINATES, PERCENT = 5, 24, 80

# Common notices, by short names of our own.
NOTICES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "apache-2.0-header",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at",
    ),
    ("mit", "Released under the MIT License."),
    (
        "mit-grant",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl-3.0-header",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)


def plain_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def telling_words(words: list[str], percent: int) -> list[str]:
    """Words that stand in more than the share of a template's shingles that a match may lack.

    One word if one is enough, the longest; else those that cover most come first.
    """
    grams = {tuple(words[i : i + WIDTH]) for i in range(len(words) - WIDTH + 1)}
    most = (100 - percent) * len(grams) // 100
    alone = [w for w in sorted({*words}) if sum(w in g for g in grams) > most]
    if alone:
        return [max(alone, key=len)]
    lacking, chosen = set(grams), []
    while len(grams) - len(lacking) <= most:
        best = max(sorted({w for g in lacking for w in g}), key=lambda w: (len(w) > 3, sum(w in g for g in lacking), len(w)))
        chosen.append(best)
        lacking = {g for g in lacking if best not in g}
    return chosen


def once(**columns: Column) -> Column:
    """Columns behind a one-row generator: computed once, and not copied into later expressions that use them."""
    return F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))


def shingles(words: Column, first: Column, last: Column) -> Column:
    """64-bit hashes of the five-word runs that begin at the words from first to last (from 0)."""
    return F.transform(F.sequence(first, last), lambda i: F.xxhash64(*[F.element_at(words, i + (k + 1)) for k in range(WIDTH)]))


def text_words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ")


def coordinates(hashes: Column) -> Column:
    least = lambda k: F.array_min(F.transform(hashes, lambda x: F.xxhash64(x, F.lit(k))))
    return F.array(*[least(k) for k in range(COORDINATES)])


def scan(docs: DataFrame, notices=NOTICES, percent: int = PERCENT) -> DataFrame:
    """doc_id, license_id, n_shingles, n_found, start of every notice found in the rows of ``docs`` (doc_id, text).

    ``n_found`` of the notice's ``n_shingles`` distinct shingles lie in the
    window with the most of them, ``start`` is its first word (from 0, words
    being runs of a-z and 0-9 after lower-casing; the first such window wins).
    Null and empty texts have none.  Rows that agree in doc_id and text give
    the same rows once.  A notice of fewer than five words is an error.
    """
    lists = {name: plain_words(text) for name, text in notices}
    short = [name for name, words in lists.items() if len(words) < WIDTH]
    if short:
        raise ValueError(f"notices need {WIDTH} words: {short}")
    spark = docs.sparkSession
    docs = with_types(docs, doc_id="bigint", text="string")
    if not lists:
        return spark.createDataFrame([], "doc_id bigint, license_id string, n_shingles bigint, n_found bigint, start bigint")
    telling = sorted({w for words in lists.values() for w in telling_words(words, percent)})
    able = docs.filter(F.lower("text").rlike(f"(?<![a-z0-9])(?:{'|'.join(telling)})(?![a-z0-9])"))
    able = able.select("doc_id", F.xxhash64("text").alias("version"), once(words=text_words(F.col("text"))))
    able = able.filter(F.size("words") >= WIDTH)
    told = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.element_at("words", i + 1).isin(telling))
    able = able.select("doc_id", "version", once(words=F.col("words"), told=told, last=F.size("words") - WIDTH))

    def windows(n: int) -> Column:
        """Windows for templates of n words in which a telling word stands; no other window can hold a match."""
        step = max(1, n // 4)
        size = n + step - WIDTH + 1
        low = lambda p: F.greatest(F.lit(0), F.floor((p - (size + WIDTH - 2) + (step - 1)) / step)) * step
        high = lambda p: F.floor(F.least(p, F.col("last")) / step) * step
        starts = F.flatten(F.transform("told", lambda p: F.sequence(low(p).cast("int"), high(p).cast("int"), F.lit(step))))
        return F.transform(
            F.array_distinct(starts),
            lambda at: F.struct(F.lit(n).alias("n_words"), at.alias("start"), shingles(F.col("words"), at, F.least(at + (size - 1), F.col("last"))).alias("window")),
        )

    sizes = sorted({len(words) for words in lists.values()})
    cut = able.select("doc_id", "version", F.inline(F.concat(*[windows(n) for n in sizes])))
    cut = cut.select("doc_id", "version", "n_words", "start", "window", once(low=coordinates(F.col("window"))))
    banded = cut.select("doc_id", "version", "n_words", "start", "window", F.posexplode("low").alias("band", "least"))

    table = spark.createDataFrame([(name, len(words), " ".join(words)) for name, words in lists.items()], "license_id string, n_words int, text string")
    table = table.select("license_id", "n_words", once(words=F.split("text", " ")))
    table = table.select("license_id", "n_words", once(template=F.array_distinct(shingles(F.col("words"), F.lit(0), F.size("words") - WIDTH))))
    table = table.select("license_id", "n_words", "template", F.posexplode(coordinates(F.col("template"))).alias("band", "least"))

    # the templates are a parameter of the call, so their table has a known size
    met = banded.join(F.broadcast(table), ["n_words", "band", "least"])
    found = F.size(F.array_intersect("template", "window")).cast("long")
    met = met.select("doc_id", "version", "license_id", F.size("template").cast("long").alias("n_shingles"), found.alias("n_found"), F.col("start").cast("long").alias("start"))
    met = met.filter(100 * F.col("n_found") >= percent * F.col("n_shingles"))
    # fixed-width state, so that the aggregation stays a hash aggregation
    best = met.groupBy("doc_id", "version", "license_id", "n_shingles").agg(F.max(F.col("n_found") * (1 << 40) - F.col("start")).alias("best"))
    n_found = F.ceil(F.col("best") / (1 << 40)).cast("long")
    return best.select("doc_id", "license_id", "n_shingles", n_found.alias("n_found"), (n_found * (1 << 40) - F.col("best")).alias("start"))
