"""License scans: base phrases, and an exact set-similarity join of text blocks (windows of words) with license templates.

DataFrame functions only.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.native import LOWER, UPPER, WORD, lowered, once

#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Sentences of well-known licenses, with labels.
TEMPLATES: list[tuple[str, str]] = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the MIT License."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
]


def sequence(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(UPPER, LOWER)))


def tokens(text: str) -> set[str]:
    return set(sequence(text))


def frequencies(docs: DataFrame, vocabulary: set[str]) -> dict[str, int]:
    """How often the words of the vocabulary occur in all texts: a sum by word, of at most as many rows as there are
    words, which the driver holds already."""
    held = F.filter(F.split(lowered("text"), f"[^{WORD}]+"), lambda x: x.isin(sorted(vocabulary)))
    return dict(docs.select(F.explode(held).alias("word")).groupBy("word").count().collect())


INDEX = "struct<templates: array<struct<label: string, words: array<string>, need: int, length: int>>, prefixes: map<string, array<struct<template: int, place: int>>>>"


def index(templates: list[tuple[str, str]], percent: int, counts: dict[str, int]) -> dict:
    """The side of the join that is known: the templates, their words in the global order (rarest first), and for each
    word the templates in whose prefix it is, and at which place. A template of n words of which k are needed has its
    n - k + 1 rarest as prefix."""
    rules, prefixes = [], {}
    for label, text in templates:
        order = sorted(tokens(text), key=lambda w: (counts.get(w, 0), w))
        if not order:
            continue
        need = math.ceil(percent * len(order) / 100)
        for i, word in enumerate(order[: len(order) - need + 1]):
            prefixes.setdefault(word, []).append({"template": len(rules), "place": i})
        rules.append({"label": label, "words": order, "need": need, "length": math.ceil(100 * len(sequence(text)) / percent)})
    return {"templates": rules, "prefixes": prefixes}


def _share(words: Column, at: Column, place: Column, rule: Column) -> Column:
    """The largest share of a template that a window with a word of its prefix, at the place in the global order, holds:
    null if none meets it."""
    length, need = rule["length"], rule["need"]
    start = F.greatest(at - length + 1, F.lit(1))
    around = F.slice(words, start, at - start + length)
    # length filter; positional filter: if this is the first word that a window shares, all others come after it
    late = F.slice(rule["words"], place + 1, F.size(rule["words"]))
    passes = (F.size(around) >= need) & (F.size(F.array_intersect(late, around)) >= need)
    held = lambda i: F.size(F.array_intersect(rule["words"], F.slice(words, i, length)))
    most = F.array_max(F.transform(F.sequence(start, at), held))
    return F.when(passes, once(most, lambda n: F.when(n >= need, n / F.size(rule["words"]))))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, percent: int = 80, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, matches) for each row of docs.

    Base: the places where a phrase's words stand consecutively; looked for around its rarest word.
    The join: a block is a window of consecutive words, whatever the line breaks, 100 / percent times as long as the
    template; it meets a template if it holds at least percent hundredths of the template's distinct words. Words are
    ordered by their frequency in all texts, rarest first. A block that meets a template holds one of its prefix (see
    index()): so each word of a text that is in a prefix makes a candidate of the template and the windows around it.
    Candidates with too few words around fail (the length filter), and so do those where too few of the template's words
    that come after the prefix word in the global order are around (the positional filter): of the words that a window
    shares, one comes first, and as that one it passes. The windows of the rest are counted in full.
    No window is left out otherwise, and nothing is shuffled but the sums of the word counts. The templates and their
    prefixes are one literal of the plan, which so is as long for one template as for thousands.

    matches are the (label, share) of templates that some block meets, by label, with the largest share of its blocks. A
    null or empty text has no words, places or matches; first_word and last_word are then null. Repeated rows are judged
    each, equal places counted once. A template without words is ignored. Other columns aren't read.
    """
    said = [(sequence(x), label) for x, label in phrases.items()]
    vocabulary = set().union(*(tokens(text) for _, text in templates), *(w for w, _ in said))
    counts = frequencies(docs, vocabulary) if vocabulary else {}
    side = index(templates, percent, counts)
    anchors = [(w, min(range(len(w)), key=lambda i: (counts.get(w[i], 0), i)), label) for w, label in said]
    probes = sorted({*side["prefixes"], *(w[i] for w, i, _ in anchors)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.split(lowered("text"), f"[^{WORD}]+").alias("words"))
    lead = F.when(F.get("words", F.lit(0)) == "", 1).otherwise(0)  # an empty piece before the first word, and after the last
    rows = rows.withColumn("lead", lead).withColumn("n_words", (F.size("words") - lead - F.when((F.size("words") > 1) & (F.element_at("words", -1) == ""), 1).otherwise(0)).cast("long"))
    mark = lambda x, i: F.when(x.isin(probes), F.struct(i.alias("at"), x.alias("word")))
    none = F.array().cast("array<struct<at: int, word: string>>")
    seen = F.when(F.exists("words", lambda x: x.isin(probes)), F.filter(F.transform("words", mark), lambda x: x.isNotNull())).otherwise(none)
    rows = rows.withColumn("seen", seen)

    def phrase(x: Column) -> Column:
        found = [F.when((x["word"] == w[i]) & _all(F.get("words", x["at"] - i + k) == y for k, y in enumerate(w)), F.struct((x["at"] - i - F.col("lead")).cast("long").alias("start"), F.lit(label).alias("label"))) for w, i, label in anchors]
        return F.filter(F.array(*found), lambda y: y.isNotNull())

    kind = "array<struct<start: bigint, label: string>>"
    base = F.flatten(F.transform("seen", phrase)).cast(kind) if anchors else F.array().cast(kind)

    def matches(known: Column) -> Column:
        hits = F.filter("seen", lambda x: x["word"].isin(sorted(side["prefixes"])))
        tried = lambda x, y: once(F.get(known["templates"], y["template"]), lambda rule: F.struct(rule["label"].alias("label"), _share(F.col("words"), x["at"] + 1, y["place"], rule).alias("share")))
        met = F.flatten(F.transform(hits, lambda x: F.transform(F.element_at(known["prefixes"], x["word"]), lambda y: tried(x, y))))
        return once(F.filter(met, lambda x: x["share"].isNotNull()), best)

    def best(met: Column) -> Column:
        labels = F.array_sort(F.array_distinct(F.transform(met, lambda x: x["label"])))
        return F.transform(labels, lambda y: F.struct(y.alias("label"), F.array_max(F.transform(F.filter(met, lambda x: x["label"] == y), lambda x: x["share"])).alias("share")))

    empty = F.array().cast("array<struct<label: string, share: double>>")
    known = F.from_json(F.lit(json.dumps(side)), INDEX)
    found = F.when(F.size("seen") > 0, matches(known)).otherwise(empty) if side["templates"] else empty
    rows = rows.select("doc_id", "n_words", base.alias("base"), found.alias("matches"))
    starts = F.transform("base", lambda x: x["start"])
    return rows.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_sort(F.array_distinct(F.transform("base", lambda x: x["label"]))).alias("base_labels"),
        "matches",
    )


def _all(tests: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests)
