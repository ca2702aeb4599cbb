"""License scan: an exact set-similarity join of text blocks with license templates.

DataFrame and SQL functions only.  A template is a known notice, as a set of
words; a block is a window of consecutive words of a document, across line ends,
as notices stand wrapped in files.  A block matches a template when it holds at
least ``threshold`` of the template's words.  A window is as long as the
template with the same share of foreign words: its words, repeats counted, over
``threshold``; so words that are scattered over a long line are no match.

Words are ordered by their document frequency over the whole corpus, rarest
first.  With ``t = ceil(threshold * |T|)``:

* prefix filter - the rarest word that a match shares with its template is one
  of the template's first ``|T| - t + 1`` words; documents are joined with
  templates on those words, so only the words around each such place are looked at;
* length filter - the words around the place are t at least;
* positional filter - of the template's words from the shared one on, in that
  order, t stand around the place;
* what passes is verified: the greatest number of them in a window that holds the place.

Templates are a parameter and small by nature (at most MAX_TEMPLATES), so they
are broadcast.  Fixed phrases are located besides, word by word.

Words are runs of a-z, 0-9 and non-ASCII characters after A-Z are lower-cased.
Null and empty texts have no words, labels or places.  Rows that repeat id and
text have equal results, each in its own row.
"""

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

# What parts words, the phrases with their labels, and the notices.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "mit": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "gpl": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "lgpl": "Licensed under the GNU Lesser General Public License, version 3.",
    "agpl": "Licensed under the GNU Affero General Public License, version 3.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "public-domain": "This work is dedicated to the public domain.",
    "reserved": "All rights reserved.",
}
THRESHOLD, MAX_TEMPLATES = 0.8, 2_000


def lowered(text: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(low: Column) -> Column:
    return F.array_remove(F.split(low, NO_WORD), "")


def _least(words: list, threshold: float) -> int:
    return math.ceil(threshold * len(words) - 1e-9)


def _template_words(templates: dict) -> dict:
    import re

    return {label: sorted(set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()))) for label, text in templates.items()}


def _window(text: str, threshold: float) -> int:
    """Words of a window for a template of this text."""
    import re

    return math.ceil(len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())) / threshold - 1e-9)


def _literal(value, kind: str) -> Column:
    """A value from the templates as one literal, however many there are."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _places(phrase: tuple) -> Column:
    """Word positions where a phrase stands; looked for only where all its words occur."""
    low, words = F.col("low"), F.col("words")
    there = F.lit(True)
    for w in phrase:
        there = there & F.contains(low, F.lit(w))
    there = there & (F.size(words) >= len(phrase))

    def stands(i):
        out = F.get(words, i) == phrase[0]
        for k, w in enumerate(phrase[1:], 1):
            out = out & F.coalesce(F.get(words, i + k) == w, F.lit(False))
        return out

    return F.when(there, F.filter(F.sequence(F.lit(0), F.size(words) - 1), stands)).otherwise(F.array().cast("array<int>"))


def _matches(scanned: DataFrame, plans: list) -> DataFrame:
    """``(doc_id, h, label, containment)`` of the windows that match.

    ``plans``: for each word of a template's prefix the word, its place (from 1)
    in the template, the label, the template's words in order, how many a match
    holds at least, and the words of a window.
    """
    prefix = scanned.sparkSession.createDataFrame(plans, "word string, p int, label string, template array<string>, t int, width int")
    reach = max((width for *_, width in plans), default=1) - 1
    starters = sorted({w for w, *_ in plans})

    def around(i):
        lo = F.greatest(i - reach, F.lit(0))
        return F.struct(F.get("words", i).alias("word"), F.slice("words", lo + 1, i - lo + 1 + reach).alias("near"), (i - lo).alias("at"))

    docs = scanned.where("low is not null").select("doc_id", "h", words_of(F.col("low")).alias("words")).where(F.size("words") > 0)
    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i).isin(starters))
    probes = docs.select("doc_id", "h", F.explode(F.transform(places, around)).alias("p")).select("doc_id", "h", "p.*")
    # windows that hold the place start at most width - 1 words before it
    first = F.greatest(F.col("at") - F.col("width") + 1, F.lit(0))
    found = probes.join(F.broadcast(prefix), "word").withColumn("near", F.slice("near", first + 1, F.col("at") - first + F.col("width"))).withColumn("starts", F.sequence(F.lit(1), F.col("at") - first + 1))
    found = found.where(F.size("near") >= F.col("t"))
    shared = F.filter(F.transform("near", lambda w: F.array_position("template", w)), lambda x: x >= F.col("p"))
    found = found.where(F.size(F.array_distinct(shared)) >= F.col("t"))
    later = found.withColumn("order", F.transform("near", lambda w: F.array_position("template", w)))
    held = F.array_max(F.transform("starts", lambda i: F.size(F.array_distinct(F.filter(F.slice("order", i, F.col("width")), lambda x: x >= F.col("p"))))))
    return later.withColumn("held", held).where("held >= t").select("doc_id", "h", "label", (F.col("held") / F.size("template")).alias("containment"))


def scan_licenses(docs: DataFrame, templates: dict | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)`` for every row of ``docs``.

    ``score`` is 1 where a fixed phrase stands, else the greatest containment
    of a matched template, 0 without a match.
    """
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    sets = {k: v for k, v in _template_words(templates).items() if v}
    if len(sets) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    vocabulary = sorted({w for v in sets.values() for w in v})
    known = _literal(vocabulary, "array<string>")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).select("doc_id", F.xxhash64("text").alias("h"), lowered(F.col("text")).alias("low"))

    def labelled(phrase, label):
        return F.transform(_places(phrase), lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))

    places = [labelled(*p) for p in PHRASES.items()]
    split = rows.select("doc_id", "h", "low", words_of(F.col("low")).alias("words"))
    scanned = split.select("doc_id", "h", F.size("words").cast("long").alias("n_words"), F.concat(*places).alias("places"), "low", F.array_intersect("words", known).alias("hits"))
    # a block's words are words of its document: only documents that hold enough of a template keep their text
    least = min((_least(v, threshold) for v in sets.values()), default=1)
    needs = _literal([{"words": v, "least": _least(v, threshold)} for v in sets.values()], "array<struct<words:array<string>,least:int>>")
    enough = (F.size("hits") >= least) & F.exists(needs, lambda t: F.size(F.array_intersect("hits", t["words"])) >= t["least"])
    scanned = scanned.withColumn("low", F.when(enough, F.col("low")))
    scanned = table(scanned, "license-words")

    counts = {r["w"]: r["n"] for r in scanned.select(F.explode("hits").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}  # at most the vocabulary
    ranked = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(ranked)}
    plans = []
    for label, words in sorted(sets.items()):
        order, t = sorted(words, key=rank.get), _least(words, threshold)
        plans += [(w, p, label, order, t, _window(templates[label], threshold)) for p, w in enumerate(order[: len(order) - t + 1], 1)]
    matched = _matches(scanned, plans)
    matched = matched.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.collect_set("label").alias("more"), F.max("containment").alias("containment"))

    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))
    out = scanned.join(matched, same, "left").select("doc_id", "n_words", "places", "more", "containment")
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    at = F.transform("places", lambda p: p["at"])
    return out.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )
