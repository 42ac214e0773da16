"""License scan with a positional rare-token index. Built-in expressions only.

The index: for each template, its words in order of inverse document frequency (counted over all documents), each
with its place. A file looks up, for every template, the rarest word of its mandatory key phrases; each place of that
word proposes where the template would start. Since these phrases must stand in full, no start is missed. There the
other indexed words are checked at their relative places (the postings' intersection), and the phrases are verified. A
phrase label is a template of its own whose words are all mandatory.

Everything but the frequency count stays inside the row; that count is one short row for each word of the templates.

Defined cases: a null text is empty; a text without a word has n_words 0, no labels and score 0; very long texts are
read whole, in time that grows with their words and the places of the looked-up words; of equally rare words the first by
name is looked up, and equal labels of several places are told once; rows are judged one
by one, so repeated ids and rows don't matter; an empty table gives no rows; other columns pass through, clashing
names are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import ascii_lower, table, text_of

LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases whose every place counts.
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

#: Openings of public licenses with the phrases without which they aren't these licenses.
TEMPLATES = {
    "apache-2.0": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        ["apache license", "in compliance with the license"],
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ["source and binary forms", "following conditions are met"],
    ),
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        ["hereby granted free of charge", "without restriction"],
    ),
    "mpl-2.0": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
        ["mozilla public license"],
    ),
    "gpl-notice": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        ["gnu general public license", "free software foundation"],
    ),
    "cc-notice": (
        "this work is licensed under a creative commons attribution 4 0 international license",
        ["creative commons attribution"],
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        ["with or without fee", "above copyright notice"],
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain",
        ["unencumbered software", "public domain"],
    ),
    # Lines that name a license instead of quoting it; what follows the stroke isn't part of the label.
    "apache-2.0/line": ("licensed under the apache license version 2 0", ["apache license"]),
    "mit/line": ("released under the mit license", ["mit license"]),
    "cc-by-nc/line": ("licensed under cc by nc 4 0", ["cc by nc"]),
    "bsd/line": ("licensed under the bsd 3 clause license", ["bsd 3 clause"]),
}
#: Rarest words of a template that are checked at a proposed place.
INDEXED = 12
#: Share of the indexed words that must stand at their places.
MIN_SHARE = 0.6


def vocabulary(templates: dict, phrases: dict) -> list[str]:
    return sorted({w for text, _ in templates.values() for w in text.split()} | {w for p in phrases.values() for w in p.split()})


def document_frequencies(words: DataFrame, vocab: list[str]) -> tuple[dict[str, int], int]:
    """Documents that hold each word of ``vocab`` and documents in all; ``words`` has an array ``_words``."""
    held = F.array_intersect("_words", F.array(*map(F.lit, vocab)))
    rows = words.select(F.explode(F.array_append(held, F.lit(""))).alias("w")).groupBy("w").count().collect()  # at most len(vocab) + 1 rows
    found = {r["w"]: r["count"] for r in rows}
    return found, found.get("", 0)


def build_index(df: dict[str, int], n: int, templates: dict, phrases: dict) -> list[dict]:
    """By template or phrase: label, indexed words rarest first with their places, and mandatory phrases with theirs."""
    idf = lambda w: math.log((1 + n) / (1 + df.get(w, 0)))
    index = []
    for label, (text, keys) in [*templates.items(), *((k, (p, [p])) for k, p in phrases.items())]:
        words, base = text.split(), label in phrases
        first = {w: i for i, w in reversed(list(enumerate(words)))}
        rare = sorted(first, key=lambda w: (-idf(w), w))[: len(words) if base else INDEXED]
        placed = [(k.split(), next(i for i in range(len(words)) if words[i : i + len(k.split())] == k.split())) for k in keys]
        # The rarest mandatory word, and its distance from the start.
        anchor = min((-idf(w), w, place + j) for key, place in placed for j, w in enumerate(key))
        index.append({"label": label.partition("/")[0], "base": base, "rare": [(w, first[w]) for w in rare], "keys": placed, "anchor": anchor[1:]})
    return index


def _matches(words: Column, t: dict) -> Column:
    """Starts of ``t`` in ``words`` as array<struct<start, share>>: proposed by the places of its rarest mandatory word."""
    rare, (word, at) = t["rare"], t["anchor"]

    def share(s: Column) -> Column:
        at = [F.when(F.get(words, s + i) == w, 1.0).otherwise(0.0) for w, i in rare]
        return sum(at[1:], at[0]) / float(len(rare))

    def stands(s: Column) -> Column:
        ok = F.lit(True)
        for key, place in t["keys"]:
            for j, w in enumerate(key):
                ok = ok & F.coalesce(F.get(words, s + (place + j)) == w, F.lit(False))
        return ok

    proposed = F.filter(F.transform(words, lambda w, i: F.when(w == word, i - at)), lambda s: s.isNotNull())
    kept = F.filter(proposed, lambda s: (s >= 0) & stands(s)) if t["base"] else F.filter(proposed, stands)
    return F.filter(F.transform(kept, lambda s: F.struct(s.alias("start"), share(s).alias("share"))), lambda x: x["share"] >= (1.0 if t["base"] else MIN_SHARE))


def scan(docs: DataFrame, *, templates: dict | None = None, phrases: dict | None = None) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels, labels, score and matches (label, start, share)."""
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    added = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
    worded = docs.drop(*added).withColumn("_words", F.regexp_extract_all(ascii_lower(text_of()), F.lit(LICENSE_WORD), F.lit(0)))
    index = build_index(*document_frequencies(docs.select(F.regexp_extract_all(ascii_lower(text_of()), F.lit(LICENSE_WORD), F.lit(0)).alias("_words")), vocabulary(templates, phrases)), templates, phrases)
    none = F.array().cast("array<struct<start:int,share:double>>")
    for k, t in enumerate(index):
        # All words of the mandatory phrases must be in the file at all, which a short array tells.
        if k == 0:
            worded = worded.withColumn("_held", F.array_intersect("_words", F.array(*[F.lit(w) for w in sorted({w for x in index for key, _ in x["keys"] for w in key})])))
        every = F.lit(True)
        for w in sorted({w for key, _ in t["keys"] for w in key}):
            every = every & F.array_contains("_held", w)
        worded = worded.withColumn(f"_m{k}", F.when(every, _matches(F.col("_words"), t)).otherwise(none))

    def tag(k: int, t: dict) -> Column:
        return F.transform(f"_m{k}", lambda m: F.struct(F.lit(t["label"]).alias("label"), F.lit(t["base"]).alias("base"), m["start"].alias("start"), m["share"].alias("share")))

    tagged = [tag(k, t) for k, t in enumerate(index)]
    base = [f"_m{k}" for k, t in enumerate(index) if t["base"]]
    starts = F.concat(*[F.transform(c, lambda m: m["start"]) for c in base])
    labelled = lambda m: F.array_join(F.array_sort(F.array_distinct(F.transform(m, lambda x: x["label"]))), ",")
    return (
        worded.withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("_starts", starts)
        .withColumn("n_base", F.size("_starts").cast("long"))
        .withColumn("first_word", F.array_min("_starts").cast("long"))
        .withColumn("last_word", F.array_max("_starts").cast("long"))
        .withColumn("matches", F.concat(*tagged))
        .withColumn("base_labels", labelled(F.filter("matches", lambda x: x["base"])))
        .withColumn("labels", labelled(F.col("matches")))
        .withColumn("score", F.coalesce(F.array_max(F.transform("matches", lambda x: x["share"])), F.lit(0.0)))
        .drop("_words", "_held", "_starts", *[f"_m{k}" for k in range(len(index))])
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def license_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op1, whose places SQL can find as well."""
    return op1_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
PLACES_SQL = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (
  SELECT *, list_filter(range(len(w)), lambda i: w[i + 1:i + 2] = ['cc', 'by']) AS c, list_filter(range(len(w)), lambda i: w[i + 1:i + 3] = ['general', 'public', 'license']) AS g,
    list_filter(range(len(w)), lambda i: w[i + 1:i + 3] = ['all', 'rights', 'reserved']) AS r FROM w)
SELECT doc_id, len(w) AS n_words, len(c) + len(g) + len(r) AS n_base, list_min(list_concat(c, g, r)) AS first_word, list_max(list_concat(c, g, r)) AS last_word,
  concat_ws(',', CASE WHEN len(c) > 0 THEN 'cc-by' END, CASE WHEN len(g) > 0 THEN 'gpl' END, CASE WHEN len(r) > 0 THEN 'reserved' END) AS base_labels
FROM p
"""
