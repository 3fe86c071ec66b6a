"""License scans: fixed phrases, and an exact containment join with license notices.

A line of a text is a block, a notice a template; both are sets of words. A
block holds a template when it has at least `threshold` of the template's
words. Words are ordered by how many blocks hold them, rare ones first, over
the whole corpus. A block that holds a template must share one of the first
|t| - need + 1 words of the template (prefix), must have `need` template words
at all (length), and after the first shared word both sides must still have
enough words left (position); only what passes is counted out.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueweave.functions.naming import let
from cueweave.llm.common import ascii_lower, stored

# Fixed values of the contract.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))

#: Notices of public licenses, as they head a file or end a page: label, words.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("gpl-notice", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                   "General Public License as published by the Free Software Foundation"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("copyright", "Copyright (c) by the authors. All rights reserved."),
)
THRESHOLD = 0.8


def template_words(text: str) -> list[str]:
    return sorted(set(re.findall(WORD, text.lower())))


def _needed(n: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * n - 1e-9))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _places(words: Column, text: Column) -> Column:
    """Per phrase: how many places, first and last start (word numbers)."""
    tokens = [p.split() for _, p in PHRASES]
    maybe = None
    for p in tokens:
        all_in = F.lit(True)
        for w in p:
            all_in = all_in & F.contains(text, F.lit(w))
        maybe = all_in if maybe is None else maybe | all_in

    def found(joined: Column) -> Column:
        def of(p: list[str]) -> Column:
            pieces = F.split(joined, "".join(f"<{w}>" for w in p))
            count = lambda piece: F.octet_length(piece) - F.octet_length(F.replace(piece, F.lit("<"), F.lit("")))
            return let(pieces, lambda s: F.struct(
                (F.size(s) - 1).cast("bigint").alias("n"), count(F.get(s, F.lit(0))).cast("bigint").alias("first"),
                (F.size(words) - count(F.element_at(s, -1)) - len(p)).cast("bigint").alias("last")))
        return F.array(*[of(p) for p in tokens])

    # Words hold no angle brackets, so bracketed words meet only as whole words.
    joined = F.concat(F.lit("<"), F.array_join(words, "><"), F.lit(">"))
    nothing = F.array().cast("array<struct<n:bigint,first:bigint,last:bigint>>")
    return F.when(maybe & (F.size(words) > 0), let(joined, found)).otherwise(nothing)


def digest(frame: DataFrame, threshold: float, key: str, text: str) -> DataFrame:
    """One row per document: counts of the phrases, and per line its template words (if enough for any template)."""
    vocabulary = sorted({w for _, t in TEMPLATES for w in template_words(t)})
    least = min(_needed(len(template_words(t)), threshold) for _, t in TEMPLATES)
    value = F.coalesce(F.col(text), F.lit(""))
    rows = frame.select(
        F.col(key).alias("_key"), F.xxhash64(value).alias("_hash"),
        # Built-in lower-casing is faster and differs for words of ASCII letters by the Kelvin sign only.
        F.when(F.contains(value, F.lit("K")), ascii_lower(value)).otherwise(F.lower(value)).alias("_text"))
    rows = rows.withColumn("_words", _words(F.col("_text")))
    rows = rows.select(
        "_key", "_hash", F.size("_words").cast("bigint").alias("n_words"),
        _places(F.col("_words"), F.col("_text")).alias("_found"),
        F.filter(
            F.transform(F.split("_text", "\n"), lambda line: F.array_intersect(
                _words(line), F.array(*[F.lit(w) for w in vocabulary]))),
            lambda b: F.size(b) >= least).alias("_blocks"))
    return rows


def join_templates(blocks: DataFrame, threshold: float) -> DataFrame:
    """`_key`, `_hash`, `label`, `score` for each block (`_key`, `_hash`, `_block`) and template that it holds."""
    counts = {r[0]: r[1] for r in blocks.select(F.explode("_block").alias("w")).groupBy("w").count().collect()}
    templates = [(label, sorted(template_words(t), key=lambda w: (counts.get(w, 0), w))) for label, t in TEMPLATES]
    order = sorted({w for _, t in templates for w in t}, key=lambda w: (counts.get(w, 0), w))
    index = []
    for label, words in templates:
        need = _needed(len(words), threshold)
        index += [(w, label, i, need, words) for i, w in enumerate(words[: len(words) - need + 1])]
    least = min(i[3] for i in index)
    spark = blocks.sparkSession
    # One row per prefix word of a template: a fixed number.
    index = spark.createDataFrame(index, "_word string, label string, _i int, _need int, _template array<string>")
    ordered = F.filter(F.array(*[F.lit(w) for w in order]), lambda w: F.array_contains("_block", w))
    rows = blocks.withColumn("_block", ordered)
    prefix = F.slice("_block", F.lit(1), F.greatest(F.lit(0), F.size("_block") - least + 1))
    rows = rows.select("_key", "_hash", "_block", F.posexplode(prefix).alias("_j", "_word"))
    rows = rows.join(F.broadcast(index), "_word").where(
        (F.size("_block") >= F.col("_need"))
        & (1 + F.least(F.size("_template") - F.col("_i") - 1, F.size("_block") - F.col("_j") - 1) >= F.col("_need")))
    shared = F.size(F.array_intersect("_block", "_template"))
    return rows.where(shared >= F.col("_need")).select(
        "_key", "_hash", "label", (shared / F.size("_template")).alias("score"))


def scan(frame: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, `n_words`, `n_base`, `first_word`, `last_word`, `base_labels`, `labels`, `score`.

    `n_base` counts all places of the fixed phrases; `labels` adds those of the
    notices found; `score` is 1 with a phrase, else the largest containment that
    met the threshold, else 0. A null or empty text has no words and no labels;
    null keys stay null and are matched as equal; repeated rows give equal rows;
    an empty table gives none. Other columns are not read. Texts are read once;
    lines are reduced to template words, and words to counts per task, before
    anything is shuffled.
    """
    rows = stored(digest(frame, threshold, key, text), "licenses")
    blocks = rows.select("_key", "_hash", F.explode("_blocks").alias("_block")).distinct()
    hits = join_templates(blocks, threshold).groupBy("_key", "_hash").agg(
        F.collect_set("label").alias("_labels"), F.max("score").alias("_score"))  # at most one label per template
    hits = hits.withColumnRenamed("_key", "_k").withColumnRenamed("_hash", "_h")
    rows = rows.join(hits, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_hash") == F.col("_h")), "left")
    hit = F.filter("_found", lambda f: f["n"] > 0)
    total = F.aggregate("_found", F.lit(0).cast("bigint"), lambda a, f: a + f["n"])
    names = F.array(*[F.lit(label) for label, _ in PHRASES])
    base = F.filter(names, lambda x, i: F.coalesce(F.get(F.col("_found"), i)["n"], F.lit(0)) > 0)
    joined = lambda labels: F.array_join(F.array_sort(labels), ",")
    return rows.select(
        F.col("_key").alias(key), "n_words", total.alias("n_base"),
        F.array_min(F.transform(hit, lambda f: f["first"])).alias("first_word"),
        F.array_max(F.transform(hit, lambda f: f["last"])).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.array_union(base, F.coalesce("_labels", F.array().cast("array<string>")))).alias("labels"),
        F.when(total > 0, 1.0).otherwise(F.coalesce("_score", F.lit(0.0))).alias("score"))
