"""Operator 1: license scan by an exact set-similarity join, in DataFrame functions alone.

Base: every place of a few phrases in the words of a whole text. Method: a text block carries a template's label if
it contains at least `threshold` of the template's distinct words. Blocks are windows of words, whatever the lines: a template of up to s words
(s a power of two) is looked for in windows of 2 * s words that begin at every s-th word. So a notice of up to s + 1 words lies whole in a block
however it is wrapped, and words scattered over a long line don't meet. The join:

1. One pass counts the documents that hold each template word; words are ranked from rare to frequent, ties by name.
2. A block that shares alpha = ceil(threshold * |T|) words with template T shares one of T's |T| - alpha + 1 rarest.
   One pass over the texts computes the base columns, and keeps the words of documents that hold such a prefix word.
3. Their blocks that hold a prefix word become sorted arrays of ranks. Words outside all templates can't add to an overlap and are left out, which
   makes the length filter tighter. Blocks meet templates on prefix words, under the length filter |B| >= alpha, the
   prefix filter on the block's side, and the positional filter min(|T| - i, |B| - j) >= alpha.
4. The overlap of each surviving pair is computed exactly.

What is broadcast (the templates' prefixes) and what goes to the driver (one count for each template word) has the size
of the templates. Null and empty texts have no words, null first_word and last_word, empty labels, and score 0. Repeated rows come
back once each; labels are found for each (doc_id, text). Other columns aren't read.
"""

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The phrases of the contract and their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
#: Sentences of public licenses, and the labels that blocks which contain them get.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("gpl-3.0", "Licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("proprietary", "No part of this document may be reproduced without prior written permission"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(_UPPER, _LOWER)))


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def least_overlap(size: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * size - 1e-9))


def template_sets(templates: list[tuple[str, str]]) -> list[tuple[int, str, list[str], int]]:
    """Number, label, distinct words, and the step of the windows: the least power of two that isn't below the number of words."""
    found = [(i, label, words_of(text)) for i, (label, text) in enumerate(templates)]
    return [(i, label, sorted(set(own)), 1 << max(len(own) - 1, 0).bit_length()) for i, label, own in found]


def windows(all_words: Column, step: int, prefix_words: list[str]) -> Column:
    """step, block and own words of the windows that hold a prefix word."""
    starts = F.sequence(F.lit(0), F.expr(f"(greatest(size(words), 1) - 1) div {step}").cast("int"))
    cut = F.transform(starts, lambda k: F.struct(F.lit(step).alias("step"), k.alias("block"), F.slice(all_words, k * step + 1, F.lit(2 * step)).alias("own")))
    return F.filter(cut, lambda b: F.exists(b["own"], lambda w: w.isin(prefix_words)))


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def ranks(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Template words from rare to frequent over all documents."""
    held = docs.select(F.explode(F.array_intersect(words(lowered(F.col("text"))), _strings(vocabulary))).alias("word"))
    counts = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}  # one row a template word
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}


def _places(all_words: Column, phrases: list[str]) -> list[Column]:
    """For each phrase, the places where its words stand consecutively."""

    def at(phrase: str) -> Column:
        parts = words_of(phrase)

        def there(i):
            found = F.get(all_words, i) == parts[0]
            for k, part in enumerate(parts[1:], 1):
                found = found & F.coalesce(F.get(all_words, i + k) == part, F.lit(False))
            return found

        return F.when(F.array_contains(all_words, parts[0]) & F.array_contains(all_words, parts[-1]), F.filter(F.sequence(F.lit(0), F.size(all_words) - 1), there)).otherwise(F.array().cast("array<int>"))

    return [at(p) for p in phrases]


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES, threshold: float = 0.9) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    sets = template_sets(templates)
    rank = ranks(docs, sorted({w for _, _, s, _ in sets for w in s}))
    prefixes, whole = [], []
    for i, label, own, step in sets:
        order = sorted(rank[w] for w in own)
        alpha = least_overlap(len(order), threshold)
        prefixes += [(i, step, r, k, len(order), alpha) for k, r in enumerate(order[: len(order) - alpha + 1])]
        whole.append((i, label, order, alpha))
    by_rank = {r: w for w, r in rank.items()}
    prefix_words = {step: sorted({by_rank[p[2]] for p in prefixes if p[1] == step}) for step in sorted({p[1] for p in prefixes})}

    texts = docs.withColumn("low", lowered(F.col("text"))).withColumn("words", words(F.col("low")))
    names = [f"at{i}" for i, _ in enumerate(phrases)]
    found = texts.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.size("words").cast("long").alias("n_words"),
        *[c.alias(n) for c, n in zip(_places(F.col("words"), [p for p, _ in phrases]), names)],
        F.when(F.arrays_overlap("words", _strings(sorted(set().union(*prefix_words.values())))), F.col("words")).alias("words"),
    )
    every = F.flatten(F.array(*names))
    base = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.size(n) > 0, F.lit(label)) for n, (_, label) in zip(names, phrases)]))))
    found = found.select("doc_id", "text_hash", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), base.alias("base"), "words")
    found = cut_lineage(found)

    numbered = F.create_map(*[x for w, r in rank.items() for x in (F.lit(w), F.lit(r))])
    cut = F.concat(*[windows(F.col("words"), step, own) for step, own in prefix_words.items()]) if prefix_words else F.expr("filter(array(struct(0 as step, 0 as block, words as own)), x -> false)")
    blocks = found.filter("words is not null").select("doc_id", "text_hash", F.explode(cut).alias("b")).select("doc_id", "text_hash", "b.*")
    blocks = blocks.select("doc_id", "text_hash", "step", "block", F.array_sort(F.transform(F.array_intersect("own", _strings(list(rank))), lambda w: F.element_at(numbered, w))).alias("tokens"))
    probes = blocks.select("doc_id", "text_hash", "step", "block", "tokens", F.size("tokens").alias("size"), F.posexplode("tokens").alias("j", "token"))
    index = spark.createDataFrame(prefixes, "template int, step int, token int, i int, of int, alpha int")
    fits = (F.col("size") >= F.col("alpha")) & (F.col("j") <= F.col("size") - F.col("alpha")) & (F.least(F.col("of") - F.col("i"), F.col("size") - F.col("j")) >= F.col("alpha"))
    pairs = probes.join(F.broadcast(index), ["step", "token"]).filter(fits).select("doc_id", "text_hash", "block", "tokens", "template").distinct()
    chosen = spark.createDataFrame(whole, "template int, label string, wanted array<int>, alpha int")
    overlap = F.size(F.array_intersect("tokens", "wanted"))
    matches = pairs.join(F.broadcast(chosen), "template").filter(overlap >= F.col("alpha"))
    by_text = matches.groupBy("doc_id", "text_hash").agg(F.collect_set("label").alias("more"), F.max(overlap / F.size("wanted")).alias("best")).toDF("other_id", "other_hash", "more", "best")
    joined = found.join(by_text, F.col("doc_id").eqNullSafe(F.col("other_id")) & (F.col("text_hash") == F.col("other_hash")), "left")
    more = F.coalesce("more", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", more)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def sql(templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES, threshold: float = 0.9) -> str:
    """The same rows in DuckDB's SQL, with every block compared to every template."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    listed = lambda own: "[" + ", ".join(map(quote, own)) + "]"
    rows = ", ".join(f"({quote(label)}, {listed(own)}, {least_overlap(len(own), threshold)}, {step})" for _, label, own, step in template_sets(templates))
    at = []
    for phrase, label in phrases:
        parts = words_of(phrase)
        at.append((label, "list_filter(range(len(w)), lambda i: " + " AND ".join(f"coalesce(w[i + {k + 1}] = {quote(p)}, false)" for k, p in enumerate(parts)) + ")"))
    return f"""
WITH texts AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS low FROM documents),
split AS (SELECT doc_id, low, regexp_extract_all(low, '{WORD}') AS w FROM texts),
placed AS (SELECT doc_id, low, len(w) AS n_words, {", ".join(f"{e} AS p{i}" for i, (_, e) in enumerate(at))} FROM split),
base AS (SELECT doc_id, low, n_words, flatten([{", ".join(f"p{i}" for i, _ in enumerate(at))}]) AS p,
  list_filter([{", ".join(f"CASE WHEN len(p{i}) > 0 THEN {quote(label)} END" for i, (label, _) in enumerate(at))}], lambda x: x IS NOT NULL) AS b FROM placed),
templates AS (SELECT * FROM (VALUES {rows}) AS t(label, wanted, alpha, step)),
steps AS (SELECT DISTINCT step FROM templates),
blocks AS (SELECT doc_id, step, list_distinct(w[b + 1 : b + 2 * step]) AS own FROM (SELECT doc_id, w, step, unnest(range(0, greatest(len(w), 1), step)) AS b FROM split, steps)),
matches AS (SELECT doc_id, list(DISTINCT label) AS more, max(n / len(wanted)) AS best FROM
  (SELECT doc_id, label, wanted, alpha, len(list_intersect(own, wanted)) AS n FROM blocks JOIN templates USING (step)) WHERE n >= alpha GROUP BY doc_id)
SELECT doc_id, n_words, len(p)::BIGINT AS n_base, list_min(p)::BIGINT AS first_word, list_max(p)::BIGINT AS last_word,
  array_to_string(list_sort(b), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(b, coalesce(more, [])))), ',') AS labels,
  CASE WHEN len(p) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score
FROM base LEFT JOIN matches USING (doc_id)
"""
