"""License scans by an exact set-similarity join (DataFrame functions only).

Text blocks are compared with license templates as sets of words. A block is a
window of consecutive words, whatever line breaks or paragraphs lie in it: twice
as wide as a template is long (rounded up to a power of two), and the next one
starts half a window on, so a notice that is not longer than its template lies
in one block as a whole. The words of all templates are ordered by how many
documents hold them, rarest first. A block that holds at least ``need`` words of
a template must share one of the template's rarest ``size - need + 1`` words
(prefix filter), must hold ``need`` words (length filter), and the words after
the first shared ones must suffice (positional filter); what is left is counted
exactly, and must hold the words by which the license is named.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The phrases and labels of the base scan.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Notices by which works declare public licenses.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "bsd-header": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "isc-header": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mit-header": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "mit-notice": "Released under the MIT License.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

# Words without which a notice does not name its license.
NAMES = {
    "apache-2.0-notice": ["apache"],
    "apache-2.0-header": ["apache"],
    "cc-by-nc-notice": ["cc", "nc"],
    "cc-by-notice": ["commons", "creative"],
    "gpl-3.0-notice": ["gnu"],
    "gpl-header": ["gnu"],
    "mit-notice": ["mit"],
    "mpl-2.0-notice": ["mozilla"],
}

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> list[str]:
    return [w for w in re.split(SEPARATOR, text.lower()) if w]


def width(template: str) -> int:
    """Words of the blocks that a template is compared with: a power of two, at least twice its length."""
    return max(16, 1 << (2 * len(words_of(template)) - 1).bit_length())


def _lower(text: Column) -> Column:
    """A-Z in lower case. Beyond ASCII only the Kelvin sign has an ASCII letter as its lower case; other letters stay letters."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0101")))


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _base(text: Column) -> Column:
    """A struct of n_words and the hits (word number and label) of the base phrases.

    The words are bound as a lambda's variable, so the text is split once.
    """

    def label_at(words: Column, i: Column) -> Column:
        label = F.lit(None).cast("string")
        for phrase, name in PHRASES.items():
            first, *rest = phrase.split()
            test = F.get(words, i) == first
            for k, w in enumerate(rest, 1):
                test &= F.coalesce(F.get(words, i + k) == w, F.lit(False))
            label = F.when(test, F.lit(name)).otherwise(label)
        return label

    def found(words: Column) -> Column:
        lead = (F.get(words, F.lit(0)) == "").cast("int")  # before a leading separator stands an empty string, likewise at the end
        tail = ((F.element_at(words, -1) == "") & (F.size(words) > 1)).cast("int")
        hint = F.array_contains(words, "license") | F.array_contains(words, "cc")
        hits = F.filter(F.transform(words, lambda _, i: F.struct((i - lead).cast("long").alias("at"), label_at(words, i).alias("label"))), lambda h: h.label.isNotNull())
        return F.struct((F.size(words) - lead - tail).cast("long").alias("n_words"), F.when(hint, hits).alias("hits"))

    return F.get(F.transform(F.array(F.split(_lower(text), SEPARATOR)), found), F.lit(0))


def scan(docs: DataFrame, threshold: float = 0.8, templates: dict[str, str] = TEMPLATES, names: dict[str, list[str]] = NAMES) -> DataFrame:
    """License labels of every row of ``docs`` (doc_id, text).

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels and score: the largest share of a template's words that one block
    holds where it reaches ``threshold``; 1.0 where a base phrase stands; else 0.
    Null and empty texts have no words and empty labels; very long ones are
    many blocks, each a row of its own. Repeated rows and null doc_ids keep
    their own rows: findings are joined by doc_id and the text's hash, and
    equal texts have equal findings. Other columns are not read; an empty table
    gives no rows. Templates are a given, bounded list; only they are
    broadcast. Of texts only template words of documents that hold a rare one
    are exchanged.
    """
    sets = {name: sorted(set(words_of(t))) for name, t in templates.items()}
    wide = {name: width(t) for name, t in templates.items()}
    vocabulary = sorted({w for s in sets.values() for w in s})
    words = F.split(_lower(F.col("text")), SEPARATOR)
    counts = docs.select(F.explode(F.array_intersect(words, _strings(vocabulary))).alias("word")).groupBy("word").count()
    seen = {r["word"]: r["count"] for r in counts.collect()}  # at most one row per template word
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (seen.get(w, 0), w)))}

    need = {name: max(1, math.ceil(threshold * len(s) - 1e-9)) for name, s in sets.items()}
    index = [(rank[w], wide[name], name, i, len(s), need[name], [rank[x] for x in s], [rank[x] for x in names.get(name, []) if x in rank]) for name, s in ((n, sorted(v, key=rank.get)) for n, v in sets.items()) for i, w in enumerate(s) if i <= len(s) - need[name]]
    spark = docs.sparkSession
    prefixes = spark.createDataFrame(index, "rank int, wide int, label string, at int, size int, need int, template array<int>, must array<int>")
    rare = sorted({w for w in vocabulary if rank[w] in {x[0] for x in index}})
    fewest = min(need.values())

    ranks = F.create_map(*[F.lit(x) for w in vocabulary for x in (w, rank[w])])
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_text")

    def hits(words: Column) -> Column:
        """Places and ranks of template words, if a rare one is among the words; the words are a lambda's variable, so the text is split once."""
        lead = (F.get(words, F.lit(0)) == "").cast("int")
        placed = F.transform(words, lambda w, i: F.struct((i - lead).alias("at"), F.element_at(ranks, w).alias("rank")))
        return F.when(F.arrays_overlap(words, _strings(rare)), F.filter(placed, lambda h: h.rank.isNotNull()))

    found_words = F.get(F.transform(F.array(words), hits), F.lit(0))
    placed = docs.select("doc_id", key, found_words.alias("_hits")).where(F.size("_hits") >= fewest).select("doc_id", "_text", F.explode("_hits").alias("h"))
    halves = F.explode(F.array(*[F.lit(w // 2) for w in sorted(set(wide.values()))])).alias("half")
    each = placed.select("doc_id", "_text", "h.at", "h.rank", halves).withColumn("to", F.floor(F.col("at") / F.col("half")))
    each = each.withColumn("block", F.explode(F.when(F.col("to") > 0, F.array("to", F.col("to") - 1)).otherwise(F.array("to"))))
    blocks = each.groupBy("doc_id", "_text", "half", F.col("block").alias("_block")).agg(F.array_sort(F.collect_set("rank")).alias("block")).where(F.size("block") >= fewest)
    probes = blocks.select("*", F.posexplode(F.slice("block", F.lit(1), F.size("block") - fewest + 1)).alias("_at", "rank"))
    same = (F.col("p.rank") == F.col("t.rank")) & (F.col("half") * 2 == F.col("wide"))
    candidates = probes.alias("p").join(F.broadcast(prefixes).alias("t"), same)
    candidates = candidates.where((F.size("block") >= F.col("need")) & (1 + F.least(F.col("size") - F.col("at") - 1, F.size("block") - F.col("_at") - 1) >= F.col("need")))
    overlap = F.size(F.array_intersect("block", "template"))
    named = F.size(F.array_except("must", "block")) == 0
    found = candidates.where((overlap >= F.col("need")) & named).groupBy("doc_id", "_text").agg(F.collect_set("label").alias("_labels"), F.max(overlap / F.col("size")).alias("_score"))

    base = docs.select("doc_id", key, _base(F.col("text")).alias("_b"))
    base = base.select(
        "doc_id",
        "_text",
        "_b.n_words",
        F.coalesce(F.size("_b.hits"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min("_b.hits.at").alias("first_word"),
        F.array_max("_b.hits.at").alias("last_word"),
        F.coalesce(F.array_sort(F.array_distinct("_b.hits.label")), F.array().cast("array<string>")).alias("_base"),
    ).withColumn("n_base", F.greatest("n_base", F.lit(0).cast("long")))
    a, b = base.alias("a"), found.alias("b")
    joined = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a._text") == F.col("b._text")), "left")
    own = F.coalesce("_labels", F.array().cast("array<string>"))
    return joined.select(
        "a.doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base", own)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_score", F.lit(0.0))).alias("score"),
    )


def oracle(threshold: float = 0.8, templates: dict[str, str] = TEMPLATES, names: dict[str, list[str]] = NAMES) -> str:
    """DuckDB SQL for :func:`scan` on ``documents``, without any filter."""
    upper, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    tests = " ".join("WHEN " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split())) + f" THEN '{n}'" for p, n in PHRASES.items())
    values = ", ".join(f"('{n}', {width(t)}, {sorted(set(words_of(t)))!r}, {names.get(n, [])!r}::VARCHAR[])" for n, t in templates.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, translate(coalesce(text, ''), '{upper}', '{small}') AS t FROM documents),
w AS (SELECT rn, doc_id, t, regexp_extract_all(t, '{word}') AS w FROM d),
p AS (SELECT rn, i, CASE {tests} END AS label FROM (SELECT rn, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
b AS (SELECT rn, count(*) AS n, min(i) - 1 AS lo, max(i) - 1 AS hi, list(DISTINCT label) AS labels FROM p WHERE label IS NOT NULL GROUP BY rn),
t(label, wide, template, must) AS (VALUES {values}),
s AS (SELECT rn, w, wide, unnest(range(0, len(w), wide // 2)) AS a FROM w, (SELECT DISTINCT wide FROM t)),
l AS (SELECT DISTINCT rn, wide, list_distinct(w[a + 1 : a + wide]) AS block FROM s),
m AS (SELECT rn, label, len(list_intersect(block, template)) / len(template)::DOUBLE AS share FROM l JOIN t USING (wide) WHERE len(list_intersect(block, template)) >= greatest(1, ceil({threshold} * len(template) - 1e-9)) AND list_has_all(block, must)),
f AS (SELECT rn, list(DISTINCT label) AS labels, max(share) AS score FROM m GROUP BY rn)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.lo::BIGINT AS first_word, b.hi::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ',') AS labels,
  CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(f.score, 0.0::DOUBLE) END AS score
FROM w LEFT JOIN b USING (rn) LEFT JOIN f USING (rn)"""
