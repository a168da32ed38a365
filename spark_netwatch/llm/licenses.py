"""Operator 7, license scans: exact set-similarity join of text blocks against license templates.

A block is a line, a template a set of words; a block carries a template when it contains at least
``threshold`` of the template's words. The template words are ordered by their frequency in the
whole corpus, rarest first. A block that reaches the threshold must hold one of a template's first
``size - needed + 1`` words (prefix filter), at least ``needed`` template words (length filter), and
enough words must follow the first common one on both sides (positional filter). Only pairs that
pass are verified. The candidates come from an equi-join on a word's rank with the prefix table,
whose size is that of the template list; no text enters a shuffle.

Defined results: a null text is the empty text (no words, no labels, score 0); rows that share a
doc_id are one document for the labels found; templates of equal words each give their label; an
empty table gives no rows; further columns are not read. Texts of any length are read whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.9

#: Phrases of the base labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices by which works state their license.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2.0"),
    ("mit", "released under the mit license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("cc-by-nc", "licensed under cc by-nc 4.0"),
    ("cc-by-sa", "licensed under cc by-sa 4.0"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
]


def words(text: Column) -> Column:
    """Words of ``text`` with A-Z lower-cased, in order."""
    return F.array_remove(F.split(F.translate(text, ASCII_UPPER, ASCII_LOWER), NOT_WORD), "")


def _template_words(text: str) -> list[str]:
    return sorted(set(text.replace(".", " ").replace("-", " ").split()))


def blocks(docs: DataFrame) -> DataFrame:
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("block", "line"))
    return lines.select("doc_id", "block", words(F.col("line")).alias("words"))


def template_matches(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, block, label, containment: every (block, template) pair at or over the threshold."""
    spark = docs.sparkSession
    sets = [(label, _template_words(text)) for label, text in templates]
    vocabulary = sorted({w for _, ws in sets for w in ws})
    counted = (blocks(docs).select(F.explode("words").alias("word")).filter(F.col("word").isin(vocabulary))
               .groupBy("word").count().collect())        # as many rows as the templates have words
    count = {r["word"]: r["count"] for r in counted}
    order = sorted(vocabulary, key=lambda w: (count.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for label, ws in sets:
        ranks = sorted(rank[w] for w in ws)
        needed = math.ceil(threshold * len(ranks) - 1e-9)
        rows += [(r, i, needed, ranks, label) for i, r in enumerate(ranks[:len(ranks) - needed + 1])]
    entries = [F.struct(F.lit(r).alias("rank"), F.lit(at).alias("at"), F.lit(needed).alias("needed"),
                        F.array(*map(F.lit, ranks)).alias("ranks"), F.lit(label).alias("label")) for r, at, needed, ranks, label in rows]
    prefixes = F.broadcast(spark.range(1).select(F.inline(F.array(*entries))))
    first = [order[r] for r in sorted({r[0] for r in rows})]
    known = F.array(*map(F.lit, order))
    held = (blocks(docs).filter(F.arrays_overlap("words", F.array(*map(F.lit, first))))
            .withColumn("held", F.array_sort(F.transform(F.array_intersect("words", known), lambda w: F.array_position(known, w).cast("int") - 1))))
    pairs = held.select("doc_id", "block", "held", F.posexplode("held").alias("held_at", "rank")).join(prefixes, "rank")
    after = F.least(F.size("ranks") - F.col("at"), F.size("held") - F.col("held_at"))
    overlap = F.size(F.array_intersect("held", "ranks"))
    return (pairs.filter((F.size("held") >= F.col("needed")) & (after >= F.col("needed")) & (overlap >= F.col("needed")))
            .select("doc_id", "block", "label", (overlap / F.size("ranks")).alias("containment")))


def _places(ws: Column, phrase: str) -> Column:
    """Where the phrase's words stand consecutively; looked for only in texts with its last word."""
    first, *rest = phrase.split()

    def here(w, i):
        hit = w == first
        for k, other in enumerate(rest, 1):
            hit = hit & F.get(ws, i + k).eqNullSafe(F.lit(other))
        return F.when(hit, i)

    return F.filter(F.transform(ws, here), lambda i: i.isNotNull())


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the greatest containment of a matched template, 0.5 for a base phrase alone, else 0.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = (template_matches(docs, templates, threshold).groupBy("doc_id")
             .agg(F.collect_set("label").alias("found"), F.max("containment").alias("best")))
    none = F.array().cast("array<int>")
    ws = F.col("words")
    places = [F.when(F.array_contains("words", phrase.split()[-1]), _places(ws, phrase)).otherwise(none) for phrase in PHRASES]
    own = docs.select("doc_id", words(F.col("text")).alias("words")).select(
        "doc_id", F.size("words").cast("long").alias("n_words"), *[p.alias(f"place{i}") for i, p in enumerate(places)])
    every = F.concat(*[F.col(f"place{i}") for i in range(len(places))])
    labels = F.array_compact(F.array(*[F.when(F.size(f"place{i}") > 0, F.lit(label)) for i, label in enumerate(PHRASES.values())]))
    own = own.select("doc_id", "n_words", every.alias("places"), labels.alias("base"))
    joined = own.join(found, own.doc_id.eqNullSafe(found.doc_id), "left").select(own.doc_id, "n_words", "places", "base", "found", "best")
    return joined.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.coalesce("best", F.when(F.size("places") > 0, 0.5).otherwise(0.0)).alias("score"))


def scan_sql(templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same result by comparing every block with every template (DuckDB)."""
    quoted = ", ".join(f"('{label}', {_template_words(text)!r})" for label, text in templates)
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    lower = f"translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}')"
    hits, names = [], []
    for phrase, label in PHRASES.items():
        test = " AND ".join(f"coalesce(ws[i + {k}] = '{w}', false)" for k, w in enumerate(phrase.split(), 1))
        hits.append(f"list_filter(range(len(ws)), lambda i: {test})")
        names.append(f"CASE WHEN len({hits[-1]}) > 0 THEN ['{label}'] ELSE [] END")
    return f"""
WITH t(label, ws) AS (VALUES {quoted}),
w AS (SELECT doc_id, regexp_extract_all({lower}, '{word}') AS ws FROM documents),
b AS (SELECT doc_id, list_distinct(regexp_extract_all(unnest(string_split({lower}, chr(10))), '{word}')) AS ws FROM documents),
m AS (SELECT doc_id, label, len(list_intersect(b.ws, t.ws)) / len(t.ws) AS c FROM b, t
      WHERE len(list_intersect(b.ws, t.ws)) >= ceil({threshold} * len(t.ws) - 1e-9)),
f AS (SELECT doc_id, list(DISTINCT label) AS found, max(c) AS best FROM m GROUP BY doc_id),
p AS (SELECT doc_id, len(ws) AS n_words, {' || '.join(hits)} AS places, {' || '.join(names)} AS base FROM w)
SELECT p.doc_id, n_words, len(places) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
       array_to_string(list_sort(base), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(base || coalesce(found, []))), ',') AS labels,
       coalesce(best, CASE WHEN len(places) > 0 THEN 0.5 ELSE 0 END) AS score
FROM p LEFT JOIN f USING (doc_id)
"""
