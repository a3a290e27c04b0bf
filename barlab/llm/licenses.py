"""Licence scans by an exact set-similarity join, in DataFrame functions alone.

Words are runs of digits, letters and characters beyond ASCII of the lower-cased text. A block is
BLOCK consecutive words; a new one begins every STEP words, so a notice of up to STEP words lies
whole in some block. A block meets a template if it holds at least THRESHOLD of the template's distinct words.

The join orders the templates' words by how many documents hold them, rarest first. A template
of n words that must share m of them is looked up by its first n - m + 1 words only; a block by the
words before its last m - 1 that any template has. A pair is dropped when the block has too few such
words (length), or when the words after the common one can't make up m (position). The survivors are
counted in full. The template side is a fixed list, so it is broadcast and no text is shuffled.

Besides, the base scan reports every place where the words of a base phrase stand one after the other.

Defined cases: a null text is empty, with no words; a null id stays a row; repeated rows stay rows;
overlapping places all count; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.llm.common import documents, quoted, text_of

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
BLOCK, STEP, THRESHOLD = 64, 32, 0.9
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at apache org", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower case of other letters can't make or break a word, nor make one of the phrases'."""
    return F.array_remove(F.split(F.lower(text), SEPARATORS), "")


def strings(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def word_ranks(words: DataFrame, templates=TEMPLATES) -> list[str]:
    """The templates' words, from the fewest documents that hold them to the most; ties in letter order."""
    vocabulary = sorted({w for t, _ in templates for w in t.split()})
    counts = (words.select(F.explode(F.array_intersect(strings(vocabulary), F.col("words"))).alias("word"))
              .groupBy("word").count().collect())       # a row per word of the fixed templates at most
    found = {r["word"]: r["count"] for r in counts}
    return sorted(vocabulary, key=lambda w: (found.get(w, 0), w))


def template_index(spark: SparkSession, ranks: list[str], threshold: float, templates=TEMPLATES) -> DataFrame:
    """word, at, size, need, tokens, label: each template under each word of its prefix."""
    place, rows = {w: i for i, w in enumerate(ranks)}, []
    for text, label in templates:
        tokens = sorted(set(text.split()), key=place.get)
        need = math.ceil(threshold * len(tokens) - 1e-9)
        rows += [(tokens[i], i, len(tokens), need, tokens, label) for i in range(len(tokens) - need + 1)]
    return spark.createDataFrame(rows, "word string, at int, size int, need int, tokens array<string>, label string")


def places(phrase: str) -> Column:
    parts = phrase.split()
    here = lambda i: all_of([F.get("words", i + k) == w for k, w in enumerate(parts)])
    n = F.size("words")
    return F.when(n >= len(parts), F.filter(F.sequence(F.lit(0), n - len(parts)), here)).otherwise(F.array().cast("array<int>"))


def all_of(tests: list[Column]) -> Column:
    every = tests[0]
    for test in tests[1:]:
        every = every & test
    return every


def scan(docs: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score (the largest share of a
    template's words in a block that meets it; 1 where a base phrase stands; else 0), per row."""
    rows = docs.select(quoted(doc_id).alias("doc_id"), text_of(text).alias("text"))
    worded = rows.select("doc_id", words_of(F.col("text")).alias("words"))
    ranks = word_ranks(worded, templates)
    index = template_index(docs.sparkSession, ranks, threshold, templates)
    starts = sorted({r["word"] for r in index.select("word").distinct().collect()})
    least = min(math.ceil(threshold * len(set(t.split())) - 1e-9) for t, _ in templates)

    # A base phrase needs all of its words: most documents are settled by one lookup of three words.
    maybe = F.arrays_overlap("words", strings([p.split()[-2] for p in BASE]))
    found = F.when(maybe, F.struct(*[places(p).alias(f"p{i}") for i, p in enumerate(BASE)]))
    blocks = F.transform(F.sequence(F.lit(0), F.size("words") - 1, F.lit(STEP)),
                         lambda i: F.array_intersect(strings(ranks), F.slice("words", i + 1, BLOCK)))
    hopeful = F.when(F.arrays_overlap("words", strings(starts)), F.filter(blocks, lambda b: F.size(b) >= least))
    based = worded.withColumn("found", found).withColumn("blocks", hopeful)
    every = F.concat(*[F.coalesce(F.col(f"found.p{i}"), F.array().cast("array<int>")) for i in range(len(BASE))])
    labels = F.array_compact(F.array(*[F.when(F.size(F.col(f"found.p{i}")) > 0, F.lit(label)) for i, label in enumerate(BASE.values())]))
    narrow = based.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), every.alias("places"),
        F.array_sort(F.array_distinct(labels)).alias("base"), "blocks")
    exploded = narrow.select("row", F.struct("doc_id", "n_words", "places", "base").alias("doc"), F.explode_outer("blocks").alias("block"))
    tokens = exploded.select("row", "doc", "block", F.posexplode_outer("block").alias("j", "word"))
    held = F.size("block")
    near = ((held >= F.col("need")) & (F.col("j") <= held - F.col("need"))
            & (1 + F.least(F.col("size") - F.col("at") - 1, held - F.col("j") - 1) >= F.col("need")))
    pairs = tokens.join(F.broadcast(index.withColumnRenamed("word", "start")), (F.col("word") == F.col("start")) & near, "left")
    common = F.size(F.array_intersect("tokens", "block"))
    meets = common >= F.col("need")
    met = pairs.groupBy("row").agg(
        F.first("doc").alias("doc"), F.collect_set(F.when(meets, F.col("label"))).alias("more"),
        F.max(F.when(meets, common / F.col("size"))).alias("share"))
    none = F.size("doc.places") == 0
    return met.select(
        "doc.doc_id", "doc.n_words", F.size("doc.places").cast("long").alias("n_base"),
        F.when(~none, F.array_min("doc.places")).cast("long").alias("first_word"),
        F.when(~none, F.array_max("doc.places")).cast("long").alias("last_word"),
        F.array_join("doc.base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("doc.base", "more")), ",").alias("labels"),
        F.when(~none, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def sql(threshold: float = THRESHOLD, templates=TEMPLATES) -> str:
    """DuckDB's form: every block against every template, without filters."""
    values = ", ".join(f"({sorted(set(t.split()))!r}, '{label}', {math.ceil(threshold * len(set(t.split())) - 1e-9)})" for t, label in templates)
    base = []
    for i, phrase in enumerate(BASE):
        parts = phrase.split()
        tests = " AND ".join(f"words[i + {k + 1}] = '{w}'" for k, w in enumerate(parts))
        base.append(f"list_filter(range(0, greatest(0, len(words) - {len(parts) - 1})), lambda i: {tests}) AS p{i}")
    return f"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(string_split_regex(lower(coalesce(text, '')), '{SEPARATORS}'), lambda x: x <> '') AS words FROM documents),
p AS (SELECT *, {", ".join(base)} FROM w),
b AS (
  SELECT *, p0 || p1 || p2 AS places,
    list_sort(list_filter([{", ".join(f"CASE WHEN len(p{i}) > 0 THEN '{label}' END" for i, label in enumerate(BASE.values()))}], lambda x: x IS NOT NULL)) AS base
  FROM p),
blocks AS (
  SELECT r, list_distinct(words[start + 1:start + {BLOCK}]) AS block
  FROM (SELECT r, words, unnest(range(0, len(words), {STEP})) AS start FROM w)),
hits AS (
  SELECT r, label, len(list_intersect(block, tokens)) / len(tokens) AS share
  FROM blocks JOIN (VALUES {values}) t(tokens, label, need) ON list_has_any(block, tokens) AND len(list_intersect(block, tokens)) >= need),
met AS (SELECT r, list(DISTINCT label) AS more, max(share) AS share FROM hits GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base,
  CAST(list_min(places) AS BIGINT) AS first_word, CAST(list_max(places) AS BIGINT) AS last_word,
  array_to_string(base, ',') AS base_labels,
  array_to_string(list_sort(list_distinct(base || coalesce(more, []))), ',') AS labels,
  CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
FROM b LEFT JOIN met USING (r)"""
