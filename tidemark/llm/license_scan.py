"""License scans by diagonal voting.

Every rolling word k-gram hash of every text is joined (Spark, broadcast of the fixed template table) to the template positions
with that hash; the words are compared too, so hash collisions don't vote. Votes are summed by offset diagonal (text position minus
template position), neighbouring diagonals (words inserted or left out) are merged, and a span is verified by the words of its template that the grams found in it cover, each counted once: 0.8 of them
or more for a template, all for a base phrase; nor may a span be longer than the template by more words than `DRIFT` and those it may lack.

A-Z are lower-cased; words are runs of ASCII letters, ASCII digits and non-ASCII characters. The template table is a fixed value of
a few hundred positions, so its broadcast does not grow with the data.

Cases: null or empty text has no words and no labels; repeated rows are rows of their own; a null id stays null; an empty table gives an
empty result; only the id and the text are read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import named

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Length of the k-grams of templates and of base phrases.
K, K_BASE = 4, 2
#: Share of a template's words that a span must cover.
COVER = 0.8
#: Diagonals that lie at most so far apart, in spans at most so many words apart, belong together.
DRIFT, GAP = 3, 8

# Base phrases with their labels.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Sentences that open or state well-known public licences, with their identifiers.
TEMPLATES = {
    "Licensed under the Apache License, Version 2.0": "apache-2.0",
    'you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0': "apache-2.0",
    "This work is licensed under the GNU General Public License, version 3": "gpl-3.0",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License": "gpl",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License": "lgpl",
    "Licensed under CC BY-NC 4.0": "cc-by-nc-4.0",
    "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by-4.0",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": "mit",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "bsd",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0": "mpl-2.0",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "This is free and unencumbered software released into the public domain": "unlicense",
}


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.translate(str.maketrans(UPPER, LOWER)))


def template_grams(spark, base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES, k: int = K) -> DataFrame:
    """One row per k-gram position: t_gram, t_pos, t_id, t_label, t_base, t_size (words), t_k. Templates shorter than k use their whole length."""
    rows = []
    for n, (phrase, label) in enumerate([*base.items(), *templates.items()]):
        words, is_base = words_of(phrase), n < len(base)
        size = min(K_BASE if is_base else k, len(words))
        rows += [(" ".join(words[i : i + size]), i, n, label, is_base, len(words), size) for i in range(len(words) - size + 1)]
    return spark.createDataFrame(rows, "t_gram string, t_pos int, t_id int, t_label string, t_base boolean, t_size int, t_k int").withColumn("t_hash", F.xxhash64("t_gram"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES, cover: float = COVER) -> DataFrame:
    """For every row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label, first, last, cover)."""
    text = F.coalesce(named(text_col), F.lit(""))
    # lower() is the faster, and the same where all is ASCII.
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    words = F.array_remove(F.split(lowered, SEPARATORS), "")
    rows = docs.select(named(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), words.alias("w0"))
    shifted = [F.expr(f"slice(w0, {i + 1}, size(w0))").alias(f"w{i}") for i in range(1, K)]
    rows = rows.select("doc_id", "row", F.size("w0").cast("long").alias("n_words"), "w0", *shifted)
    at = rows.select("doc_id", "row", "n_words", F.posexplode_outer(F.arrays_zip("w0", "w1", "w2", "w3")).alias("pos", "g"))
    pair = F.concat_ws(" ", "g.w0", "g.w1")
    four = F.concat_ws(" ", "g.w0", "g.w1", "g.w2", "g.w3")
    grams = at.select(
        "doc_id", "row", "n_words", "pos", F.explode(F.array(F.when(F.col("g.w1").isNotNull(), pair), F.when(F.col("g.w3").isNotNull(), four))).alias("gram")
    ).select("*", F.xxhash64("gram").alias("hash"), (F.coalesce("pos", F.lit(0)) == 0).alias("head"))
    table = F.broadcast(template_grams(docs.sparkSession, base, templates))
    voted = grams.join(table, (F.col("hash") == F.col("t_hash")) & (F.col("gram") == F.col("t_gram")), "left").where("t_id is not null or head")
    diagonals = (
        voted.withColumn("diagonal", F.col("pos") - F.col("t_pos"))
        .groupBy("doc_id", "row", "n_words", "t_id", "t_label", "t_base", "t_size", "t_k", F.when(F.col("t_id").isNotNull(), F.col("diagonal")).alias("diagonal"))
        .agg(F.count(F.lit(1)).alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_set("t_pos").alias("found"))
    )
    by = Window.partitionBy("row", "t_id").orderBy("first", "diagonal")
    apart = (
        F.col("t_base")
        | (F.abs(F.col("diagonal") - F.lag("diagonal").over(by)) > DRIFT)
        | (F.col("first") - F.max("last").over(by.rowsBetween(Window.unboundedPreceding, -1)) > GAP)
    )
    merged = diagonals.withColumn("apart", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("span", F.sum("apart").over(by))
    spans = merged.groupBy("doc_id", "row", "n_words", "t_id", "t_label", "t_base", "t_size", "t_k", "span").agg(
        F.flatten(F.collect_list("found")).alias("found"), F.min("first").cast("long").alias("first"), F.max(F.col("last") + F.col("t_k") - 1).cast("long").alias("last")
    )
    # A template has a fixed number of positions, so the arrays are bounded; nothing is voted for in a document's own row.
    covered = F.size(F.array_distinct(F.flatten(F.transform("found", lambda p: F.sequence(p, p + F.col("t_k") - 1)))))
    spans = spans.withColumn("cover", F.when(F.col("t_id").isNotNull(), covered / F.col("t_size")))
    least = F.when(F.col("t_base"), 1.0).otherwise(cover)
    longest = F.col("t_size") * (2 - least) + DRIFT
    good = F.col("t_id").isNotNull() & (F.col("cover") >= least) & (F.col("last") - F.col("first") + 1 <= longest)
    base_hit = good & F.col("t_base")
    joined = lambda hit: F.array_join(F.array_sort(F.collect_set(F.when(hit, F.col("t_label")))), ",")
    return spans.groupBy("doc_id", "row").agg(
        F.max("n_words").alias("n_words"),
        F.count(F.when(base_hit, 1)).alias("n_base"),
        F.min(F.when(base_hit, F.col("first"))).alias("first_word"),
        F.max(F.when(base_hit, F.col("first"))).alias("last_word"),
        joined(base_hit).alias("base_labels"),
        joined(good).alias("labels"),
        F.coalesce(F.max(F.when(good, F.col("cover"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(good, F.struct("first", "last", F.col("t_label").alias("label"), "cover")))).alias("spans"),
    ).drop("row")


def oracle_sql(base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES, k: int = K, cover: float = COVER) -> str:
    """DuckDB SQL for `scan` on `documents`, without the spans."""
    values = []
    for n, (phrase, label) in enumerate([*base.items(), *templates.items()]):
        words, is_base = words_of(phrase), n < len(base)
        size = min(K_BASE if is_base else k, len(words))
        values += [f"('{' '.join(words[i : i + size])}', {i}, {n}, '{label}', {is_base}, {len(words)}, {size})" for i in range(len(words) - size + 1)]
    gram = lambda m: " || ' ' || ".join(f"w[i + {j}]" for j in range(m))
    return rf"""
WITH t AS (SELECT * FROM (VALUES {", ".join(values)}) v(gram, t_pos, t_id, label, base, size, k)),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SEPARATORS}'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT r, i - 1 AS pos, {gram(2)} AS gram FROM (SELECT r, w, unnest(range(1, len(w))) AS i FROM d) UNION ALL SELECT r, i - 1, {gram(4)} FROM (SELECT r, w, unnest(range(1, len(w) - 2)) AS i FROM d)),
n AS (SELECT r, t_id, label, base, size, k, pos - t_pos AS diagonal, min(pos) AS first, max(pos) AS last, list(t_pos) AS found FROM g JOIN t USING (gram) GROUP BY ALL),
m AS (SELECT *, coalesce(base OR abs(diagonal - lag(diagonal) OVER o) > {DRIFT} OR first - max(last) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > {GAP}, true) AS apart FROM n WINDOW o AS (PARTITION BY r, t_id ORDER BY first, diagonal)),
s AS (SELECT *, sum(apart::INT) OVER (PARTITION BY r, t_id ORDER BY first, diagonal ROWS UNBOUNDED PRECEDING) AS span FROM m),
c AS (SELECT r, label, base, size, min(first) AS first, max(last + k - 1) AS last, len(list_distinct(flatten(flatten(list(list_transform(found, lambda p: range(p, p + k))))))) / size AS cover FROM s GROUP BY r, t_id, label, base, size, span),
h AS (SELECT * FROM c WHERE cover >= CASE WHEN base THEN 1 ELSE {cover}::DOUBLE END AND last - first + 1 <= size * (2 - CASE WHEN base THEN 1 ELSE {cover}::DOUBLE END) + {DRIFT}),
q AS (SELECT r, count(*) FILTER (WHERE base) AS n_base, min(first) FILTER (WHERE base) AS first_word, max(first) FILTER (WHERE base) AS last_word, array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE base)), ',') AS base_labels,
  array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(cover) AS score FROM h GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN q USING (r)"""
