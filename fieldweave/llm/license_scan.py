"""License scans by diagonal voting.

Every rolling three-word gram of every document is joined to the template positions that hold
the same gram. A hit votes for its diagonal (document position less template position). A
diagonal on which every gram of a phrase votes is an exact place of the phrase; for the longer
notices, neighbouring diagonals (a few words put in or left out) are merged and the merged span
must hold enough of the notice in about its length.

Null texts count as empty; empty texts have no words, no places and score 0. Repeated rows with
the same id and text are scanned alike and each keeps its row. Templates are a fixed small table
and so are broadcast. Other columns of the input are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldweave.llm.common import WORD, ascii_words, text_key

K = 3
#: Neighbouring diagonals at most so far apart are one span of a long notice.
SLACK = 4
#: Share of a notice's grams that a span must hold, and the span's greatest length in notices.
COVERAGE, STRETCH = 0.8, 1.4

# The contract's phrases.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Short public notices, with the label each one stands for.
NOTICES = {
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind": "apache-2",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl-2",
    "licensed under a creative commons attribution 4 0 international license": "cc-by",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "cc0",
    "all rights reserved no part of this publication may be reproduced": "all-rights-reserved",
}


def template_rows() -> list[tuple[int, str, bool, int, int, str, str, str]]:
    """(template, label, exact, grams, position, word, next word, the one after)."""
    rows = []
    for t, (text, label) in enumerate([*PHRASES.items(), *NOTICES.items()]):
        words = re.findall(WORD, text)
        n = len(words) - K + 1
        rows += [(t, label, text in PHRASES, n, i, *words[i : i + K]) for i in range(n)]
    return rows


def templates(spark: SparkSession) -> DataFrame:
    values = ", ".join(f"({t}, '{label}', {str(exact).lower()}, {n}, {i}, '{a}', '{b}', '{c}')" for t, label, exact, n, i, a, b, c in template_rows())
    return spark.sql(f"SELECT *, xxhash64(a, b, c) AS gram FROM VALUES {values} AS t(template, label, exact, grams, tpos, a, b, c)")


def spans(docs: DataFrame) -> DataFrame:
    """Verified spans: doc_id, text key, label, exact, first word, end word (exclusive), coverage."""
    words = docs.select("doc_id", text_key(F.col("text")).alias("tk"), ascii_words(F.col("text")).alias("w"))
    # no filter on the words: Spark would push it down and split every text twice
    grams = words.select("doc_id", "tk", "w", F.explode_outer(F.when(F.size("w") >= K, F.sequence(F.lit(0), F.size("w") - K))).alias("pos"))
    at = lambda i: F.get("w", F.col("pos") + i)
    votes = (
        grams.withColumn("gram", F.xxhash64(at(0), at(1), at(2)))
        .join(F.broadcast(templates(docs.sparkSession)), "gram")
        .filter((at(0) == F.col("a")) & (at(1) == F.col("b")) & (at(2) == F.col("c")))
        .select("doc_id", "tk", "template", "label", "exact", "grams", "tpos", (F.col("pos") - F.col("tpos")).alias("diagonal"))
    )
    keys = ["doc_id", "tk", "template", "label", "exact", "grams"]
    # a set, bounded by the template, so that repeated rows vote once
    diagonals = votes.groupBy(*keys, "diagonal").agg(F.collect_set("tpos").alias("seen"))
    near = Window.partitionBy(*keys).orderBy("diagonal")
    apart = F.col("exact") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(near) > SLACK, F.lit(True))
    merged = (
        diagonals.withColumn("cluster", F.sum(apart.cast("int")).over(near))
        .groupBy(*keys, "cluster")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("held"),
            F.min(F.col("diagonal") + F.array_min("seen")).alias("first"),
            (F.max(F.col("diagonal") + F.array_max("seen")) + K).alias("end"),
        )
    )
    coverage = F.col("held") / F.col("grams")
    fits = (coverage >= COVERAGE) & (F.col("end") - F.col("first") <= STRETCH * (F.col("grams") + K - 1))
    return merged.withColumn("coverage", coverage).filter(F.when(F.col("exact"), F.col("held") == F.col("grams")).otherwise(fits)).select("doc_id", "tk", "label", "exact", "first", "end", "coverage")


def scan(docs: DataFrame) -> DataFrame:
    """One row per document with its places of the phrases and its labels."""
    base = F.col("exact")
    join_labels = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = spans(docs).groupBy(F.col("doc_id").alias("id2"), F.col("tk").alias("tk2")).agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        join_labels(F.when(base, F.col("label"))).alias("base_labels"),
        join_labels(F.col("label")).alias("labels"),
        F.max("coverage").alias("score"),
    )
    counted = docs.select("doc_id", text_key(F.col("text")).alias("tk"), F.size(ascii_words(F.col("text"))).cast("long").alias("n_words"))
    return counted.join(found, counted.doc_id.eqNullSafe(found.id2) & (counted.tk == found.tk2), "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).cast("double").alias("score"),
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    values = ", ".join(f"({t}, '{label}', {str(exact).lower()}, {n}, {i}, '{a} {b} {c}')" for t, label, exact, n, i, a, b, c in template_rows())
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH t(template, label, exact, grams, tpos, gram) AS (VALUES {values}),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
g AS (SELECT doc_id, pos, words[pos + 1] || ' ' || words[pos + 2] || ' ' || words[pos + 3] AS gram
      FROM (SELECT doc_id, words, unnest(range(0, len(words) - 2)) AS pos FROM w WHERE len(words) >= 3)),
votes AS (SELECT DISTINCT doc_id, template, label, exact, grams, tpos, pos - tpos AS diagonal FROM g JOIN t USING (gram)),
c AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal RANGE UNBOUNDED PRECEDING) AS cluster FROM (
      SELECT *, CASE WHEN (row_number() OVER (PARTITION BY doc_id, template, diagonal ORDER BY tpos)) > 1 THEN 0
        WHEN exact OR diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal, tpos) <= {SLACK} IS NOT TRUE THEN 1 ELSE 0 END AS apart FROM votes)),
m AS (SELECT doc_id, template, label, exact, grams, count(DISTINCT tpos) AS held, min(diagonal + tpos) AS first, max(diagonal + tpos) + {K} AS fin
      FROM c GROUP BY doc_id, template, label, exact, grams, cluster),
s AS (SELECT *, held / grams AS coverage FROM m WHERE CASE WHEN exact THEN held = grams
      ELSE held / grams >= {COVERAGE} AND fin - first <= {STRETCH} * (grams + {K} - 1) END),
f AS (SELECT doc_id, count(*) FILTER (exact) AS n_base, min(first) FILTER (exact) AS first_word, max(first) FILTER (exact) AS last_word,
      string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score
      FROM s GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM w LEFT JOIN f USING (doc_id)"""


ORACLE = {"op1_license_scan": _sql()}
