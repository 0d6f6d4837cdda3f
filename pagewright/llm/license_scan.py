"""License scans by diagonal voting (DataFrame functions only).

Every rolling word k-gram of a document whose hash occurs in a template is joined to the template positions that hold
it. Each joined pair votes for the diagonal ``document position - template position``; diagonals that lie within
``DIAGONAL_GAP`` of each other are merged, so that a few inserted or missing words do not break a span, and a merged
span is kept when the template k-grams it saw, compared as words and not only as hashes, cover enough of the template.
Where a chain of diagonals is longer than a span may be (phrases of a licence repeated beside it), its densest window of
diagonals is verified instead.

Defined results: a null or word-less text has no words and no labels; a text of any length is scanned whole; of windows
that hold as much, the one on the smallest diagonal counts; a place that several templates claim has a span of each;
repeated rows each get their own row; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.rows import named, quoted

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DIAGONAL_GAP = 3
#: Share of a long template's k-grams that a span must hold.
COVERAGE = 0.5
#: A span may be this many times as long as its template.
STRETCH = 1.5
TEXT_K = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Template k-grams that are sent to every task; a larger table is shuffled.
BROADCAST_GRAMS = 100_000


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: A phrase must be held whole; its places are the base places.
    phrase: bool = False

    @property
    def words(self) -> list[str]:
        return "".join(c if c.isascii() and c.isalnum() else " " for c in self.text.lower()).split()

    @property
    def k(self) -> int:
        return 2 if self.phrase else TEXT_K


# Phrases of the contract, and opening or granting sentences of widely used public licences.
TEMPLATES = (
    Template("gpl", "gnu general public license", phrase=True),
    Template("apache", "apache license", phrase=True),
    Template("cc-by", "cc by", phrase=True),
    Template("mit", "mit license", phrase=True),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    Template("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    Template("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-sa", "This work is licensed under the Creative Commons Attribution ShareAlike 4.0 International License"),
    Template("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    Template("bsl", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"),
    Template("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    Template("epl", "The accompanying program is provided under the terms of this Eclipse Public License (Agreement). Any use, reproduction or distribution of the program constitutes recipient's acceptance of this agreement"),
    Template("cc0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    Template("cc-by-nd", "This work is licensed under a Creative Commons Attribution NoDerivatives 4.0 International License"),
    Template("wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed"),
    Template("ofl", "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ"),
    Template("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
)


def gram_hash(words: list[str]) -> int:
    """``xxhash64(w1, w2, ...)`` as the SQL function computes it: each word hashed with the last hash as seed."""
    seed = 42
    for word in words:
        seed = xxhash.xxh64_intdigest(word.encode(), seed=seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def template_grams(templates: tuple[Template, ...]) -> list[tuple]:
    """One row per template k-gram: a table whose size depends on the templates alone."""
    rows = []
    for tid, t in enumerate(templates):
        words, total = t.words, len(t.words) - t.k + 1
        if total < 1:
            raise ValueError(f"template needs at least {t.k} words: {t.text!r}")
        for at in range(total):
            gram = words[at : at + t.k]
            rows.append((tid, t.label, t.phrase, len(words), total, t.k, at, gram_hash(gram), " ".join(gram)))
    return rows


GRAM_SCHEMA = "tid int, label string, phrase boolean, n_template int, n_grams int, k int, at int, gram_hash long, gram string"


def _window(votes: Column, first: Column) -> Column:
    """What some diagonals hold together; larger is better."""
    return F.struct(
        F.size(F.array_distinct(F.flatten(F.transform(votes, lambda v: v["seen"])))).alias("held"),
        (-first).alias("order"),
        F.array_min(F.transform(votes, lambda v: v["lo"])).alias("lo"),
        F.array_max(F.transform(votes, lambda v: v["hi"])).alias("hi"),
    )


def _too_long(votes: str) -> Column:
    reach = F.array_max(F.transform(votes, lambda v: v["hi"])) - F.array_min(F.transform(votes, lambda v: v["lo"])) + 1
    return ~F.col("phrase") & (reach > STRETCH * F.col("n_template"))


def _windows(votes: str) -> Column:
    """From every diagonal as far as a span may drift: one candidate span each."""
    drift = F.floor((STRETCH - 1) * F.col("n_template"))
    within = lambda v: F.filter(votes, lambda w: (w["diagonal"] >= v["diagonal"]) & (w["diagonal"] <= v["diagonal"] + drift))
    return F.transform(votes, lambda v: _window(within(v), v["diagonal"]))


def spans(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Verified licence spans of every document.

    Returns ``keep`` + ``_row, n_words, label, phrase, first_word, last_word, coverage``; a document without a span has
    one row whose label is null.
    """
    spark: SparkSession = docs.sparkSession
    keep = tuple(map(quoted, keep))
    grams = template_grams(templates)
    table = spark.createDataFrame(grams, GRAM_SCHEMA)
    table = F.broadcast(table) if len(grams) <= BROADCAST_GRAMS else table

    def held(words, k):
        wanted = sorted({g[7] for g in grams if g[5] == k})
        return lambda i: F.xxhash64(*[words[i + j] for j in range(k)]).isin(wanted)

    def gram(words, k):
        return lambda i: F.struct(
            F.lit(k).alias("k"),
            i.alias("pos"),
            F.xxhash64(*[words[i + j] for j in range(k)]).alias("gram_hash"),
            F.array_join(F.slice(words, i + 1, F.lit(k)), " ").alias("gram"),
        )

    def hits(words):
        """Places of k-grams whose hash a template holds. The word list is bound once, not split again per place."""
        found = []
        for k in sorted({t.k for t in templates}):
            places = F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(F.array().cast("array<int>"))
            found.append(F.transform(F.filter(places, held(words, k)), gram(words, k)))
        return F.struct(F.size(words).alias("n_words"), F.concat(*found).alias("hits"))

    words = F.regexp_extract_all(F.translate(F.coalesce(named(text), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))
    read = docs.select(*keep, F.monotonically_increasing_id().alias("_row"), F.transform(F.array(words), hits)[0].alias("_h"))
    voted = (
        read.select(*keep, "_row", F.col("_h.n_words").alias("n_words"), F.explode_outer("_h.hits").alias("hit"))
        .select(*keep, "_row", "n_words", "hit.*")
        .join(table, ["k", "gram_hash", "gram"], "left")
        .groupBy(*keep, "_row", "n_words", "tid", "label", "phrase", "n_template", "n_grams", "k", (F.col("pos") - F.col("at")).alias("diagonal"))
        .agg(F.count(F.lit(1)).alias("votes"), F.collect_set("at").alias("seen"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    )
    # merge neighbouring diagonals of long templates; a phrase has to lie on one diagonal
    by_place = Window.partitionBy("_row", "tid").orderBy("diagonal")
    apart = F.col("phrase") | (F.col("diagonal") - F.lag("diagonal").over(by_place) > DIAGONAL_GAP)
    merged = (
        voted.withColumn("_new", F.when(apart, 1).otherwise(0))
        .withColumn("_span", F.sum("_new").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keep, "_row", "n_words", "tid", "label", "phrase", "n_template", "n_grams", "_span")
        .agg(F.sort_array(F.collect_list(F.struct("diagonal", "seen", "lo", (F.col("hi") + F.col("k") - 1).alias("hi")))).alias("votes"))
        .withColumn("best", F.when(_too_long("votes"), F.array_max(_windows("votes"))).otherwise(_window(F.col("votes"), F.lit(0))))
        .select(
            *keep, "_row", "n_words", "tid", "label", "phrase", "n_template", "n_grams",
            "best.held", F.col("best.lo").alias("first_word"), F.col("best.hi").alias("last_word"),
        )
        .withColumn("coverage", F.col("held") / F.col("n_grams"))
    )
    whole = F.col("held") == F.col("n_grams")
    close = (F.col("coverage") >= COVERAGE) & (F.col("last_word") - F.col("first_word") + 1 <= STRETCH * F.col("n_template"))
    verified = F.col("tid").isNotNull() & F.when(F.col("phrase"), whole).otherwise(close)
    return merged.select(
        *keep,
        "_row",
        "n_words",
        *[F.when(verified, F.col(c)).alias(c) for c in ("label", "phrase", "first_word", "last_word", "coverage")],
    )


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row per document with its licence labels; ``first_word``/``last_word`` are starts of base phrases."""
    base, names = F.col("phrase"), tuple(map(quoted, keep))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return (
        spans(docs, text, keep, templates)
        .groupBy("_row", *names, "n_words")
        .agg(
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("first_word"))).cast("long").alias("first_word"),
            F.max(F.when(base, F.col("first_word"))).cast("long").alias("last_word"),
            joined(F.when(base, F.col("label"))).alias("base_labels"),
            joined("label").alias("labels"),
            F.coalesce(F.max("coverage"), F.lit(0.0)).alias("score"),
        )
        .withColumn("n_words", F.col("n_words").cast("long"))
        .drop("_row")
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    rows = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v).upper() for v in (*g[:7], g[8])) + ")" for g in template_grams(TEMPLATES))
    return rf"""
WITH t(tid, label, phrase, n_template, n_grams, k, tpos, gram) AS (VALUES {rows}),
d AS (SELECT doc_id, row_number() OVER () AS rid,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w
      FROM documents),
p AS (SELECT rid, unnest(range(len(w))) AS pos, unnest(w) AS w1 FROM d),
q AS (SELECT rid, pos, w1, lead(w1, 1) OVER s AS w2, lead(w1, 2) OVER s AS w3, lead(w1, 3) OVER s AS w4
      FROM p WINDOW s AS (PARTITION BY rid ORDER BY pos)),
g AS (SELECT rid, pos, 2 AS k, w1 || ' ' || w2 AS gram FROM q WHERE w2 IS NOT NULL
      UNION ALL SELECT rid, pos, {TEXT_K}, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM q WHERE w4 IS NOT NULL),
v AS (SELECT rid, tid, label, phrase, n_template, n_grams, t.k, pos - tpos AS diagonal, pos, tpos
      FROM g JOIN t ON g.k = t.k AND g.gram = t.gram),
o AS (SELECT DISTINCT rid, tid, phrase, diagonal FROM v),
m AS (SELECT rid, tid, diagonal,
             CASE WHEN phrase OR diagonal - lag(diagonal) OVER (PARTITION BY rid, tid ORDER BY diagonal) > {DIAGONAL_GAP} THEN 1 ELSE 0 END AS apart
      FROM o),
n AS (SELECT rid, tid, diagonal, sum(apart) OVER (PARTITION BY rid, tid ORDER BY diagonal) AS span FROM m),
vn AS (SELECT v.*, span FROM v JOIN n ON v.rid = n.rid AND v.tid = n.tid AND v.diagonal = n.diagonal),
s0 AS (SELECT rid, tid, label, phrase, n_template, n_grams, span, count(DISTINCT tpos) AS held, min(pos) AS first_word, max(pos + k - 1) AS last_word FROM vn GROUP BY ALL),
chain AS (SELECT * FROM s0 WHERE NOT phrase AND last_word - first_word + 1 > {STRETCH} * n_template),
anchors AS (SELECT DISTINCT vn.rid, vn.tid, vn.span, vn.diagonal AS anchor FROM vn JOIN chain USING (rid, tid, span)),
win AS (SELECT vn.rid, vn.tid, label, phrase, n_template, n_grams, vn.span, anchor, count(DISTINCT tpos) AS held, min(pos) AS first_word, max(pos + k - 1) AS last_word
      FROM anchors a JOIN vn ON vn.rid = a.rid AND vn.tid = a.tid AND vn.span = a.span AND vn.diagonal BETWEEN anchor AND anchor + floor({STRETCH - 1} * n_template) GROUP BY ALL),
s AS (SELECT * EXCLUDE (anchor) FROM win QUALIFY row_number() OVER (PARTITION BY rid, tid, span ORDER BY held DESC, anchor) = 1
      UNION ALL SELECT * FROM s0 WHERE NOT (NOT phrase AND last_word - first_word + 1 > {STRETCH} * n_template)),
f AS (SELECT *, held / n_grams AS coverage FROM s
      WHERE CASE WHEN phrase THEN held = n_grams ELSE held / n_grams >= {COVERAGE} AND last_word - first_word + 1 <= {STRETCH} * n_template END),
r AS (SELECT rid, count(*) FILTER (WHERE phrase) AS n_base, min(first_word) FILTER (WHERE phrase) AS first_word,
             max(first_word) FILTER (WHERE phrase) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE phrase) AS base_labels,
             string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score
      FROM f GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN r USING (rid)
"""


QUERIES = {"op1_license_scan": op1_license_scan}
ORACLES = {"op1_license_scan": _oracle()}
