"""Licence scans, in DataFrame functions only: Dice coefficient of word bigrams against licence templates.

A text is compared as a whole, by paragraphs and by lines. Each of these passages is normalised and becomes its set of word bigrams.
A template of b bigrams can reach a Dice coefficient of t only with passages of b*t/(2-t) to b*(2-t)/t bigrams, so a passage meets the
templates that admit its size, by an equality of sizes against a small fixed table, and no others. Before that, texts and passages
without any of a few words that every match must hold (``anchors``) are left aside; no match is lost by this.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm import common

THRESHOLD = 0.75
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARKS = r"[^\p{L}\p{N}]+"

#: Public licence notices, by identifier. Fixed values.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)


def _normal(text: Column) -> Column:
    """Words in lower case (A-Z alone), all marks gone."""
    return F.filter(F.split(F.translate(text, UPPER, LOWER), MARKS), lambda w: w != "")


def sizes(b: int, threshold: float) -> tuple[int, int]:
    """Least and largest number of bigrams with which a passage can reach ``threshold`` against a template of ``b``."""
    return max(1, math.ceil(b * threshold / (2 - threshold) - 1e-9)), math.floor(b * (2 - threshold) / threshold + 1e-9)


@functools.cache
def anchors(threshold: float) -> tuple[str, ...]:
    """Words of which every passage that reaches ``threshold`` against any template holds at least one.

    A match shares at least ``sizes(b, threshold)[0]`` of a template's b bigrams. So many words are chosen that fewer than that are left
    without a chosen word, in each template: words of six letters and more first, those in most bigrams before others; of shorter ones
    that number squared counts against the templates that hold the word, which keeps articles and prepositions out.
    """
    left, common_in = [], Counter()
    for _, text in TEMPLATES:
        words = re.findall("[a-z0-9]+", text.translate(str.maketrans(UPPER, LOWER)))
        pairs = set(zip(words[:-1], words[1:], strict=True))
        left.append((pairs, sizes(len(pairs), threshold)[0]))
        common_in.update(set(words))
    chosen: list[str] = []
    while left := [(pairs, least) for pairs, least in left if len(pairs) >= least]:
        score: dict[str, float] = {}
        for pairs, least in left:
            for pair in pairs:
                for word in set(pair):
                    score[word] = score.get(word, 0) + 1 / (len(pairs) - least + 1)
        chosen.append(max(score, key=lambda w: (len(w) >= 6, round(score[w] if len(w) >= 6 else score[w] ** 2 / common_in[w], 9), w)))
        left = [({p for p in pairs if chosen[-1] not in p}, least) for pairs, least in left]
    return tuple(chosen)


def _may_match(lowered: Column, threshold: float) -> Column:
    """Whether a text in lower case holds an anchor; long ones also count inside a word, which is cheaper and lets a little more pass."""
    words = anchors(threshold)
    long = [w for w in words if len(w) >= 6 and not any(len(v) >= 6 and v != w and v in w for v in words)]
    short = "|".join(w for w in words if len(w) < 6)
    inside = F.exists(F.array(*map(F.lit, long)), lambda w: lowered.contains(w))
    return inside | lowered.rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{short})(?![\p{{L}}\p{{N}}])") if short else inside


def _bigrams(rows: DataFrame, words: str, name: str) -> DataFrame:
    w = F.col(words)
    return rows.withColumn(name, common.held(F.when(F.size(w) > 1, F.array_distinct(F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1)))))))


def templates(spark: SparkSession, threshold: float) -> DataFrame:
    """(license, t_bigrams, b, a): each template once for each size a of passage that it admits."""
    rows = spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(TEMPLATES)], "template int, license string, t_text string")
    rows = _bigrams(rows.withColumn("t_words", common.held(_normal(F.col("t_text")))), "t_words", "t_bigrams").withColumn("b", F.size("t_bigrams"))
    low, high = F.ceil(F.col("b") * threshold / (2 - threshold) - 1e-9), F.floor(F.col("b") * (2 - threshold) / threshold + 1e-9)
    return rows.withColumn("a", F.explode(F.sequence(F.greatest(low.cast("int"), F.lit(1)), high.cast("int")))).select("template", "license", "t_bigrams", "b", "a")


def hits(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(columns of ``docs`` but text, passage, license, dice): each passage that reaches ``threshold``, with its best template; of
    equal ones the licence first in the alphabet. A passage that a row holds twice counts once."""
    text = F.col("text").cast("string")
    paragraphs = F.split(text, r"\n[ \t\r]*\n\s*")
    lines = F.split(text, r"\n")
    others = [c for c in docs.columns if c != "text"]
    whole = docs.where("text is not null").select(*others, text.alias("text"), common.held(F.lower(text)).alias("lowered")).where(_may_match(F.col("lowered"), threshold))
    cut = whole.select(*others, "text", paragraphs.alias("paragraphs"), lines.alias("lines"))
    passages = F.concat(F.array("text"), F.when(F.size("paragraphs") > 1, F.col("paragraphs")).otherwise(F.array().cast("array<string>")), F.when(F.size("lines") > F.size("paragraphs"), F.col("lines")).otherwise(F.array().cast("array<string>")))
    rows = cut.select(*others, F.explode(passages).alias("passage")).withColumn("lowered", common.held(F.lower("passage"))).where(_may_match(F.col("lowered"), threshold)).drop("lowered")
    rows = rows.withColumn("words", common.held(_normal(F.col("passage"))))
    least = min(sizes(len(set(zip(t.split()[:-1], t.split()[1:], strict=True))) or 1, threshold)[0] for _, t in TEMPLATES)
    rows = _bigrams(rows.where(F.size("words") > min(least, 2)), "words", "bigrams").withColumn("a", F.size("bigrams"))
    met = rows.join(F.broadcast(templates(docs.sparkSession, threshold)), "a")
    met = met.withColumn("dice", F.lit(2.0) * F.size(F.array_intersect("bigrams", "t_bigrams")) / (F.col("a") + F.col("b"))).where(F.col("dice") >= threshold)
    best = F.min(F.struct((-F.col("dice")).alias("dice"), "license")).alias("best")
    return met.groupBy(*others, "passage").agg(best).select(*others, "passage", "best.license", (-F.col("best.dice")).alias("dice"))


def scanned(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_licenses, licenses, dice), one row for each row of ``docs(doc_id, text)``.

    licenses lists the licences that any passage of the row's doc_id reaches, in alphabetical order and joined with commas; dice is
    the best coefficient to six digits, 0 without any. Null and empty texts and passages of fewer than two words match nothing. Rows
    that share a doc_id share its licences; a null doc_id counts as one value. Only doc_id and text are read.
    """
    ids = F.col("doc_id").cast("long")
    found = hits(docs.select(ids.alias("doc_id"), "text"), threshold)
    told = found.groupBy(F.col("doc_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"), F.max("dice").alias("dice"), F.count_distinct("license").alias("n"))
    out = docs.select(ids.alias("doc_id")).join(told, F.col("doc_id").eqNullSafe(F.col("id")), "left")
    return out.select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_licenses"), F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce(F.round("dice", 6), F.lit(0.0)).alias("dice"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql(threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for ``scanned``: every passage against every template whose size it admits, written out as plain joins."""
    values = ", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in TEMPLATES)
    normal = lambda x: f"list_filter(regexp_split_to_array(translate({x}, '{UPPER}', '{LOWER}'), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    pairs = lambda w: f"list_distinct(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"
    return rf"""
WITH t0 AS (SELECT license, {normal("t")} AS w FROM (VALUES {values}) v(license, t)), t AS (SELECT license, {pairs("w")} AS tb FROM t0),
cut AS (SELECT doc_id, text, regexp_split_to_array(text, '\n[ \t\r]*\n\s*') AS paragraphs, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
p0 AS (SELECT doc_id, unnest([text] || (CASE WHEN len(paragraphs) > 1 THEN paragraphs ELSE [] END) || (CASE WHEN len(lines) > len(paragraphs) THEN lines ELSE [] END)) AS passage FROM cut),
p1 AS (SELECT doc_id, passage, {normal("passage")} AS w FROM p0), p AS (SELECT doc_id, passage, {pairs("w")} AS pb FROM p1 WHERE len(w) > 1),
met AS (SELECT doc_id, passage, license, 2.0 * len(list_intersect(pb, tb)) / (len(pb) + len(tb)) AS dice FROM p JOIN t ON len(pb) <= len(tb) * (2 - {threshold}) / {threshold} + 1e-9 AND len(pb) >= len(tb) * {threshold} / (2 - {threshold}) - 1e-9),
best AS (SELECT doc_id, license, dice, row_number() OVER (PARTITION BY doc_id, passage ORDER BY dice DESC, license) AS place FROM met WHERE dice >= {threshold}),
told AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, max(dice) AS dice, count(DISTINCT license) AS n FROM best WHERE place = 1 GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_licenses, coalesce(licenses, '') AS licenses, CAST(coalesce(round(dice, 6), 0.0) AS DOUBLE) AS dice FROM documents d LEFT JOIN told ON d.doc_id IS NOT DISTINCT FROM told.doc_id
"""
