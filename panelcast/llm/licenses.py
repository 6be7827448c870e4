"""License scans in native DataFrame operations: sparse TF-IDF cosine to templates, then inheritance by directory.

Each sentence of a file is compared with template sentences. A sentence without any of the anchor terms cannot reach the
threshold (by Cauchy-Schwarz, as the other terms of every template weigh too little), so text is first filtered by
anchors; this loses nothing.

Headers and licence files are compared as blocks of words, wherever their lines break: a run of as many words as a known
text has, placed by any anchor the two share, with weights from counts over all files. SPDX lines are read as they are.
A file whose statements make up most of its words, or whose name says so, is a licence file
of its directory; files without a statement of their own take the licence of the nearest ancestor directory that has one.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm import common
from panelcast.llm.license_texts import BLOCKS, SPDX
from panelcast.sources.staging import stage

# Sentences by which licences are declared.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
# Words of ordinary prose, which are anchors only if a template cannot do without.
COMMON = {"a", "all", "and", "any", "are", "by", "following", "for", "form", "has", "in", "into", "is", "met", "of", "or", "person", "provided", "that", "the", "this", "to", "use", "with", "without", "work"}
TERM = "[a-z0-9]+(?:[.+-][a-z0-9]+)*"
FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)[^/]*$"
THRESHOLD, FILE_SHARE = 0.75, 0.5
#: Share of a known text's distinct words that a block must have, whatever their weights.
COVERAGE = 0.6
#: Words of a text from which a known text makes a whole notice, and words cut off at a time.
WHOLE, SEGMENT = 30, 512
#: More than twice the places where a block of a segment can start.
SPOTS = 1 << 13
SPDX_LINE = r"(?i)spdx-license-identifier:[ \t]*\(?([a-z0-9][a-z0-9.+-]*(?:[ \t]+(?:or|and|with)[ \t]+[a-z0-9][a-z0-9.+-]*)*)"
#: Which statements count first: SPDX lines, whole notices, sentences.
BY_SPDX, BY_NOTICE, BY_SENTENCE = 0, 1, 2


def template_weights(templates: list[tuple[str, str]] = TEMPLATES) -> tuple[list[tuple[int, str, float]], dict[str, float], float]:
    """((template, term, unit weight), idf by term, idf of any other term) of the templates, which are a constant list."""
    counts = [{t: 0 for t in re.findall(TERM, text.lower())} for _, text in templates]
    for own, (_, text) in zip(counts, templates, strict=True):
        for t in re.findall(TERM, text.lower()):
            own[t] += 1
    n = len(templates)
    idf = {t: math.log((1 + n) / (1 + sum(t in own for own in counts))) + 1 for own in counts for t in own}
    rows = []
    for i, own in enumerate(counts):
        norm = math.sqrt(sum((k * idf[t]) ** 2 for t, k in own.items()))
        rows += [(i, t, k * idf[t] / norm) for t, k in own.items()]
    return rows, idf, math.log(1 + n) + 1


def anchors(threshold: float = THRESHOLD, templates: list[tuple[str, str]] = TEMPLATES) -> list[str]:
    """Terms of which every sentence within the threshold of a template has at least one."""
    rows, idf, _ = template_weights(templates)
    return anchor_terms(rows, idf, len(templates), threshold)


def anchor_terms(rows: list[tuple[int, str, float]], idf: dict[str, float], n: int, threshold: float) -> list[str]:
    """Terms without which the others of each of ``n`` unit vectors weigh less than the threshold."""
    chosen: set[str] = set()
    while True:
        missing = {i: sum(w * w for j, t, w in rows if j == i and t not in chosen) for i in range(n)}
        missing = {i: x for i, x in missing.items() if x >= threshold**2 * (1 - 1e-9)}
        if not missing:
            return sorted(chosen)
        gain: dict[str, float] = {}
        for j, t, w in rows:
            if j in missing and t not in chosen:
                gain[t] = gain.get(t, 0.0) + w * w * idf[t]  # rare terms let less text through
        chosen.add(max(sorted(gain), key=lambda t: (t not in COMMON and len(t) > 1, gain[t])))


def statements(files: DataFrame, threshold: float = THRESHOLD, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(id, row, total, sentence, words, license, score): sentences of (id, text) that declare a licence.

    ``row`` tells apart texts of one id, ``total`` counts the words of the text; equal rows are one.
    """
    spark = files.sparkSession
    rows, idf, other = template_weights(templates)
    weights = spark.createDataFrame(rows, "template int, term string, weight double")
    terms = spark.createDataFrame(sorted(idf.items()), "term string, idf double")
    names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(templates)], "template int, license string")
    any_anchor = "(?:^|[^a-z0-9])(?:" + "|".join(map(re.escape, anchors(threshold, templates))) + ")(?:$|[^a-z0-9])"
    told = files.select("id", F.lower("text").alias("text"), F.xxhash64("text").alias("row")).filter(F.col("text").rlike(any_anchor))
    told = told.dropDuplicates(["id", "row"]).withColumn("total", F.size(F.regexp_extract_all("text", F.lit(TERM), F.lit(0))))
    cut = F.split(F.regexp_replace("text", "([.!?;])[ \t\r\n]+", "$1\n"), "\n")
    sentences = told.select("id", "row", "total", F.posexplode(cut).alias("sentence", "said")).filter(F.col("said").rlike(any_anchor))
    counted = sentences.select("id", "row", "total", "sentence", F.explode(F.regexp_extract_all("said", F.lit(TERM), F.lit(0))).alias("term"))
    key = ["id", "row", "total", "sentence"]
    counted = stage(counted.groupBy(*key, "term").agg(F.count("*").alias("n")), "sentence-terms")  # read three times
    norms = counted.join(terms, "term", "left").groupBy(*key).agg(F.sqrt(F.sum((F.col("n") * F.coalesce("idf", F.lit(other))) ** 2)).alias("norm"), F.sum("n").alias("words"))
    own = counted.join(terms, "term").join(weights, "term")
    dots = own.groupBy(*key, "template").agg(F.sum(F.col("n") * F.col("idf") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, key).join(names, "template").select(*key, "words", "license", F.round(F.col("dot") / F.col("norm"), 9).alias("score"))
    best = scored.filter(F.col("score") >= threshold).groupBy(*key, "words").agg(F.min(F.struct((-F.col("score")).alias("score"), "license")).alias("best"))
    return best.select(*key, "words", F.col("best.license").alias("license"), (-F.col("best.score")).alias("score"))


def block_weights(files: DataFrame) -> tuple[list[tuple[int, str, float]], dict[str, float], float]:
    """As ``template_weights`` of the known texts, with the idf of their terms from counts over all (id, text) rows.

    Words of no known text weigh as much as the mean of theirs, so that the size of a table does not decide about them.
    """
    texts = [re.findall(TERM, text.lower()) for _, _, text in BLOCKS]
    vocabulary = sorted({t for own in texts for t in own})
    held = F.array_intersect(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(TERM), F.lit(0)), F.lit(vocabulary))
    counts = files.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("term")).groupBy("term").count()
    seen = dict(map(tuple, counts.collect()))  # at most a row per word of the known texts, and one for all files
    n = seen.get("", 0)
    idf = {t: math.log((1 + n) / (1 + seen.get(t, 0))) + 1 for t in vocabulary}
    rows = []
    for i, own in enumerate(texts):
        norm = math.sqrt(sum((own.count(t) * idf[t]) ** 2 for t in set(own)))
        rows += [(i, t, own.count(t) * idf[t] / norm) for t in sorted(set(own))]
    return rows, idf, sum(idf.values()) / len(idf)


def notices(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, row, total, words, license, score, kind): blocks of (id, text) that a known text matches, and SPDX lines.

    A block starts where a shared anchor puts the start of the known text, to a 64th of its length. Texts are cut
    into overlapping segments, each with the blocks that start in it, so no text is held more than twice.
    """
    spark = files.sparkSession
    rows, idf, other = block_weights(files)
    chosen = anchor_terms(rows, idf, len(BLOCKS), threshold)
    texts = [re.findall(TERM, text.lower()) for _, _, text in BLOCKS]
    longest = max(map(len, texts))
    info = [(i, name, len(own), key.split(), sorted(set(own)), math.ceil(COVERAGE * len(set(own)))) for i, ((name, key, _), own) in enumerate(zip(BLOCKS, texts, strict=True))]
    info = spark.createDataFrame(info, "template int, license string, length int, required array<string>, terms array<string>, least int")
    places: dict[str, list[tuple[int, int, int]]] = {t: [] for t in chosen}
    for i, own in enumerate(texts):
        for q, t in enumerate(own):
            if t in places:
                places[t].append((i, q, max(1, len(own) // 64)))
    spots = [F.array(*(F.struct(F.lit(i).alias("template"), F.lit(q).alias("q"), F.lit(g).alias("grid")) for i, q, g in places[t])) for t in chosen]
    of_term = F.map_from_arrays(F.lit(chosen), F.array(*spots))
    any_anchor = "(?:^|[^a-z0-9])(?:" + "|".join(map(re.escape, chosen)) + ")(?:$|[^a-z0-9])"
    lower = files.select("id", "text", F.lower("text").alias("lower"), F.xxhash64("text").alias("row"))
    words = F.regexp_extract_all("lower", F.lit(TERM), F.lit(0))
    told = lower.filter(F.col("lower").rlike(any_anchor)).drop("text").dropDuplicates(["id", "row"]).select("id", "row", words.alias("said"))
    told = told.withColumn("total", F.size("said"))
    cut = F.transform(F.sequence(F.lit(0), F.greatest("total", F.lit(1)) - 1, F.lit(SEGMENT)), lambda at: F.struct(at.alias("at"), F.slice("said", at + 1, SEGMENT + longest).alias("said")))
    parts = told.select("id", "row", "total", F.explode(cut).alias("part")).select("id", "row", "total", "part.*")

    def starts(term, p):
        def start(spot):  # a block that would start before the text starts with it
            first = F.when(F.col("at") == 0, F.greatest(p - spot["q"], F.lit(0))).otherwise(p - spot["q"])
            return (spot["template"] * SPOTS + F.floor(first / spot["grid"]).cast("int") * spot["grid"]).cast("long")  # numbers, as equal structs are slow to find

        return F.transform(F.coalesce(F.try_element_at(of_term, term), F.array().cast("array<struct<template:int,q:int,grid:int>>")), start)

    found = F.array_distinct(F.flatten(F.transform("said", starts)))
    blocks = parts.select("id", "row", "total", "at", "said", F.explode(found).alias("b"))
    blocks = blocks.withColumn("template", F.round(F.col("b") / SPOTS).cast("int")).withColumn("start", (F.col("b") - F.col("template") * SPOTS).cast("int")).filter(F.col("start").between(0, SEGMENT - 1))
    blocks = blocks.join(F.broadcast(info), "template").withColumn("block", F.slice("said", F.col("start") + 1, F.col("length")))
    blocks = blocks.filter((F.size(F.array_except("required", "block")) == 0) & (F.size(F.array_intersect("terms", "block")) >= F.col("least")))
    key = ["id", "row", "total", "template", "license", "start"]
    counted = blocks.select("id", "row", "total", "template", "license", (F.col("at") + F.col("start")).alias("start"), F.explode("block").alias("term")).groupBy(*key, "term").agg(F.count("*").alias("n"))
    weights = spark.createDataFrame(rows, "template int, term string, weight double")
    terms = spark.createDataFrame(sorted(idf.items()), "term string, idf double")
    part = F.col("n") * F.coalesce("idf", F.lit(other))
    scored = counted.join(terms, "term", "left").join(weights, ["template", "term"], "left").groupBy(*key).agg((F.sum(part * F.coalesce("weight", F.lit(0.0))) / F.sqrt(F.sum(part**2))).alias("score"), F.sum("n").alias("words"))
    kind = F.when(F.col("words") >= WHOLE, BY_NOTICE).otherwise(BY_SENTENCE).alias("kind")
    scored = scored.withColumn("score", F.round("score", 9)).filter(F.col("score") >= threshold).select("id", "row", "total", "words", "license", "score", kind)
    marked = lower.filter(F.col("lower").contains("spdx-license-identifier")).dropDuplicates(["id", "row"])  # few texts, so apart from the others
    lines = marked.select("id", "row", F.size(words).alias("total"), F.explode(F.regexp_extract_all("text", F.lit(SPDX_LINE), F.lit(1))).alias("said"))
    known = F.create_map(*(F.lit(x) for pair in SPDX.items() for x in pair))
    lines = lines.select("id", "row", "total", F.lit(2).cast("long").alias("words"), F.coalesce(F.try_element_at(known, F.lower("said")), "said").alias("license"), F.lit(1.0).alias("score"), F.lit(BY_SPDX).alias("kind"))
    return scored.unionByName(lines)


def parent(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, path, license, score, evidence, licensed_by) of each file row.

    ``evidence`` is file or header for a statement of its own, inherited, or none; ``licensed_by`` is the directory whose
    licence applies. Of several statements SPDX lines count before notices and these before sentences, then
    the closest, then the first licence by name. Null and empty texts state
    nothing and inherit; a null path is the root. Rows that repeat an id share their statements.
    """
    rows = files.select(common.id_key(files[id_col]).alias("id"), F.coalesce(files[path_col], F.lit("")).alias("path"), files[text_col].alias("text"))
    found = stage(statements(rows.select("id", "text"), threshold), "statements")
    told = stage(notices(rows.select("id", "text"), threshold), "notices")
    found = found.select("id", "row", "total", "words", "license", "score", F.lit(BY_SENTENCE).alias("kind"), F.lit(True).alias("apart"))
    found = found.unionByName(told.withColumn("apart", F.lit(False)))  # notices can overlap each other and sentences
    closest = F.min(F.struct("kind", (-F.col("score")).alias("score"), "license")).alias("best")
    stated = F.greatest(F.sum(F.when(F.col("apart"), F.col("words"))), F.max(F.when(~F.col("apart"), F.col("words"))))
    texts = found.groupBy("id", "row", "total").agg(closest, stated.alias("stated"))
    own = texts.groupBy("id").agg(F.min("best").alias("best"), F.sum("stated").alias("stated"), F.sum("total").alias("total"))
    own = own.select("id", F.col("best.license").alias("own"), (-F.col("best.score")).alias("own_score"), "stated", "total")
    narrow = rows.select("id", "path", parent(F.col("path")).alias("dir"))
    placed = narrow.join(own, "id", "left")
    is_file = F.col("own").isNotNull() & (F.col("path").rlike(FILE_NAME) | (F.col("stated") >= FILE_SHARE * F.col("total")))
    placed = placed.withColumn("is_file", is_file)
    licensed = placed.filter("is_file").groupBy("dir").agg(F.min(F.struct((-F.col("own_score")).alias("score"), F.col("own").alias("license"))).alias("best"))
    licensed = licensed.select(F.col("dir").alias("above"), F.col("best.license").alias("given"), (-F.col("best.score")).alias("given_score"))
    steps = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
    lines = narrow.select("dir").distinct().select("dir", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), above))).alias("above"))
    nearest = lines.join(licensed, "above").groupBy("dir").agg(F.max(F.struct(F.length("above").alias("depth"), "above", "given", "given_score")).alias("near"))
    nearest = nearest.select("dir", F.col("near.above").alias("above"), F.col("near.given").alias("given"), F.col("near.given_score").alias("given_score"))
    out = placed.join(nearest, "dir", "left")
    evidence = F.when(F.col("is_file"), "file").when(F.col("own").isNotNull(), "header").when(F.col("given").isNotNull(), "inherited").otherwise("none")
    return out.select(
        common.public_id(F.col("id")).alias("doc_id"), "path", F.coalesce("own", "given").alias("license"), F.round(F.coalesce("own_score", "given_score"), 6).alias("score"),
        evidence.alias("evidence"), F.when(evidence == "file", F.col("dir")).when(evidence == "inherited", F.col("above")).alias("licensed_by"),
    )


def scan_sql(table: str, path_sql: str, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL of ``scan`` over whole texts, without the anchor filter."""
    rows, idf, other = template_weights()
    weights = ", ".join(f"({i}, '{TEMPLATES[i][0]}', '{t}', {idf[t]!r}::DOUBLE, {w!r}::DOUBLE)" for i, t, w in rows)
    return f"""
WITH weights(template, license, term, idf, weight) AS (VALUES {weights}),
files AS (SELECT doc_id AS id, {path_sql} AS path, text FROM {table}),
placed0 AS (SELECT id, path, text, CASE WHEN instr(path, '/') > 0 THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir FROM files),
cut AS (SELECT id, string_split(regexp_replace(lower(text), '([.!?;])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), chr(10)) AS said FROM files),
sentences AS (SELECT id, unnest(range(len(said))) AS sentence, unnest(said) AS said FROM cut),
words AS (SELECT id, sentence, unnest(regexp_extract_all(said, '{TERM}')) AS term FROM sentences),
counted AS (SELECT id, sentence, term, count(*) AS n FROM words GROUP BY ALL),
terms AS (SELECT DISTINCT term, idf FROM weights),
norms AS (SELECT id, sentence, sqrt(sum(pow(n * coalesce(idf, {other!r}::DOUBLE), 2))) AS norm, sum(n) AS words FROM counted LEFT JOIN terms USING (term) GROUP BY ALL),
dots AS (SELECT id, sentence, template, license, sum(n * idf * weight) AS dot FROM counted JOIN weights USING (term) GROUP BY ALL),
scored AS (SELECT id, sentence, words, license, round(dot / norm, 9) AS score FROM dots JOIN norms USING (id, sentence) WHERE round(dot / norm, 9) >= {threshold}),
best AS (SELECT id, sentence, words, license, score FROM scored QUALIFY row_number() OVER (PARTITION BY id, sentence ORDER BY score DESC, license) = 1),
own AS (SELECT id, first(license ORDER BY score DESC, license) AS own, max(score) AS own_score, sum(words) AS stated FROM best GROUP BY id),
sized AS (SELECT id, sum(len(regexp_extract_all(lower(text), '{TERM}'))) AS total FROM files GROUP BY id),
placed AS (
  SELECT p.id, p.path, p.dir, o.own, o.own_score,
    o.own IS NOT NULL AND (regexp_matches(p.path, '{FILE_NAME}') OR o.stated >= {FILE_SHARE} * s.total) AS is_file
  FROM placed0 p LEFT JOIN own o USING (id) LEFT JOIN sized s USING (id)),
licensed AS (SELECT dir AS above, first(own ORDER BY own_score DESC, own) AS given, max(own_score) AS given_score FROM placed WHERE is_file GROUP BY dir),
nearest AS (
  SELECT d.dir, l.above, l.given, l.given_score
  FROM (SELECT DISTINCT dir FROM placed0) d JOIN licensed l ON l.above = '' OR l.above = d.dir OR starts_with(d.dir, l.above || '/')
  QUALIFY row_number() OVER (PARTITION BY d.dir ORDER BY length(l.above) DESC) = 1)
SELECT p.id AS doc_id, p.path, coalesce(p.own, n.given) AS license, round(coalesce(p.own_score, n.given_score), 6) AS score,
  CASE WHEN p.is_file THEN 'file' WHEN p.own IS NOT NULL THEN 'header' WHEN n.given IS NOT NULL THEN 'inherited' ELSE 'none' END AS evidence,
  CASE WHEN p.is_file THEN p.dir WHEN p.own IS NULL THEN n.above END AS licensed_by
FROM placed p LEFT JOIN nearest n USING (dir)"""
