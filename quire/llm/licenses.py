"""License scans by sparse TF-IDF cosine and directory inheritance (operator 8), DataFrame functions only.

Every line of every file is compared with short notices of known licences:
weights are ``1 + ln tf`` times an inverse document frequency that is counted,
for the notices' terms, over all documents; terms outside the notices weigh as
if no document had them.  A line that could reach the threshold must hold one of
a notice's anchor terms (the heaviest ones, such that the rest of the notice is
too light), so only lines with an anchor are taken apart; nothing is lost by it.

Headers and licence texts wrap over lines or stand inside longer ones, so the
text is also read as one run of terms, and passages of a template's length are
compared with the notices and with longer headers and texts: wherever an anchor
of a template occurs, the passage that has it in the template's place.  Passages
are cut inside their row; only distinct ones leave it.  Document frequencies are
here counted for all terms.  Titles without a version count as
whole lines, SPDX tags by the identifiers in their expressions.

A file has the licence of its best line; if it has none, or only a reservation
of rights, that of its best passage, title or tag.  Of the long licences (GPL,
Apache, MPL, CC) the header and the title are templates, not the whole text.  A licence file (by its name) gives its
licence to its directory, and a file without one of its own takes that of the
nearest directory above it: distinct directories are exploded to their ancestors
and joined with the licensed ones by path, then files with their directories.

Defined cases: null or empty text has no licence of its own; a null path is in
no directory and inherits nothing; of equal cosines the licence first in the
alphabet wins; very long lines count whole; each row is judged by its own text
and path, whatever its id, which may be null or repeated, one result each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._common import keyed, materialize, read

#: (licence, notice); several notices of one licence are allowed.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work and dedicates it to the public domain"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "All rights reserved."),
)
#: The one notice that says nothing against another licence in the same file.
RESERVED = "proprietary"
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, "
    "either version {version} of the License, or (at your option) any later version."
)
#: Headers, titles with their version and whole texts, compared with passages besides the notices.
PASSAGES = (
    ("AGPL-3.0", _GNU.format(name="GNU Affero General Public License", version="3")),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("EPL-2.0", "Eclipse Public License v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE"),
    ("GPL-2.0", _GNU.format(name="GNU General Public License", version="2")),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", _GNU.format(name="GNU General Public License", version="3")),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", _GNU.format(name="GNU Lesser General Public License", version="2.1")),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", _GNU.format(name="GNU Lesser General Public License", version="3")),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
)
#: Terms of a whole line, by licence; a leading "the" is left out before.
TITLES = (
    ("Apache-2.0", "apache license"), ("BSD", "bsd license"), ("BSD", "bsd 2 clause license"), ("BSD", "bsd 3 clause license"), ("EPL-2.0", "eclipse public license v 2 0"), ("ISC", "isc license"),
    ("MIT", "mit license"), ("MIT", "mit license mit"), ("Unlicense", "unlicense"), ("Zlib", "zlib license"),
)
TITLE = "(?i)(mit|apache|bsd|clause|isc|zlib|eclipse)[^a-z0-9]+(public[^a-z0-9]+)?license|unlicense"
#: A tag's expression: identifiers with operators and brackets between them.
SPDX = r"(?i)SPDX-License-Identifier:[ \t]*([a-z0-9.+\-() \t]+)"
#: What an expression says beside licences.
SPDX_WORDS = ("or", "and", "none", "noassertion")
THRESHOLD = 0.75
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|unlicense)([.\-_].*)?$"
NOT_TERM = "[^a-z0-9]+"


def terms_of(notice: str) -> list[str]:
    return [t for t in re.split(NOT_TERM, notice.lower()) if t]


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NOT_TERM), lambda t: t != "")


def notice_weights(n_docs: int, df: dict[str, int], notices: Sequence[tuple[str, str]] = NOTICES, threshold: float = THRESHOLD) -> tuple[dict[str, float], list[tuple[int, str, str, float]], list[str]]:
    """idf by term, unit weights (notice, licence, term, weight), and the anchors."""
    idf = {t: math.log((1 + n_docs) / (1 + df.get(t, 0))) + 1 for _, notice in notices for t in terms_of(notice)}
    rows, anchors = [], set()
    for k, (name, notice) in enumerate(notices):
        raw = {t: (1 + math.log(c)) * idf[t] for t, c in Counter(terms_of(notice)).items()}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        ranked = sorted(((w / norm, t) for t, w in raw.items()), reverse=True)
        rows += [(k, name, t, w) for w, t in ranked]
        left = 1.0
        for w, t in ranked:
            if math.sqrt(max(left, 0.0)) < threshold - 1e-9:
                break
            anchors.add(t)
            left -= w * w
    return idf, rows, sorted(anchors)


ROW = ("r1", "r2")
LONGEST = 10_000  # terms of a template, below


def own_licenses(rows: DataFrame, *, text: str = "text", notices: Sequence[tuple[str, str]] = NOTICES, passages: Sequence[tuple[str, str]] = PASSAGES, threshold: float = THRESHOLD) -> DataFrame:
    """r1, r2, license, score (best cosine), found (all licences at the threshold) of rows (see ``keyed``) with one."""
    spark = rows.sparkSession
    d = rows.select(*ROW, F.coalesce(F.col("row").getField(text), F.lit("")).alias("text"))
    templates = (*notices, *passages)
    vocabulary = sorted({t for _, notice in templates for t in terms_of(notice)})
    counts = materialize(d.select(F.explode(F.array_distinct(_terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")))
    # One row a term of the templates, a few hundred at most.
    df = {r.term: r.n for r in counts.where(F.col("term").isin(vocabulary)).collect()}
    n_docs = d.count()
    idf, weights, anchors = notice_weights(n_docs, df, notices, threshold)
    pattern = f"(?i)(?<![a-z0-9])(?:{'|'.join(anchors)})(?![a-z0-9])"
    lines = d.where(F.col("text").rlike(pattern)).select(*ROW, F.explode(F.filter(F.split("text", "\n"), lambda x: x.rlike(pattern))).alias("line"))
    # Equal lines need one look: lines are keyed by their terms.
    lines = materialize(_bagged(lines.select(*ROW, F.array_join(F.sort_array(_terms(F.col("line"))), " ").alias("bag"))))
    bags = _distinct(lines)
    rare = math.log(1 + n_docs) + 1
    cosines = _cosines(bags, spark.createDataFrame(sorted(idf.items()), "term string, idf double"), rare, weights, threshold)
    # The order of (-score, license): best first, ties by name.
    matched = lines.select(*ROW, *BAG).join(cosines, [*BAG]).select(*ROW, "license", "score").distinct()
    other = materialize(_passages(d, templates, counts, n_docs, df, threshold).unionByName(_named(d)))
    every = matched.withColumn("line", F.lit(True)).unionByName(other.withColumn("line", F.lit(False)))
    order = F.struct((-F.col("score")).alias("minus"), "license")
    reserved = F.col("license") == RESERVED
    best = every.groupBy(*ROW).agg(
        F.min(F.when(F.col("line"), order)).alias("a"), F.min(F.when(~F.col("line") & ~reserved, order)).alias("b"), F.min(F.when(~F.col("line") & reserved, order)).alias("c"),
        F.coalesce(F.bool_or(F.col("line") & ~reserved), F.lit(False)).alias("plain"), F.sort_array(F.collect_set("license")).alias("found"),
    )
    best = best.withColumn("best", F.when(F.col("plain"), F.col("a")).otherwise(F.coalesce("b", "a", "c")))
    return best.select(*ROW, F.col("best.license").alias("license"), (-F.col("best.minus")).alias("score"), "found")


BAG = ("b1", "b2")


def _bagged(df: DataFrame) -> DataFrame:
    """Adds a 128-bit key for the bag, which would else travel with each of its terms."""
    return df.select("*", F.xxhash64("bag").alias("b1"), F.xxhash64(F.lit(8), "bag").alias("b2"))


def _distinct(df: DataFrame) -> DataFrame:
    return df.groupBy(*BAG).agg(F.first("bag").alias("bag"))


def _cosines(bags: DataFrame, idf: DataFrame, rare: float, weights: list[tuple[int, str, str, float]], threshold: float) -> DataFrame:
    """b1, b2, license, score of the pairs of bags and notices at the threshold."""
    counted = bags.select(*BAG, F.explode(F.split("bag", " ")).alias("term")).groupBy(*BAG, "term").agg(F.count(F.lit(1)).alias("tf"))
    counted = counted.join(idf, "term", "left").withColumn("u", (1 + F.log("tf")) * F.coalesce("idf", F.lit(rare)))
    norms = counted.groupBy(*BAG).agg(F.sqrt(F.sum(F.col("u") * F.col("u"))).alias("norm"))
    weight_rows = F.broadcast(bags.sparkSession.createDataFrame(weights, "notice int, license string, term string, weight double"))
    dots = counted.join(weight_rows, "term").groupBy(*BAG, "notice", "license").agg(F.sum(F.col("u") * F.col("weight")).alias("dot"))
    return dots.join(norms, [*BAG]).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= threshold).select(*BAG, "license", "score")


def _passages(d: DataFrame, templates: Sequence[tuple[str, str]], counts: DataFrame, n_docs: int, df: dict[str, int], threshold: float) -> DataFrame:
    """r1, r2, license, score of passages of the text, whatever lines they are in.

    A passage at the threshold holds an anchor of its template; it is looked for
    where the anchor would have its place.
    """
    weights = notice_weights(n_docs, df, templates, threshold)[1]
    places: dict[str, set[tuple[int, int]]] = {}
    for name, body in templates:
        terms = terms_of(body)
        for anchor in notice_weights(n_docs, df, [(name, body)], threshold)[2]:
            for i, t in enumerate(terms):
                if t == anchor:
                    places.setdefault(t, set()).add((i, len(terms)))
    anchors = sorted(places)
    # Of each anchor: the places it has in templates, and the templates' lengths.
    at = F.array(*[F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(size).cast("long").alias("size")) for i, size in sorted(places[t])]) for t in anchors])
    pattern = f"(?i)(?<![a-z0-9])(?:{'|'.join(anchors)})(?![a-z0-9])"
    held = d.where(F.col("text").rlike(pattern)).select(*ROW, _terms(F.col("text")).alias("terms"))
    # Both columns need the terms, so that they aren't taken apart anew for each hit.
    names = F.array(*[F.lit(t) for t in anchors])
    marked = F.filter(F.transform("terms", lambda t, pos: F.when(t.isin(anchors), F.struct(pos.alias("pos"), F.get(at, (F.array_position(names, t) - 1).cast("int")).alias("at")))), lambda x: x.isNotNull())
    held = held.select(*ROW, "terms", marked.alias("hits"))
    # A passage's start and size in one number, as equal structs would be looked for pair by pair.
    starts = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.transform(h["at"], lambda x: (h["pos"] - x["i"]) * LONGEST + x["size"]))))

    def bag(s: Column) -> Column:
        start, size = F.floor(s / LONGEST).cast("int"), F.pmod(s, F.lit(LONGEST)).cast("int")
        return F.array_join(F.sort_array(F.slice("terms", F.greatest(start, F.lit(0)) + 1, F.greatest(size + F.least(start, F.lit(0)), F.lit(0)))), " ")

    found = materialize(_bagged(held.select(*ROW, "terms", starts.alias("starts")).select(*ROW, F.explode(F.array_distinct(F.transform("starts", bag))).alias("bag"))))
    bags = materialize(_possible(_distinct(found), weights, threshold))
    # Frequencies of the passages' terms that no template has; a table of the terms of few documents.
    used = bags.select(F.explode(F.split("bag", " ")).alias("term")).distinct()
    seen = counts.join(used, "term").select("term", (F.log((1 + n_docs) / (1 + F.col("n"))) + 1).alias("idf"))
    return found.select(*ROW, *BAG).join(_cosines(bags, seen, math.log(1 + n_docs) + 1, weights, threshold), [*BAG]).select(*ROW, "license", "score")


def _possible(bags: DataFrame, weights: list[tuple[int, str, str, float]], threshold: float) -> DataFrame:
    """Bags that hold enough of a notice: a cosine is at most the length of the notice's part that is there."""
    weight_rows = F.broadcast(bags.sparkSession.createDataFrame(weights, "notice int, license string, term string, weight double"))
    part = bags.select(*BAG, F.explode(F.array_distinct(F.split("bag", " "))).alias("term")).join(weight_rows, "term")
    part = part.groupBy(*BAG, "notice").agg(F.sum(F.col("weight") * F.col("weight")).alias("part"))
    return bags.join(part.where(F.col("part") >= threshold * threshold - 1e-6).select(*BAG).distinct(), [*BAG])


def _named(d: DataFrame) -> DataFrame:
    """r1, r2, license, score (1) of titles that are a whole line, and of SPDX tags.

    A tag's expression counts for each licence in it; NONE and NOASSERTION are no
    licences, the exception after WITH is none either, case doesn't matter.
    """
    words = F.regexp_replace(F.array_join(_terms(F.col("line")), " "), "^the ", "")
    titles = d.where(F.col("text").rlike(TITLE)).select(*ROW, F.explode(F.filter(F.split("text", "\n"), lambda x: x.rlike(TITLE))).alias("line")).withColumn("words", words)
    name = F.coalesce(*[F.when(F.col("words") == title, licence) for licence, title in TITLES])
    titles = titles.select(*ROW, name.alias("license"))
    tags = d.where(F.col("text").rlike(SPDX)).select(*ROW, F.explode(F.regexp_extract_all("text", F.lit(SPDX), F.lit(1))).alias("tag"))
    ids = F.split(F.regexp_replace("tag", r"(?i)\bwith[ \t()]+[a-z0-9.+\-]+", " "), r"[ \t()]+")
    tags = tags.select(*ROW, F.explode(F.filter(ids, lambda x: (x != "") & ~F.lower(x).isin(*SPDX_WORDS))).alias("id"))
    plain = F.regexp_replace(F.regexp_replace("id", r"(?i)(-only|-or-later|\+)$", ""), r"(?i)^BSD-[0-9]-Clause$", "BSD")
    tags = tags.withColumn("plain", plain)
    known = sorted({licence for licence, _ in (*NOTICES, *PASSAGES, *TITLES)} - {RESERVED})
    named = F.coalesce(*[F.when(F.lower("plain") == k.lower(), k) for k in known], F.col("plain"))
    both = titles.where("license IS NOT NULL").unionByName(tags.select(*ROW, named.alias("license")))
    return both.distinct().withColumn("score", F.lit(1.0))


def directory(path: Column) -> Column:
    """Everything before the last slash; the root is the empty string."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(docs: DataFrame, *, doc_id: str = "doc_id", path: str = "path", text: str = "text", notices: Sequence[tuple[str, str]] = NOTICES, threshold: float = THRESHOLD, licence_file: str = LICENCE_FILE) -> DataFrame:
    """doc_id, path, license, score, origin (own, inherited, none), inherited_from."""
    rows = keyed(docs)
    own = materialize(own_licenses(rows, text=text, notices=notices, threshold=threshold))
    at = F.col("row").getField(path)
    files = rows.select(*ROW, F.col("row").getField(doc_id).alias("doc_id"), at.alias("path"), directory(at).alias("dir"), F.element_at(F.split(at, "/"), -1).alias("base"))
    files = materialize(files.join(own, [*ROW], "left"))
    licensed = files.where(F.col("license").isNotNull() & F.col("base").rlike(licence_file)).groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("best"))
    licensed = licensed.select(F.col("dir").alias("above"), F.col("best.license").alias("dir_license"), (-F.col("best.minus")).alias("dir_score"))
    dirs = files.where(F.col("license").isNull() & F.col("dir").isNotNull()).select("dir").distinct()
    parts = F.split("dir", "/")
    above = dirs.withColumn("parts", parts).select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size("parts")), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice("parts", 1, n), "/").alias("above")))).alias("a"))
    above = above.select("dir", "a.depth", "a.above").distinct()
    nearest = above.join(licensed, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "dir_license", "dir_score")).alias("n"))
    nearest = nearest.select("dir", F.col("n.above").alias("above"), F.col("n.dir_license").alias("dir_license"), F.col("n.dir_score").alias("dir_score"))
    out = files.join(nearest, "dir", "left")
    mine = F.col("license").isNotNull()
    return out.select(
        "doc_id", "path", F.coalesce("license", "dir_license").alias("license"), F.when(mine, F.col("score")).otherwise(F.col("dir_score")).alias("score"),
        F.when(mine, "own").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none").alias("origin"), F.when(~mine, F.col("above")).alias("inherited_from"),
    )


#: Where the query's documents lie: source/shelf of 256 ids/language.  Texts of up to 500 characters play the licence files.
PATH_SQL = "concat_ws('/', source, CAST(floor(doc_id / 256) AS BIGINT), lang, concat(CASE WHEN length(coalesce(text, '')) <= 500 THEN 'LICENSE-' ELSE 'text-' END, doc_id))"


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return scan(docs.select("doc_id", F.expr(PATH_SQL).alias("path"), "text"))


_NOTICES_SQL = ", ".join(f"({k}, '{name}', '{notice}')" for k, (name, notice) in enumerate(NOTICES))

OP8_SQL = rf"""
WITH notices(notice, license, body) AS (VALUES {_NOTICES_SQL}),
docs AS (SELECT doc_id, coalesce(text, '') AS text, {PATH_SQL} AS path FROM documents),
total AS (SELECT count(*) AS n FROM docs),
notice_terms AS (
  SELECT notice, license, term, count(*) AS tf
  FROM (SELECT notice, license, unnest(regexp_split_to_array(lower(body), '{NOT_TERM}')) AS term FROM notices) WHERE term <> '' GROUP BY ALL),
doc_terms AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '{NOT_TERM}')) AS term FROM docs) WHERE term IN (SELECT term FROM notice_terms)),
idf AS (
  SELECT t.term, ln((1 + (SELECT n FROM total)) / (1 + count(d.doc_id))) + 1 AS idf
  FROM (SELECT DISTINCT term FROM notice_terms) t LEFT JOIN doc_terms d ON t.term = d.term GROUP BY t.term),
weights AS (
  SELECT notice, license, term, (1 + ln(tf)) * idf AS raw, sqrt(sum(((1 + ln(tf)) * idf) * ((1 + ln(tf)) * idf)) OVER (PARTITION BY notice)) AS norm
  FROM notice_terms JOIN idf USING (term)),
lines AS (SELECT doc_id, row_number() OVER () AS line_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)),
counted AS (
  SELECT doc_id, line_id, l.term, (1 + ln(count(*))) * coalesce(any_value(idf), ln(1 + (SELECT n FROM total)) + 1) AS u
  FROM (SELECT doc_id, line_id, unnest(regexp_split_to_array(lower(line), '{NOT_TERM}')) AS term FROM lines) l LEFT JOIN idf i ON l.term = i.term
  WHERE l.term <> '' GROUP BY doc_id, line_id, l.term),
norms AS (SELECT line_id, sqrt(sum(u * u)) AS norm FROM counted GROUP BY line_id),
cosines AS (
  SELECT c.doc_id, w.license, round(sum(c.u * w.raw / w.norm) / any_value(n.norm), 6) AS score
  FROM counted c JOIN weights w ON c.term = w.term JOIN norms n ON c.line_id = n.line_id
  GROUP BY c.doc_id, c.line_id, w.notice, w.license),
own AS (
  SELECT doc_id, license, score FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license) AS r FROM cosines WHERE score >= {THRESHOLD}) WHERE r = 1),
files AS (
  SELECT d.doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir, string_split(path, '/')[-1] AS base, license, score
  FROM docs d LEFT JOIN own o ON d.doc_id = o.doc_id),
licensed AS (
  SELECT dir AS above, license, score FROM (
    SELECT *, row_number() OVER (PARTITION BY dir ORDER BY score DESC, license) AS r
    FROM files WHERE license IS NOT NULL AND regexp_matches(base, '{LICENCE_FILE}')) WHERE r = 1),
nearest AS (
  SELECT * FROM (
    SELECT f.doc_id, l.above, l.license, l.score, row_number() OVER (PARTITION BY f.doc_id ORDER BY length(l.above) DESC) AS r
    FROM files f JOIN licensed l ON f.dir = l.above OR starts_with(f.dir, l.above || '/') OR l.above = ''
    WHERE f.license IS NULL) WHERE r = 1)
SELECT f.doc_id, f.path, coalesce(f.license, n.license) AS license, coalesce(f.score, n.score) AS score,
       CASE WHEN f.license IS NOT NULL THEN 'own' WHEN n.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       CASE WHEN f.license IS NULL THEN n.above END AS inherited_from
FROM files f LEFT JOIN nearest n ON f.doc_id = n.doc_id
"""
