"""Licence scans by sparse TF-IDF cosine and directory inheritance, in DataFrame functions only.

Every line of every file is a unit.  Of its distinct terms only those of some template are kept, as
numbers; all others only count.  Document frequencies of the template terms come from all lines.
A line whose cosine with a template is high enough is a licence notice.  A file with a notice has that
licence; a licence file (by its name, or because notices are at least half of its words) gives its
licence to its directory.  Other files take the licence of the nearest directory above them that has
one: this is a join of distinct directories with their ancestors, not of files.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkweave.scale import cut_lineage

# Short notices as they stand in headers and licence files.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
# No repeated groups: the regular expressions of the JVM recurse on them, and runs can be long.
BREAK = r"[^a-z0-9.+-]+|[.+-]+(?![a-z0-9])"
LICENCE_FILE = r"(?i)^(un)?licen[cs]e|^copying|^notice"
MIN_COSINE = 0.7
MIN_SHARE = 0.5


def _terms(text: str) -> set[str]:
    return {t for t in re.split(BREAK, text.lower()) if t}


def _line_terms(files: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Lines with a template term: numbers of these terms, how many other terms, and word counts."""
    terms = F.array_distinct(F.filter(F.split(F.lower("line"), BREAK), lambda w: w != ""))
    numbered = F.transform(
        F.filter("terms", lambda w: w.isin(vocabulary)),
        lambda w: F.array_position(F.lit(vocabulary), w).cast("int"),
    )
    return (
        files.select("id", "path", "version", "n_words", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        .select("id", "path", "version", "n_words", "line_no", "line", terms.alias("terms"))
        .select(
            "id", "path", "version", "n_words", "line_no",
            F.regexp_count("line", F.lit(r"\S+")).alias("line_words"),
            numbered.alias("known"), F.size("terms").alias("n_terms"),
        )
        .filter(F.size("known") > 0)
    )


def _parents(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.lit(""))


def notices(
    files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, min_cosine: float = MIN_COSINE
) -> DataFrame:
    """Lines that are licence notices: ``id``, ``path``, ``version``, ``n_words``, ``line_no``, ``line_words``, ``license``, ``score``.

    ``version`` is the digest of the text, ``n_words`` its number of words; both come with ``files``.
    """
    sets = [(name, _terms(text)) for name, text in templates]
    vocabulary = sorted(set().union(*(s for _, s in sets)))
    lines = cut_lineage(_line_terms(files, vocabulary), "lines")
    n_lines = files.agg(F.sum(F.size(F.split("text", "\n")))).first()[0] or 0
    counted = lines.select(F.explode("known").alias("term")).groupBy("term").count().collect()  # one row per term
    df = {r["term"]: r["count"] for r in counted}
    idf = [math.log((1 + n_lines) / (1 + df.get(i + 1, 0))) + 1 for i in range(len(vocabulary))]
    other = math.log(1 + n_lines) + 1
    squares = F.array(*(F.lit(x * x) for x in idf))
    total = lambda weights: F.aggregate("known", F.lit(0.0), lambda a, t: a + F.element_at(weights, t))
    norm = F.sqrt(total(squares) + (F.col("n_terms") - F.size("known")) * F.lit(other * other))
    scores = []
    for name, own in sets:
        at = [vocabulary.index(t) for t in sorted(own)]
        weights = F.array(*(F.lit(idf[i] ** 2 if i in at else 0.0) for i in range(len(vocabulary))))
        size = math.sqrt(sum(idf[i] ** 2 for i in at))
        scores.append(F.struct((total(weights) / (F.lit(size) * F.col("norm"))).alias("score"), F.lit(name).alias("license")))
    # A line with few template terms among its terms cannot reach the cosine, whatever the weights.
    possible = F.size("known") >= F.lit(min_cosine**2 * (1 - 1e-9)) * F.col("n_terms")
    best = F.array_sort(
        F.array(*scores),
        lambda a, b: F.when(a["score"] != b["score"], F.when(a["score"] > b["score"], -1).otherwise(1))
        .when(a["license"] < b["license"], -1).when(a["license"] > b["license"], 1).otherwise(0),
    )[0]
    return (
        lines.filter(possible)
        .withColumn("norm", norm)
        .withColumn("best", best)
        .filter(F.col("best.score") >= min_cosine)
        .select("id", "path", "version", "n_words", "line_no", "line_words", "best.license", "best.score")
    )


def license_scan(
    files: DataFrame,
    id_col: str = "doc_id",
    path_col: str = "path",
    text_col: str = "text",
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    min_cosine: float = MIN_COSINE,
) -> DataFrame:
    """The licence of each file and where it comes from.

    Returns per row of ``files``: ``id``, ``path``, ``notice`` (the licence of the best line), ``score``
    and ``notice_line`` of it, ``license`` (own notice, else inherited) and ``inherited_from`` (the
    directory it comes from, null for an own notice).

    Equal scores go to the earlier line, then the licence that is first by name.  Of several licence files in a
    directory the one with the best score counts, then the first by path.  A null or empty text has
    no notice but can inherit; a null path has no directory and inherits nothing; the root is the
    directory "".  Rows with the same id and path are one file here: they share what any of them says, and
    equal texts among them count once.  An empty table gives an empty result; extra columns are ignored.
    """
    if not 0 < min_cosine <= 1:
        raise ValueError("need 0 < min_cosine <= 1")
    named = files.select(
        F.col(id_col).cast("long").alias("id"), F.col(path_col).cast("string").alias("path"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    counted = named.withColumns({"n_words": F.regexp_count("text", F.lit(r"\S+")), "version": F.xxhash64("text")})
    found = cut_lineage(notices(counted, templates, min_cosine), "notices")
    rank = (-F.col("score")).alias("rank"), F.col("line_no"), F.col("license")
    own = cut_lineage(
        found.dropDuplicates(["id", "path", "version", "line_no"])
        .groupBy("id", "path", "version", "n_words")
        .agg(F.min(F.struct(*rank, "score")).alias("best"), F.sum("line_words").alias("notice_words"))
        .groupBy("id", "path")
        .agg(
            F.min("best").alias("best"),
            F.bool_or(F.col("notice_words") >= MIN_SHARE * F.col("n_words")).alias("whole"),
        )
        .select(
            "id", "path", F.col("best.license").alias("notice"), "best.score",
            F.col("best.line_no").alias("notice_line"), "whole",
        ),
        "own",
    )
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    givers = (
        own.filter(F.col("path").isNotNull() & (base.rlike(LICENCE_FILE) | F.col("whole")))
        .groupBy(_parents(F.col("path")).alias("giver"))
        .agg(F.min_by("notice", F.struct(-F.col("score"), F.col("path"), F.col("notice"))).alias("given"))
    )
    slim = named.select("id", "path").withColumn("directory", _parents(F.col("path")))
    steps = F.split("directory", "/")
    ancestors = F.transform(
        F.sequence(F.lit(0), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/")
    )
    nearest = (
        slim.filter("path is not null").select("directory").distinct()
        .select("directory", F.explode(F.array_distinct(ancestors)).alias("giver"))
        .join(givers, "giver")
        .groupBy("directory")
        .agg(F.max_by(F.struct("giver", "given"), F.length("giver")).alias("near"))
    )
    same = slim["id"].eqNullSafe(own["id"]) & slim["path"].eqNullSafe(own["path"])
    return (
        slim.join(own, same, "left")
        .select(slim["id"], slim["path"], slim["directory"], "notice", "score", "notice_line")
        .join(nearest, "directory", "left")
        .select(
            "id", "path", "notice", "score", F.col("notice_line").cast("long").alias("notice_line"),
            F.when(F.col("path").isNull(), F.col("notice")).otherwise(F.coalesce("notice", "near.given")).alias("license"),
            F.when(F.col("notice").isNull() & F.col("path").isNotNull(), F.col("near.giver")).alias("inherited_from"),
        )
    )
