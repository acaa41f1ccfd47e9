"""Licence texts by canonical digest, in DataFrame functions only.

A text is brought to a canonical form: lower case, one space for everything that is no letter or
digit, copyright lines removed, equivalent spellings made equal.  Its digest is joined with the
digests of known licence texts.  The whole text of a document is looked up, and each of its lines
and paragraphs, since notices usually stand among other text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrain.llm.license_texts import complete_texts

#: Fixed: spellings that count as the same word, after lower-casing.
EQUIVALENT = (
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licences", "licenses"),
    ("sublicence", "sublicense"),
    ("analyse", "analyze"),
    ("authorised", "authorized"),
    ("cancelled", "canceled"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labour", "labor"),
    ("noncommercial", "non commercial"),
    ("organisation", "organization"),
    ("recognise", "recognize"),
    ("whilst", "while"),
    ("https", "http"),
)

#: Fixed: short notices and first paragraphs by the usual short names of their licences.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        'and associated documentation files (the "Software"), to deal in the Software without '
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions:",
    ),
)


def _plain(text: Column) -> Column:
    """Words in lower case with one space on both sides, lines apart, spellings made equal."""
    words = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " ")
    words = F.concat(F.lit(" "), F.replace(words, F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for other, usual in EQUIVALENT:
        words = F.replace(words, F.lit(f" {other} "), F.lit(f" {usual} "))
    return words


#: Fixed: words after "copyright" in a sentence of a licence, where a notice has a sign, year or name.
NO_NOTICE = (
    "also and are as at act be doctrine doctrines disclaimer for from holder holders if in infringement interest "
    "interests is law laws license licenses like line lines management may notice notices of on or owner owners "
    "ownership patent permission protection right rights statement statements status that those to treaties treaty "
    "under which with"
).split() + ["the library", "the software"]
_NOTICE = rf"^(copyright (c |\d{{4}}\b|(?!({'|'.join(NO_NOTICE)})\b))|copr |c \d{{4}}\b)"


def _kept_lines(lines: Column) -> Column:
    """Trimmed lines without copyright lines.

    A wrapped sentence may have "copyright" at the start of a line, as in "copyright notice"; that is
    no copyright line.
    """
    trimmed = F.transform(lines, lambda line: F.trim(line))
    return F.filter(
        trimmed,
        lambda line: ~(
            (F.startswith(line, F.lit("c")) & line.rlike(_NOTICE)) | (line == "all rights reserved")
        ),
    )


def _joined(lines: Column) -> Column:
    return F.trim(F.regexp_replace(F.array_join(lines, " "), " +", " "))


def canonical_digest(text: Column) -> Column:
    """The digest of a whole text's canonical form; null if nothing is left."""
    joined = _joined(_kept_lines(F.split(_plain(text), "\n")))
    return F.when(joined != "", F.sha2(joined, 256))


def known_licenses(spark: SparkSession, texts=None) -> DataFrame:
    """``(digest, license)``; the first name stays where two texts have one canonical form.

    Without ``texts`` these are the notices of ``KNOWN`` and the complete texts and headers.
    """
    texts = [*KNOWN, *complete_texts()] if texts is None else texts
    rows = [(i, name, text) for i, (name, text) in enumerate(texts)]
    table = spark.createDataFrame(rows, "i int, license string, text string")
    return (
        table.select(canonical_digest(F.col("text")).alias("digest"), "i", "license")
        .where(F.col("digest").isNotNull())
        .groupBy("digest")
        .agg(F.min_by("license", "i").alias("license"))
    )


def license_scan(
    docs: DataFrame, known: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``(doc_id, whole_license, licenses, n_units)`` of each row.

    ``whole_license`` is the licence that the entire text is, ``licenses`` the sorted names found in
    lines, paragraphs or the whole text, joined by commas (null if none), ``n_units`` how many lines,
    paragraphs and whole texts matched.  A unit equal to a larger one (a paragraph of one line) counts
    once.  Null and empty texts match nothing; repeated rows and null ids have rows of their own; an
    empty table gives no row; with an empty list of licences nothing matches.
    """
    keyed = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    lines = _kept_lines(F.split(_plain(F.coalesce(F.col("text"), F.lit(""))), "\n"))
    units = keyed.select("doc_id", F.xxhash64("text").alias("_text"), lines.alias("_lines"))
    # Paragraphs stand between empty lines; a text of one paragraph has none beside itself.
    marked = F.array_join(F.transform("_lines", lambda line: F.when(line == "", "\n").otherwise(line)), " ")
    whole = _joined(F.col("_lines"))
    paragraphs = F.when(
        F.array_contains("_lines", ""), F.transform(F.split(marked, "\n"), lambda p: F.trim(p))
    ).otherwise(F.array().cast("array<string>"))
    units = units.select("doc_id", "_text", "_lines", whole.alias("_whole"), paragraphs.alias("_paragraphs"))
    every = F.array_distinct(F.concat("_lines", "_paragraphs", F.array("_whole")))
    digests = (
        units.select("doc_id", "_text", "_whole", F.explode(every).alias("_unit"))
        .where(F.col("_unit") != "")
        .select(
            "doc_id",
            "_text",
            (F.col("_unit") == F.col("_whole")).alias("_is_whole"),
            F.sha2("_unit", 256).alias("digest"),
        )
    )
    hits = (
        digests.join(known, "digest")
        .groupBy("doc_id", "_text")
        .agg(
            F.max(F.when(F.col("_is_whole"), F.col("license"))).alias("whole_license"),
            F.array_join(F.sort_array(F.collect_set("license")), ",").alias("licenses"),
            F.count_distinct("digest").alias("n_units"),
        )
        .select(F.col("doc_id").alias("_id"), F.col("_text").alias("_same"), "whole_license", "licenses", "n_units")
    )
    ids = keyed.select("doc_id", F.xxhash64("text").alias("_text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_same"))
    return ids.join(hits, same, "left").select(
        "doc_id", "whole_license", "licenses", F.coalesce("n_units", F.lit(0)).alias("n_units")
    )
