"""License scans by canonical digest.

A unit of text (a whole document, each of its lines, and each paragraph of several lines) is normalised: lower case, equivalent spellings, without copyright
lines, punctuation and repeated space. Its SHA-256 is hash-joined to the digests of known licence texts and notices; only
an entire unit matches. Known texts are a table of the caller's, by default KNOWN and the full texts in ``licences/``, with
and without the usual titles. Units of a length that no known text has are not hashed. Paragraphs add to ``licences``, not to
the count of lines; the SQL form knows the notices of KNOWN and no paragraphs.

Defined results: null and empty texts have no units and match nothing; a text of copyright lines only is empty; repeated lines
count each; repeated rows are scanned each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palate.session import stage

# Published licence texts and notices, by their short names.
KNOWN = (
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("Proprietary", "All rights reserved."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
        " provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    ),
)
# Titles that may stand before a full text.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License"),
}
# Equivalent spellings.
SPELLINGS = (("licence", "license"), ("sub-license", "sublicense"), ("noncommercial", "non-commercial"), ("organisation", "organization"), ("favour", "favor"))
_COPYRIGHT = r"(?m)^[ \t]*(?:copyright\b|\(c\)|©)[^\n]*$"
_MARKS = ("copyright", "(c)", "©")
_KEPT = "[^a-z0-9à-ɏ]+"
_KEPT_IN_LINES = "[^a-z0-9à-ɏ\\n]+"
_BREAK = r"\n[ \t\r]*\n\s*"


def _marked(low: Column, kept: str) -> Column:
    """Lower-case text without copyright lines, in one spelling, runs of what is not ``kept`` as a space. Literal searches are much
    cheaper than regular expressions, so one runs only where it can match."""
    marks = [F.contains(low, F.lit(mark)) for mark in _MARKS]
    out = F.when(reduce(Column.__or__, marks), F.regexp_replace(low, _COPYRIGHT, "")).otherwise(low)
    for said, same in SPELLINGS:
        out = F.replace(out, F.lit(said), F.lit(same))
    return F.regexp_replace(out, kept, " ")


def normal(text: Column) -> Column:
    return F.trim(_marked(F.lower(text), _KEPT))


def full_texts() -> list[tuple[str, str]]:
    """(licence, text) of the full licences, in the forms that they are given in."""
    out = []
    for path in sorted((Path(__file__).parent / "licences").glob("*.txt")):
        name, text = path.name.removesuffix(".txt").removesuffix(".regents"), path.read_text()
        forms = [text]
        if "END OF TERMS AND CONDITIONS" in text:
            terms = text[: text.index("END OF TERMS AND CONDITIONS")]
            forms += [terms, terms + "END OF TERMS AND CONDITIONS"]
        for form in list(forms):
            forms += [f"{title}\n\n{rights}{form}" for title in ("", *TITLES.get(name, ())) for rights in ("", "All rights reserved.\n\n")]
        out += [(name, form) for form in dict.fromkeys(forms)]
    return out


def known(spark: SparkSession, texts: DataFrame | None = None) -> DataFrame:
    """(digest, length, licence) of the known texts (licence, text)."""
    rows = spark.createDataFrame([*KNOWN, *full_texts()], "licence string, text string") if texts is None else texts.select("licence", "text")
    rows = rows.withColumn("text", normal(F.col("text"))).where("text <> ''")
    return stage(
        rows.select(F.sha2("text", 256).alias("digest"), F.length("text").alias("length"), "licence").groupBy("digest", "length").agg(F.min("licence").alias("licence")),
        "known",
    )


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: DataFrame | None = None) -> DataFrame:
    """One row per document: id, whole_licence, n_licence_lines, licences (distinct, sorted, comma-joined)."""
    names = known(docs.sparkSession, texts)
    lengths = [r[0] for r in names.select("length").distinct().collect()]
    digests = lambda units: F.transform(F.filter(units, lambda u: F.length(u).isin(lengths)), lambda u: F.sha2(u, 256))
    low = docs.select(F.col(id_col).alias("id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("low"))
    # Every line is normalised once: the whole text is its lines joined, as no rule looks across a line's end.
    lines = F.filter(F.transform(F.split(_marked(F.col("low"), _KEPT_IN_LINES), "\n", -1), lambda line: F.trim(line)), lambda line: line != "")
    # A text without a break is one paragraph, which the whole text stands for.
    paragraphs = F.when(F.col("low").rlike(_BREAK), F.filter(F.split("low", _BREAK, -1), lambda p: F.trim(p).contains("\n"))).otherwise(F.array())
    split = low.select("id", lines.alias("lines"), paragraphs.alias("paragraphs"))
    rows = split.select(
        "id",
        F.sha2(F.nullif(F.array_join("lines", " "), F.lit("")), 256).alias("whole"),
        digests(F.col("lines")).alias("lines"),
        digests(F.transform("paragraphs", lambda p: F.trim(_marked(p, _KEPT)))).alias("paragraphs"),
    )
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "units")
    units = rows.select("row", F.lit("whole").alias("kind"), F.col("whole").alias("digest"))
    for kind in ("lines", "paragraphs"):
        units = units.unionByName(rows.select("row", F.lit(kind).alias("kind"), F.explode(kind).alias("digest")))
    met = units.join(F.broadcast(names) if texts is None else names, "digest").groupBy("row").agg(
        F.max(F.when(F.col("kind") == "whole", F.col("licence"))).alias("whole_licence"),
        F.sum((F.col("kind") == "lines").cast("long")).alias("n"),
        F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("licences"),
    )
    return rows.join(met, "row", "left").select(
        F.col("id").alias(id_col), "whole_licence", F.coalesce("n", F.lit(0)).cast("long").alias("n_licence_lines"), F.coalesce("licences", F.lit("")).alias("licences")
    )


def _normal_sql(text: str) -> str:
    out = f"regexp_replace(lower({text}), '{_COPYRIGHT}', '', 'g')"
    for said, same in SPELLINGS:
        out = f"replace({out}, '{said}', '{same}')"
    return f"trim(regexp_replace({out}, '{_KEPT}', ' ', 'g'))"


SQL = f"""
WITH k AS (SELECT {_normal_sql("t")} AS n, min(licence) AS licence FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in KNOWN)}) v(licence, t) GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
u AS (SELECT r, true AS w, {_normal_sql("text")} AS n FROM d
    UNION ALL SELECT r, false, {_normal_sql("line")} FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)),
m AS (SELECT r, max(CASE WHEN w THEN licence END) AS whole_licence, count(*) FILTER (WHERE NOT w) AS n,
    string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences FROM u JOIN k USING (n) WHERE n <> '' GROUP BY r)
SELECT doc_id, whole_licence, CAST(coalesce(m.n, 0) AS BIGINT) AS n_licence_lines, coalesce(licences, '') AS licences FROM d LEFT JOIN m USING (r)
"""
