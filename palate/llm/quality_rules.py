"""Quality rules with adaptive thresholds instead of fixed cutoffs.

Four measures per document: symbols, duplicate lines and repeated words per thousand words, and hundredths of characters per
word. Their distributions are kept as mergeable sketches: a histogram over log-linear buckets (16 to each power of two, so
a relative error of at most 1/16), one per language and source, added up to the language's and to the whole table's. A
threshold is median + FENCE * (upper quartile - median) + slack, from the documents that pass the base rule; groups of under
MIN_ROWS documents use the sketch of their language, such languages that of the table. The thresholds are joined back by
language and source; a document stays if no measure is above its threshold.

Everything is DataFrame functions; texts are read once and never shuffled. Repeated windows are found by 64-bit hashes
within a text.

Defined results: null, empty and blank texts have no words and fail the base rule; null languages and sources are groups of
their own; repeated rows are judged each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palate.session import stage

MIN_WORDS, MAX_REPEATED, WINDOW = 10, 20, 5
MIN_ROWS = 50
FENCE = 4
#: What a measure may exceed its fence by.
SLACK = {"symbols": 100, "dup_lines": 20, "repeats": 100, "length": 200}
_SPACE = r"\x20\x09-\x0D"
_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def _again(x: Column, k: Column) -> Column:
    """Whether a placed window has an equal neighbour in hash order."""
    at = lambda i: F.col("placed")[i]["h"]
    last = F.size("placed") - 1
    return ((k > 0) & (at(F.greatest(k - 1, F.lit(0))) == x["h"])) | ((k < last) & (at(F.least(k + 1, last)) == x["h"]))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base counts."""
    base = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    base = base.select(
        "doc_id",
        "lang",
        "source",
        F.transform(F.regexp_extract_all("text", F.lit(f"[^{_SPACE}]+"), F.lit(0)), lambda w: F.xxhash64(w)).alias("w"),
        F.length(F.translate("text", _BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n", -1), lambda line: F.length(F.translate(line, _BLANKS, "")) > 0).alias("lines"),
    )
    windows = F.transform(
        F.sequence(F.lit(0), F.size("w") - WINDOW), lambda i: F.xxhash64(*[F.col("w")[i + k] for k in range(WINDOW)])
    )
    base = base.select(
        "doc_id",
        "lang",
        "source",
        F.size("w").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") > WINDOW, windows).otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    base = base.withColumn("dup", F.size("h") > F.size(F.array_distinct("h")))
    # Only texts with a repeated window sort theirs. Each array is a column: a lambda must not build it again per element.
    placed = F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    base = base.withColumn("placed", F.when(F.col("dup"), placed))
    base = base.withColumn("at", F.when(F.col("dup"), F.filter("placed", _again)))
    base = base.withColumn("at", F.when(F.col("dup"), F.sort_array(F.transform("at", lambda x: x["i"]))))
    covered = F.aggregate(
        F.sequence(F.lit(0), F.size("at") - 1),
        F.lit(0),
        lambda a, k: a + F.when(k + 1 < F.size("at"), F.least(F.col("at")[F.least(k + 1, F.size("at") - 1)] - F.col("at")[k], F.lit(WINDOW))).otherwise(WINDOW),
    )
    base = base.withColumn("n_repeat_words", F.when(F.col("dup"), covered).otherwise(0).cast("long")).drop("h", "dup", "placed", "at")
    return base.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))


def _per(count: str, of: int) -> Column:
    return F.expr(f"{of} * {count} div greatest(n_words, 1)")


MEASURES = {"symbols": ("n_symbols", 1000), "dup_lines": ("n_dup_lines", 1000), "repeats": ("n_repeat_words", 1000), "length": ("word_chars", 100)}


def _bucket(value: Column) -> Column:
    bits = F.length(F.bin(value))
    return F.when(value < 16, value).otherwise((bits - 4) * 16 + F.floor(value / F.pow(F.lit(2.0), bits - 5))).cast("long")


def _edge(bucket: Column) -> Column:
    """The smallest value of a bucket."""
    bits = F.floor(bucket / 16) + 3
    return F.when(bucket < 16, bucket).otherwise((bucket - (bits - 4) * 16) * F.pow(F.lit(2.0), bits - 5)).cast("long")


def _thresholds(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n and a threshold per measure from a sketch (keys, measure, bucket, n)."""
    # A window holds the buckets of one group and measure: a bounded number.
    upto = Window.partitionBy(*keys, "measure").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys, "measure")
    ranked = sketch.withColumns({"upto": F.sum("n").over(upto), "size": F.sum("n").over(whole)})
    edge = lambda part: F.min(F.when(F.col("upto") * 100 >= F.col("size") * part, _edge(F.col("bucket"))))
    cut = ranked.groupBy(*keys, "measure").agg(F.max("size").alias("size"), edge(50).alias("mid"), edge(75).alias("high"))
    slack = F.coalesce(*[F.when(F.col("measure") == m, s) for m, s in SLACK.items()])
    cut = cut.withColumn("limit", F.col("mid") + FENCE * (F.col("high") - F.col("mid")) + slack)
    return cut.groupBy(*keys).agg(F.max("size").alias("n"), *[F.max(F.when(F.col("measure") == m, F.col("limit"))).alias(m) for m in MEASURES])


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, kept."""
    rows = measure(docs)
    rows = stage(rows.select("*", *[_per(*m).alias(f"m_{k}") for k, m in MEASURES.items()]), "measures")
    said = F.explode(F.create_map(*[x for m in MEASURES for x in (F.lit(m), _bucket(F.col(f"m_{m}")))])).alias("measure", "bucket")
    fine = rows.where("not base_failed").select("lang", "source", said).groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))
    fine = stage(fine, "sketch")
    middle = fine.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n"))
    coarse = fine.groupBy(F.lit(1).alias("one"), "measure", "bucket").agg(F.sum("n").alias("n"))
    by_source = _thresholds(fine, ["lang", "source"])
    by_lang = _thresholds(middle, ["lang"]).select(F.col("lang").alias("l"), *[F.col(c).alias(f"l_{c}") for c in ("n", *MEASURES)])
    overall = _thresholds(coarse, ["one"]).select(*MEASURES).first()
    chosen = by_source.join(by_lang, by_source["lang"].eqNullSafe(by_lang["l"]))
    limits = chosen.select(
        F.col("lang").alias("k_lang"),
        F.col("source").alias("k_source"),
        *[
            F.when(F.col("n") >= MIN_ROWS, F.col(m)).when(F.col("l_n") >= MIN_ROWS, F.col(f"l_{m}")).otherwise(overall[m] if overall else None).alias(m)
            for m in MEASURES
        ],
    )
    limits = stage(limits, "limits")
    judged = rows.join(limits, rows["lang"].eqNullSafe(limits["k_lang"]) & rows["source"].eqNullSafe(limits["k_source"]), "left")
    within = [F.coalesce(F.col(f"m_{m}") <= F.col(m), F.lit(True)) for m in MEASURES]
    kept = ~F.col("base_failed")
    for w in within:
        kept = kept & w
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


def _limits_sql(name: str, keys: str, source: str) -> str:
    by = f"{keys}, " if keys else ""
    columns = ", ".join(f"max(CASE WHEN measure = '{m}' THEN mid + {FENCE} * (high - mid) + {s} END) AS {m}" for m, s in SLACK.items())
    return f"""
{name}_s AS (SELECT {by}measure, bucket, sum(n) AS n FROM {source} GROUP BY ALL),
{name}_r AS (SELECT *, sum(n) OVER (PARTITION BY {by}measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by}measure) AS size FROM {name}_s),
{name}_c AS (SELECT {by}measure, max(size) AS size,
    min(CASE WHEN upto * 100 >= size * 50 THEN {_EDGE_SQL} END) AS mid, min(CASE WHEN upto * 100 >= size * 75 THEN {_EDGE_SQL} END) AS high
    FROM {name}_r GROUP BY ALL),
{name} AS (SELECT {by}max(size) AS n, {columns} FROM {name}_c{' GROUP BY ALL' if keys else ''})"""


_EDGE_SQL = "(CASE WHEN bucket < 16 THEN bucket ELSE (bucket - ((bucket // 16) - 1) * 16) * CAST(pow(2, (bucket // 16) - 2) AS BIGINT) END)"
_BUCKET_SQL = "(CASE WHEN v < 16 THEN v ELSE (length(bin(v)) - 4) * 16 + v // CAST(pow(2, length(bin(v)) - 5) AS BIGINT) END)"


def _sql() -> str:
    words = r"[^\x20\x09-\x0D]+"
    values = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, m_{m} AS v FROM m WHERE NOT base_failed" for m in MEASURES)
    measures = ", ".join(f"{of} * {count} // greatest(n_words, 1) AS m_{m}" for m, (count, of) in MEASURES.items())
    limit = lambda m: f"CASE WHEN a.n >= {MIN_ROWS} THEN a.{m} WHEN b.n >= {MIN_ROWS} THEN b.{m} ELSE (SELECT {m} FROM g) END"
    within = " AND ".join(f"coalesce(m_{m} <= {limit(m)}, true)" for m in MEASURES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{words}') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{words}')) AS ls FROM d),
win AS (SELECT r, i, list_slice(ws, i, i + {WINDOW - 1}) AS win FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - {WINDOW - 1})) AS i FROM w WHERE len(ws) >= {WINDOW})),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(generate_series(0, {WINDOW - 1})) AS k) GROUP BY r),
b AS (SELECT doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN cov USING (r)),
m AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed, {measures} FROM b),
s AS (SELECT lang, source, measure, {_BUCKET_SQL} AS bucket, count(*) AS n FROM ({values}) GROUP BY ALL),
{_limits_sql("a", "lang, source", "s")}, {_limits_sql("l", "lang", "s")}, {_limits_sql("g", "", "s")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {within} AS kept
FROM m LEFT JOIN a ON m.lang IS NOT DISTINCT FROM a.lang AND m.source IS NOT DISTINCT FROM a.source
LEFT JOIN l b ON m.lang IS NOT DISTINCT FROM b.lang
"""


SQL = _sql()
