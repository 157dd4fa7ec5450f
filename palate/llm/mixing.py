"""Mixing sources to target weights by iterative proportional fitting.

Token weights are summed by cell (source, language, topic). Raking multiplies the cells in turn so that their sums meet the
target of each source, language and topic; ROUNDS rounds. A cell's factor is its raked weight over its weight, and a
document stays with probability factor / largest factor, decided by a hash of its id: the kept tokens have the target
shares in expectation, and a rerun keeps the same documents.

Default targets are the observed shares to the power TEMPERATURE, scaled to one: large sources, languages and topics give way
to small ones. Topics are a column expression of the caller; ``register`` is the one that the queries use.

Cells are pre-aggregated where the documents are read; margins are sums over cells with map-side combination and small joins.

Defined results: nulls in source, language or topic are values of their own; null, empty and blank texts have no tokens, take
no part in the weights and stay by their cell's factor (by 1 where the cell has no tokens); equal ids share one
decision; null ids count as the empty string; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palate.session import stage

ROUNDS = 8
TEMPERATURE = 0.9
MARGINS = ("source", "lang", "topic")
_WORD = r"[^\x20\x09-\x0D]+"
# What marks a register, in order of precedence.
REGISTERS = (
    ("licence", "(?i)licen[cs]ed under|copyright|all rights reserved"),
    ("contact", "@[A-Za-z0-9-]+[.]|[+][0-9]"),
    ("table", " [|] "),
    ("notes", "\\n.*\\n.*\\n"),
)


def register(text: str = "text") -> Column:
    """A coarse topic by marks in the text: the table has no topic column."""
    column = F.lit("prose")
    for name, mark in reversed(REGISTERS):
        column = F.when(F.coalesce(F.col(text).rlike(mark), F.lit(False)), name).otherwise(column)
    return column


def draw(id_col: str) -> Column:
    """A number in [0, 1) from the id."""
    head = F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 8)
    return F.conv(head, 16, 10).cast("double") / F.lit(4294967296.0)


def rake(cells: DataFrame, margins: tuple[str, ...] = MARGINS, temperature: float = TEMPERATURE, rounds: int = ROUNDS) -> DataFrame:
    """Cells with ``factor``; ``weight`` is their token count."""
    now = cells.withColumn("raked", F.col("weight").cast("double"))
    for i, m in enumerate(margins):
        shares = cells.groupBy(m).agg(F.sum("weight").cast("double").alias("sum")).where("sum > 0")
        scaled = stage(shares.select(F.col(m).alias("key"), F.pow("sum", F.lit(temperature)).alias("scaled")), "target")
        total = scaled.agg(F.sum("scaled")).first()[0] or 1.0
        target = scaled.select("key", (F.col("scaled") / F.lit(total)).alias(f"target_{i}"))
        now = now.join(target, now[m].eqNullSafe(target["key"])).drop("key")
    # Every cell carries its targets, so a step is one sum and one join.
    now = stage(now, "cells")
    for _ in range(rounds):
        for i, m in enumerate(margins):
            steps = now.groupBy(F.col(m).alias("key")).agg((F.first(f"target_{i}") / F.sum("raked")).alias("step"))
            now = now.join(steps, now[m].eqNullSafe(steps["key"])).withColumn("raked", F.col("raked") * F.col("step")).drop("key", "step")
        now = stage(now, "cells")
    now = now.drop(*[f"target_{i}" for i in range(len(margins))])
    return now.withColumn("factor", F.col("raked") / F.col("weight")).drop("raked")


def mix(docs: DataFrame, topic: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents' columns as in_0, in_1, ... with tokens, probability and kept."""
    keep = [F.col(c).alias(f"in_{i}") for i, c in enumerate(docs.columns)]
    at = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    named = docs.select(
        *keep,
        F.col("source").alias("source"),
        F.col("lang").alias("lang"),
        (register(text_col) if topic is None else topic).alias("topic"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(_WORD)), F.lit(0)).cast("long").alias("tokens"),
    )
    rows = stage(named, "mix")
    cells = rows.where("tokens > 0").groupBy(*MARGINS).agg(F.sum("tokens").alias("weight"))
    factors = rake(stage(cells, "cells"))
    top = factors.agg(F.max("factor")).first()[0] or 1.0
    chances = stage(factors.select(*[F.col(m).alias(f"k_{m}") for m in MARGINS], F.round(F.col("factor") / F.lit(top), 9).alias("p")), "chances")
    same = [rows[m].eqNullSafe(chances[f"k_{m}"]) for m in MARGINS]
    out = rows.join(chances, same, "left").withColumn("probability", F.coalesce("p", F.lit(1.0)))
    return out.withColumn("kept", draw(at[id_col]) < F.col("probability")).drop(*[f"k_{m}" for m in MARGINS], "p")


def report(docs: DataFrame) -> DataFrame:
    out = mix(docs.select("doc_id", "text", "source", "lang"))
    return out.select(F.col("in_0").alias("doc_id"), "topic", F.col("tokens").alias("n_tokens"), F.round("probability", 6).alias("probability"), "kept")


def sample(docs: DataFrame) -> DataFrame:
    """The kept documents, with their columns."""
    return mix(docs).where("kept").select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(docs.columns)])


def _round_sql(n: int) -> str:
    steps, last = [], "r0" if n == 1 else f"r{(n - 1) * len(MARGINS)}"
    for k, m in enumerate(MARGINS):
        name = f"r{(n - 1) * len(MARGINS) + k + 1}"
        steps.append(
            f"{name} AS (SELECT c.* REPLACE (c.raked * t.target / sum(c.raked) OVER (PARTITION BY c.{m}) AS raked)"
            f" FROM {last} c JOIN t_{m} t ON c.{m} IS NOT DISTINCT FROM t.key)"
        )
        last = name
    return ", ".join(steps)


def _sql() -> str:
    case = " ".join(
        f"WHEN coalesce(regexp_matches(text, '{mark.replace('(?i)', '')}'{', ' + chr(39) + 'i' + chr(39) if '(?i)' in mark else ''}), false) THEN '{name}'"
        for name, mark in REGISTERS
    )
    targets = ", ".join(
        f"t_{m} AS (SELECT {m} AS key, pow(s, {TEMPERATURE}) / sum(pow(s, {TEMPERATURE})) OVER () AS target"
        f" FROM (SELECT {m}, CAST(sum(weight) AS DOUBLE) AS s FROM cells GROUP BY {m}))"
        for m in MARGINS
    )
    last = f"r{ROUNDS * len(MARGINS)}"
    return f"""
WITH d AS (SELECT doc_id, source, lang, CASE {case} ELSE 'prose' END AS topic,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens FROM documents),
cells AS (SELECT source, lang, topic, sum(n_tokens) AS weight FROM d WHERE n_tokens > 0 GROUP BY ALL),
{targets}, r0 AS (SELECT *, CAST(weight AS DOUBLE) AS raked FROM cells),
{", ".join(_round_sql(n) for n in range(1, ROUNDS + 1))},
p AS (SELECT source, lang, topic, round(raked / weight / max(raked / weight) OVER (), 9) AS p FROM {last})
SELECT doc_id, d.topic, n_tokens, round(coalesce(p, 1.0), 6) AS probability,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0 < coalesce(p, 1.0) AS kept
FROM d LEFT JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.lang IS NOT DISTINCT FROM p.lang AND d.topic = p.topic
"""


SQL = _sql()
