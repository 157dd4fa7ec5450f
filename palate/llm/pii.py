"""Personal data: fixed formats as seeds, and contextual extraction bootstrapped from them.

Formats (e-mail, IP, card, phone) give the base spans. They seed a search for identifiers of other formats: a candidate is
a word with a digit that no base span touches; lexical patterns are the words around it ("the two before", "one before and
one after"). A pattern's confidence is the mean score of its distinct instances, smoothed by SMOOTH unknown ones; an
instance's score is one for seeds and else the noisy-or of its patterns. Rounds of both score the pattern-instance graph;
candidates in a pattern with MIN_SUPPORT seeds and MIN_CONFIDENCE become spans of kind ``other``.

All of it is DataFrame functions. The formats are written so that matching never restarts inside a run and never recurses:
the spans are those of the plain patterns. Documents are read once; what is staged are matches, not gaps.

Defined results: null counts as empty text; no matches give zero counts, an empty spans string and the digest of the empty
string; positions count code points, ends are exclusive; equal rows give equal results; an empty table gives an empty
result. Overlapping spans of different kinds all stay; masking replaces the first of overlapping ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palate.session import stage

KINDS = ("email", "ip", "card", "phone", "other")
ROUNDS = 3
SMOOTH = 2.0
MIN_SUPPORT = 3
MIN_CONFIDENCE = 0.6
_BLOCK = 128

_LOCAL, _LABEL, _SPACE = "A-Za-z0-9._%+-", "A-Za-z0-9-", r"\x20\x09-\x0D"
_PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@(?=[{_LABEL}]++\.[{_LABEL}])[{_LABEL}][{_LABEL}.]*?(?=\.(?![{_LABEL}])|(?![{_LABEL}.]))",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?=[\x20-]?[0-9])[0-9\x20-]*?(?![0-9]|[\x20-][0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "other": rf"(?<![^{_SPACE}])[^{_SPACE}]*[0-9][^{_SPACE}]*",
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _word_at_end(gap: Column, back: int) -> Column:
    """The last word of a gap, or the one before it; lower case. A word cut by the window of 80 is cut alike everywhere."""
    inside = rf"([^{_SPACE}]+)[{_SPACE}]*$" if back == 1 else rf"([^{_SPACE}]+)[{_SPACE}]+[^{_SPACE}]+[{_SPACE}]*$"
    return F.lower(F.regexp_extract(F.substring(gap, -80, 80), inside, 1))


def _word_at_start(gap: Column) -> Column:
    return F.lower(F.regexp_extract(F.substring(gap, 1, 40), rf"^[{_SPACE}.,;:!?)]*([^{_SPACE}.,;:!?]+)", 1))


def _around(gaps: Column):
    return lambda m, i: F.struct(
        F.length(gaps[i]).alias("gap"),
        m.alias("match"),
        _word_at_end(gaps[i], 1).alias("l1"),
        _word_at_end(gaps[i], 2).alias("l2"),
        _word_at_start(gaps[i + 1]).alias("r1"),
    )


def _total(part: Column) -> Column:
    return F.aggregate(part, F.lit(0), lambda a, x: a + x)


def _block_sums(kind: str) -> Column:
    """Sums of lengths by blocks of matches: first positions stay cheap however many matches a text has."""
    lens = F.col(f"{kind}_lens")
    blocks = F.sequence(F.lit(0), F.floor(F.size(lens) / _BLOCK).cast("int"))
    return F.transform(blocks, lambda b: _total(F.slice(lens, b * _BLOCK + 1, F.lit(_BLOCK))))


def _offsets(kind: str) -> Column:
    blocks = F.col(f"{kind}_blocks")
    return F.transform(blocks, lambda _, b: _total(F.slice(blocks, F.lit(1), b)))


def find(docs: DataFrame, kept: list[str], text_col: str = "text") -> DataFrame:
    """The ``kept`` columns of the documents as in_0, in_1, ... with ``base_spans`` and ``all_spans``: arrays of (kind number, start, end)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keep = [F.col(c).alias(f"in_{i}") for i, c in enumerate(kept)]
    cut = docs.select(*keep, text.alias("t"))
    # A text without the characters that a format must have is not searched for it.
    cut = cut.withColumns({"ats": F.col("t").contains("@"), "digits": F.col("t").rlike("[0-9]")})
    none = F.array().cast("array<string>")
    for kind, pattern in _PATTERNS.items():
        may = F.col("ats" if kind == "email" else "digits")
        cut = cut.withColumns(
            {
                f"{kind}_found": F.when(may, F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).otherwise(none),
                f"{kind}_gaps": F.when(may, F.split("t", pattern, -1)).otherwise(none),
            }
        )
    # Of the gaps only their lengths and the words next to the matches are kept.
    small = []
    for kind in KINDS:
        gaps, found = F.col(f"{kind}_gaps"), F.col(f"{kind}_found")
        small.append(F.transform(found, _around(gaps)).alias(kind))
    rows = stage(cut.select(*[f"in_{i}" for i in range(len(keep))], *small).withColumn("row", F.monotonically_increasing_id()), "pii")

    placed = rows.withColumns({f"{k}_lens": F.transform(k, lambda x: x["gap"] + F.length(x["match"])) for k in KINDS})
    placed = placed.withColumns({f"{k}_blocks": _block_sums(k) for k in KINDS})
    placed = placed.withColumns({f"{k}_offsets": _offsets(k) for k in KINDS})

    def spans(number: int, kind: str) -> Column:
        def one(x: Column, i: Column) -> Column:
            block = F.floor(i / _BLOCK).cast("int")
            before = _total(F.slice(f"{kind}_lens", block * _BLOCK + 1, i % _BLOCK))
            start = F.col(f"{kind}_offsets")[block] + before + x["gap"]
            return F.struct(F.lit(number).alias("kind"), start.alias("start"), (start + F.length(x["match"])).alias("end"), x.alias("x"))

        return F.filter(F.transform(kind, one), lambda s: _valid(kind, s["x"]["match"]))

    placed = placed.select(
        "row", *[f"in_{i}" for i in range(len(keep))], *[spans(i, k).alias(k) for i, k in enumerate(KINDS)]
    )
    placed = stage(placed.withColumn("base", F.concat(*KINDS[:4])).drop(*KINDS[:4]), "spans")

    other = placed.select("row", "other", "base").where(F.size("other") > 0).select("row", "base", F.explode("other").alias("s"))
    touched = F.exists("base", lambda b: (b["start"] < F.col("s.end")) & (F.col("s.start") < b["end"]))
    unseen = other.where(~touched).select("row", "s.start", F.lit(False).alias("seed"), "s.x")
    # A candidate ends before its closing punctuation.
    bare = F.regexp_replace(F.col("x.match"), "[.,;:!?)]+$", "")
    unseen = unseen.select("row", "start", (F.col("start") + F.length(bare)).alias("end"), "seed", F.lower(bare).alias("instance"), "x")
    seeds = placed.select(F.explode("base").alias("s")).select(F.lit(True).alias("seed"), F.lower("s.x.match").alias("instance"), F.col("s.x").alias("x"))
    patterns = F.array(
        F.when((F.col("x.l1") != "") & (F.col("x.l2") != ""), F.concat_ws(" ", F.lit("<"), "x.l2", "x.l1")),
        F.when((F.col("x.l1") != "") & (F.col("x.r1") != ""), F.concat_ws(" ", F.lit("|"), "x.l1", "x.r1")),
    )
    edges = seeds.select("seed", "instance", F.explode(patterns).alias("pattern")).unionByName(
        unseen.select("seed", "instance", F.explode(patterns).alias("pattern"))
    )
    edges = stage(edges.where("pattern is not null").groupBy("instance", "pattern").agg(F.max("seed").alias("seed")), "edges")
    # Only patterns that seeds induce can be trusted.
    induced = edges.groupBy("pattern").agg(F.sum(F.col("seed").cast("long")).alias("support")).where(F.col("support") >= MIN_SUPPORT)
    graph = edges.join(induced, "pattern").withColumn("score", F.col("seed").cast("double"))
    for _ in range(ROUNDS):
        trusted = graph.groupBy("pattern").agg((F.sum("score") / (F.count("*") + SMOOTH)).alias("confidence"))
        told = graph.select("instance", "pattern", "seed").join(trusted, "pattern")
        scored = told.groupBy("instance").agg(
            F.greatest(F.max(F.col("seed").cast("double")), 1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))).alias("score")
        )
        graph = stage(told.drop("confidence").join(scored, "instance"), "graph")
    sure = graph.groupBy("pattern").agg((F.sum("score") / (F.count("*") + SMOOTH)).alias("confidence")).where(F.col("confidence") >= MIN_CONFIDENCE)
    more = (
        unseen.select("row", "start", "end", F.explode(patterns).alias("pattern"))
        .join(sure, "pattern")
        .groupBy("row")
        .agg(F.collect_set(F.struct(F.lit(4).alias("kind"), "start", "end")).alias("more"))
    )
    lean = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    out = placed.join(more, "row", "left").withColumn("base_spans", F.sort_array(lean))
    out = out.withColumn("all_spans", F.when(F.col("more").isNull(), F.col("base_spans")).otherwise(F.sort_array(F.concat("base_spans", "more"))))
    return out.select(*[f"in_{i}" for i in range(len(keep))], "base_spans", "all_spans")


def _said(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, a count per fixed format, the digest of the base spans, all spans."""
    found = find(docs, [id_col], text_col)
    of_kind = lambda i: F.filter("base_spans", lambda s: s["kind"] == i)
    counts = [F.size(of_kind(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    return found.select(F.col("in_0").alias(id_col), *counts, F.sha2(_said("base_spans"), 256).alias("base_sha256"), _said("all_spans").alias("spans"))


def mask(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The same columns with every span replaced by its kind, and the length renewed."""
    found = find(docs, docs.columns, text_col)
    text = f"in_{docs.columns.index(text_col)}"
    order = F.sort_array(F.transform("all_spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    # Of overlapping spans the first stays: one that starts after all before it have ended.
    found = found.withColumn("order", order)
    order = F.col("order")
    apart = F.filter(
        order, lambda s, i: (i == 0) | (s["start"] >= F.coalesce(-F.array_min(F.transform(F.slice(order, F.lit(1), i), lambda p: p["back"])), F.lit(0)))
    )
    found = found.withColumn("cuts", apart)
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    pieces = F.transform(
        "cuts",
        lambda s, i: F.concat(
            F.substring(F.col(text), F.when(i == 0, 1).otherwise(1 - F.col("cuts")[i - 1]["back"]), s["start"] + F.when(i == 0, 0).otherwise(F.col("cuts")[i - 1]["back"])),
            names[s["kind"]],
        ),
    )
    tail = F.substring(F.col(text), 1 - F.element_at("cuts", -1)["back"], F.length(text))
    masked = F.when(F.size("cuts") > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(F.col(text))
    out = found.withColumn(text, masked)
    columns = {c: F.col(f"in_{i}") for i, c in enumerate(docs.columns)}
    if length_col in columns:
        columns[length_col] = F.coalesce(F.length(text).cast("long"), F.lit(0).cast("long"))
    return out.select(*[column.alias(c) for c, column in columns.items()])
