"""Title and artist normalisation, and the indel ratio between two strings."""

from __future__ import annotations

import functools
import json
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palate.functions.indel import indel_ratios

# What is cut from a lower-cased title, in this order.
SOUNDTRACK_TAILS = [
    r"""\s*-\s*from\s+["'].*?["'].*$""",
    r"\s*-\s*original\s+soundtrack.*$",
]
BRACKETED = r"\s*[\(\[\{].*?[\)\]\}]"
EDITION_TAIL = r"\s*-\s*(remaster(ed)?(\s*\d{2,4})?|live|radio\s*edit|single\s*version|album\s*version|mono|stereo|deluxe|bonus\s*track).*$"
GUEST_TAIL = r"\s*(feat\.|ft\.|with)\s+.*$"
NOT_TITLE_TEXT = r"[^a-z0-9\s]"
ARTIST_SEPARATOR = ", "
# Spellings of the same artist.
ARTIST_ALIASES = {
    "kanye west": ["ye"],
    "ty dolla sign": ["ty dolla $ign"],
    "ty dolla $ign": ["ty dolla sign"],
    "¥$": ["ye"],
}


def _cut(col: Column, pattern: str, by: str = "") -> Column:
    # (?U): \s also matches the Unicode spaces.
    return F.regexp_replace(col, "(?U)" + pattern, by)


def normalize_title(col: Column, strip_parentheses: bool = False) -> Column:
    out = F.lower(F.coalesce(col, F.lit("")))
    patterns = SOUNDTRACK_TAILS + ([BRACKETED] if strip_parentheses else [])
    for pattern in patterns + [EDITION_TAIL, GUEST_TAIL, NOT_TITLE_TEXT]:
        out = _cut(out, pattern)
    return F.trim(_cut(out, r"\s+", " "))


@functools.cache
def _ascii_forms() -> dict[str, str]:
    """Every character whose compatibility decomposition holds ASCII, with that ASCII part, by rule."""
    forms = {}
    for code in range(0x80, sys.maxunicode + 1):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if ord(c) < 128)
        if plain:
            forms[chr(code)] = plain
    return forms


def fold_to_ascii(col: Column) -> Column:
    """Accents, full-width and styled letters to ASCII; characters without an ASCII form stay.

    One-letter forms are one native translation. Ligatures, fractions and the like are looked up character by
    character, in names that hold one.
    """
    forms = _ascii_forms()
    single = {c: f for c, f in forms.items() if len(f) == 1}
    out = F.translate(col, "".join(single), "".join(single.values()))
    more = {c: f for c, f in forms.items() if len(f) > 1}
    # One constant instead of hundreds of expressions.
    known = F.from_json(F.lit(json.dumps(more)), "map<string, string>")
    held = "[" + "".join(more) + "]"
    each = F.transform(F.split(out, ""), lambda c: F.coalesce(F.try_element_at(known, c), c))
    return F.when(out.rlike(held), F.array_join(each, "")).otherwise(out)


def normalize_artist(col: Column) -> Column:
    """Folded to ASCII natively; letters without an ASCII form are dropped."""
    out = F.lower(fold_to_ascii(F.coalesce(col, F.lit(""))))
    out = _cut(out, NOT_TITLE_TEXT)
    return F.trim(_cut(out, r"\s+", " "))


@F.pandas_udf(T.StringType())
def fold_compatibility(values: pd.Series) -> pd.Series:
    """Full compatibility decomposition to ASCII, for names the native table does not cover."""
    folded = values.fillna("").str.normalize("NFKD")
    return folded.str.encode("ascii", "ignore").str.decode("ascii")


def normalize_artist_exact(col: Column) -> Column:
    out = _cut(F.lower(fold_compatibility(col)), NOT_TITLE_TEXT)
    return F.trim(_cut(out, r"\s+", " "))


def artist_list(col: Column) -> Column:
    return F.split(col, ARTIST_SEPARATOR)


def join_artists(col: Column) -> Column:
    return F.array_join(col, ARTIST_SEPARATOR)


def indel_ratio(a: str, b: str) -> float:
    return float(indel_ratios([a], [b], np.zeros(1, np.int64), np.zeros(1, np.int64))[0])


@F.pandas_udf(T.DoubleType())
def ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Similarity in 0-100 from insertions and deletions only; NULL if either side is NULL."""
    for left, right in pairs:
        known = (left.notna() & right.notna()).to_numpy()
        out, each = np.full(len(left), np.nan), np.arange(known.sum())
        out[known] = indel_ratios(left[known].tolist(), right[known].tolist(), each, each)
        yield pd.Series(out, dtype="Float64").mask(~known)
