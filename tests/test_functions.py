"""Hand-computed cases of the column functions."""

import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palate.functions import indel
from palate.functions.mood import mood
from palate.functions.scaling import feature_vectors, fit_scalers
from palate.functions.text import fold_to_ascii, indel_ratio, normalize_artist, normalize_artist_exact, normalize_title, ratio
from palate.functions.vectors import cosine
from palate.functions.weights import track_weight
from palate.schema import (
    FEATURES,
    MODEL_INPUTS,
    MissingColumns,
    coerce_numeric,
    nulls_at_source,
    require_columns,
    standardize_columns,
)

MOOD_SCHEMA = "energy double, danceability double, valence double, acousticness double, instrumentalness double"


@pytest.mark.parametrize(
    "row, expected",
    [
        ((0.7, 0.9, 0.7, 0.0, 0.0), "Party"),
        ((0.75, 0.8, 0.9, 0.0, 0.0), "High Energy"),
        ((None, None, None, None, None), "Medium Energy"),
        ((0.3, 0.2, 0.6, 0.5, 0.9), "Chill"),
        ((0.4, 0.2, 0.6, 0.5, 0.9), "Focus"),
        ((0.5, 0.5, 0.2, 0.4, 0.0), "Emotional"),
    ],
)
def test_mood(spark, row, expected):
    df = spark.createDataFrame([row], MOOD_SCHEMA)
    assert df.select(mood().alias("m")).first()["m"] == expected


def test_absent_column_counts_as_half_but_null_never_matches(spark):
    df = spark.createDataFrame([(0.3, 0.2, 0.6)], "energy double, danceability double, valence double")
    assert df.select(mood(df.columns).alias("m")).first()["m"] == "Chill"


@pytest.mark.parametrize(
    "row, expected",
    [((100, 0.8, 0.8, 0.8), 4.68), ((10, 0.2, 0.2, 0.2), 0.396), ((None, None, None, None), 1.0), ((50, 0.7, 0.3, 0.5), 1.0)],
)
def test_track_weight(spark, row, expected):
    df = spark.createDataFrame([row], "popularity int, energy double, danceability double, valence double")
    assert df.select(track_weight().alias("w")).first()["w"] == pytest.approx(expected)


@pytest.mark.parametrize(
    "title, norm, bare",
    [
        ('Danger Zone - From "Top Gun" Original Soundtrack', "danger zone", "danger zone"),
        ("Hello (Live) - Remastered 2009", "hello live", "hello"),
        ("Song [Deluxe] feat. Somebody", "song deluxe", "song"),
        ("Café  Blue", "caf blue", "caf blue"),
        ("東京", "", ""),
        (None, "", ""),
    ],
)
def test_titles(spark, title, norm, bare):
    df = spark.createDataFrame([(title,)], "t string")
    row = df.select(normalize_title(F.col("t")).alias("n"), normalize_title(F.col("t"), True).alias("b")).first()
    assert (row["n"], row["b"]) == (norm, bare)


def test_artists(spark):
    df = spark.createDataFrame([("Beyoncé",), ("¥$ Ñandú",), ("Sigur  Rós",)], "a string")
    for fn in (normalize_artist, normalize_artist_exact):
        assert [r["a"] for r in df.select(fn(F.col("a")).alias("a")).collect()] == ["beyonce", "nandu", "sigur ros"]


def test_indel_ratio():
    assert indel_ratio("danger zone live", "danger zone") == pytest.approx(81.4814814)
    assert indel_ratio("", "") == 100.0
    assert indel_ratio("abc", "") == 0.0
    assert indel_ratio("a" * 200 + "b", "a" * 200) == pytest.approx(200 * 200 / 401)


def test_cosine_of_zero_vector(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert df.select(cosine(F.col("a"), F.col("b")).alias("c")).first()["c"] == 0.0


def test_missing_values_become_null(spark):
    df = spark.createDataFrame([("", float("nan")), ("x", 1.0)], "s string, d double")
    assert [tuple(r) for r in nulls_at_source(df).collect()] == [(None, None), ("x", 1.0)]
    text = spark.createDataFrame([("1.5",), ("bad",), ("NaN",)], "v string")
    assert [r["v"] for r in coerce_numeric(text, ["v"]).collect()] == [1.5, None, None]


def test_column_dialects_and_gate(spark):
    df = spark.createDataFrame([(1, 5)], ["Track ID", "key_value"])
    assert standardize_columns(df).columns == ["track_id", "key"]
    with pytest.raises(MissingColumns, match="missing audio features: acousticness"):
        require_columns(df, FEATURES)


def test_scaling_by_hand(spark):
    fields = [T.StructField("track_id", T.LongType()), T.StructField("popularity", T.IntegerType())]
    fields += [T.StructField(c, T.DoubleType()) for c in FEATURES]
    low, high = {c: 0.0 for c in FEATURES}, {c: 2.0 for c in FEATURES}
    rows = [(1, 50, *[low[c] for c in FEATURES]), (2, 100, *[high[c] for c in FEATURES])]
    df = spark.createDataFrame(rows, T.StructType(fields))
    got = {r["track_id"]: dict(zip(MODEL_INPUTS, r["feat"])) for r in feature_vectors(df, fit_scalers(df)).collect()}
    assert got[1]["energy"] == 0.0 and got[2]["energy"] == 1.0
    assert got[1]["tempo"] == -1.0 and got[2]["tempo"] == 1.0
    assert got[2]["key"] == pytest.approx(2 / 11) and got[2]["mode"] == 2.0 and got[1]["popularity_norm"] == 0.5


def plain_common_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for k, y in enumerate(b):
            row.append(last[k] + 1 if x == y else max(last[k + 1], row[k]))
    return row[-1]


def test_common_lengths_of_many_pairs(monkeypatch):
    rng = np.random.default_rng(4)
    letters = np.array(list("abcdé你🙂 "))
    word = lambda n: "".join(rng.choice(letters, n))
    lefts = ["", "a" * 64, "a" * 65, "ab" * 64, "x"] + [word(n) for n in rng.integers(0, 40, 60)] + [word(n) for n in (63, 64, 65, 127, 128, 129, 300)]
    rights = ["", "a" * 200, "b", "zz"] + [word(n) for n in rng.integers(0, 80, 40)] + [x[1:] + "q" for x in lefts]
    i, j = map(np.ravel, np.meshgrid(np.arange(len(lefts)), np.arange(len(rights)), indexing="ij"))
    want = [plain_common_length(lefts[a], rights[b]) for a, b in zip(i, j)]
    assert indel.common_lengths(lefts, rights, i, j).tolist() == want
    monkeypatch.setattr(indel, "PAIRS", 50)
    monkeypatch.setattr(indel, "MASK_BYTES", 1)
    assert indel.common_lengths(lefts, rights, i, j).tolist() == want
    shared = indel.letter_overlap(lefts, rights)
    assert shared.ravel().tolist() == [sum((Counter(lefts[a]) & Counter(rights[b])).values()) for a, b in zip(i, j)]
    assert indel.letter_overlap(["", "a"], [""]).tolist() == [[0], [0]]


def test_ratio_column_keeps_nulls(spark):
    rows = [("ab", "ab"), ("", ""), (None, "x"), ("x", None), ("abc", "")]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").coalesce(1).select(ratio(F.col("a"), F.col("b"))).collect()]
    assert got == [100.0, 100.0, None, None, 0.0]


def test_folding_equals_compatibility_decomposition(spark):
    names = ["Beyoncé", "Ｃｈｅｒ＆ｘ", "ﬁne ½ Ⅷ №5", "𝓐𝓫𝓬", "Ångström", "你好", "Đ ø ß", "x̂ŷ", "㎏ ﷺ", "", "plain"]
    names += ["".join(chr(c) for c in range(k, k + 50) if not 0xD800 <= c < 0xE000) for k in (0xA0, 0x1E00, 0x2070, 0x2100, 0xFB00, 0xFF00, 0x1D400)]
    folded = spark.createDataFrame([(n,) for n in names], "n string").select("n", fold_to_ascii(F.col("n")).alias("f"), normalize_artist(F.col("n")).alias("a"))
    for r in folded.collect():
        plain = unicodedata.normalize("NFKD", r.n).encode("ascii", "ignore").decode()
        assert r.f.encode("ascii", "ignore").decode() == plain
        assert r.a == re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", "", plain.lower())).strip()
