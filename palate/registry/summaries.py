"""Queries over aggregations and column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palate.functions import text as X
from palate.functions import vectors as V
from palate.functions.mood import mood
from palate.functions.scaling import feature_vectors, fit_scalers
from palate.functions.weights import track_weight
from palate.operators import catalog as C
from palate.operators import discovery as D
from palate.operators import evaluation as E
from palate.operators import quality as Q
from palate.operators import taste
from palate.operators.catalog import split_bucket, split_name
from palate.plans.lifecycle import whole_days
from palate.registry.core import FEATURE_LIST, MOOD_SQL, WEIGHT_SQL, cosine_sql, query, views
from palate.registry.tables import rich
from palate.schema import MODEL_INPUTS
from palate.session import fill_slots
from palate.sources import bindings as B

DIGITS = 9


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, DIGITS) for c in columns})


def moody(spark, d) -> DataFrame:
    return taste.with_mood(rich(spark, d))


# ---- taste


@query(
    "a1_mood_statistics",
    views("moody", "mood_counts")
    + """SELECT s.user_id, s.mood, s.cnt, round(c.pct, 9) AS pct, round(avg_energy, 9) AS avg_energy,
            round(avg_valence, 9) AS avg_valence, round(avg_danceability, 9) AS avg_danceability,
            round(avg_acousticness, 9) AS avg_acousticness
         FROM (SELECT user_id, mood, count(*) AS cnt, avg(energy) AS avg_energy, avg(valence) AS avg_valence,
                   avg(danceability) AS avg_danceability, avg(acousticness) AS avg_acousticness FROM moody GROUP BY 1, 2) s
         JOIN mood_counts c USING (user_id, mood)""",
)
def a1(spark, d):
    stats = taste.mood_statistics(moody(spark, d))
    return rounded(stats, "pct", "avg_energy", "avg_valence", "avg_danceability", "avg_acousticness")


@query(
    "w6_sample_tracks",
    views("moody")
    + """SELECT user_id, mood, position, track_id, track_name, artists FROM (
            SELECT *, row_number() OVER (PARTITION BY user_id, mood ORDER BY added_at DESC, track_id)::INTEGER AS position
            FROM moody) WHERE position <= 3""",
)
def w6(spark, d):
    return taste.sample_tracks(moody(spark, d)).drop("added_at")


@query(
    "a2_taste_summary",
    views("moody")
    + """SELECT user_id, count(*) AS total_tracks, count(*) FILTER (WHERE energy IS NOT NULL AND danceability IS NOT NULL
            AND valence IS NOT NULL AND acousticness IS NOT NULL AND instrumentalness IS NOT NULL) AS tracks_with_features,
            count(DISTINCT mood) AS n_moods FROM moody GROUP BY 1""",
)
def a2(spark, d):
    return taste.taste_summary(moody(spark, d))


@query(
    "a3_listening_patterns",
    views(
        "mood_counts",
        extra={
            "placed": "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pct DESC, mood) AS place FROM mood_counts",
            "broad": "SELECT user_id, count(*) FILTER (WHERE pct > 10) AS n FROM mood_counts GROUP BY 1",
        },
    )
    + """SELECT user_id, 'Primary' AS type, mood, round(pct, 9) AS percentage,
            format('You primarily listen to {} music ({:.1f}%)', lower(mood), pct) AS description FROM placed WHERE place = 1
         UNION ALL SELECT user_id, 'Secondary', mood, round(pct, 9), format('You also enjoy {} music ({:.1f}%)', lower(mood), pct)
         FROM placed WHERE place = 2 AND pct > 15
         UNION ALL SELECT user_id, 'Diversity', 'Mixed', 0.0,
            CASE WHEN n >= 3 THEN 'You have diverse music taste' ELSE 'You have focused music taste' END FROM broad""",
)
def a3(spark, d):
    return rounded(taste.listening_patterns(taste.mood_counts(moody(spark, d))), "percentage")


@query(
    "a4_music_profile",
    views(
        "rich",
        extra={
            "counts": "SELECT user_id, artists, count(*) AS cnt FROM rich GROUP BY 1, 2",
            "placed": "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY cnt DESC, artists) AS place FROM counts",
            "tops": "SELECT user_id, string_agg(artists, '|' ORDER BY place) AS top_artists FROM placed WHERE place <= 10 GROUP BY 1",
        },
    )
    + """SELECT user_id, round(avg(popularity), 9) AS avg_popularity, round(stddev_samp(popularity), 9) AS popularity_std,
            count(*) AS total_tracks, any_value(top_artists) AS top_artists FROM rich JOIN tops USING (user_id) GROUP BY 1""",
)
def a4(spark, d):
    profile = taste.music_profile(rich(spark, d))
    return rounded(profile, "avg_popularity", "popularity_std").withColumn("top_artists", F.array_join("top_artists", "|"))


@query(
    "a5_top_artists",
    views("rich", extra={"counts": "SELECT user_id, artists, count(*) AS cnt FROM rich GROUP BY 1, 2"})
    + """SELECT user_id, artists, cnt, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY cnt DESC, artists)::INTEGER AS place
         FROM counts) WHERE place <= 10""",
)
def a5(spark, d):
    return taste.top_values(rich(spark, d), ["user_id"], "artists", 10)


@query(
    "a6_profile_vectors",
    views("profile")
    + "SELECT user_id, pos::INTEGER AS pos, round(vec[pos], 9) AS value FROM profile, (SELECT unnest(range(1, 65)) AS pos)",
)
def a6(spark, d):
    vectors = taste.profile_vectors(B.owned(spark, d), B.embedded_catalog(spark, d))
    return vectors.select("user_id", F.posexplode("vec").alias("p", "value")).select(
        "user_id", (F.col("p") + 1).alias("pos"), F.round("value", DIGITS).alias("value")
    )


@query(
    "a7_table_counts",
    views("tracks", "users", "library")
    + """SELECT 'tracks' AS table_name, count(*) AS n_rows FROM tracks UNION ALL
         SELECT 'users', count(*) FROM users UNION ALL SELECT 'user_tracks', count(*) FROM library""",
)
def a7(spark, d):
    return C.table_counts({"tracks": B.tracks(spark, d), "users": B.users(spark, d), "user_tracks": B.owned(spark, d)})


@query(
    "a8_library_summary",
    views("rich")
    + "SELECT user_id, count(*) AS n_tracks, count(acousticness) AS n_with_features, count(DISTINCT playlist_name) AS n_playlists FROM rich GROUP BY 1",
)
def a8(spark, d):
    return rich(spark, d).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_tracks"),
        F.count("acousticness").alias("n_with_features"),
        F.countDistinct("playlist_name").alias("n_playlists"),
    )


def _profile_sql(c: str) -> str:
    kind = "int" if c in ("key", "mode") else "double"
    return f"""SELECT '{c}' AS feature, '{kind}' AS dtype, count(*) AS total_rows, count(*) - count("{c}") AS missing,
        round((count(*) - count("{c}")) * 100.0::DOUBLE / count(*), 6) AS missing_pct, round(min("{c}")::DOUBLE, 6) AS min_value,
        round(max("{c}")::DOUBLE, 6) AS max_value, round(avg("{c}"), 6) AS mean_value, round(stddev_samp("{c}"), 6) AS std_value FROM tracks"""


@query("a9_quality_profile", views("tracks") + " UNION ALL ".join(_profile_sql(c) for c in FEATURE_LIST.split(", ")))
def a9(spark, d):
    return Q.quality_profile(B.tracks(spark, d))


SCALERS_SQL = " UNION ALL ".join(
    [
        f"SELECT '{c}' AS feature, 'minmax' AS kind, min({c}) AS shift, CASE WHEN max({c}) = min({c}) THEN 1.0 ELSE max({c}) - min({c}) END AS divisor FROM complete"
        for c in ("acousticness", "danceability", "energy", "instrumentalness", "liveness", "speechiness", "valence")
    ]
    + [
        f"SELECT '{c}', 'standard', avg({c}), CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END FROM complete"
        for c in ("loudness", "tempo")
    ]
)


@query(
    "a10_fit_scalers",
    views("complete", extra={"scalers": SCALERS_SQL}) + "SELECT feature, kind, round(shift, 6) AS shift, round(divisor, 6) AS divisor FROM scalers",
)
def a10(spark, d):
    return fit_scalers(Q.complete(B.tracks(spark, d))).withColumns({c: F.round(c, 6) for c in ("shift", "divisor")})


def _scaled_sql() -> str:
    def one(c: str) -> str:
        if c == "key":
            return '"key" / 11.0::DOUBLE'
        if c == "mode":
            return "mode::DOUBLE"
        if c == "popularity_norm":
            return "popularity / 100.0::DOUBLE"
        return f"({c} - (SELECT shift FROM scalers WHERE feature = '{c}')) / (SELECT divisor FROM scalers WHERE feature = '{c}')"

    return ", ".join(one(c) for c in MODEL_INPUTS)


FEAT_VIEW = {"scalers": SCALERS_SQL, "feat": f"SELECT track_id, [{_scaled_sql()}] AS feat FROM complete"}


@query(
    "m1_feature_vectors",
    views("complete", extra=FEAT_VIEW)
    + "SELECT track_id, pos::INTEGER AS pos, round(feat[pos], 9) AS value FROM feat, (SELECT unnest(range(1, 13)) AS pos)",
)
def m1(spark, d):
    tracks = Q.complete(B.tracks(spark, d))
    rows = feature_vectors(tracks, fit_scalers(tracks))
    return rows.select("track_id", F.posexplode("feat").alias("p", "value")).select(
        "track_id", (F.col("p") + 1).alias("pos"), F.round("value", DIGITS).alias("value")
    )


@query(
    "g6_scaling",
    views("tracks", "complete", extra={"scalers": SCALERS_SQL})
    + """SELECT track_id, round((energy - (SELECT shift FROM scalers WHERE feature = 'energy')) / (SELECT divisor FROM scalers WHERE feature = 'energy'), 9) AS energy,
            round((tempo - (SELECT shift FROM scalers WHERE feature = 'tempo')) / (SELECT divisor FROM scalers WHERE feature = 'tempo'), 9) AS tempo,
            round("key" / 11.0::DOUBLE, 9) AS "key" FROM tracks""",
)
def g6(spark, d):
    tracks = B.tracks(spark, d)
    f = feature_vectors(tracks, fit_scalers(Q.complete(tracks)))
    at = lambda c: F.round(F.col("feat")[MODEL_INPUTS.index(c)], DIGITS).alias(c)
    return f.select("track_id", at("energy"), at("tempo"), at("key"))


def predictions(spark, d) -> DataFrame:
    """Two stretches of each embedding as input and reconstruction."""
    return B.embeddings(spark, d).select("track_id", F.slice("vec", 1, 12).alias("x"), F.slice("vec", 13, 12).alias("y"))


PREDICTED = {
    "p": "SELECT vec_id AS track_id, CAST(embedding AS DOUBLE[])[1:12] AS x, CAST(embedding AS DOUBLE[])[13:24] AS y FROM embeddings",
    "gap": "SELECT track_id, list_transform(range(1, 13), lambda i: x[i] - y[i]) AS g FROM p",
    "err": """SELECT track_id, list_inner_product(g, g) / 12 AS e, list_sum(list_transform(g, lambda v: abs(v))) / 12 AS a,
              sqrt(list_inner_product(g, g)) AS m FROM gap""",
}


@query(
    "a11_reconstruction_metrics",
    views(extra=PREDICTED)
    + """SELECT round(avg(e), 9) AS mse, round(avg(a), 9) AS mae, round(sqrt(avg(e)), 9) AS rmse,
            round(avg(e), 9) AS mean_reconstruction_error, round(stddev_pop(e), 9) AS std_reconstruction_error FROM err""",
)
def a11(spark, d):
    out = E.reconstruction_metrics(predictions(spark, d))
    return rounded(out, *out.columns)


@query("g12_row_error", views(extra=PREDICTED) + "SELECT track_id, round(e, 9) AS error, round(m, 9) AS magnitude FROM err")
def g12(spark, d):
    return predictions(spark, d).select(
        "track_id",
        F.round(V.row_error(F.col("x"), F.col("y")), DIGITS).alias("error"),
        F.round(V.distance(F.col("x"), F.col("y")), DIGITS).alias("magnitude"),
    )


@query(
    "a13_error_histogram",
    views(extra=PREDICTED | {"span": "SELECT min(m) AS lo, max(m) AS hi FROM err"})
    + """SELECT least(floor((m - lo) / ((hi - lo) / 50)), 49)::INTEGER AS bin, count(*) AS n FROM err, span GROUP BY 1""",
)
def a13(spark, d):
    return E.histogram(predictions(spark, d), V.distance(F.col("x"), F.col("y")))


@query(
    "a13_feature_errors",
    views(extra=PREDICTED)
    + "SELECT 'f' || i AS feature, round(avg(g[i] * g[i]), 9) AS mse FROM gap, (SELECT unnest(range(1, 13)) AS i) GROUP BY i",
)
def a13_features(spark, d):
    return rounded(E.feature_errors(predictions(spark, d), [f"f{i}" for i in range(1, 13)]), "mse")


@query(
    "a14_style_summary",
    views("rich", extra={"means": """SELECT user_id, avg(energy) AS e, avg(danceability) AS da, avg(valence) AS v, avg(popularity) AS p
            FROM rich WHERE danceability IS NOT NULL GROUP BY 1"""})
    + """SELECT user_id, round(e, 9) AS avg_energy, round(da, 9) AS avg_danceability, round(v, 9) AS avg_valence, round(p, 9) AS avg_popularity,
            concat_ws(', ', CASE WHEN e > 0.7 THEN 'High Energy' WHEN e < 0.3 THEN 'Low Energy' END,
                CASE WHEN da > 0.7 THEN 'Danceable' WHEN da < 0.3 THEN 'Not Danceable' END,
                CASE WHEN v > 0.7 THEN 'Positive Mood' WHEN v < 0.3 THEN 'Negative Mood' END) AS style FROM means""",
)
def a14(spark, d):
    return rounded(taste.style_summary(rich(spark, d)), "avg_energy", "avg_danceability", "avg_valence", "avg_popularity")


@query(
    "a20_keywords",
    views(
        extra={
            "said": """SELECT lang, unnest(regexp_split_to_array(lower(text),
                '[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+')) AS word FROM documents""",
            "counts": """SELECT lang, word, count(*) AS cnt FROM said WHERE word <> '' AND word NOT IN
                ('the', 'a', 'an', 'and', 'or', 'but', 'in', 'on', 'at', 'to', 'for', 'of', 'with', 'by') GROUP BY 1, 2""",
        }
    )
    + """SELECT lang, word, cnt, place FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, word)::INTEGER AS place
         FROM counts) WHERE place <= 10""",
)
def a20(spark, d):
    return D.keywords(fill_slots(B.table(spark, d, "documents").select("lang", "text")), ["lang"], ["text"], 10)


@query(
    "a21_training_summary",
    views(extra={"h": """SELECT dense_rank() OVER (ORDER BY day)::INTEGER AS epoch, loss, val_loss, val_mae FROM (
            SELECT date_trunc('day', ts) AS day, avg(value) AS loss, avg(value) FILTER (WHERE event_type = 'view') AS val_loss,
                avg(value) FILTER (WHERE event_type = 'click') AS val_mae FROM events GROUP BY 1)"""})
    + """SELECT arg_min(epoch, val_loss) AS best_epoch, round(min(val_loss), 9) AS best_val_loss, round(min(val_mae), 9) AS best_val_mae,
            round(arg_max(val_loss, epoch), 9) AS final_val_loss, round(arg_max(val_mae, epoch), 9) AS final_val_mae, count(*) AS total_epochs FROM h""",
)
def a21(spark, d):
    from pyspark.sql import Window

    days = B.plays(spark, d).groupBy(F.date_trunc("day", "ts").alias("day")).agg(
        F.avg("value").alias("loss"),
        F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("val_loss"),
        F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("val_mae"),
    )
    history = days.withColumn("epoch", F.dense_rank().over(Window.orderBy("day")))
    out = E.training_summary(history)
    return rounded(out, "best_val_loss", "best_val_mae", "final_val_loss", "final_val_mae")


@query(
    "a22_user_feature_means",
    views("rich", "users")
    + """SELECT user_id, any_value(cohort) AS cohort, count(*) AS num_tracks, round(avg(popularity), 9) AS avg_popularity, round(avg(energy), 9) AS avg_energy,
            round(avg(danceability), 9) AS avg_danceability, round(avg(valence), 9) AS avg_valence FROM rich JOIN users USING (user_id) GROUP BY 1""",
)
def a22(spark, d):
    means = rich(spark, d).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("num_tracks"),
        *[F.round(F.avg(c), DIGITS).alias(f"avg_{c}") for c in ("popularity", "energy", "danceability", "valence")],
    )
    return means.join(B.users(spark, d).select("user_id", "cohort"), "user_id")


# ---- column functions


TITLE_SQL = """CASE p_partkey % 8
    WHEN 1 THEN p_name || ' - From "' || p_type || '" Original Soundtrack'
    WHEN 2 THEN p_name || ' - Remastered 2011'
    WHEN 3 THEN p_name || ' (feat. ' || p_brand || ')'
    WHEN 4 THEN p_name || ' ft. ' || p_brand
    WHEN 5 THEN p_name || ' [Deluxe Edition]'
    WHEN 6 THEN p_name || ' - Live at Home'
    WHEN 7 THEN upper(p_name) || '  with Friends'
    ELSE p_name END"""


def decorated_title():
    """Part names dressed up the way titles come from different catalogs."""
    kind, name, lit = F.col("p_partkey") % 8, F.col("p_name"), F.lit
    forms = [
        F.concat(name, lit(' - From "'), "p_type", lit('" Original Soundtrack')),
        F.concat(name, lit(" - Remastered 2011")),
        F.concat(name, lit(" (feat. "), "p_brand", lit(")")),
        F.concat(name, lit(" ft. "), "p_brand"),
        F.concat(name, lit(" [Deluxe Edition]")),
        F.concat(name, lit(" - Live at Home")),
        F.concat(F.upper(name), lit("  with Friends")),
    ]
    out = F
    for i, form in enumerate(forms, start=1):
        out = out.when(kind == i, form)
    return out.otherwise(name)


def title_sql(col: str, bare: bool = False) -> str:
    steps = [
        ("""\\s*-\\s*from\\s+["''].*?["''].*$""", ""),
        ("\\s*-\\s*original\\s+soundtrack.*$", ""),
        *([("\\s*[\\(\\[\\{].*?[\\)\\]\\}]", "")] if bare else []),
        (
            "\\s*-\\s*(remaster(ed)?(\\s*\\d{2,4})?|live|radio\\s*edit|single\\s*version|album\\s*version|mono|stereo|deluxe|bonus\\s*track).*$",
            "",
        ),
        ("\\s*(feat\\.|ft\\.|with)\\s+.*$", ""),
        ("[^a-z0-9\\s]", ""),
        ("\\s+", " "),
    ]
    out = f"lower({col})"
    for pattern, by in steps:
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    return f"trim({out})"


@query(
    "g1_normalize_title",
    f"SELECT p_partkey AS track_id, {title_sql('t')} AS norm, {title_sql('t', True)} AS bare FROM (SELECT p_partkey, {TITLE_SQL} AS t FROM part)",
)
def g1(spark, d):
    titled = B.table(spark, d, "part").select(F.col("p_partkey").alias("track_id"), decorated_title().alias("t"))
    return titled.select(
        "track_id", X.normalize_title(F.col("t")).alias("norm"), X.normalize_title(F.col("t"), True).alias("bare")
    )


ACCENTED_SQL = "replace(replace(replace(p_brand, 'a', 'á'), 'B', 'Ç'), '#', ' $Ñ-ü ')"


def accented_artist():
    return F.replace(F.replace(F.replace("p_brand", F.lit("a"), F.lit("á")), F.lit("B"), F.lit("Ç")), F.lit("#"), F.lit(" $Ñ-ü "))


ARTIST_SQL = f"""SELECT p_partkey AS track_id, trim(regexp_replace(regexp_replace(lower(strip_accents({ACCENTED_SQL})), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS artist FROM part"""


@query("g2_normalize_artist", ARTIST_SQL)
def g2(spark, d):
    return B.table(spark, d, "part").select(
        F.col("p_partkey").alias("track_id"), X.normalize_artist(accented_artist()).alias("artist")
    )


@query("g2_normalize_artist_exact", ARTIST_SQL)
def g2_exact(spark, d):
    return B.table(spark, d, "part").select(
        F.col("p_partkey").alias("track_id"), X.normalize_artist_exact(accented_artist()).alias("artist")
    )


def lcs_sql(a: str, b: str) -> str:
    """Bit-parallel common subsequence length for strings below 62 characters."""
    mask = f"list_sum(list_transform(range(0, length({a})), lambda i: CASE WHEN substr({a}, (i + 1)::INTEGER, 1) = c THEN (1::BIGINT << i::INTEGER) ELSE 0::BIGINT END))::BIGINT"
    masks = f"list_transform(string_split({b}, ''), lambda c: {mask})"
    full = f"((1::BIGINT << length({a})::INTEGER) - 1)"
    walk = f"list_reduce({masks}, lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full}, {full})"
    return f"CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 ELSE length({a}) - bit_count({walk}) END"


def ratio_sql(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 100.0::DOUBLE ELSE 200.0::DOUBLE * ({lcs_sql(a, b)}) / (length({a}) + length({b})) END"


@query(
    "g3_indel_ratio",
    f"""SELECT track_id, round({ratio_sql('t', 'p_name')}, 9) AS to_name, round({ratio_sql('t', 'm')}, 9) AS to_maker
        FROM (SELECT p_partkey AS track_id, {TITLE_SQL} AS t, p_name, lower(p_type || p_brand) AS m FROM part)""",
)
def g3(spark, d):
    maker = F.lower(F.concat("p_type", "p_brand"))
    t = decorated_title()
    return B.table(spark, d, "part").select(
        F.col("p_partkey").alias("track_id"),
        F.round(X.ratio(t, F.col("p_name")), DIGITS).alias("to_name"),
        F.round(X.ratio(t, maker), DIGITS).alias("to_maker"),
    )


@query("g4_mood", views("tracks") + f"SELECT track_id, {MOOD_SQL} AS mood FROM tracks")
def g4(spark, d):
    return B.tracks(spark, d).select("track_id", mood().alias("mood"))


@query("g5_track_weight", views("tracks") + f"SELECT track_id, round({WEIGHT_SQL}, 9) AS weight FROM tracks")
def g5(spark, d):
    return B.tracks(spark, d).select("track_id", F.round(track_weight(), DIGITS).alias("weight"))


NEXT = {
    "v": "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings",
    "pairs": "SELECT a.vec_id AS a, b.vec_id AS b, a.vec AS x, b.vec AS y FROM v a JOIN v b ON b.vec_id = a.vec_id + 1",
}


def neighbours_by_id(spark, d) -> DataFrame:
    e = B.embeddings(spark, d)
    right = e.select((F.col("track_id") - 1).alias("a"), F.col("track_id").alias("b"), F.col("vec").alias("y"))
    return e.select(F.col("track_id").alias("a"), F.col("vec").alias("x")).join(right, "a")


@query("g7_cosine", views(extra=NEXT) + f"SELECT a, b, round({cosine_sql('x', 'y')}, 9) AS sim FROM pairs")
def g7(spark, d):
    return neighbours_by_id(spark, d).select("a", "b", F.round(V.cosine(F.col("x"), F.col("y")), DIGITS).alias("sim"))


@query(
    "g8_norm_distance",
    views(extra=NEXT)
    + """SELECT a, b, round(sqrt(list_inner_product(x, x)), 9) AS norm_a,
            round(list_distance(x, y), 9) AS dist FROM pairs""",
)
def g8(spark, d):
    return neighbours_by_id(spark, d).select(
        "a", "b", F.round(V.norm(F.col("x")), DIGITS).alias("norm_a"), F.round(V.distance(F.col("x"), F.col("y")), DIGITS).alias("dist")
    )


@query(
    "g10_descriptions",
    views("mood_counts") + "SELECT user_id, mood, format('{} ({:.1f}%)', lower(mood), pct) AS shown FROM mood_counts",
)
def g10(spark, d):
    shown = F.format_string("%s (%.1f%%)", F.lower("mood"), F.bround("pct", 1))
    return taste.mood_counts(moody(spark, d)).select("user_id", "mood", shown.alias("shown"))


@query(
    "g11_days_since",
    views("landed", extra={"last": "SELECT user_id, max(added_at) AS m FROM landed GROUP BY 1"})
    + """SELECT user_id, floor((epoch(TIMESTAMP '2002-01-01 06:00:00') - epoch(m::TIMESTAMP)) / 86400)::BIGINT AS days FROM last""",
)
def g11(spark, d):
    now = F.to_timestamp(F.lit("2002-01-01T06:00:00"))
    last = B.landed_library(spark, d).groupBy("user_id").agg(F.max("added_at").alias("m"))
    return last.select("user_id", whole_days(F.col("m"), now).alias("days"))


@query(
    "g13_json_defaults",
    """SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0) AS k, coalesce(json_extract_string(props, '$.missing.isrc'), 'none') AS isrc FROM events""",
)
def g13(spark, d):
    item = F.from_json("props", "k bigint, missing struct<isrc: string>")
    return B.table(spark, d, "events").select(
        "event_id", F.coalesce(item["k"], F.lit(0)).alias("k"), F.coalesce(item["missing"]["isrc"], F.lit("none")).alias("isrc")
    )


@query(
    "g14_casts",
    """SELECT p_partkey AS track_id, TRY_CAST(x AS DOUBLE) AS as_double, TRY_CAST(x AS INTEGER) AS as_int FROM (
         SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'unknown' ELSE CAST(p_size AS VARCHAR) END AS x FROM part)""",
)
def g14(spark, d):
    text = F.when(F.col("p_partkey") % 5 == 0, "unknown").otherwise(F.col("p_size").cast("string"))
    return B.table(spark, d, "part").select(
        F.col("p_partkey").alias("track_id"), text.try_cast("double").alias("as_double"), text.try_cast("int").alias("as_int")
    )


@query(
    "g15_library_fingerprint",
    views("owned")
    + "SELECT user_id, count(*) AS n_tracks, bool_or(track_id % 97 = 0) AS changed FROM owned GROUP BY 1",
)
def g15(spark, d):
    """Order-free fingerprints of two library versions tell which listeners need new lists."""
    now, later = B.owned(spark, d), B.owned(spark, d).where(F.col("track_id") % 97 != 0)
    old = fingerprint(now).withColumnRenamed("print", "old")
    return old.join(fingerprint(later).drop("n_tracks"), "user_id", "left").select(
        "user_id", "n_tracks", (~F.col("old").eqNullSafe(F.col("print"))).alias("changed")
    )


def fingerprint(library: DataFrame) -> DataFrame:
    """Combines row by row, so no library is collected: xor of hashes plus the row count."""
    return library.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_tracks"),
        F.xxhash64(F.bit_xor(F.xxhash64("track_id")), F.count(F.lit(1))).alias("print"),
    )


@query(
    "w10_split",
    views("complete")
    + """SELECT track_id, CASE WHEN b < 64 THEN 'train' WHEN b < 80 THEN 'validation' ELSE 'test' END AS split
        FROM (SELECT track_id, ('0x' || substr(md5(track_id::VARCHAR), 1, 8))::BIGINT % 100 AS b FROM complete)""",
)
def w10(spark, d):
    return Q.complete(B.tracks(spark, d)).select("track_id", split_name(split_bucket("track_id")).alias("split"))


