"""Queries over sources, sinks, projections, filters and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palate.functions.mood import mood
from palate.functions.text import artist_list
from palate.operators import catalog as C
from palate.operators import discovery as D
from palate.operators import quality as Q
from palate.operators import taste
from palate.operators.ranking import keep_first
from palate.operators.resolve import artist_tokens, feature_cascade
from palate.registry.core import FEATURE_LIST, MOOD_SQL, query, views
from palate.schema import CATALOG_COLS, FEATURES, METADATA_COLS, canonical, coerce_numeric, require_columns, standardize_columns
from palate.session import new_path
from palate.sources import bindings as B
from palate.sources import files, landed

DAY = "yyyy-MM-dd"
CATALOG_SQL = f"track_id, track_name, artists, popularity, {FEATURE_LIST}"


def day(df: DataFrame) -> DataFrame:
    return df.withColumn("added_at", F.date_format("added_at", DAY))


def rich(spark: SparkSession, d: str) -> DataFrame:
    return B.library(spark, d).join(B.tracks(spark, d), "track_id")


# ---- sources and sinks


@query("s1_parquet_scan", views("complete") + f"SELECT track_id, {FEATURE_LIST} FROM complete")
def s1(spark, d):
    path = new_path(spark, "features")
    empty_before = files.read_features(spark, path)
    Q.complete(B.tracks(spark, d)).select("track_id", *FEATURES).write.parquet(path)
    return files.read_features(spark, path).unionByName(empty_before)


@query(
    "s2_dedup_sink",
    views("landed", "tracks")
    + f"SELECT DISTINCT track_id, {FEATURE_LIST} FROM tracks WHERE track_id IN (SELECT track_id FROM landed)",
)
def s2(spark, d):
    repeated = B.landed_library(spark, d).select("track_id").join(B.tracks(spark, d), "track_id")
    path = new_path(spark, "features")
    files.write_features(repeated.select("track_id", *FEATURES), path)
    return files.read_features(spark, path)


@query("s3_csv_scan", views("tracks") + f"SELECT {CATALOG_SQL} FROM tracks")
def s3(spark, d):
    path = new_path(spark, "csv")
    files.write_csv(canonical(B.tracks(spark, d)), path)
    return files.read_catalog_csv(spark, path)


@query("s4_csv_metadata_sink", views("complete") + "SELECT track_id, track_name, artists, popularity FROM complete")
def s4(spark, d):
    path = new_path(spark, "csv")
    files.write_csv(Q.complete(B.tracks(spark, d)).select(*METADATA_COLS), path)
    schema = "track_id bigint, track_name string, artists string, popularity int"
    return spark.read.schema(schema).option("header", True).csv(path)


@query("s5_id_list", views("tracks") + "SELECT track_id FROM tracks")
def s5(spark, d):
    return B.tracks(spark, d).select("track_id")


@query(
    "s6_key_lookup",
    views("users", "tracks", "landed")
    + """SELECT user_id, display_name, CAST(NULL AS VARCHAR) AS track_name FROM users
         WHERE user_id = (SELECT min(user_id) FROM landed)
         UNION ALL SELECT NULL, NULL, track_name FROM tracks WHERE track_id = (SELECT max(track_id) FROM landed)""",
)
def s6(spark, d):
    keys = B.landed_library(spark, d).agg(F.min("user_id"), F.max("track_id")).first()
    user = C.lookup(B.users(spark, d), "user_id", keys[0]).select(
        "user_id", "display_name", F.lit(None).cast("string").alias("track_name")
    )
    track = C.lookup(B.tracks(spark, d), "track_id", keys[1]).select(
        F.lit(None).cast("bigint").alias("user_id"), F.lit(None).cast("string").alias("display_name"), "track_name"
    )
    return user.unionByName(track)


@query("s7_bulk_reload", views("tracks") + f"SELECT {CATALOG_SQL} FROM tracks")
def s7(spark, d):
    text = B.tracks(spark, d).select(*[F.col(c).cast("string").alias(c) for c in CATALOG_COLS])
    path = new_path(spark, "reload")
    files.typed_catalog(text).write.mode("overwrite").parquet(path)
    return files.read_parquet(spark, path, canonical(B.tracks(spark, d)).schema)


@query(
    "s8_payload_flatten",
    views("landed", "tracks")
    + """SELECT l.user_id, l.track_id, t.track_name,
             CASE WHEN l.track_id % 3 = 0 THEN t.artists || ', ' || p_type ELSE t.artists END AS artists,
             l.playlist_name AS album_name, CASE WHEN l.track_id % 7 = 0 THEN 0 ELSE t.popularity END AS popularity,
             CASE WHEN l.track_id % 11 = 0 THEN 'QZ' || l.track_id END AS isrc
         FROM landed l JOIN tracks t USING (track_id) JOIN part ON p_partkey = l.track_id""",
)
def s8(spark, d):
    return landed.flatten_items(landed.parse_items(payloads(spark, d), "payload"), ["user_id"])


def payloads(spark, d) -> DataFrame:
    """Library additions as the nested JSON items a service would land."""
    kind = B.table(spark, d, "part").select(F.col("p_partkey").alias("track_id"), "p_type")
    rows = B.landed_library(spark, d).join(B.tracks(spark, d), "track_id").join(kind, "track_id")
    names = F.when(F.col("track_id") % 3 == 0, F.array("artists", "p_type")).otherwise(F.array("artists"))
    track = F.struct(
        F.col("track_id").alias("id"),
        F.col("track_name").alias("name"),
        F.when(F.col("track_id") % 7 != 0, F.col("popularity")).alias("popularity"),
        F.struct(F.col("playlist_name").alias("name")).alias("album"),
        F.transform(names, lambda a: F.struct(a.alias("name"))).alias("artists"),
        F.struct(F.when(F.col("track_id") % 11 == 0, F.concat(F.lit("QZ"), F.col("track_id"))).alias("isrc")).alias("external_ids"),
    )
    return rows.select("user_id", "added_at", "playlist_name", "batch_key", F.to_json(F.struct(track.alias("track"))).alias("payload"))


@query("s8_feature_response", views("tracks") + f"SELECT track_id, {FEATURE_LIST} FROM tracks")
def s8_features(spark, d):
    entry = F.struct(F.col("track_id").alias("id"), *FEATURES)
    numbered = B.tracks(spark, d).withColumn("call", F.floor(F.col("track_id") / C.FEATURE_BATCH))
    calls = numbered.groupBy("call").agg(F.to_json(F.struct(F.collect_list(entry).alias("content"))).alias("response"))
    return landed.flatten_features(calls, "response")


@query(
    "s8_event_payload",
    "SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS track_id FROM events",
)
def s8_events(spark, d):
    k = F.from_json("props", "k bigint")["k"]
    return B.table(spark, d, "events").select("event_id", "user_id", k.alias("track_id"))


@query(
    "s9_artifact_store",
    views("emb") + "SELECT track_id, track_name, artists, popularity, len(vec)::INTEGER AS dim, round(vec[1], 9) AS first FROM emb",
)
def s9(spark, d):
    base = new_path(spark, "artifacts")
    catalog = B.embedded_catalog(spark, d)
    vectors, meta = files.VersionedTable(spark, f"{base}/embeddings"), files.VersionedTable(spark, f"{base}/metadata")
    vectors.publish(catalog.select("track_id", "vec"))
    meta.publish(catalog.select(*METADATA_COLS))
    shown = vectors.current().select("track_id", F.size("vec").alias("dim"), F.round(F.col("vec")[0], 9).alias("first"))
    return meta.current().join(shown, "track_id").select(*METADATA_COLS, "dim", "first")


@query(
    "s10_report_sink",
    views("tracks", "users", "library")
    + """SELECT 'tracks' AS table_name, count(*) AS n_rows FROM tracks UNION ALL
         SELECT 'users', count(*) FROM users UNION ALL SELECT 'user_tracks', count(*) FROM library""",
)
def s10(spark, d):
    path = new_path(spark, "report")
    counts = C.table_counts({"tracks": B.tracks(spark, d), "users": B.users(spark, d), "user_tracks": B.owned(spark, d)})
    files.write_json_report(counts, path)
    return spark.read.schema("table_name string, n_rows bigint").json(path)


@query(
    "s11_versioned_backup",
    views("tracks", "complete")
    + """SELECT 'v1' AS version, count(*) AS n_rows, false AS is_current FROM tracks
         UNION ALL SELECT 'v2', count(*), true FROM complete""",
)
def s11(spark, d):
    store = files.VersionedTable(spark, new_path(spark, "catalog"))
    store.publish(B.tracks(spark, d), "v1")
    store.publish(Q.complete(store.current()), "v2")
    return store.history().select("version", "n_rows", "is_current")


# ---- projections and filters


@query(
    "f1_standardize",
    views("rich") + 'SELECT user_id, track_id, track_name, artists, playlist_name, popularity, "key", mode FROM rich',
)
def f1(spark, d):
    shown = rich(spark, d).select(
        F.col("user_id").alias("Owner ID"),
        F.col("track_id").alias("Track ID"),
        F.col("track_name").alias("Track Name"),
        F.col("artists").alias("Artist(s)"),
        F.col("playlist_name").alias("Playlist Name"),
        F.col("popularity").alias("Popularity"),
        F.col("key").alias("key_value"),
        F.col("mode").alias("mode_value"),
    )
    return standardize_columns(shown)


@query("f2_complete_filter", views("complete") + "SELECT * FROM complete")
def f2(spark, d):
    return Q.complete(B.tracks(spark, d))


@query(
    "f3_library_with_features",
    views("rich")
    + """SELECT user_id, track_id, strftime(added_at, '%Y-%m-%d') AS added_at, energy FROM rich
         WHERE acousticness IS NOT NULL AND danceability IS NOT NULL AND energy IS NOT NULL
           AND "key" IS NOT NULL AND mode IS NOT NULL""",
)
def f3(spark, d):
    rows = Q.library_with_features(B.library(spark, d), B.tracks(spark, d))
    return day(rows).select("user_id", "track_id", "added_at", "energy")


@query(
    "f4_search",
    views("tracks")
    + """SELECT * FROM tracks WHERE track_name ILIKE '%RING%' OR artists ILIKE '%RING%'
         ORDER BY popularity DESC, track_id LIMIT 10""",
)
def f4(spark, d):
    return C.search(B.tracks(spark, d), "RING", 10)


@query(
    "f5_feature_range",
    views("tracks")
    + """SELECT * FROM tracks WHERE energy >= 0.5 AND energy <= 0.9 AND danceability >= 0.4
         ORDER BY popularity DESC, track_id LIMIT 100""",
)
def f5(spark, d):
    return C.feature_range(B.tracks(spark, d), {"energy": (0.5, 0.9), "danceability": (0.4, None)}, 100)


@query(
    "f6_popularity_floor",
    views("tracks")
    + """SELECT track_id, popularity, popularity >= 20 AS diverse, popularity >= 30 AS trending
         FROM tracks WHERE popularity >= 20""",
)
def f6(spark, d):
    floor = C.POPULARITY_FLOOR
    return B.tracks(spark, d).where(F.col("popularity") >= floor["diverse"]).select(
        "track_id",
        "popularity",
        (F.col("popularity") >= floor["diverse"]).alias("diverse"),
        (F.col("popularity") >= floor["trending"]).alias("trending"),
    )


def popularity_bands(spark, d) -> DataFrame:
    mean = F.avg("popularity")
    return rich(spark, d).groupBy("user_id").agg(mean.alias("mean"), F.stddev_samp("popularity").alias("std"))


@query(
    "f7_popularity_band",
    views(
        "rich",
        "tracks",
        extra={
            "stats": "SELECT user_id, avg(popularity) AS mean FROM rich GROUP BY 1",
            "bands": "SELECT DISTINCT ceil(mean - 20) AS lo, floor(mean + 20) AS hi FROM stats",
            "ranked": """SELECT lo, hi, track_id, popularity,
                row_number() OVER (PARTITION BY lo, hi ORDER BY popularity DESC, track_id) AS place
                FROM bands JOIN tracks ON popularity BETWEEN lo AND hi""",
        },
    )
    + """SELECT user_id, track_id, popularity, place::INTEGER AS place FROM stats JOIN ranked
         ON lo = ceil(mean - 20) AND hi = floor(mean + 20) WHERE place <= 10""",
)
def f7(spark, d):
    bands = popularity_bands(spark, d).select(
        "user_id", (F.col("mean") - D.POPULARITY_BAND).alias("lo"), (F.col("mean") + D.POPULARITY_BAND).alias("hi")
    )
    tracks = B.tracks(spark, d).select("track_id", "popularity")
    return D.popular_in_band(bands, tracks, 10).select("user_id", "track_id", "popularity", "place")


@query(
    "f7_std_band_size",
    views(
        "rich",
        "tracks",
        extra={
            "stats": "SELECT user_id, avg(popularity) AS mean, stddev_samp(popularity) AS std FROM rich GROUP BY 1",
            "hist": "SELECT popularity, count(*) AS n FROM tracks GROUP BY 1",
        },
    )
    + """SELECT user_id, coalesce(sum(n), 0)::BIGINT AS n_tracks FROM stats
         LEFT JOIN hist ON popularity >= mean - std AND popularity <= mean + std GROUP BY 1""",
)
def f7_std(spark, d):
    bands = popularity_bands(spark, d).select(
        "user_id", (F.col("mean") - F.col("std")).alias("lo"), (F.col("mean") + F.col("std")).alias("hi")
    )
    return D.band_sizes(bands, B.tracks(spark, d))


@query(
    "f8_top_playlists",
    views("library", extra={"named": """SELECT user_id, track_id, added_at, CASE WHEN playlist_name LIKE '%URGENT' OR playlist_name LIKE '%HIGH'
            THEN 'Top Tracks (' || playlist_name || ')' ELSE playlist_name END AS playlist_name FROM library"""})
    + """SELECT user_id, track_id, playlist_name, position FROM (
            SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY added_at DESC, track_id)::INTEGER AS position
            FROM named WHERE regexp_matches(playlist_name, 'Top Tracks \\(.*\\)')) WHERE position <= 15""",
)
def f8(spark, d):
    from pyspark.sql import Window

    p = F.col("playlist_name")
    top = F.concat(F.lit("Top Tracks ("), p, F.lit(")"))
    named = B.library(spark, d).withColumn("playlist_name", F.when(p.endswith("URGENT") | p.endswith("HIGH"), top).otherwise(p))
    newest = Window.partitionBy("user_id").orderBy(F.desc("added_at"), "track_id")
    shown = named.where(F.col("playlist_name").rlike(r"Top Tracks \(.*\)"))
    return (
        shown.withColumn("position", F.row_number().over(newest))
        .where("position <= 15")
        .select("user_id", "track_id", "playlist_name", "position")
    )


@query("f9_mood_filter", views("moody") + "SELECT user_id, track_id, mood FROM moody WHERE mood = 'Chill'")
def f9(spark, d):
    return taste.mood_filter(rich(spark, d), "Chill").select("user_id", "track_id", "mood")


@query(
    "f10_numeric_coercion",
    """SELECT p_partkey AS track_id, TRY_CAST(CASE WHEN p_partkey % 5 = 0 THEN 'n/a' WHEN p_partkey % 7 = 0 THEN ''
           WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(p_size AS VARCHAR) END AS DOUBLE) AS popularity FROM part""",
)
def f10(spark, d):
    key = F.col("p_partkey")
    text = F.when(key % 5 == 0, "n/a").when(key % 7 == 0, "").when(key % 11 != 0, F.col("p_size").cast("string"))
    raw = B.table(spark, d, "part").select(key.alias("track_id"), text.alias("popularity"))
    return coerce_numeric(raw, ["popularity"])


@query(
    "f11_schema_gate",
    views("tracks", "complete")
    + """SELECT (SELECT count(*) FROM tracks) AS total_rows, (SELECT count(*) FROM complete) AS complete_rows,
                (SELECT count(*) FROM complete) >= 1000 AS enough""",
)
def f11(spark, d):
    return Q.training_gate(require_columns(B.tracks(spark, d), FEATURES))


@query(
    "f12_volume_gate",
    views("users", "usable", "owned", "emb", extra={"counts": "SELECT user_id, count(*) AS n FROM owned JOIN emb USING (track_id) GROUP BY 1"})
    + """SELECT user_id, coalesce(n, 0) AS usable_tracks, coalesce(n, 0) >= 3 AS eligible,
            CASE WHEN coalesce(n, 0) = 0 THEN 'No tracks with audio features found. Please collect more data.'
                 WHEN n < 3 THEN 'Need at least 3 tracks with audio features for good recommendations.' END AS reason
         FROM users LEFT JOIN counts USING (user_id)""",
)
def f12(spark, d):
    usable = B.owned(spark, d).join(B.embedded_catalog(spark, d).select("track_id"), "track_id")
    return Q.volume_gate(B.users(spark, d), usable)


@query(
    "f13_imputation",
    views("tracks")
    + f"""SELECT track_id, CASE WHEN track_id % 5 = 0 THEN 0 ELSE popularity END AS popularity,
              CASE WHEN track_id % 5 = 0 THEN 0.5 ELSE popularity / 100.0::DOUBLE END AS popularity_norm, {MOOD_SQL} AS mood
          FROM (SELECT * REPLACE (0.5::DOUBLE AS acousticness) FROM tracks)""",
)
def f13(spark, d):
    gone = F.col("track_id") % 5 == 0
    sparse = B.tracks(spark, d).drop("acousticness").withColumn("popularity", F.when(~gone, F.col("popularity")))
    return sparse.select(
        "track_id",
        F.coalesce("popularity", F.lit(0)).alias("popularity"),
        F.coalesce(F.col("popularity") / F.lit(100.0), F.lit(0.5)).alias("popularity_norm"),
        mood(sparse.columns).alias("mood"),
    )


@query(
    "f14_drop_items_without_id",
    views("landed") + "SELECT user_id, track_id FROM landed WHERE track_id % 13 <> 0",
)
def f14(spark, d):
    local = F.when(F.col("track_id") % 13 != 0, F.col("track_id")).alias("id")
    items = B.landed_library(spark, d).select("user_id", F.struct(F.struct(
        local, F.lit("x").alias("name"), F.lit(1).alias("popularity"), F.struct(F.lit("a").alias("name")).alias("album"),
        F.array(F.struct(F.lit("b").alias("name"))).alias("artists"),
        F.struct(F.lit(None).cast("string").alias("isrc")).alias("external_ids"),
    ).alias("track")).alias("item"))
    return landed.flatten_items(items, ["user_id"]).select("user_id", "track_id")


@query("f15_canonical_columns", views("complete") + f"SELECT {CATALOG_SQL} FROM complete")
def f15(spark, d):
    wide = Q.complete(B.tracks(spark, d)).withColumn("source", F.lit("x")).withColumn("mood", mood())
    return canonical(wide)


@query(
    "f16_full_library",
    views("library") + "SELECT user_id, track_id, strftime(added_at, '%Y-%m-%d') AS added_at, playlist_name FROM library",
)
def f16(spark, d):
    return day(Q.newest_first(B.library(spark, d))).select("user_id", "track_id", "added_at", "playlist_name")


# ---- joins


def new_items(spark, d) -> DataFrame:
    """Every supplied part as a newly found track without features."""
    return B.table(spark, d, "lineitem").select(F.col("l_partkey").alias("track_id")).distinct().join(
        B.tracks(spark, d).select(*METADATA_COLS), "track_id"
    )


@query(
    "j1_attach_features",
    views("landed", "complete")
    + f"SELECT {CATALOG_SQL} FROM complete WHERE track_id IN (SELECT track_id FROM landed)",
)
def j1(spark, d):
    return canonical(C.attach_features(new_items(spark, d), B.tracks(spark, d)))


@query("j2_library_features", views("library", "tracks") + f"SELECT user_id, track_id, {FEATURE_LIST} FROM library JOIN tracks USING (track_id)")
def j2(spark, d):
    features = keep_first(B.tracks(spark, d).select("track_id", *FEATURES), ["track_id"], [F.col("energy")])
    return B.owned(spark, d).join(features, "track_id").select("user_id", "track_id", *FEATURES)


@query(
    "j3_new_to_catalog",
    views("complete", "landed") + "SELECT DISTINCT track_id FROM landed WHERE track_id NOT IN (SELECT track_id FROM complete)",
)
def j3(spark, d):
    ids = B.landed_library(spark, d).select("track_id").distinct()
    return ids.join(Q.complete(B.tracks(spark, d)).select("track_id"), "track_id", "left_anti")


@query(
    "j4_cache_misses",
    views("landed")
    + """SELECT DISTINCT track_id FROM landed WHERE track_id % 13 <> 0
         AND track_id NOT IN (SELECT vec_id FROM embeddings)""",
)
def j4(spark, d):
    needed = B.landed_library(spark, d).select(F.when(F.col("track_id") % 13 != 0, F.col("track_id")).alias("track_id"))
    return C.cache_misses(needed, B.embeddings(spark, d))


@query(
    "j5_catalog_rows_for_ids",
    views("tracks") + f"SELECT {CATALOG_SQL} FROM tracks WHERE track_id IN (SELECT vec_id FROM embeddings)",
)
def j5(spark, d):
    ids = B.table(spark, d, "embeddings").select(F.col("vec_id").alias("track_id"))
    return canonical(B.tracks(spark, d)).join(ids, "track_id", "left_semi")


@query(
    "j6_exclude_owned",
    views("landed", "owned")
    + """SELECT e.user_id, k AS track_id, count(*) AS plays FROM (
            SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) e
         WHERE NOT EXISTS (SELECT 1 FROM owned o WHERE o.user_id = e.user_id AND o.track_id = e.k) GROUP BY 1, 2""",
)
def j6(spark, d):
    played = s8_events(spark, d).groupBy("user_id", "track_id").agg(F.count(F.lit(1)).alias("plays"))
    return played.join(B.owned(spark, d), ["user_id", "track_id"], "left_anti")


@query(
    "j7_attach_metadata",
    views("tracks") + "SELECT vec_id AS track_id, track_name, artists, popularity, label FROM embeddings JOIN tracks ON track_id = vec_id",
)
def j7(spark, d):
    labels = B.embeddings(spark, d).select("track_id", "label")
    return labels.join(B.tracks(spark, d).select(*METADATA_COLS), "track_id").select(*METADATA_COLS, "label")


@query(
    "j10_artist_tokens",
    """SELECT DISTINCT track_id, trim(regexp_replace(regexp_replace(lower(a), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS artist
       FROM (SELECT p_partkey AS track_id, unnest(string_split(CASE WHEN p_partkey % 3 = 0 THEN p_brand || ', ' || p_type ELSE p_brand END, ', ')) AS a FROM part)""",
)
def j10(spark, d):
    return artist_tokens(credited(spark, d), "track_id")


def credited(spark, d) -> DataFrame:
    """Tracks with their credits; every third has a second artist."""
    both = F.concat_ws(", ", "p_brand", "p_type")
    return B.table(spark, d, "part").select(
        F.col("p_partkey").alias("track_id"),
        F.when(F.col("p_partkey") % 3 == 0, both).otherwise(F.col("p_brand")).alias("artists"),
    )


@query(
    "j11_feature_cascade",
    views(
        "landed",
        "complete",
        extra={
            "wanted": "SELECT DISTINCT track_id FROM landed",
            "known": "SELECT * FROM complete WHERE track_id % 4 <> 0",
            "walk": "SELECT DISTINCT track_id, track_id + 1 AS foreign_id FROM landed WHERE track_id % 8 = 0",
        },
    )
    + """SELECT w.track_id, CASE WHEN a.track_id IS NOT NULL THEN 'direct' WHEN b.track_id IS NOT NULL THEN 'crosswalk' END AS source, """
    + ", ".join(
        f'CASE WHEN a.track_id IS NOT NULL THEN a."{c}" ELSE b."{c}" END AS "{c}"' for c in FEATURE_LIST.split(", ")
    )
    + """ FROM wanted w LEFT JOIN known a ON a.track_id = w.track_id LEFT JOIN walk x ON x.track_id = w.track_id
          LEFT JOIN known b ON b.track_id = x.foreign_id""",
)
def j11(spark, d):
    wanted = B.landed_library(spark, d).select("track_id").distinct()
    known = Q.complete(B.tracks(spark, d)).where(F.col("track_id") % 4 != 0)
    walk = wanted.where(F.col("track_id") % 8 == 0).withColumn("foreign_id", F.col("track_id") + 1)
    return feature_cascade(wanted, known, walk)


@query("g9_artist_round_trip", "SELECT p_partkey AS track_id, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS n_artists, CASE WHEN p_partkey % 3 = 0 THEN p_brand || ', ' || p_type ELSE p_brand END AS artists FROM part")
def g9(spark, d):
    names = artist_list(F.col("artists"))
    from palate.functions.text import join_artists

    return credited(spark, d).select("track_id", F.size(names).alias("n_artists"), join_artists(names).alias("artists"))


