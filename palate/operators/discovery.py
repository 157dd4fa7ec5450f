"""Candidates from outside the similarity model: artists, keywords, popularity, curated lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palate.operators.taste import top_values

# Words that never become keywords.
STOP_WORDS = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by"]
# Caps and scores of the discovery strategies, in the order they fill a list.
SAME_ARTIST = {"score": 0.8, "artists": 3, "per_artist": 10}
POPULARITY_MATCH = {"score": 0.6, "tracks": 20}
CURATED = {"score": 0.7, "per_list": 5}
POPULARITY_BAND = 20
TOP_ARTISTS, PER_RELATED_ARTIST = 10, 5
TOP_KEYWORDS, LISTS_PER_KEYWORD, PER_LIST = 3, 5, 10
# What separates words, the white space of every script.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def words(*texts: str) -> Column:
    """Lower-cased pieces between white space; neighbouring separators leave empty pieces.

    Every separator becomes a plain space first: splitting on one character is far cheaper than a
    regular expression over long texts.
    """
    joined = F.concat_ws(" ", *[F.coalesce(F.col(t), F.lit("")) for t in texts])
    return F.split(F.translate(F.lower(joined), SPACES, " " * len(SPACES)), " ")


def keywords(df: DataFrame, keys: list[str], texts: list[str], k: int = 10) -> DataFrame:
    """Most frequent words per key. Stop words go before counting, and counts combine per task."""
    said = df.select(*keys, F.explode(words(*texts)).alias("word"))
    return top_values(said.where((F.col("word") != "") & ~F.col("word").isin(STOP_WORDS)), keys, "word", k)


def popular_in_band(bands: DataFrame, tracks: DataFrame, k: int) -> DataFrame:
    """Per user the k most popular tracks with lo <= popularity <= hi.

    Popularity is a whole number from 0 to 100, so there are few distinct bands: tracks are thinned to
    k per popularity value, ranked once per distinct band, and joined to users on the band.
    """
    per_value = Window.partitionBy("popularity").orderBy("track_id")
    thin = tracks.withColumn("_k", F.row_number().over(per_value)).where(F.col("_k") <= k).drop("_k")
    whole = bands.where(F.col("lo").isNotNull() & F.col("hi").isNotNull()).select(
        "user_id",
        F.greatest(F.ceil("lo"), F.lit(0)).cast("int").alias("lo"),
        F.least(F.floor("hi"), F.lit(100)).cast("int").alias("hi"),
    )
    distinct = whole.where("lo <= hi").select("lo", "hi").distinct()
    values = distinct.select("lo", "hi", F.explode(F.sequence("lo", "hi")).alias("popularity"))
    order = Window.partitionBy("lo", "hi").orderBy(F.desc("popularity"), "track_id")
    best = (
        values.join(thin, "popularity")
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= k)
    )
    return whole.join(best, ["lo", "hi"]).drop("lo", "hi")


def band_sizes(bands: DataFrame, tracks: DataFrame) -> DataFrame:
    """Per user how many tracks lie in the band, from the 101-value popularity histogram."""
    histogram = tracks.groupBy("popularity").agg(F.count(F.lit(1)).alias("n"))
    whole = bands.select(
        "user_id",
        F.greatest(F.ceil("lo"), F.lit(0)).cast("int").alias("lo"),
        F.least(F.floor("hi"), F.lit(100)).cast("int").alias("hi"),
    )
    distinct = whole.where("lo <= hi").select("lo", "hi").distinct()
    sizes = (
        distinct.select("lo", "hi", F.explode(F.sequence("lo", "hi")).alias("popularity"))
        .join(histogram, "popularity")
        .groupBy("lo", "hi")
        .agg(F.sum("n").alias("n_tracks"))
    )
    return whole.join(sizes, ["lo", "hi"], "left").select("user_id", F.coalesce("n_tracks", F.lit(0)).alias("n_tracks"))


def artist_tops(tracks: DataFrame, per_artist: int) -> DataFrame:
    """The most popular tracks of each artist, at most `per_artist`."""
    order = Window.partitionBy("artists").orderBy(F.desc("popularity"), "track_id")
    return tracks.withColumn("artist_rank", F.row_number().over(order)).where(F.col("artist_rank") <= per_artist)


def related_tracks(library: DataFrame, tracks: DataFrame, cap: int) -> DataFrame:
    """Per user: first tracks of the ten most frequent artists, artist by artist, up to `cap`."""
    favourite = top_values(library, ["user_id"], "artists", TOP_ARTISTS).withColumnRenamed("place", "artist_place")
    rows = favourite.join(artist_tops(tracks, PER_RELATED_ARTIST), "artists")
    order = Window.partitionBy("user_id").orderBy("artist_place", "artist_rank")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap)


def keyword_list_tracks(top_words: DataFrame, lists: DataFrame, cap: int) -> DataFrame:
    """top_words(user_id, word, place); lists(list_id, list_name, position, track_id).

    A list matches a keyword that is one of its name's words: an equi-join on the word.
    """
    order_lists = Window.partitionBy("word").orderBy("list_id")
    named = (
        lists.select("list_id", F.explode(F.array_distinct(words("list_name"))).alias("word"))
        .where("word <> ''")
        .distinct()
        .withColumn("list_place", F.row_number().over(order_lists))
        .where(F.col("list_place") <= LISTS_PER_KEYWORD)
    )
    order_tracks = Window.partitionBy("list_id").orderBy("position", "track_id")
    heads = lists.withColumn("track_place", F.row_number().over(order_tracks)).where(F.col("track_place") <= PER_LIST)
    chosen = top_words.where(F.col("place") <= TOP_KEYWORDS).withColumnRenamed("place", "word_place")
    rows = chosen.join(named, "word").join(heads.select("list_id", "track_place", "track_id"), "list_id")
    order = Window.partitionBy("user_id").orderBy("word_place", "list_place", "track_place")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap)


def profile_discovery(profile: DataFrame, favourites: DataFrame, tracks: DataFrame, curated: DataFrame, n: int) -> DataFrame:
    """Three strategies per user, earlier ones first, n rows in all.

    profile(user_id, avg_popularity, popularity_std); favourites(user_id, artists, place);
    curated(list_order, position, track_id). Each strategy is capped per user before they are merged.
    """
    named = tracks.select("track_id", "track_name", "artists", "popularity")
    band = profile.select(
        "user_id",
        (F.col("avg_popularity") - F.col("popularity_std")).alias("lo"),
        (F.col("avg_popularity") + F.col("popularity_std")).alias("hi"),
    )
    within = (F.col("popularity") >= F.col("lo")) & (F.col("popularity") <= F.col("hi"))
    same = (
        favourites.where(F.col("place") <= SAME_ARTIST["artists"])
        .join(artist_tops(named, SAME_ARTIST["per_artist"]), "artists")
        .join(band, "user_id")
        .where(within)
        .select("user_id", "track_id", "track_name", "artists", "popularity",
                F.lit(SAME_ARTIST["score"]).alias("sim"), F.lit("Same Artist").alias("source"),
                F.lit(1).alias("strategy_order"), (F.col("place") * 100 + F.col("artist_rank")).alias("within_order"))
    )
    pool = named.orderBy(F.desc("popularity"), "track_id").limit(POPULARITY_MATCH["tracks"])
    pool_rank = Window.orderBy(F.desc("popularity"), "track_id")
    numbered = pool.withColumn("pool_rank", F.row_number().over(pool_rank))
    match = _offer(band, numbered, "pool_rank").where(within).select(
        "user_id", "track_id", "track_name", "artists", "popularity",
        F.lit(POPULARITY_MATCH["score"]).alias("sim"), F.lit("Popularity Match").alias("source"),
        F.lit(2).alias("strategy_order"), F.col("pool_rank").alias("within_order"),
    )
    heads = (
        curated.where(F.col("position") <= CURATED["per_list"])
        .join(named, "track_id")
        .withColumn("within_order", F.col("list_order") * 100 + F.col("position"))
    )
    listed = _offer(band, heads, "within_order").select(
        "user_id", "track_id", "track_name", "artists", "popularity",
        F.lit(CURATED["score"]).alias("sim"), F.lit("Curated").alias("source"),
        F.lit(3).alias("strategy_order"), "within_order",
    )
    order = Window.partitionBy("user_id").orderBy("strategy_order", "within_order", "track_id")
    return (
        same.unionByName(match)
        .unionByName(listed)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n)
        .drop("within_order")
    )


def _offer(users: DataFrame, pool: DataFrame, order: str) -> DataFrame:
    """Offer a fixed short list (20 or 15 tracks by its definition) to every user as one packed row."""
    packed = pool.agg(
        F.sort_array(F.collect_list(F.struct(order, *[c for c in ("track_id", "track_name", "artists", "popularity")]))).alias("offer")
    )
    return users.select("user_id", "lo", "hi", F.inline(packed.scalar()))
