"""What a library says about its listener: moods, patterns, style, profile vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palate.functions.mood import mood
from palate.functions.text import artist_list
from palate.functions.weights import track_weight
from palate.operators.similarity import CATALOG_ROWS
from palate.operators.sweep import readable, unique, weighted_means
from palate.schema import MOOD_FEATURES, require_columns

# Cut-offs of the listening patterns, in percent.
SECONDARY_OVER = 15
DIVERSE_OVER = 10
DIVERSE_MOODS = 3
SAMPLE_TRACKS = 3
# Profile defaults where a library has no popularity.
DEFAULT_POPULARITY, DEFAULT_POPULARITY_STD = 50.0, 20.0
# Style labels above 0.7 and below 0.3.
STYLE_LABELS = {
    "energy": ("High Energy", "Low Energy"),
    "danceability": ("Danceable", "Not Danceable"),
    "valence": ("Positive Mood", "Negative Mood"),
}
MIN_MOOD_FEATURES = 3


def with_mood(df: DataFrame) -> DataFrame:
    present = [c for c in MOOD_FEATURES if c in df.columns]
    if len(present) < MIN_MOOD_FEATURES:
        require_columns(df, MOOD_FEATURES)
    return df.withColumn("mood", mood(df.columns))


def mood_filter(df: DataFrame, target: str) -> DataFrame:
    return with_mood(df).where(F.col("mood") == target)


def mood_counts(moody: DataFrame) -> DataFrame:
    """Per (user, mood): count and share of all the user's rows. The window sees at most six rows per user."""
    counts = moody.groupBy("user_id", "mood").agg(F.count(F.lit(1)).alias("cnt"))
    total = F.sum("cnt").over(Window.partitionBy("user_id"))
    return counts.withColumn("pct", F.col("cnt") / total * 100)


def mood_statistics(moody: DataFrame) -> DataFrame:
    """Count, share and feature means per (user, mood), from one shuffle of combined rows."""
    means = {f"avg_{c}": F.avg(c) for c in ["energy", "valence", "danceability", "acousticness"]}
    stats = moody.groupBy("user_id", "mood").agg(
        F.count(F.lit(1)).alias("cnt"), *[v.alias(k) for k, v in means.items()]
    )
    total = F.sum("cnt").over(Window.partitionBy("user_id"))
    return stats.withColumn("pct", F.col("cnt") / total * 100)


def sample_tracks(moody: DataFrame, per_mood: int = SAMPLE_TRACKS) -> DataFrame:
    """The newest few tracks per (user, mood); each partition passes on only that many rows."""
    newest = Window.partitionBy("user_id", "mood").orderBy(F.desc("added_at"), "track_id")
    return (
        moody.select("user_id", "mood", "added_at", "track_id", "track_name", "artists")
        .withColumn("position", F.row_number().over(newest))
        .where(F.col("position") <= per_mood)
    )


def taste_summary(moody: DataFrame) -> DataFrame:
    present = F.lit(True)
    for c in MOOD_FEATURES:
        present = present & F.col(c).isNotNull()
    return moody.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_tracks"),
        F.count_if(present).alias("tracks_with_features"),
        F.countDistinct("mood").alias("n_moods"),
    )


def listening_patterns(stats: DataFrame) -> DataFrame:
    """Primary, secondary and diversity rows from (user_id, mood, pct)."""
    order = Window.partitionBy("user_id").orderBy(F.desc("pct"), "mood")
    ranked = stats.select("user_id", "mood", "pct").withColumn("place", F.row_number().over(order))
    folded = ranked.groupBy("user_id").agg(
        F.max(F.when(F.col("place") == 1, F.col("mood"))).alias("mood_1"),
        F.max(F.when(F.col("place") == 1, F.col("pct"))).alias("pct_1"),
        F.max(F.when(F.col("place") == 2, F.col("mood"))).alias("mood_2"),
        F.max(F.when(F.col("place") == 2, F.col("pct"))).alias("pct_2"),
        F.count_if(F.col("pct") > DIVERSE_OVER).alias("broad"),
    )

    def says(text: str, n: int):
        return F.format_string(f"{text} %s music (%.1f%%)", F.lower(f"mood_{n}"), F.bround(f"pct_{n}", 1))

    def row(kind: str, mood_col, pct, description):
        return F.struct(
            F.lit(kind).alias("type"), mood_col.alias("mood"), pct.alias("percentage"), description.alias("description")
        )

    taste = F.when(F.col("broad") >= DIVERSE_MOODS, "You have diverse music taste").otherwise(
        "You have focused music taste"
    )
    secondary = row("Secondary", F.col("mood_2"), F.col("pct_2"), says("You also enjoy", 2))
    rows = F.array_compact(
        F.array(
            row("Primary", F.col("mood_1"), F.col("pct_1"), says("You primarily listen to", 1)),
            F.when(F.col("pct_2") > SECONDARY_OVER, secondary),
            row("Diversity", F.lit("Mixed"), F.lit(0.0), taste),
        )
    )
    return folded.select("user_id", F.inline(rows))


def top_values(df: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    """Most frequent values per key, counted before they are ranked; equal counts by value."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("cnt"))
    order = Window.partitionBy(*keys).orderBy(F.desc("cnt"), value)
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def artists_of(df: DataFrame) -> DataFrame:
    return df.withColumn("artist", F.explode(artist_list(F.col("artists"))))


def music_profile(library: DataFrame, top_artists: int = 10) -> DataFrame:
    """Mean and sample deviation of popularity, track count, most frequent artists."""
    has = "popularity" in library.columns
    mean = F.avg("popularity") if has else F.lit(DEFAULT_POPULARITY)
    std = F.stddev_samp("popularity") if has else F.lit(DEFAULT_POPULARITY_STD)
    numbers = library.groupBy("user_id").agg(
        mean.alias("avg_popularity"), std.alias("popularity_std"), F.count(F.lit(1)).alias("total_tracks")
    )
    names = (
        top_values(library, ["user_id"], "artists", top_artists)
        .groupBy("user_id")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "artists"))), lambda s: s["artists"]).alias("top_artists"))
    )
    return numbers.join(names, "user_id", "left")


def style_summary(library: DataFrame) -> DataFrame:
    """Mean features of each listener and the labels they earn; rows without danceability do not count."""
    means = library.where(F.col("danceability").isNotNull()).groupBy("user_id").agg(
        *[F.avg(c).alias(f"avg_{c}") for c in [*STYLE_LABELS, "popularity"]]
    )
    labels = [
        F.when(F.col(f"avg_{c}") > 0.7, F.lit(high)).when(F.col(f"avg_{c}") < 0.3, F.lit(low))
        for c, (high, low) in STYLE_LABELS.items()
    ]
    return means.withColumn("style", F.array_join(F.array_compact(F.array(*labels)), ", "))


def profile_vectors(library: DataFrame, embedded: DataFrame, minimum: int = 3) -> DataFrame:
    """Weighted mean vector of every listener with enough usable tracks.

    Library rows meet as keys, and vectors are read where they meet (`weighted_means`). Where a track comes more than once or tasks cannot
    read the shared folder, one sum per component in an ordinary hash aggregate with map-side combining: no vector is exploded or collected,
    however large a library is. All vectors have the length of the first one.
    """
    if readable(embedded.sparkSession) and unique(embedded):
        return weighted_means(library, embedded.select("track_id", track_weight().alias("w"), "vec"), minimum, CATALOG_ROWS)
    known = embedded.select(F.size("vec").alias("n")).first()
    places = [f"_{i}" for i in range(known.n if known else 0)]
    weighted = embedded.select("track_id", track_weight().alias("w"), "vec")
    sums = weighted.select("track_id", "w", *[(F.col("vec")[i] * F.col("w")).alias(p) for i, p in enumerate(places)])
    return (
        library.select("user_id", "track_id")
        .join(sums, "track_id")
        .groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("usable_tracks"), F.sum("w").alias("total_weight"), *[F.sum(p).alias(p) for p in places])
        .where(F.col("usable_tracks") >= minimum)
        .select("user_id", "usable_tracks", "total_weight", F.array(*[F.col(p) / F.col("total_weight") for p in places]).cast("array<double>").alias("vec"))
    )
