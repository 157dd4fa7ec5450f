"""Recommendations for every listener in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palate import session
from palate.operators.discovery import profile_discovery
from palate.operators.quality import MIN_LIBRARY
from palate.operators.ranking import (
    MMR_POOL,
    OVERFETCH,
    SETTLED,
    Spread,
    diversify,
    diversify_heads,
    merge_moods,
    mix_sources,
    mood_quotas,
    seed_candidates,
    seed_neighbours,
    spread,
)
from palate.operators.similarity import nearest_tracks
from palate.operators.sweep import Walked, readable, unique
from palate.operators.taste import mood_counts, music_profile, profile_vectors, top_values, with_mood
from palate.schema import METADATA_COLS, standardize_columns
from palate.session import stage

#: How much deeper than the walk's n its first look goes (at least), and by how much each further look is deeper.
SPARE_ROWS, DEEPER = 64, 4
QUICK_DIVERSITY, FALLBACK_DIVERSITY = 0.1, 0.3
EXTRA_PER_MOOD = 5
DEFAULT_MOODS = ["High Energy", "Chill", "Medium Energy"]
# Energy preferences and the energy each one accepts.
ENERGY_PREFERENCES = {
    "High Energy": (0.7, None),
    "Medium Energy": (0.4, 0.7),
    "Low Energy": (None, 0.4),
}


@dataclass
class Inputs:
    """library(user_id, track_id, ...), tracks (catalog with features), catalog (tracks with `vec`).

    `absent`, with the catalog's columns, holds library tracks outside the catalog: they count as seeds, never as candidates.

    The row counts are upper bounds, from table footers for instance; they size the similarity grid.
    Without them the tables are staged and counted.
    """

    library: DataFrame
    tracks: DataFrame
    catalog: DataFrame
    n_listeners: int | None = None
    n_catalog: int | None = None
    absent: DataFrame | None = None

    @property
    def embedded(self) -> DataFrame:
        """All tracks with a vector."""
        return self.catalog if self.absent is None else self.catalog.unionByName(self.absent)

    def __post_init__(self):
        self.library = standardize_columns(self.library)
        self.tracks = standardize_columns(self.tracks)


def eligible_library(inputs: Inputs, minimum: int = MIN_LIBRARY) -> DataFrame:
    """Library rows with complete features and a vector, of listeners who have enough of them; `in_catalog` counts."""
    usable = inputs.library.select("user_id", "track_id").join(
        inputs.embedded.select("track_id", *_features(inputs)), "track_id"
    )
    owns = usable.groupBy("user_id").agg(F.count(F.lit(1)).alias("in_catalog"))
    return usable.join(owns.where(F.col("in_catalog") >= minimum), "user_id")


def _features(inputs: Inputs) -> list[str]:
    return [c for c in inputs.catalog.columns if c in ("energy", "danceability", "valence", "acousticness", "instrumentalness")]


def profile_top(inputs: Inputs, k: int, library: DataFrame | None = None, packed: bool = False) -> DataFrame:
    """The k unseen tracks nearest to each listener's weighted mean vector; packed: one row per listener, the list in `near`."""
    profiles = profile_vectors(library if library is not None else inputs.library, inputs.embedded)
    found = nearest_tracks(
        profiles.select(F.col("user_id").alias("query_id"), "vec"),
        inputs.catalog,
        k,
        exclude=_owned(inputs).withColumnRenamed("user_id", "query_id"),
        n_queries=inputs.n_listeners,
        n_catalog=inputs.n_catalog,
        packed=packed,
    )
    return found.withColumnRenamed("query_id", "user_id")


def diversified_profile_top(inputs: Inputs, n: int) -> DataFrame:
    """All unseen tracks of a listener in order of similarity to the mean vector, walked down to n (`diversify`): user_id, rank, track_id, sim.

    The walk seldom needs a list's end. It reads the heads of all lists, and deeper ones only of lists whose end could still
    change the result, at last whole lists; so no list is longer than needed anywhere. Heads are walked where they are found, and
    leave there as n rows. Where a track comes more than once or tasks cannot read the shared folder, heads are shuffled to be walked.
    """
    names = inputs.tracks.select("track_id", "track_name", "artists").join(inputs.catalog.select("track_id"), "track_id", "left_semi")
    names = stage(names, "names")
    known = names.agg(F.countDistinct(F.lower("artists")).alias("artists"), F.count_if(F.col("artists").isNull()).alias("without")).first()
    n_artists = None if known["without"] else known["artists"]
    n_catalog = inputs.catalog.count() if inputs.n_catalog is None else inputs.n_catalog
    depth, done = n + max(SPARE_ROWS, n // 8), None
    profiles = profile_vectors(inputs.library, inputs.embedded).select(F.col("user_id").alias("query_id"), "vec")
    if unique(names) and unique(inputs.catalog) and readable(names.sparkSession):
        # The walk ends where the list is found.
        depth = min(depth, max(n_catalog, 1))
        return nearest_tracks(
            profiles,
            _numbered(inputs.catalog, names),
            depth,
            exclude=_owned(inputs).withColumnRenamed("user_id", "query_id"),
            n_queries=inputs.n_listeners,
            n_catalog=n_catalog,
            finish=Walked(n, depth, DEEPER, n_artists),
        ).withColumnRenamed("query_id", "user_id")
    profiles = stage(profiles, "profiles")
    while True:
        heads = nearest_tracks(
            profiles,
            inputs.catalog,
            min(depth, max(n_catalog, 1)),
            exclude=_owned(inputs).withColumnRenamed("user_id", "query_id"),
            n_queries=inputs.n_listeners,
            n_catalog=n_catalog,
        )
        named = heads.withColumnRenamed("query_id", "user_id").drop("rank").join(names, "track_id")
        walked = stage(diversify_heads(named, n, ["user_id"], n_artists), "walked")
        whole = depth >= n_catalog
        final = (walked if whole else walked.where(SETTLED)).select("user_id", "rank", "track_id", "sim")
        done = final if done is None else done.unionByName(final)
        if whole:
            return done
        again = walked.where(~F.col(SETTLED)).select(F.col("user_id").alias("query_id"))
        if again.isEmpty():
            return done
        profiles, depth = stage(profiles.join(again, "query_id", "left_semi"), "profiles"), depth * DEEPER


def _numbered(catalog: DataFrame, names: DataFrame) -> DataFrame:
    """track_id, vec, and as artist and title the smallest track that has the same one, NULL where a track has none."""
    out = names.select("track_id", F.lower("artists").alias("_artist"), F.lower("track_name").alias("_title"))
    for column in ("artist", "title"):
        first = out.where(F.col(f"_{column}").isNotNull()).groupBy(f"_{column}").agg(F.min("track_id").alias(column))
        out = out.join(first, f"_{column}", "left")
    return catalog.select("track_id", "vec").join(out.select("track_id", "artist", "title"), "track_id")


def _owned(inputs: Inputs) -> DataFrame:
    return inputs.library.select("user_id", "track_id")


def _named(recs: DataFrame, inputs: Inputs, rows: int = 0) -> DataFrame:
    """Rows with their track's names. ``rows``, at most one per listener and track (or few), sizes the tasks: a track that all
    listeners get is dealt to several by a salt.
    """
    names = inputs.tracks.select(*METADATA_COLS)
    if rows <= session.TASK_ROWS:
        return recs.join(names, "track_id")
    salts = -(-(inputs.library.select("user_id").distinct().count() if inputs.n_listeners is None else inputs.n_listeners) // session.TASK_ROWS)
    salted = recs.withColumn("_salt", F.pmod(F.xxhash64("user_id"), F.lit(max(salts, 1))).cast("int"))
    names = names.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(max(salts, 1) - 1))))
    key = ["track_id", "_salt"]
    return session.by_key(salted, rows, *key).join(session.by_key(names, rows, *key), key).drop("_salt")


def _with_source(recs: DataFrame, inputs: Inputs) -> DataFrame:
    source = inputs.tracks.select(
        F.col("track_id").alias("seed_id"), F.col("track_name").alias("source_track"), F.col("artists").alias("source_artist")
    )
    return recs.join(source, "seed_id", "left")


def _seeds(inputs: Inputs, tracks: DataFrame) -> DataFrame:
    """Those of the tracks that sit in some library."""
    return tracks.select("track_id", "vec").join(inputs.library.select("track_id"), "track_id", "left_semi")


def similar_to_seeds(inputs: Inputs, n: int) -> DataFrame:
    """Per listener: unseen tracks near any of their tracks, diversified to n."""
    near = seed_neighbours(_seeds(inputs, inputs.embedded), inputs.catalog, OVERFETCH * n, inputs.n_catalog)
    rows = stage(eligible_library(inputs).select("user_id", "track_id", "in_catalog"), "eligible")
    candidates = seed_candidates(rows, near, _owned(inputs), n, ["user_id"])
    n_rows = rows.count() * n
    listed = diversify(_named(candidates, inputs, n_rows), n, ["user_id"], n_rows)
    return _with_source(listed, inputs)


def recommend(inputs: Inputs, n: int = 20, quick: bool = False, seed: int | None = 42) -> DataFrame:
    """The standard recommender: near the listener's tracks, or near the mean vector when `quick`.

    Listeners for whom no seed names an unseen track fall back to the mean vector.
    """
    if quick:
        return _named(profile_spread(inputs, n, QUICK_DIVERSITY, seed), inputs)
    listed = stage(similar_to_seeds(inputs, n), "listed")
    without = eligible_library(inputs).join(listed.select("user_id"), "user_id", "left_anti")
    fallback = profile_spread(
        inputs, n, FALLBACK_DIVERSITY, seed, library=without.select("user_id", "track_id")
    )
    columns = ["user_id", "rank", *METADATA_COLS, "sim", "source_track", "source_artist"]
    blank = F.lit(None).cast("string")
    return listed.select(*columns).unionByName(
        _named(fallback, inputs).withColumns({"source_track": blank, "source_artist": blank}).select(*columns)
    )


def profile_spread(inputs: Inputs, n: int, diversity: float, seed: int | None, library: DataFrame | None = None) -> DataFrame:
    """Near the mean vector, n of the best 3n of each listener, traded for distance from each other (`spread`)."""
    profiles = profile_vectors(library if library is not None else inputs.library, inputs.embedded)
    owned = _owned(inputs).withColumnRenamed("user_id", "query_id")
    return _spread_near(inputs, profiles, owned, inputs.n_listeners, n, diversity, seed)


def _spread_near(inputs: Inputs, profiles: DataFrame, owned: DataFrame, n_queries: int | None, n: int, diversity: float, seed: int | None) -> DataFrame:
    """`spread` of the lists of profiles(user_id, vec). Pools are spread where they are found, next to the vectors, if each track is there once."""
    alone = unique(inputs.catalog) and readable(inputs.catalog.sparkSession)
    found = nearest_tracks(
        profiles.select(F.col("user_id").alias("query_id"), "vec"),
        inputs.catalog,
        MMR_POOL * n,
        exclude=owned,
        n_queries=n_queries,
        n_catalog=inputs.n_catalog,
        finish=Spread(n, MMR_POOL * n, diversity, seed) if alone else None,
    ).withColumnRenamed("query_id", "user_id")
    return found if alone else spread(found, inputs.catalog, n, diversity, seed)


def mood_lists(inputs: Inputs, moods: list[str], per_mood: int) -> DataFrame:
    """One diversified list per (listener, requested mood), all moods in one pass."""
    wanted = F.col("mood").isin(moods)
    seeds = _seeds(inputs, with_mood(inputs.embedded).where(wanted))
    near = seed_neighbours(seeds, inputs.catalog, OVERFETCH * per_mood, inputs.n_catalog)
    keys = ["user_id", "mood"]
    rows = stage(with_mood(eligible_library(inputs)).where(wanted).select(*keys, "track_id", "in_catalog"), "eligible")
    candidates = seed_candidates(rows, near, _owned(inputs), per_mood, keys)
    n_rows = rows.count() * per_mood
    return diversify(_named(candidates, inputs, n_rows), per_mood, keys, n_rows)


def quick_mood_lists(inputs: Inputs, moods: list[str], per_mood: int, diversity: float, seed: int | None) -> DataFrame:
    """One list per (listener, requested mood) near the mean vector of the listener's tracks of that mood.

    Listener and mood make one key, so all moods are one search.
    """
    place = F.coalesce(*[F.when(F.col("mood") == m, F.lit(i)) for i, m in enumerate(moods)])
    rows = with_mood(eligible_library(inputs)).where(F.col("mood").isin(moods))
    keyed = rows.select((F.col("user_id") * len(moods) + place).alias("user_id"), "track_id")
    profiles = stage(profile_vectors(keyed, inputs.embedded, minimum=1), "mood_profiles")
    owned = _owned(inputs).withColumn("_place", F.explode(F.sequence(F.lit(0), F.lit(len(moods) - 1))))
    owned = owned.select((F.col("user_id") * len(moods) + F.col("_place")).alias("query_id"), "track_id")
    owned = owned.join(profiles.select(F.col("user_id").alias("query_id")), "query_id", "left_semi")
    n_queries = None if inputs.n_listeners is None else inputs.n_listeners * len(moods)
    picked = _spread_near(inputs, profiles, owned, n_queries, per_mood, diversity, seed)
    mood = F.element_at(F.array(*[F.lit(m) for m in moods]), (F.pmod("user_id", F.lit(len(moods))) + 1).cast("int"))
    user = F.expr(f"(user_id - pmod(user_id, {len(moods)})) div {len(moods)}")
    return _named(picked.select(user.alias("user_id"), mood.alias("mood"), "rank", "track_id", "sim"), inputs)


def recommend_by_mood(
    inputs: Inputs,
    n: int = 20,
    moods: list[str] = DEFAULT_MOODS,
    weigh_by_taste: bool = True,
    diversity_level: float = 0.3,
    energy_preference: str = "Match My Taste",
    quick: bool = False,
    seed: int | None = 42,
    apply_energy: bool = False,
) -> DataFrame:
    """Balanced over the requested moods by the listener's own shares.

    `quick` searches near each mood's mean vector and spreads by `diversity_level`; without it that level has no effect. The energy
    preference passes lists through unless `apply_energy`.
    """
    order = F.coalesce(*[F.when(F.col("mood") == m, F.lit(i)) for i, m in enumerate(moods)])
    per_mood = n // len(moods) + EXTRA_PER_MOOD
    if quick:
        lists = quick_mood_lists(inputs, moods, per_mood, diversity_level, seed).withColumn("seed_id", F.lit(None).cast("bigint"))
    else:
        lists = mood_lists(inputs, moods, per_mood)
    merged = merge_moods(lists.drop("rank").withColumn("mood_order", order).withColumnRenamed("mood", "source_mood"))
    merged = prefer_energy(stage(merged, "merged"), inputs.tracks, energy_preference, active=apply_energy)
    shares = None
    if weigh_by_taste:
        moody = with_mood(inputs.library.select("user_id", "track_id").join(inputs.tracks, "track_id"))
        shares = mood_counts(moody).withColumnRenamed("mood", "source_mood")
    return _with_source(mood_quotas(merged, n, shares), inputs).drop("mood_order")


def prefer_energy(recs: DataFrame, tracks: DataFrame, preference: str, active: bool = True) -> DataFrame:
    """Keep tracks of the preferred energy. Inactive (the standard behaviour) the list passes through."""
    if not active or preference not in ENERGY_PREFERENCES:
        return recs
    low, high = ENERGY_PREFERENCES[preference]
    wanted = tracks.select("track_id", "energy").where(F.col("energy").isNotNull())
    if low is not None:
        wanted = wanted.where(F.col("energy") > low if preference == "High Energy" else F.col("energy") >= low)
    if high is not None:
        wanted = wanted.where(F.col("energy") <= high if preference == "Medium Energy" else F.col("energy") < high)
    return recs.join(wanted.select("track_id"), "track_id", "left_semi")


def smart_mix(inputs: Inputs, curated: DataFrame, n: int = 20) -> DataFrame:
    """Half from the catalog recommender, half from discovery, ranked together."""
    full = inputs.library.select("user_id", "track_id").join(inputs.tracks, "track_id")
    profile = music_profile(full).select("user_id", "avg_popularity", "popularity_std")
    favourites = top_values(full, ["user_id"], "artists", 3)
    found = profile_discovery(profile, favourites, inputs.tracks, curated, n // 2)
    cols = ["user_id", "track_id", "track_name", "artists", "popularity", "sim", "source", "source_order", "source_rank"]
    near = similar_to_seeds(inputs, n // 2).withColumns(
        {"source": F.lit("Catalog"), "source_order": F.lit(0), "source_rank": F.col("rank")}
    )
    out = found.withColumns({"source_order": F.lit(1), "source_rank": F.col("rank")})
    return mix_sources(near.select(*cols).unionByName(out.select(*cols)), n)


def held_out_check(catalog: DataFrame, test_ids: DataFrame, n: int = 10, n_catalog: int | None = None) -> DataFrame:
    """Every held-out track as a listener who owns just that track."""
    queries = catalog.join(test_ids.select("track_id"), "track_id", "left_semi")
    own = queries.select(F.col("track_id").alias("query_id"), "track_id")
    vectors = queries.select(F.col("track_id").alias("query_id"), "vec")
    return nearest_tracks(vectors, catalog, n, exclude=own, n_queries=n_catalog, n_catalog=n_catalog)

