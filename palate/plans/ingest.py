"""Collecting libraries and growing the catalog."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palate.operators.catalog import (
    CATALOG_TARGET,
    attach_features,
    cache_misses,
    expand,
    insert_absent,
)
from palate.operators.quality import complete
from palate.operators.ranking import keep_first
from palate.plans.crosswalk import Crosswalk, feature_chain
from palate.schema import FEATURES, canonical
from palate.session import stage


@dataclass
class Ingested:
    library_rows: DataFrame
    catalog_rows: DataFrame
    misses: DataFrame
    catalog: DataFrame


def ingest_batch(landed: DataFrame, features: DataFrame, library: DataFrame, catalog: DataFrame) -> Ingested:
    """One batch of landed items (user_id, added_at, source_priority, metadata).

    New library rows of tracks that have features, ids whose features are unknown, the cleaned catalog, and the rows the
    batch adds to it. The same function serves the batch job and the stream.
    """
    valid = landed.where(F.col("track_id").isNotNull())
    order = [F.col("source_priority"), F.col("added_at"), F.col("event_id")]
    new_rows = gated_rows(valid, features, library, order)
    misses = cache_misses(valid, features)
    cleaned = complete(catalog)
    meta = keep_first(valid, ["track_id"], order).select("track_id", "track_name", "artists", "popularity")
    grown = canonical(attach_features(meta, features)).join(cleaned.select("track_id"), "track_id", "left_anti")
    return Ingested(new_rows, grown, misses, cleaned.select(*grown.columns).unionByName(grown))


def gated_rows(landed: DataFrame, features: DataFrame, library: DataFrame, order: list, keys: list[str] | None = None) -> DataFrame:
    """The library rows a batch adds: tracks without features wait until they have some."""
    usable = landed.join(features.select("track_id").distinct(), "track_id", "left_semi")
    return insert_absent(library, usable, keys or ["user_id", "track_id"], order)


@dataclass
class Collected:
    sources: DataFrame
    users: DataFrame
    library_rows: DataFrame
    catalog: DataFrame


def collect(
    landed: DataFrame,
    features: DataFrame,
    foreign: DataFrame,
    foreign_features: DataFrame,
    crosswalk: Crosswalk,
    users: DataFrame,
    library: DataFrame,
    catalog: DataFrame,
    batch_id: int,
    found: DataFrame | None = None,
    target: int = CATALOG_TARGET,
) -> Collected:
    """The whole job for one batch: users, features through all catalogs, gated library rows, cleaned and grown catalog.

    landed(user_id, display_name, track_id, title, artists, album, isrc, popularity, source_priority, added_at, event_id); of a
    track's rows the first names it. With ``found`` the catalog also grows towards ``target`` from search results.
    """
    valid = stage(landed.where(F.col("track_id").isNotNull()), "landed")
    order = [F.col("source_priority"), F.col("added_at"), F.col("event_id")]
    tracks = stage(keep_first(valid, ["track_id"], order), "landed_tracks")
    chain = stage(feature_chain(tracks, features, foreign, foreign_features, crosswalk, batch_id), "chain")
    new_users = keep_first(landed.where(F.col("user_id").isNotNull()).select("user_id", "display_name"), ["user_id"], [F.col("display_name")])
    new_users = new_users.join(users.select("user_id"), "user_id", "left_anti")
    rows = valid.withColumnRenamed("title", "track_name")
    batch = ingest_batch(rows, chain.select("track_id", *FEATURES), library, catalog)
    grown = batch.catalog
    if found is not None:
        grown = stage(grown, "grown")
        grown = grown.unionByName(expand_catalog(grown, found, features, target).select(*grown.columns))
    return Collected(chain.select("track_id", "source", "foreign_id"), new_users, batch.library_rows, grown)


def expand_catalog(catalog: DataFrame, found: DataFrame, features: DataFrame, target: int = CATALOG_TARGET) -> DataFrame:
    """Rows that bring a catalog towards `target`; none if it is there already."""
    needed = target - catalog.count()
    if needed <= 0:
        return canonical(catalog).limit(0)
    return expand(catalog, found, features, needed)
