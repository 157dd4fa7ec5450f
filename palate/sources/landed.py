"""Landed service payloads: nested items and feature responses to flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palate.functions.text import join_artists
from palate.schema import FEATURES

ITEM = """
    track struct<
        id: bigint, name: string, popularity: int, album: struct<name: string>,
        artists: array<struct<name: string>>, external_ids: struct<isrc: string>
    >
"""
FEATURE_RESPONSE = (
    "content array<struct<id: bigint, acousticness: double, danceability: double, energy: double,"
    " instrumentalness: double, key: int, liveness: double, loudness: double, mode: int,"
    " speechiness: double, tempo: double, valence: double>>"
)


def parse_items(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("item", F.from_json(column, ITEM))


def flatten_items(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row per landed item that has a track id; missing popularity counts as 0."""
    track: Column = F.col("item.track")
    return df.select(
        *keep,
        track["id"].alias("track_id"),
        track["name"].alias("track_name"),
        join_artists(F.transform(track["artists"], lambda a: a["name"])).alias("artists"),
        track["album"]["name"].alias("album_name"),
        F.coalesce(track["popularity"], F.lit(0)).alias("popularity"),
        track["external_ids"]["isrc"].alias("isrc"),
    ).where(F.col("track_id").isNotNull())


def flatten_features(df: DataFrame, column: str) -> DataFrame:
    """A response carries many tracks: one row per entry, keyed by its id."""
    entries = df.select(F.inline(F.from_json(column, FEATURE_RESPONSE)["content"]))
    return entries.select(F.col("id").alias("track_id"), *FEATURES)
