"""Features through other catalogs, with a memory of what was matched.

A track's features come from its own id, else from the id a crosswalk knows for it, else from the id that title resolution finds now; what
resolution finds is added to the crosswalk, so the next batch resolves only tracks it has never seen, and those that found nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palate.operators.ranking import keep_first
from palate.operators.resolve import resolve_titles
from palate.schema import FEATURES
from palate.session import stage
from palate.sources.files import read_parquet

BUCKETS = 64
TITLED = ["track_id", "title", "artists", "album", "isrc"]


@dataclass
class Crosswalk:
    """(track_id, foreign_id) pairs under one folder, laid out by batch and by bucket of the track.

    A batch writes its own directory anew, so a retry gives the same table; a batch does not see itself or later ones.
    The first pair of a track stays.
    """

    spark: SparkSession
    path: str

    SCHEMA = T.StructType(
        [T.StructField(n, t) for n, t in (("track_id", T.LongType()), ("foreign_id", T.LongType()), ("bucket", T.IntegerType()), ("batch_id", T.LongType()))]
    )

    def pairs(self, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        rows = read_parquet(self.spark, self.path, self.SCHEMA)
        rows = rows if before is None else rows.where(F.col("batch_id") < before)
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def known(self, tracks: DataFrame, before: int) -> DataFrame:
        """The stored pairs of these tracks; only buckets that occur among them are read."""
        asked = tracks.select("track_id", bucket_of("track_id").alias("bucket"))
        touched = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # at most BUCKETS numbers
        return self.pairs(before, touched).join(asked, ["bucket", "track_id"], "left_semi").select("track_id", "foreign_id")

    def remember(self, found: DataFrame, batch_id: int) -> None:
        """Insert if absent: tracks that earlier batches stored keep their pair."""
        new = keep_first(found.select("track_id", "foreign_id"), ["track_id"], [F.col("foreign_id")])
        new = new.withColumn("bucket", bucket_of("track_id"))
        new = new.join(self.known(new, batch_id).select("track_id"), "track_id", "left_anti")
        new.select("track_id", "foreign_id", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/batch_id={batch_id}")


def bucket_of(key: str):
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _one_each(features: DataFrame) -> DataFrame:
    """The first stored feature row of a track, in a total order of its values."""
    return keep_first(features.select("track_id", *FEATURES), ["track_id"], [F.asc_nulls_last(c) for c in FEATURES])


def feature_chain(
    tracks: DataFrame, features: DataFrame, foreign: DataFrame, foreign_features: DataFrame, crosswalk: Crosswalk, batch_id: int
) -> DataFrame:
    """tracks(track_id, title, artists, album, isrc; one row each) -> track_id, source, foreign_id and features, of tracks that have any.

    foreign(foreign_id, title, artists, album, isrc), foreign_features(foreign_id, features). `source` is direct, crosswalk or
    resolved. A pair whose foreign id has no features is remembered too, and the track goes without.
    """
    tracks = stage(tracks.select(*TITLED), "tracks")
    own = _one_each(features)
    direct = tracks.select("track_id").join(own, "track_id").select("track_id", F.lit("direct").alias("source"), F.lit(None).cast("bigint").alias("foreign_id"), *FEATURES)
    rest = stage(tracks.join(own.select("track_id"), "track_id", "left_anti"), "not_direct")
    theirs = _one_each(foreign_features.withColumnRenamed("foreign_id", "track_id")).withColumnRenamed("track_id", "foreign_id")
    known = stage(crosswalk.known(rest, batch_id), "known_pairs")
    by_pair = known.join(theirs, "foreign_id")
    # A known pair without features is looked for again, as is a track without any pair.
    open_ = stage(rest.join(by_pair.select("track_id"), "track_id", "left_anti"), "unresolved")
    resolved = open_.select("track_id").limit(0).withColumn("foreign_id", F.lit(None).cast("bigint"))
    if not open_.isEmpty():
        resolved = stage(resolve_titles(open_, foreign).select("track_id", "foreign_id"), "resolved_pairs")
    crosswalk.remember(resolved, batch_id)
    pick = lambda df, name: df.select("track_id", F.lit(name).alias("source"), "foreign_id", *FEATURES)
    return direct.unionByName(pick(by_pair, "crosswalk")).unionByName(pick(resolved.join(theirs, "foreign_id"), "resolved"))
