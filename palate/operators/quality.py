"""Completeness, volume gates and data-quality profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palate.schema import FEATURES, LIBRARY_FEATURES, nulls_at_source, require_columns

MIN_LIBRARY = 3
MIN_TRAINING_ROWS = 1000
TOO_FEW = "Need at least 3 tracks with audio features for good recommendations."
NO_FEATURES = "No tracks with audio features found. Please collect more data."


def is_complete(columns: list[str] = FEATURES) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out


def complete(df: DataFrame) -> DataFrame:
    """Rows with all 11 features."""
    return nulls_at_source(require_columns(df, FEATURES)).dropna(how="any", subset=FEATURES)


def incomplete(df: DataFrame) -> DataFrame:
    return nulls_at_source(require_columns(df, FEATURES)).where(~is_complete())


def clean(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The complete rows, and one row (before, after, removed)."""
    counted = nulls_at_source(df).agg(
        F.count(F.lit(1)).alias("before"), F.count_if(is_complete()).alias("after")
    )
    return complete(df), counted.withColumn("removed", F.col("before") - F.col("after"))


def library_with_features(library: DataFrame, tracks: DataFrame) -> DataFrame:
    """Library rows whose five checked features are present, newest first per listener."""
    rows = library.join(tracks, "track_id").dropna(how="any", subset=LIBRARY_FEATURES)
    return newest_first(rows)


def newest_first(library: DataFrame) -> DataFrame:
    """Each listener's rows one after another, newest first: placed by listener and sorted where they lie, so the table is
    neither sampled nor sorted as a whole."""
    return library.repartition("user_id").sortWithinPartitions("user_id", F.desc("added_at"), "track_id")


def volume_gate(users: DataFrame, usable: DataFrame, minimum: int = MIN_LIBRARY) -> DataFrame:
    """Every user with the usable track count, the verdict and the reason of a rejection."""
    counts = usable.groupBy("user_id").agg(F.count(F.lit(1)).alias("usable_tracks"))
    n = F.coalesce(F.col("usable_tracks"), F.lit(0))
    reason = F.when(n == 0, F.lit(NO_FEATURES)).when(n < minimum, F.lit(TOO_FEW))
    return (
        users.select("user_id")
        .join(counts, "user_id", "left")
        .select("user_id", n.alias("usable_tracks"), (n >= minimum).alias("eligible"), reason.alias("reason"))
    )


def training_gate(tracks: DataFrame, minimum: int = MIN_TRAINING_ROWS) -> DataFrame:
    n_complete = F.count_if(is_complete())
    return nulls_at_source(tracks).agg(
        F.count(F.lit(1)).alias("total_rows"),
        n_complete.alias("complete_rows"),
        (n_complete >= minimum).alias("enough"),
    )


def quality_profile(df: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """One row per column: type, rows, missing, range, mean and sample deviation. One scan."""
    types = dict(df.dtypes)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for c in columns:
        v = F.col(c).cast("double")
        aggs += [
            F.count(c).alias(f"{c}_n"),
            F.min(v).alias(f"{c}_min"),
            F.max(v).alias(f"{c}_max"),
            F.avg(v).alias(f"{c}_mean"),
            F.stddev_samp(v).alias(f"{c}_std"),
        ]
    wide = df.agg(*aggs)
    missing = lambda c: F.col("rows") - F.col(f"{c}_n")
    rows = [
        F.struct(
            F.lit(c).alias("feature"),
            F.lit(types[c]).alias("dtype"),
            F.col("rows").alias("total_rows"),
            missing(c).alias("missing"),
            F.round(missing(c) * 100.0 / F.col("rows"), 6).alias("missing_pct"),
            F.round(F.col(f"{c}_min"), 6).alias("min_value"),
            F.round(F.col(f"{c}_max"), 6).alias("max_value"),
            F.round(F.col(f"{c}_mean"), 6).alias("mean_value"),
            F.round(F.col(f"{c}_std"), 6).alias("std_value"),
        )
        for c in columns
    ]
    return wide.select(F.inline(F.array(*rows)))
