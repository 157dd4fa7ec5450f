"""Catalog and library maintenance: keep-first, upsert, search, ranking, batching, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palate.operators.quality import complete
from palate.operators.ranking import keep_first
from palate.schema import FEATURES, canonical

# Popularity floors, caps per search bucket, batch sizes, split shares in percent.
POPULARITY_FLOOR = {"diverse": 20, "trending": 30, "curated": 0}
BUCKET_CAP = {"diverse": 25, "trending": 20, "curated": 15}
STRATEGIES = ["diverse", "trending", "curated"]
FEATURE_BATCH, EXPORT_BATCH, LOAD_BATCH = 40, 100, 1000
TRAIN_SHARE, VALIDATION_SHARE = 64, 16
CATALOG_TARGET = 150_000


def by_popularity() -> list[Column]:
    return [F.desc("popularity"), F.asc("track_id")]


def search(tracks: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """Case-insensitive substring of title or artist; wildcards in the text are taken literally."""
    escaped = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    like = lambda c: F.col(c).ilike(f"%{escaped}%")
    return tracks.where(like("track_name") | like("artists")).orderBy(*by_popularity()).limit(limit)


def feature_range(tracks: DataFrame, bounds: dict[str, tuple[float | None, float | None]], limit: int = 100) -> DataFrame:
    for c, (low, high) in bounds.items():
        if low is not None:
            tracks = tracks.where(F.col(c) >= low)
        if high is not None:
            tracks = tracks.where(F.col(c) <= high)
    return tracks.orderBy(*by_popularity()).limit(limit)


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == value)


def append_unique(existing: DataFrame, new: DataFrame, key: str = "track_id", order: list | None = None) -> DataFrame:
    """Existing rows win; of the new rows the first per key is added: the most popular, then by all other columns."""
    fresh = keep_first(new, [key], order or [F.desc("popularity"), *[F.asc_nulls_last(c) for c in sorted(new.columns) if c not in (key, "popularity")]])
    return existing.unionByName(fresh.join(existing.select(key), key, "left_anti").select(*existing.columns))


def insert_absent(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The rows an insert-if-absent would add: first per key in the batch, keys not stored yet."""
    return keep_first(incoming, keys, order).join(existing.select(*keys), keys, "left_anti")


def cache_misses(needed: DataFrame, cache: DataFrame) -> DataFrame:
    ids = needed.select("track_id").where(F.col("track_id").isNotNull()).distinct()
    return ids.join(cache.select("track_id"), "track_id", "left_anti")


def attach_features(rows: DataFrame, features: DataFrame) -> DataFrame:
    """Rows with the first stored feature row of their track; rows left incomplete are dropped."""
    bare = rows.drop(*[c for c in FEATURES if c in rows.columns])
    one_each = keep_first(features.select("track_id", *FEATURES), ["track_id"], [F.asc_nulls_last(c) for c in FEATURES])
    return complete(bare.join(one_each, "track_id", "left"))


def unresolved_by_popularity(rows: DataFrame, features: DataFrame, size: int = FEATURE_BATCH) -> DataFrame:
    """Rows without features, numbered in batches of the most popular first."""
    return batches(rows.join(features.select("track_id"), "track_id", "left_anti"), by_popularity(), size)


def staged_candidates(found: DataFrame, needed: int) -> DataFrame:
    """found(strategy, bucket, bucket_order, track_id, popularity, ...): cap per bucket, floor, then a
    budget of a third of the need per strategy, taken in bucket order.

    A bucket's rows are ranked within the bucket; how many rows the buckets before it offer comes from running sums over the
    table of bucket sizes, one row per bucket. No window holds a strategy's rows.
    """
    floor = F.coalesce(*[F.when(F.col("strategy") == s, F.lit(v)) for s, v in POPULARITY_FLOOR.items()])
    cap = F.coalesce(*[F.when(F.col("strategy") == s, F.lit(v)) for s, v in BUCKET_CAP.items()])
    key = ["strategy", "bucket_order", "bucket"]
    shown = Window.partitionBy(*key).orderBy(F.desc("popularity"), "track_id")
    largest = max(BUCKET_CAP.values())
    # The floor only cuts the end of a bucket's list, so the rank in the bucket is the rank among what it offers.
    offered = (
        found.withColumn("_shown", F.row_number().over(shown))
        .where(F.col("_shown") <= largest)
        .where((F.col("_shown") <= cap) & (F.col("popularity") >= floor))
    )
    before = Window.partitionBy("strategy").orderBy("bucket_order", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = offered.groupBy(*key).agg(F.count(F.lit(1)).alias("_size"))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    budget = needed // len(STRATEGIES)
    return (
        offered.join(starts.where(F.col("_start") < budget), key)
        .withColumn("taken", (F.col("_start") + F.col("_shown")).cast("int"))
        .where(F.col("taken") <= budget)
        .drop("_shown", "_start")
    )


def expand(catalog: DataFrame, found: DataFrame, features: DataFrame, needed: int) -> DataFrame:
    """New complete catalog rows from staged candidates that the catalog lacks."""
    order = F.coalesce(*[F.when(F.col("strategy") == s, F.lit(i)) for i, s in enumerate(STRATEGIES)])
    staged = staged_candidates(found, needed).withColumn("_s", order)
    new = keep_first(staged, ["track_id"], [F.col("_s"), F.col("taken")])
    return canonical(attach_features(new.join(catalog.select("track_id"), "track_id", "left_anti"), features))


def batches(df: DataFrame, key: str | list[Column], size: int) -> DataFrame:
    """Dense batch numbers in the order of a key or of columns, without sorting the table in one task.

    Range partitions are numbered locally; the start of each partition comes from the small table of
    partition sizes.
    """
    spark = df.sparkSession
    order = [key] if isinstance(key, str) else key
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = ranged.withColumn("_mono", F.monotonically_increasing_id())
    part, local = F.shiftright("_mono", 33), F.col("_mono").bitwiseAND((1 << 33) - 1)
    rows = numbered.select(*df.columns, part.alias("_part"), local.alias("_local"))
    from palate.session import stage

    rows = stage(rows, "batches")
    sizes = rows.groupBy("_part").agg((F.max("_local") + 1).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    index = F.col("_start") + F.col("_local")
    return rows.join(starts, "_part").select(
        *df.columns, index.alias("row_index"), F.floor(index / size).alias("batch_no")
    )


def split_bucket(key: str, buckets: int = 100) -> Column:
    """Stable bucket of a key: the same at every catalog size and row order."""
    return F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint") % buckets


def split_name(bucket: Column) -> Column:
    return (
        F.when(bucket < TRAIN_SHARE, "train")
        .when(bucket < TRAIN_SHARE + VALIDATION_SHARE, "validation")
        .otherwise("test")
    )


def sample_rows(df: DataFrame, n: int, key: str = "track_id", seed: int = 42) -> DataFrame:
    """n rows without replacement, reproducible in any engine: the smallest digests of key and seed."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def table_counts(named: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in named.items():
        row = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = row if out is None else out.unionByName(row)
    return out


def union_sources(sources: list[DataFrame]) -> DataFrame:
    """Library sources in priority order; the first source that names a track provides its row."""
    tagged = [df.withColumn("source_priority", F.lit(i)) for i, df in enumerate(sources)]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df)
    return out
