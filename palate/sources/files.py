"""Readers and writers: parquet, CSV, JSON, JDBC, and versioned tables."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palate.operators.ranking import keep_first
from palate.schema import FEATURES, catalog_schema, feature_schema, feature_type, nulls_at_source


def read_parquet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table with a known schema; an empty one where nothing has been written yet."""
    try:
        return nulls_at_source(spark.read.schema(schema).parquet(path))
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return read_parquet(spark, path, feature_schema())


def write_features(df: DataFrame, path: str) -> None:
    """One row per track, the first by feature values where sources disagree."""
    keep_first(df, ["track_id"], [F.asc_nulls_last(c) for c in FEATURES]).write.parquet(path)


def read_catalog_csv(spark: SparkSession, path: str) -> DataFrame:
    return nulls_at_source(spark.read.schema(catalog_schema()).option("header", True).csv(path))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options) -> DataFrame:
    """Range-partitioned scan of a relational table; fixed-point features become doubles."""
    df = (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts, **options)
        .load()
    )
    decimals = {f.name: F.col(f.name).cast("double") for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)}
    return df.withColumns(decimals)


def write_jdbc(df: DataFrame, url: str, table: str, batch: int = 1000, **options) -> None:
    """Truncate and reload, `batch` rows per statement."""
    writer = df.write.format("jdbc").mode("overwrite").option("truncate", True).option("batchsize", batch)
    writer.options(url=url, dbtable=table, **options).save()


def typed_catalog(raw: DataFrame) -> DataFrame:
    """Per-column casts of a text catalog; a value that does not cast is missing."""
    casts = {"track_id": "bigint", "popularity": "int"}
    cols = [F.col(c).try_cast(t).alias(c) for c, t in casts.items()]
    cols += [F.col(c).cast("string").alias(c) for c in ("track_name", "artists")]
    cols += [F.col(c).try_cast(feature_type(c)).alias(c) for c in FEATURES]
    return raw.select(*cols)


class VersionedTable:
    """Versions of a table side by side under one folder; `current` is the newest published one.

    A version is written first and published by appending a pointer row, so a lost writer leaves the
    earlier version in place and nothing is overwritten.
    """

    POINTER = "version string, published_at timestamp, n_rows bigint"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def publish(self, df: DataFrame, version: str | None = None) -> str:
        version = version or uuid.uuid4().hex
        target = f"{self.path}/data/version={version}"
        df.write.parquet(target)
        n_rows = self.spark.read.parquet(target).agg(F.count(F.lit(1)).alias("n_rows"))
        pointer = n_rows.select(F.lit(version).alias("version"), F.current_timestamp().alias("published_at"), "n_rows")
        pointer.coalesce(1).write.mode("append").parquet(f"{self.path}/pointer")
        return version

    def history(self) -> DataFrame:
        pointers = self.spark.read.schema(self.POINTER).parquet(f"{self.path}/pointer")
        newest = pointers.agg(F.max_by("version", "published_at")).scalar()
        return pointers.select("version", "n_rows", "published_at", (F.col("version") == newest).alias("is_current"))

    def current(self) -> DataFrame:
        row = self.history().where("is_current").select("version").first()
        return self.spark.read.parquet(f"{self.path}/data/version={row['version']}")

    def version(self, version: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/data/version={version}")


def write_json_report(df: DataFrame, path: str) -> None:
    df.write.json(path)


STATE = "timestamp timestamp, dataset_size bigint, status string"


def append_state(spark: SparkSession, path: str, dataset_size: DataFrame, status: str = "completed", at=None) -> None:
    """One more row in the retraining history; dataset_size is a one-row count."""
    when = F.current_timestamp() if at is None else at
    dataset_size.select(when.alias("timestamp"), F.col("dataset_size"), F.lit(status).alias("status")).coalesce(1).write.mode("append").json(path)


def read_json_state(spark: SparkSession, path: str) -> DataFrame:
    """The retraining history; empty before the first training."""
    try:
        return spark.read.schema(STATE).json(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], STATE)
