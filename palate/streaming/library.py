"""Libraries as a stream: incremental ingest and the growth counter behind retraining."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palate.operators.catalog import cache_misses
from palate.plans.ingest import gated_rows
from palate.sources.files import read_parquet

LIBRARY = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("track_id", T.LongType()),
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
    ]
)
KEYS = ["user_id", "track_id"]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def new_additions(additions: DataFrame) -> DataFrame:
    """The rows of a stream of additions that name a (listener, track) for the first time, for a sink in update mode.

    The first batch that names a pair stores its earliest row (without a time last); whatever comes later is a repeat. The state is one
    small value per pair in the state store, so a batch reads its own rows and the state of its own pairs; a repeated or late row meets
    the state however long ago its pair was stored, also after a restart from the checkpoint. A batch's own time is written down with
    its offsets: a pair is new where it is the only one that the state has seen, in a replay too.
    """
    whole = additions.where(F.col("user_id").isNotNull() & F.col("track_id").isNotNull() & F.col("event_id").isNotNull())
    earliest = F.min(F.struct(F.col("ts").isNull(), "ts", "event_id")).alias("first")
    seen = whole.withColumn("batch", F.current_timestamp()).groupBy(*KEYS)
    seen = seen.agg(earliest, F.min("batch").alias("since"), F.max("batch").alias("until")).where(F.col("since") == F.col("until"))
    return seen.select("user_id", "track_id", "first.event_id", "first.ts")


def library_sink(path: str, misses_path: str, features: DataFrame) -> Callable[[DataFrame, int], None]:
    """Store a batch of new additions and the tracks whose features are unknown.

    Each batch overwrites its own directory, so a retry after a lost executor or driver writes the same rows again. Nothing
    that was stored before is read.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.select(*[f.name for f in LIBRARY.fields]).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        # The stream is read once per batch; what was just written stands for it.
        written = batch.sparkSession.read.schema(LIBRARY).parquet(f"{path}/batch_id={batch_id}")
        cache_misses(written, features).write.mode("overwrite").parquet(f"{misses_path}/batch_id={batch_id}")

    return store


def ingest_stream(additions: DataFrame, path: str, misses_path: str, features: DataFrame, checkpoint: str):
    """additions: a stream of (event_id, user_id, track_id, ts). A track is stored with or without features, as a stream
    cannot ask for a row again; `usable_library` shows those that have some by now.
    """
    spark = additions.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return (
            new_additions(additions)
            .writeStream.outputMode("update")
            .foreachBatch(library_sink(path, misses_path, features))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        spark.conf.set(PROVIDER, before)


def usable_library(stored: DataFrame, features: DataFrame) -> DataFrame:
    """Stored additions whose track has features, by the gate of the batch job."""
    return gated_rows(stored, features, stored.limit(0), [F.col("ts"), F.col("event_id")])


def growth_stream(additions: DataFrame, path: str, checkpoint: str):
    """Additions per day. Each batch stores the counts of its own rows and overwrites them when replayed;
    a day is the sum over batches, so late rows count."""

    def store(batch: DataFrame, batch_id: int) -> None:
        daily = batch.groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("added"))
        daily.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        additions.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_growth(spark: SparkSession, path: str) -> DataFrame:
    """The count of each day: the sum of what the batches added to it."""
    schema = "day timestamp, added bigint, batch_id bigint"
    rows = read_parquet(spark, path, T._parse_datatype_string(schema))
    return rows.groupBy("day").agg(F.sum("added").alias("added"))


def read_library(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*[f.name for f in LIBRARY.fields])


def event_additions(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Landed play events as library additions: the JSON payload names the track."""
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
        .select(
            "event_id",
            "user_id",
            F.get_json_object("props", "$.k").cast("bigint").alias("track_id"),
            F.col("ts").cast("timestamp").alias("ts"),
        )
    )
