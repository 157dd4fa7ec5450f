"""Session defaults and durable staging of intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a task whose size is set by the number of rows, not by compressed bytes.
TASK_ROWS = 1 << 19
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName("palate")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master).config("spark.driver.memory", "8g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def staging_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a scratch folder only for a single-process master."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="palate-stage-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named


def new_path(spark: SparkSession, label: str) -> str:
    return f"{staging_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage, so a lost executor re-reads files instead of recomputing the plan, and makes
    row counts a footer read. Once the table is written, nothing needs the shuffles behind it: their files go at once, not
    when the driver happens to collect garbage.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    before = spark.conf.get(CLEAN_SHUFFLES, "false")
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def task_slots(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, 1)


def fill_slots(df: DataFrame) -> DataFrame:
    """Spread a scan of fewer tasks than the cluster has slots, for work that is heavy per row.

    A table of many files scans in many tasks and is left alone.
    """
    slots = task_slots(df.sparkSession)
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


def by_key(df: DataFrame, rows: int, *keys: str, always: bool = False) -> DataFrame:
    """Placed by keys that few rows share, in tasks of bounded size; up to TASK_ROWS rows are left to the engine (or placed in tasks of
    its choice: ``always``).

    Adaptive execution packs tasks by compressed bytes: of narrow rows that is millions per task, each branch of a union adds its own sort
    to the same task, and beyond the width of a shuffle tasks grow with the table. ``rows``, any upper bound, only sizes the tasks.
    """
    if rows > TASK_ROWS:
        return df.repartition(max(-(-rows // TASK_ROWS), task_slots(df.sparkSession)), *keys)
    return df.repartition(*keys) if always else df


def even_keys(spark: SparkSession, n: int, parts: int) -> Column:
    """An array of n different keys (bigint) which `repartition(parts, key)` deals evenly: key i goes where key i + parts goes, and no other.

    Few heavy keys numbered in a row would meet by hash: of eight in eight tasks, one task mostly gets two or three and others
    none. Any distinct keys are right; where a place has too few candidates, the next best ones are taken.
    """
    order = Window.partitionBy("place").orderBy("id")
    placed = spark.range(32 * n).select("id", F.pmod(F.hash("id"), F.lit(parts)).alias("place"))
    ranked = placed.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= -(-n // parts) + 1)
    return F.array(*[F.lit(r["id"]).cast("bigint") for r in ranked.orderBy("turn", "place").limit(n).collect()])
