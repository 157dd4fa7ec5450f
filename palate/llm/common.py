"""Helpers that several of the training-data operators use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palate.session import stage

# Arrow batches are bounded in bytes: texts have no length limit, so a bound in rows is none.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shuffle_width(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _shape(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b); the component is the smallest id reachable.

    Large-star and small-star rounds: each round is a map-side combined minimum per node and a join on the
    node, so a node with a third of all edges is an ordinary skewed join. Every round is written to the
    shared folder, which cuts the lineage. No edge list or label leaves the executors.
    """
    now = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    shape = _shape(now)
    while shape[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # A node keeps its edge to its smaller neighbours' minimum, and those neighbours get one too.
        now_large = large.where("a <> b").distinct()
        least = now_large.groupBy("a").agg(F.min("b").alias("m"))
        small = now_large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = stage(small.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
        last, shape, now = shape, _shape(after), after
        if shape == last:
            break
    roots = now.select(F.col("b").alias("id")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        roots.select("id", F.col("id").alias("component"))
    )
