"""Evaluation report over all listeners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palate.operators import evaluation as V


def checks(recs: DataFrame, requests: DataFrame, gate: DataFrame, consistency: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Every pass/fail decision as a row (suite, subject, passed)."""
    counted = V.count_compliance(requests, recs, gate).where(F.col("reason").isNull())
    basic = counted.select(F.lit("basic").alias("suite"), F.col("user_id").cast("string").alias("subject"), F.col("met").alias("passed"))
    quality = V.quality(recs, ["user_id"]).select(
        F.lit("quality").alias("suite"),
        F.col("user_id").cast("string").alias("subject"),
        (F.col("avg_similarity") > V.SIMILARITY_OVER).alias("passed"),
    )
    genre = consistency.select(F.lit("consistency").alias("suite"), F.col("genre").alias("subject"), "passed")
    apart = overlaps.select(
        F.lit("diversity").alias("suite"),
        F.concat_ws(" vs ", "a", "b").alias("subject"),
        (F.col("overlap_ratio") < V.OVERLAP_GOOD).alias("passed"),
    )
    return basic.unionByName(quality).unionByName(genre).unionByName(apart)


def report(all_checks: DataFrame) -> DataFrame:
    rolled = V.suite_rollup(all_checks)
    return rolled.withColumn("tier", V.tier(F.col("pass_rate")))
