"""Metrics over recommendations, reconstructions and embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palate.functions.vectors import norm, row_error
from palate.operators.similarity import highest_cosine
from palate.schema import FEATURES

# Expected (lowest, highest) of each feature per genre, in genre order.
EXPECTED_RANGES = {
    "rock": {"energy": (0.6, 1.0), "danceability": (0.4, 0.8)},
    "pop": {"energy": (0.5, 0.9), "danceability": (0.6, 0.9)},
    "electronic": {"energy": (0.7, 1.0), "danceability": (0.7, 1.0)},
    "classical": {"energy": (0.1, 0.6), "danceability": (0.1, 0.5)},
    "jazz": {"energy": (0.3, 0.7), "danceability": (0.3, 0.7)},
    "hip_hop": {"energy": (0.5, 0.9), "danceability": (0.6, 0.9)},
    "country": {"energy": (0.3, 0.7), "danceability": (0.4, 0.8)},
    "blues": {"energy": (0.3, 0.7), "danceability": (0.3, 0.6)},
}
GENRES = list(EXPECTED_RANGES)
# Pass marks.
CONSISTENCY_OVER, SIMILARITY_OVER, SENSITIVITY_OVER = 0.6, 0.5, 0.3
OVERLAP_GOOD, OVERLAP_HIGH, OVERLAP_SAME = 0.3, 0.6, 0.8
SUITE_PASS, SUITE_WEAK = 80, 60
TIERS = [(85, "excellent"), (70, "good"), (50, "fair")]
HISTOGRAM_BINS = 50


def quality(recs: DataFrame, keys: list[str]) -> DataFrame:
    return recs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_recs"),
        F.avg("sim").alias("avg_similarity"),
        F.min("sim").alias("min_similarity"),
        F.max("sim").alias("max_similarity"),
        F.stddev_pop("sim").alias("similarity_std"),
        F.avg("popularity").alias("avg_popularity"),
        (F.countDistinct("popularity") / F.count(F.lit(1))).alias("popularity_diversity"),
    )


def distinct_share(recs: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct tracks over rows per group, from counts per (group, track)."""
    per_track = recs.groupBy(*keys, "track_id").agg(F.count(F.lit(1)).alias("n"))
    return per_track.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("distinct_tracks"), F.sum("n").alias("total_tracks")
    ).withColumn("diversity_ratio", F.col("distinct_tracks") / F.col("total_tracks"))


def count_compliance(requests: DataFrame, recs: DataFrame, gate: DataFrame) -> DataFrame:
    """requests(user_id, wanted): rows returned, whether the count was met, or the gate's reason."""
    got = recs.groupBy("user_id").agg(F.count(F.lit(1)).alias("returned"))
    n = F.coalesce("returned", F.lit(0))
    return (
        requests.join(got, "user_id", "left")
        .join(gate.select("user_id", "reason"), "user_id", "left")
        .select("user_id", "wanted", n.alias("returned"), (n == F.col("wanted")).alias("met"), "reason")
    )


def genre_name(index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(g) for g in GENRES]), (index + 1).cast("int"))


def _in_range(feature: str) -> Column:
    low = F.create_map(*[F.lit(x) for g in GENRES for x in (g, EXPECTED_RANGES[g][feature][0])])
    high = F.create_map(*[F.lit(x) for g in GENRES for x in (g, EXPECTED_RANGES[g][feature][1])])
    genre = F.col("genre")
    return F.col(feature).between(low[genre], high[genre]).cast("int")


def genre_consistency(recs: DataFrame, keys: list[str]) -> DataFrame:
    """recs with `genre` and features: share of rows in the expected range, averaged over the features."""
    checked = ["energy", "danceability"]
    shares = [F.avg(_in_range(c)).alias(f"{c}_share") for c in checked]
    mean = sum((F.col(f"{c}_share") for c in checked), F.lit(0.0)) / len(checked)
    return (
        recs.groupBy(*keys, "genre").agg(*shares)
        .withColumn("consistency", mean)
        .withColumn("passed", F.col("consistency") > CONSISTENCY_OVER)
    )


def feature_means(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in FEATURES])


def profile_difference(means: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """pairs(a, b): mean absolute difference of the eleven feature means."""
    packed = means.select(key, F.array(*FEATURES).alias("m"))
    left = packed.select(F.col(key).alias("a"), F.col("m").alias("m_a"))
    right = packed.select(F.col(key).alias("b"), F.col("m").alias("m_b"))
    gaps = F.zip_with("m_a", "m_b", lambda x, y: F.abs(x - y))
    total = F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))
    return (
        pairs.join(left, "a").join(right, "b").select("a", "b", (total / len(FEATURES)).alias("profile_difference"))
    )


def overlap(recs: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """pairs(a, b): Jaccard overlap of their track sets.

    Track lists of a group are bounded by the list length, so the two sides of a pair travel as
    arrays and no inverted index has to pair up everyone who was given a popular track.
    """
    sets = recs.groupBy(key).agg(F.collect_set("track_id").alias("tracks"))
    left = sets.select(F.col(key).alias("a"), F.col("tracks").alias("t_a"))
    right = sets.select(F.col(key).alias("b"), F.col("tracks").alias("t_b"))
    shared, union = F.size(F.array_intersect("t_a", "t_b")), F.size(F.array_union("t_a", "t_b"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .select("a", "b", shared.alias("overlap_count"), union.alias("total_unique"))
        .withColumn(
            "overlap_ratio",
            F.when(F.col("total_unique") > 0, F.col("overlap_count") / F.col("total_unique")).otherwise(0.0),
        )
        .withColumn(
            "status",
            F.when(F.col("overlap_ratio") < OVERLAP_GOOD, "good")
            .when(F.col("overlap_ratio") < OVERLAP_HIGH, "high")
            .otherwise("very high"),
        )
    )


def reconstruction_metrics(df: DataFrame) -> DataFrame:
    """df(x, y): error metrics of all elements and of the per-row error."""
    absolute = F.aggregate(F.zip_with("x", "y", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda acc, v: acc + v)
    per_row = df.select(row_error(F.col("x"), F.col("y")).alias("err"), (absolute / F.size("x")).alias("abs_err"))
    out = per_row.agg(
        F.avg("err").alias("mse"),
        F.avg("abs_err").alias("mae"),
        F.avg("err").alias("mean_reconstruction_error"),
        F.stddev_pop("err").alias("std_reconstruction_error"),
    )
    return out.withColumn("rmse", F.sqrt("mse"))


def feature_errors(df: DataFrame, names: list[str]) -> DataFrame:
    """Mean squared error per input feature, one pass, one aggregate per feature."""
    aggs = [F.avg((F.col("x")[i] - F.col("y")[i]) * (F.col("x")[i] - F.col("y")[i])).alias(n) for i, n in enumerate(names)]
    rows = [F.struct(F.lit(n).alias("feature"), F.col(n).alias("mse")) for n in names]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def histogram(df: DataFrame, value: Column, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins between the smallest and largest value; the last bin includes its end."""
    valued = df.select(value.alias("v"))
    span = valued.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi")).alias("span")).scalar()
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(
        F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))
    )
    return (
        valued.select("v", span["lo"].alias("lo"), span["hi"].alias("hi"))
        .groupBy(at.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def embedding_norms(df: DataFrame) -> DataFrame:
    return df.select(norm(F.col("vec")).alias("n")).agg(
        F.avg("n").alias("embedding_norm_mean"), F.stddev_pop("n").alias("embedding_norm_std")
    )


def embedding_metrics(sample: DataFrame) -> DataFrame:
    """Cosine statistics of all pairs of the given vectors, each with itself included, and norm statistics.

    Mean and deviation of all pairs follow from the sum of the unit vectors and from their second
    moments, so no pair is formed; the smallest cosine is the nearest neighbour of a negated vector, and the largest is that of
    any vector with itself, unless all are of length zero.
    """
    length = norm(F.col("vec"))
    # The length is a column of its own: inside the lambda it would be computed once per component.
    measured = sample.select("track_id", "vec", length.alias("_length"))
    unit = measured.select("track_id", F.transform("vec", lambda x: F.when(F.col("_length") == 0, 0.0).otherwise(x / F.col("_length"))).alias("vec"))
    moments = unit.mapInArrow(_moments, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    totals = moments.agg(
        F.sum(F.when(F.col("i") == -1, F.col("v") * F.col("v"))).alias("sum_sim"),
        F.sum(F.when(F.col("i") >= 0, F.col("v") * F.col("v"))).alias("sum_sq"),
    )
    queries = unit.withColumnRenamed("track_id", "query_id")
    opposite = queries.withColumn("vec", F.transform("vec", lambda x: -x))
    lowest = highest_cosine(opposite, unit).select((-F.col("sim")).alias("min_similarity"))
    highest = sample.agg(F.max(F.when(length > 0, 1.0).otherwise(0.0)).alias("max_similarity"))
    counted = sample.agg(F.count(F.lit(1)).alias("n"))
    norms = embedding_norms(sample).select(F.struct("*").alias("norms")).scalar()
    out = totals.withColumns({"n": counted.scalar(), "norms": norms, "lowest": lowest.scalar(), "highest": highest.scalar()})
    pairs = F.col("n") * F.col("n")
    mean = F.col("sum_sim") / pairs
    return out.select(
        mean.alias("mean_similarity"),
        F.sqrt(F.greatest(F.col("sum_sq") / pairs - mean * mean, F.lit(0.0))).alias("std_similarity"),
        F.col("lowest").alias("min_similarity"),
        F.col("highest").alias("max_similarity"),
        "norms.embedding_norm_mean",
        "norms.embedding_norm_std",
    )


def _moments(batches):
    """Per Arrow batch: component sums as row -1, and the products of every two components."""
    for batch in batches:
        vec = batch.column(batch.schema.get_field_index("vec"))
        if not len(vec):
            continue
        m = vec.flatten().to_numpy(zero_copy_only=False).reshape(len(vec), -1)
        dim = m.shape[1]
        i, j = np.divmod(np.arange(dim * dim), dim)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([np.full(dim, -1), i]).astype("int32")),
                pa.array(np.concatenate([np.arange(dim), j]).astype("int32")),
                pa.array(np.concatenate([m.sum(0), (m.T @ m).ravel()])),
            ],
            ["i", "j", "v"],
        )


def suite_rollup(checks: DataFrame) -> DataFrame:
    """checks(suite, passed): counts and rates per suite and overall, with the verdicts."""
    rolled = checks.rollup("suite").agg(
        F.count_if(F.col("passed")).alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
        F.grouping("suite").alias("overall"),
    )
    total = F.col("passed") + F.col("failed")
    rate = F.when(total > 0, F.col("passed") * 100.0 / total).otherwise(0.0)
    verdict = (
        F.when(F.col("pass_rate") >= SUITE_PASS, "ready")
        .when(F.col("pass_rate") >= SUITE_WEAK, "needs improvement")
        .otherwise("needs major work")
    )
    suite_verdict = F.when(F.col("pass_rate") >= SUITE_PASS, "pass").otherwise("fail")
    return (
        rolled.withColumn("pass_rate", rate)
        .withColumn("suite", F.when(F.col("overall") == 1, "overall").otherwise(F.col("suite")))
        .withColumn("verdict", F.when(F.col("overall") == 1, verdict).otherwise(suite_verdict))
        .drop("overall")
    )


def tier(score: Column) -> Column:
    out = F
    for floor, name in TIERS:
        out = out.when(score >= floor, name)
    return out.otherwise("poor")


def training_summary(history: DataFrame) -> DataFrame:
    """history(epoch, loss, val_loss, val_mae): best and last values."""
    best = F.min_by("epoch", F.struct("val_loss", "epoch"))
    return history.agg(
        best.alias("best_epoch"),
        F.min("val_loss").alias("best_val_loss"),
        F.min("val_mae").alias("best_val_mae"),
        F.max_by("val_loss", "epoch").alias("final_val_loss"),
        F.max_by("val_mae", "epoch").alias("final_val_mae"),
        F.count(F.lit(1)).alias("total_epochs"),
    )
