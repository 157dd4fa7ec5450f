"""Ranked, de-duplicated, diversified and mood-balanced lists, for all listeners in one plan."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palate.operators.similarity import nearest_tracks
from palate.operators.sweep import ROWS, Block, Grouped, Search
from palate.operators.walk import SETTLED, diversify, diversify_heads  # noqa: F401
from palate.session import by_key

OVERFETCH = 5
MMR_POOL = 3
MMR_TOP_SHARE = 0.3


def _best(*keys: str):
    return Window.partitionBy(*keys).orderBy(F.desc("sim"), "track_id")


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first in a stated total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_first", F.row_number().over(w)).where("_first = 1").drop("_first")


def seed_neighbours(seeds: DataFrame, catalog: DataFrame, depth: int, n_catalog: int | None = None) -> DataFrame:
    """For each distinct seed track its `depth` nearest tracks, packed as one array per seed.

    A track that sits in many libraries is searched once, not once per library. Seeds bring their vector or take the catalog's.
    """
    seeds = seeds if "vec" in seeds.columns else seeds.join(catalog.select("track_id", "vec"), "track_id")
    queries = seeds.select(F.col("track_id").alias("query_id"), "vec")
    found = nearest_tracks(queries, catalog, depth, n_queries=n_catalog, n_catalog=n_catalog, packed=True)
    return found.withColumnRenamed("query_id", "seed_id")


def seed_candidates(
    library: DataFrame, neighbours: DataFrame, owned: DataFrame, n: int, keys: list[str]
) -> DataFrame:
    """Per (keys, track): the best score any seed gives it, after each seed named up to n unseen tracks.

    `in_catalog` on the library rows is how many catalog tracks the listener owns: at most that many
    neighbours can fall away, so only n + in_catalog of a list are unpacked. Lists join as packed
    arrays. The exclusion, the cap per seed and the merge are keyed by pairs, which spreads a listener
    with a huge library over all tasks.
    """
    needed = F.least(F.size("near"), F.lit(n) + F.col("in_catalog")).cast("int")
    # How many rows are unpacked, and how many stay, at most; both only size tasks. The library is read for it: hand in a stored one.
    unpacked, stay = library.agg(F.sum(F.least(F.lit(OVERFETCH * n), F.lit(n) + F.col("in_catalog"))), F.count(F.lit(1)) * n).first()
    rows = (
        library.select(*keys, F.col("track_id").alias("seed_id"), "in_catalog")
        .join(neighbours, "seed_id")
        .select(*keys, "seed_id", F.inline(F.slice("near", F.lit(1), needed)))
        .drop("rank")
    )
    pairs = by_key(owned.select("user_id", "track_id"), unpacked or 0, "user_id", "track_id")
    unseen = by_key(rows, unpacked or 0, "user_id", "track_id").join(pairs, ["user_id", "track_id"], "left_anti")
    placed = by_key(unseen, unpacked or 0, *keys, "seed_id")
    capped = placed.withColumn("_n", F.row_number().over(_best(*keys, "seed_id"))).where(F.col("_n") <= n)
    return (
        by_key(capped, stay, *keys, "track_id", always=True)
        # Two hash aggregates over one placement: equal scores first give their smallest seed.
        .groupBy(*keys, "track_id", "sim")
        .agg(F.min("seed_id").alias("seed_id"))
        .groupBy(*keys, "track_id")
        .agg(F.max("sim").alias("best"), F.max_by("seed_id", "sim").alias("seed_id"))
        .select(*keys, "track_id", F.col("best").alias("sim"), "seed_id")
    )


def merge_moods(lists: DataFrame) -> DataFrame:
    """A track named by several moods stays with the first mood of the request order."""
    return keep_first(lists, ["user_id", "track_id"], [F.col("mood_order")])


def mood_quotas(recs: DataFrame, n: int, shares: DataFrame | None = None) -> DataFrame:
    """Give each mood its share of n rows, then fill up by score.

    shares(user_id, source_mood, cnt) weighs the moods that returned rows by the listener's own track
    counts; a mood without a share, or no shares at all, gets an equal part. Quotas are whole-number
    divisions, so they do not hang on summation order. Lists of n rows or fewer are returned as they
    are. Each mood's list is already bounded, so the windows per user are too.
    """
    weighed = recs.groupBy("user_id", "source_mood").agg(F.count(F.lit(1)).alias("available"))
    user = Window.partitionBy("user_id")
    if shares is None:
        weighed = weighed.withColumn("cnt", F.lit(None).cast("bigint"))
    else:
        weighed = weighed.join(shares.select("user_id", "source_mood", "cnt"), ["user_id", "source_mood"], "left")
    weighed = weighed.withColumns(
        {"total": F.sum("cnt").over(user), "n_moods": F.count(F.lit(1)).over(user), "n_rows": F.sum("available").over(user)}
    )
    quota = weighed.select(
        "user_id",
        "source_mood",
        F.expr(f"greatest(1, coalesce({n} * cnt div total, {n} div n_moods))").alias("quota"),
        "n_rows",
    )
    marked = (
        recs.join(quota, ["user_id", "source_mood"])
        .withColumn("_in_mood", F.row_number().over(_best("user_id", "source_mood")))
        .withColumn("_late", ((F.col("n_rows") > n) & (F.col("_in_mood") > F.col("quota"))).cast("int"))
    )
    order = Window.partitionBy("user_id").orderBy("_late", F.desc("sim"), "track_id")
    cut = marked.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n)
    return cut.withColumn("rank", F.row_number().over(_best("user_id"))).select(*recs.columns, "rank")


def _uniform(seed: int, users: np.ndarray, step: int, ids: np.ndarray) -> np.ndarray:
    """Reproducible numbers in (0, 1) from a 64-bit mix of the arguments, one per user and id."""
    with np.errstate(over="ignore"):
        x = ids.astype("uint64") + np.uint64(0x9E3779B97F4A7C15) * np.uint64(seed * 1000003 + step + 1)
        x ^= users.astype("int64").view("uint64") * np.uint64(0xD6E8FEB86659FD93)
        for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(mult)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype("float64") + 0.5) / float(1 << 53)


def _spread_lists(table: pa.Table, n: int, diversity: float, seed: int | None) -> pa.RecordBatch:
    """Select n of each bounded pool, trading similarity against mean distance to what is selected; all pools in step.

    The rows of a user are neighbours. Pools are rows of matrices as wide as the longest one.
    """
    user, ids, sims = (table.column(c).to_numpy() for c in ("user_id", "track_id", "sim"))
    flat = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
    starts = np.flatnonzero(np.append(True, user[1:] != user[:-1]))
    row_list = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(user))))
    order = np.lexsort((ids, -sims, row_list))
    user, ids, sims, flat = user[order], ids[order], sims[order], flat[order]
    place = np.arange(len(user)) - starts[row_list]
    shape, lists = (len(starts), int(place.max()) + 1), np.arange(len(starts))

    def padded(values, fill):
        out = np.full((*shape, *values.shape[1:]), fill, values.dtype)
        out[row_list, place] = values
        return out

    free = padded(np.ones(len(user), bool), False)
    ids, sims, vectors, users = padded(ids, 0), padded(sims, 0.0), padded(flat, 0.0), user[starts]
    scale = 2.0 * np.sqrt(vectors.shape[2])
    away = lambda row: np.linalg.norm(vectors - vectors[lists, row][:, None, :], axis=2)
    row, out = np.zeros(len(lists), np.int64), []
    apart = np.zeros(shape)
    going = np.ones(len(lists), bool)
    for step in range(n):
        if step:
            going = free.any(axis=1)
            if not going.any():
                break
            score = np.where(free, np.round((1 - diversity) * sims + diversity * (apart / step / scale), 9), -np.inf)
            by_score = np.lexsort((ids.ravel(), -score.ravel(), np.repeat(lists, shape[1]))).reshape(shape) % shape[1]
            row = by_score[:, 0]
            if seed is not None:
                most = np.maximum(1, (free.sum(axis=1) * MMR_TOP_SHARE).astype(int))
                noise = -np.log(-np.log(_uniform(seed, users[:, None], step, ids)))
                drawn = np.log(np.maximum(score, 1e-12)) + noise
                drawn = np.where(np.arange(shape[1]) < most[:, None], np.take_along_axis(drawn, by_score, axis=1), -np.inf)
                row = by_score[lists, drawn.argmax(axis=1)]
        out.append((lists[going], row[going], np.full(going.sum(), step + 1)))
        free[lists[going], row[going]] = False
        apart = apart + away(row)
    chosen, row, rank = (np.concatenate(c) for c in zip(*out))
    return pa.RecordBatch.from_pydict(
        {
            "user_id": pa.array(users[chosen], pa.int64()),
            "rank": pa.array(rank, pa.int32()),
            "track_id": pa.array(ids[chosen, row], pa.int64()),
            "sim": pa.array(sims[chosen, row], pa.float64()),
        }
    )


def _spreader(n: int, diversity: float, seed: int | None):
    """Pools one after another, those of a batch together; the last one of a batch may go on in the next."""

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            user = table.column("user_id").to_numpy()
            last = int(np.flatnonzero(np.append(True, user[1:] != user[:-1]))[-1])
            held = table.slice(last)
            if last:
                yield _spread_lists(table.slice(0, last), n, diversity, seed)
        if held is not None:
            yield _spread_lists(held, n, diversity, seed)

    return run


def spread(candidates: DataFrame, catalog: DataFrame, n: int, diversity: float, seed: int | None = None) -> DataFrame:
    """candidates(user_id, track_id, sim, rank): the best 3n per user compete for n places.

    With a seed, places are drawn with probability proportional to score from the top 30 %; without
    one the best score wins. The pool of a user is at most 3n rows.
    """
    pool = candidates.where(F.col("rank") <= MMR_POOL * n).join(catalog.select("track_id", "vec"), "track_id")
    placed = pool.select("user_id", "track_id", "sim", "vec").repartition("user_id").sortWithinPartitions("user_id")
    return placed.mapInArrow(_spreader(n, diversity, seed), "user_id bigint, rank int, track_id bigint, sim double")


@dataclass
class Spread:
    """n of each list of k, traded against their distance from each other (`spread`)."""

    n: int
    k: int
    diversity: float
    seed: int | None
    more: tuple[str, ...] = ()
    keep_raw: bool = True
    schema: str = ROWS
    #: Lists that are spread together.
    TOGETHER = 1024

    def run(self, block: Block, search: Search, groups: Grouped | None) -> Iterator[pa.RecordBatch]:
        lists = search.nearest(block, self.k, groups)
        if not len(lists.rows):
            return
        wanted, place = np.unique(lists.ids, return_inverse=True)
        vectors, queries = search.vectors(wanted), block.ids.to_numpy()
        for at in range(0, len(block.unit), self.TOGETHER):
            a, b = np.searchsorted(lists.rows, [at, at + self.TOGETHER])
            if a == b:
                continue
            flat = vectors[place[a:b]]
            vec = pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), flat.shape[1])
            pool = pa.table({"user_id": queries[lists.rows[a:b]], "track_id": lists.ids[a:b], "sim": lists.sims[a:b], "vec": vec})
            yield _spread_lists(pool, self.n, self.diversity, self.seed).rename_columns(["query_id", "rank", "track_id", "sim"])


def mix_sources(recs: DataFrame, n: int) -> DataFrame:
    """Lists of several sources in one: one row per (title, artist), then best score and popularity."""
    keyed = recs.withColumns({"_t": F.lower("track_name"), "_a": F.lower("artists")})
    unique = keep_first(keyed, ["user_id", "_t", "_a"], [F.col("source_order"), F.col("source_rank"), F.col("track_id")])
    order = Window.partitionBy("user_id").orderBy(F.desc("sim"), F.desc("popularity"), "track_id")
    return unique.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).drop("_t", "_a")
