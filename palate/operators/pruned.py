"""Exact nearest tracks in a catalog of many groups, visiting only groups that can still matter.

The catalog is grouped around centroids fitted on a bounded sample; a group knows its rows and its radius, the largest angle of
a track to the centroid. A query first visits its nearest groups until they hold enough rows, which gives it a k-th best score. No
track of a group can be nearer than the angle to the centroid less the radius, so the second pass visits only groups whose best possible
cosine reaches that score. Every visit is an exact comparison in a bounded cell; small groups share one, larger ones are cut.

What the driver holds is one row per group, at most MOST_GROUPS of them. Where workers can open the shared folder both passes are one
sweep of a block of queries (`sweep.py`), and nothing but queries and owned rows is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palate.functions.vectors import RANK_DIGITS
from palate.session import even_keys, stage, task_slots

#: The sample that centroids are fitted on, and how many there may be.
SAMPLE, MOST_GROUPS, FIT_ROUNDS = 20_000, 4096, 8
#: Rows that the first pass looks at, as a multiple of k.
FIRST_LOOK = 4
#: Tracks that a cell compares, of as many groups as they are; owned rows count an eighth of a query.
SLAB_ROWS, QUERY_ROWS = 65536, 65536
#: Scores are rounded; a bound may miss them by that much and is widened.
SLACK = 10.0 ** (1 - RANK_DIGITS)


@dataclass(frozen=True)
class Groups:
    """Centroids (the last group holds vectors of length zero), rows and radius of each group, and the box of its unit vectors if known."""

    centroids: np.ndarray
    rows: np.ndarray
    radius: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    def bounds(self, unit: np.ndarray, slack: float = SLACK) -> tuple[np.ndarray, np.ndarray]:
        """Per query and group: cosine to the centroid, and the highest cosine that any of its tracks can have."""
        near = np.clip(unit @ self.centroids.T, -1.0, 1.0)
        # The cosine of the angle to the centroid less the radius.
        best = near * np.cos(self.radius) + np.sqrt(1.0 - near * near) * np.sin(self.radius)
        best = np.where(near >= np.cos(self.radius), 1.0, best)
        if self.low is not None:
            best = np.minimum(best, np.maximum(unit, 0.0) @ self.high.T + np.minimum(unit, 0.0) @ self.low.T)
        best += slack
        zero = ~unit.any(axis=1)
        near[zero], best[zero] = 0.0, slack
        near, best = (np.pad(m, ((0, 0), (0, 1)), constant_values=v) for m, v in ((near, -2.0), (best, slack)))
        return near, np.where(self.rows > 0, best, -np.inf)

    def first(self, unit: np.ndarray, wanted: int) -> np.ndarray:
        """The nearest groups that together hold ``wanted`` rows, as a mask."""
        near, _ = self.bounds(unit)
        order = np.argsort(-near, axis=1, kind="stable")
        before = np.cumsum(self.rows[order], axis=1) - self.rows[order]
        mask = np.zeros(order.shape, bool)
        np.put_along_axis(mask, order, before < wanted, axis=1)
        return mask & (self.rows > 0)


def unit_rows(m: np.ndarray) -> np.ndarray:
    length = np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype("float64", copy=False) if len(column) else np.zeros((0, 1))


def fit_centroids(sample: np.ndarray, n_groups: int) -> np.ndarray:
    """Spherical k-means from evenly spaced rows of a sample in hash order."""
    unit = unit_rows(sample)
    unit = unit[unit.any(axis=1)]
    if not len(unit):
        return np.zeros((0, sample.shape[1]))
    centroids = unit[np.unique(np.linspace(0, len(unit) - 1, min(n_groups, len(unit))).astype(int))].copy()
    for _ in range(FIT_ROUNDS):
        nearest = np.concatenate([np.argmax(unit[at : at + 256] @ centroids.T, axis=1) for at in range(0, len(unit), 256)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, unit)
        moved = unit_rows(sums)
        centroids = np.where(moved.any(axis=1)[:, None], moved, centroids)
    return centroids


def sampled(rows: DataFrame, key: str) -> pa.Array:
    """Some vectors of rows(key, vec), the first in hash order."""
    found = rows.select(key, "vec").orderBy(F.xxhash64(key), key).limit(SAMPLE).select("vec").toArrow()
    return found.column("vec").combine_chunks()


def _boxes(batches):
    """Per group the lowest and highest of each component of its unit vectors, as far as a task sees them."""
    low, high = {}, {}
    for batch in batches:
        unit, group = unit_rows(matrix(batch.column("vec"))), batch.column("grp").to_numpy()
        if not len(unit):
            continue
        order = np.argsort(group, kind="stable")
        seen, start = np.unique(group[order], return_index=True)
        for g, a, b in zip(seen.tolist(), np.minimum.reduceat(unit[order], start), np.maximum.reduceat(unit[order], start)):
            low[g], high[g] = np.minimum(low.get(g, a), a), np.maximum(high.get(g, b), b)
    yield pa.RecordBatch.from_pydict({"grp": pa.array(list(low), pa.int32()), "low": pa.array([v.tolist() for v in low.values()], pa.list_(pa.float64())), "high": pa.array([high[g].tolist() for g in low], pa.list_(pa.float64()))})


def _joined_boxes(rows: pa.Table) -> pa.Table:
    low, high = (f(matrix(rows.column(c).combine_chunks()), axis=0) for f, c in ((np.min, "low"), (np.max, "high")))
    return pa.table({"grp": rows.column("grp").slice(0, 1), "low": pa.array([low.tolist()], pa.list_(pa.float64())), "high": pa.array([high.tolist()], pa.list_(pa.float64()))})


def group_catalog(catalog: DataFrame, n_groups: int, more: tuple[str, ...] = (), boxes: bool = False) -> tuple[DataFrame, Groups]:
    """catalog(track_id, vec, further columns of numbers) with its group; rows and radius of each group, also their boxes if asked for."""
    centroids = fit_centroids(matrix(sampled(catalog, "track_id")), min(n_groups, MOST_GROUPS))

    def assign(batches):
        for batch in batches:
            unit = unit_rows(matrix(batch.column("vec")))
            for at in range(0, len(unit), 256):
                part, rows = unit[at : at + 256], batch.slice(at, 256)
                near = part @ centroids.T if len(centroids) else np.zeros((len(part), 1))
                group = np.where(part.any(axis=1), near.argmax(axis=1), len(centroids))
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(group, pa.int32()), pa.array(near.max(axis=1), pa.float64())], ["track_id", "vec", *more, "grp", "near"]
                )

    rows = catalog.select("track_id", F.col("vec").cast("array<double>").alias("vec"), *[F.coalesce(F.col(c).cast("bigint"), F.lit(-1)).alias(c) for c in more])
    columns = ["track_id bigint", "vec array<double>", *[f"{c} bigint" for c in more], "grp int", "near double"]
    placed = stage(rows.mapInArrow(assign, ", ".join(columns)), "grouped")
    n, radius = np.zeros(len(centroids) + 1, np.int64), np.zeros(len(centroids))
    for r in placed.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("near")).collect():
        n[r.grp] = r.n
        if r.grp < len(centroids):
            # Near 1 an angle is known to the root of the rounding only.
            radius[r.grp] = np.arccos(np.clip(r.near, -1.0, 1.0)) + 4e-8
    if not boxes:
        return placed.drop("near"), Groups(centroids, n, radius)
    low, high = np.zeros_like(centroids), np.zeros_like(centroids)
    fields = "grp int, low array<double>, high array<double>"
    for r in placed.select("vec", "grp").mapInArrow(_boxes, fields).groupBy("grp").applyInArrow(_joined_boxes, fields).toLocalIterator():
        if r.grp < len(centroids):
            low[r.grp], high[r.grp] = r.low, r.high
    return placed.drop("near"), Groups(centroids, n, radius, low, high)


@dataclass(frozen=True)
class Slabs:
    """Neighbouring groups share a slab of at most so many tracks; a larger group has several of its own, by a hash of the track."""

    first: np.ndarray
    parts: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray, most: int) -> Slabs:
        first, parts, held, last = np.zeros(len(rows), np.int64), np.maximum(-(-rows // most), 1), 0, 0
        for g, n in enumerate(rows):
            if g and (parts[g] > 1 or held + n > most):
                last, held = last + parts[g - 1], 0
            first[g], held = last, most if parts[g] > 1 else held + n
        return cls(first, parts)

    @property
    def n(self) -> int:
        return int(self.first[-1] + self.parts[-1])

    def groups(self, slab: int) -> tuple[int, int]:
        here = np.flatnonzero((self.first <= slab) & (slab < self.first + self.parts))
        return int(here[0]), int(here[-1]) + 1


VISITS = "query_id bigint, vec array<double>, floor double, home int, slab int, base int, bits binary, visits bigint, compared bigint"
#: Entries of the table of queries and groups that a task looks at in one step.
LOOK = 1 << 20


def _visits(queries: DataFrame, groups: Groups, slabs: Slabs, wanted: int | None) -> DataFrame:
    """What each query visits, one row per slab, its groups as bits: the first pass if ``wanted`` rows are given, else what
    must be visited beyond it.

    For the second pass queries hold ``floor``, their k-th best score so far, and ``looked``, the rows they wanted before.
    """
    spans = [slabs.groups(slab) for slab in range(slabs.n)]
    step = max(1, min(1024, LOOK // len(groups.rows)))

    def run(batches):
        for batch in batches:
            unit = unit_rows(matrix(batch.column("vec")))
            for at in range(0, len(unit), step):
                part, rows = unit[at : at + step], batch.slice(at, step)
                near, best = groups.bounds(part)
                home = near.argmax(axis=1)
                floor = rows.column("floor").fill_null(-np.inf).to_numpy(zero_copy_only=False)
                if wanted is not None:
                    mask = groups.first(part, wanted)
                else:
                    mask = (best >= floor[:, None]) & ~groups.first(part, int(rows.column("looked")[0].as_py()))
                for slab, (start, end) in enumerate(spans):
                    here = mask[:, start:end]
                    row = np.flatnonzero(here.any(axis=1))
                    if not len(row):
                        continue
                    taken, here, n = rows.take(pa.array(row, pa.int64())), here[row], len(row)
                    bits = [b.tobytes() for b in np.packbits(here, axis=1)]
                    # A group in several slabs is one visit.
                    first = slab == slabs.first[start]
                    visits = here.sum(axis=1) if first else np.zeros(n, np.int64)
                    compared = here @ groups.rows[start:end] if first else np.zeros(n, np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            taken.column("query_id"), taken.column("vec"), taken.column("floor"), pa.array(home[row], pa.int32()),
                            pa.array(np.full(n, slab), pa.int32()), pa.array(np.full(n, start), pa.int32()), pa.array(bits, pa.binary()),
                            pa.array(visits, pa.int64()), pa.array(compared, pa.int64()),
                        ],
                        ["query_id", "vec", "floor", "home", "slab", "base", "bits", "visits", "compared"],
                    )

    return queries.mapInArrow(run, VISITS)


def _compare(visits: DataFrame, catalog: DataFrame, owned: DataFrame | None, n_slabs: int, kernel, query_rows: int) -> DataFrame:
    """Every visit as an exact comparison; a cell is a slab of tracks and a block of its visitors with their owned rows."""
    slots = task_slots(visits.sparkSession)
    blocks = np.ones(n_slabs, np.int64)
    for r in visits.groupBy("slab").agg(F.count(F.lit(1)).alias("n")).collect():
        blocks[r.slab] = max(-(-r.n // query_rows), min(-(-slots // n_slabs), -(-r.n // 32)))
    if owned is not None:
        for r in owned.groupBy("slab").agg(F.count(F.lit(1)).alias("n")).collect():
            blocks[r.slab] = max(blocks[r.slab], -(-r.n // (8 * QUERY_ROWS)))
    of = F.element_at(F.array(*[F.lit(int(c)) for c in blocks]), F.col("slab") + 1)
    block = F.pmod(F.xxhash64("query_id"), of).cast("int").alias("block")
    width = int(min(max(blocks.sum(), 1), 8 * slots))
    before = F.element_at(F.array(*[F.lit(int(c)) for c in np.cumsum(blocks) - blocks]), F.col("slab") + 1)
    cell = F.element_at(even_keys(visits.sparkSession, int(blocks.sum()), width), (before + F.col("block") + 1).cast("int")).alias("cell")
    cols = ["query_id", "vec", "floor", "home", "base", "bits"]
    left = visits.withColumn("block", block).select(cell, *cols, F.lit(None).cast("bigint").alias("masked_id"))
    if owned is not None:
        # Empty, not NULL: a run of NULL lists is slow to hand over in Arrow batches.
        blank = {"vec": F.array().cast("array<double>"), "floor": F.lit(None).cast("double"), "home": F.lit(0), "base": F.lit(0), "bits": F.lit(b"")}
        left = left.unionByName(owned.withColumn("block", block).select(cell, "query_id", *[v.alias(c) for c, v in blank.items()], F.col("track_id").alias("masked_id")))
    right = catalog.select("slab", F.explode(F.sequence(F.lit(0), of - 1)).alias("block"), "track_id", "vec", "grp")
    right = right.select(cell, "track_id", "vec", "grp")
    return (
        left.repartition(width, "cell")
        .groupBy("cell")
        .cogroup(right.repartition(width, "cell").groupBy("cell"))
        .applyInArrow(kernel, "query_id bigint, rank int, track_id bigint, sim double")
    )


def _top(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("sim"), "track_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def nearest_pruned(
    queries: DataFrame, catalog: DataFrame, k: int, kernel, group_rows: int, exclude: DataFrame | None, n_catalog: int, cell_rows: int, query_rows: int,
    overall: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The k nearest tracks of every query, and what was visited (pass, visits, compared, of_all).

    Small groups meet a block of queries together, as one slab of at most SLAB_ROWS tracks (``cell_rows`` if that is more): what travels
    is a query and its bits per slab, and what comes back is k rows per slab, however many groups there are.

    ``overall`` asks for the best rows of all queries together: queries then have one floor, the best score of the first pass, and
    lists hold no more than what reaches it.
    """
    from palate.operators import sweep

    if not overall and sweep.readable(queries.sparkSession):
        return sweep.pruned(queries, catalog, k, group_rows, exclude, n_catalog, max(cell_rows, SLAB_ROWS))
    placed, groups = group_catalog(catalog, max(-(-n_catalog // group_rows), 1))
    slabs = Slabs.of(groups.rows, max(cell_rows, SLAB_ROWS))
    at = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("grp") + 1)
    placed = placed.withColumn("slab", (at(slabs.first) + F.pmod(F.xxhash64("track_id"), at(slabs.parts))).cast("int"))
    queries = stage(queries.select("query_id", F.col("vec").cast("array<double>").alias("vec")), "queries")
    owned = None
    if exclude is not None:
        owned = exclude.select("query_id", "track_id").join(placed.select("track_id", "slab"), "track_id")
        owned = stage(owned.join(queries.select("query_id"), "query_id", "left_semi"), "owned")
    wanted = FIRST_LOOK * k
    first = stage(_visits(queries.withColumn("floor", F.lit(None).cast("double")), groups, slabs, wanted), "first_visits")
    found = stage(_compare(first, placed, owned, slabs.n, kernel, query_rows), "first_found")
    floors = _top(found, k).where(F.col("rank") == k).select("query_id", F.col("sim").alias("floor"))
    again = queries.join(floors, "query_id", "left") if not overall else queries.withColumn("floor", F.lit(found.agg(F.max("sim")).first()[0]).cast("double"))
    again = again.withColumn("looked", F.lit(wanted))
    second = stage(_visits(again, groups, slabs, None), "second_visits")
    more = _compare(second, placed, owned, slabs.n, kernel, query_rows)
    both = first.select(F.lit(1).alias("pass"), "visits", "compared").unionByName(second.select(F.lit(2).alias("pass"), "visits", "compared"))
    visited = both.groupBy("pass").agg(F.sum("visits").alias("visits"), F.sum("compared").alias("compared"))
    visited = visited.withColumn("of_all", F.lit(int(groups.rows.sum())) * F.lit(queries.count()))
    return _top(found.unionByName(more), k), visited
