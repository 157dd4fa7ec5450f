"""Embedding near-duplicates with an inverted multi-index.

Two codebooks, one per half of the vector, span a product grid of cells. A vector is stored in its nearest cell and visits
the cells with the smallest sums of half distances: the pair (i-th nearest, j-th nearest) can be among the first T only if
i * j <= T, so the traversal looks at few pairs. T is the number of cells that reach TARGET of the linked pairs of a
sample, compared by brute force. Where MOST_VISITS cells don't reach them (a large family of near copies draws many codes
and spreads over thousands of cells), the codebooks are fitted anew with half the codes, until they do: at the latest when
all cells are visited. A sample of a larger table with too few linked pairs to tell TARGET is helped by pairs made at
the cosine LINK. What shares a visited cell is verified by cosine in double precision.

The codebooks are fitted on a bounded sample (SAMPLE vectors, by hash of the id); every vector is indexed and every vector
visits. Equal vectors are one entry with a count. A cell with many entries is dealt in blocks of bounded size against blocks
of visitors; blocks return counts and a spanning forest of their links, never pairs.

Defined results: vectors that are null, zero or hold null or non-finite components link with nothing; vectors of another
length than the sample's link only with their equals; n_links counts other vectors; repeated rows are vectors of
their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palate.llm.common import bound_batches, components
from palate.session import stage

LINK = 0.9
SAMPLE = 20_000
TARGET = 0.999
PER_CELL = 32
MOST_CODES = 256
LEAST_VISITS = 8
MOST_VISITS = 512
BLOCK, VISITORS = 1024, 4096


def codebook(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means from evenly spaced rows in the order of the first component; deterministic."""
    order = np.argsort(points[:, 0], kind="stable")
    centers = points[order[np.linspace(0, len(points) - 1, k).astype(int)]].copy()
    for _ in range(rounds):
        near = np.argmax(points @ centers.T - (centers**2).sum(1) / 2, axis=1)
        for c in np.unique(near):
            centers[c] = points[near == c].mean(0)
    return centers


class Grid:
    def __init__(self, first: np.ndarray, second: np.ndarray, visits: int):
        self.first, self.second, self.visits = first, second, visits
        side = np.arange(1, max(visits, 1) + 1)
        i, j = np.meshgrid(side, side, indexing="ij")
        inside = (i * j <= visits) & (i <= len(first)) & (j <= len(second))
        self.i, self.j = i[inside] - 1, j[inside] - 1

    def walk(self, x: np.ndarray) -> np.ndarray:
        """The cells that each vector visits, nearest first; the first one is its own."""
        half = self.first.shape[1]
        out = []
        for rows in np.array_split(x, max(len(x) // 512, 1)):
            a = (self.first**2).sum(1) - 2 * rows[:, :half] @ self.first.T
            b = (self.second**2).sum(1) - 2 * rows[:, half:] @ self.second.T
            by_a, by_b = np.argsort(a, 1, kind="stable"), np.argsort(b, 1, kind="stable")
            ca, cb = by_a[:, self.i], by_b[:, self.j]
            cost = np.take_along_axis(a, ca, 1) + np.take_along_axis(b, cb, 1)
            best = np.argsort(cost, 1, kind="stable")[:, : self.visits]
            out.append(np.take_along_axis(ca * len(self.second) + cb, best, 1))
        return np.concatenate(out)


def _needed(sample: np.ndarray, grid: Grid, made: bool) -> np.ndarray:
    """How many linked pairs of the sample are met at each visit (from 1); the last place counts those that are missed."""
    cells = grid.walk(sample)
    width = cells.shape[1]
    rank = np.full(len(grid.first) * len(grid.second), width + 1)
    met = np.zeros(width + 2, np.int64)

    def add(x: int, others: np.ndarray) -> None:
        rank[cells[x]] = np.arange(1, width + 1)
        met[:] += np.bincount(rank[others], minlength=width + 2)
        rank[cells[x]] = width + 1

    for at in range(0, len(sample), 1024):
        linked = sample[at : at + 1024] @ sample.T >= LINK
        for x in range(len(linked)):
            linked[x, at + x] = False
            others = np.flatnonzero(linked[x])
            if len(others):
                add(at + x, cells[others, 0])
    if made and met.sum() * (1 - TARGET) < 1:
        aside = np.random.default_rng(0).normal(size=sample.shape)
        aside -= (aside * sample).sum(1, keepdims=True) * sample
        aside /= np.linalg.norm(aside, axis=1, keepdims=True)
        near = Grid(grid.first, grid.second, 1).walk(LINK * sample + np.sqrt(1 - LINK**2) * aside)
        for x in range(len(sample)):
            add(x, near[x, :1])
    return met


def fit(sample: np.ndarray, n: int) -> Grid:
    """Codebooks for n vectors, and as many visits as the sample's linked pairs need."""
    k = int(min(max(np.ceil(np.sqrt(n / PER_CELL)), 1), MOST_CODES, len(sample)))
    half = sample.shape[1] // 2
    while True:
        first, second = codebook(sample[:, :half], k), codebook(sample[:, half:], k)
        most = min(k * k, MOST_VISITS)
        met = np.cumsum(_needed(sample, Grid(first, second, most), n > len(sample)))
        visits = int(np.searchsorted(met, np.ceil(TARGET * met[-1]))) if met[-1] else 1
        if visits <= most:
            return Grid(first, second, min(max(visits, LEAST_VISITS), k * k))
        k = max(k // 2, 1)


def _unit(vectors: pa.Array, length: int) -> np.ndarray:
    x = np.array(vectors.to_pylist(), float).reshape(-1, length)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


_BLOCKED = "a bigint, b bigint, n bigint"


def _verify(length: int):
    def run(table: pa.Table) -> pa.Table:
        visitor = table.column("visitor").to_numpy()
        ids, size = table.column("id").to_numpy(), table.column("size").to_numpy()
        x = _unit(table.column("embedding").combine_chunks(), length)
        cells = np.array(table.column("cells").to_pylist())
        p, q = np.flatnonzero(visitor), np.flatnonzero(~visitor)
        if not len(p) or not len(q):
            return pa.table({c: pa.array([], pa.int64()) for c in ("a", "b", "n")})
        hit = (x[p] @ x[q].T >= LINK) & (ids[p][:, None] != ids[q])
        # A stored entry that visits the visitor's own cell counts the visitor there; else here.
        own, which = np.unique(cells[p, 0], return_inverse=True)
        here = hit & ~np.array([(cells[q] == c).any(1) for c in own])[which]
        count = np.r_[hit @ size[q], here.T @ size[p]]
        both = np.r_[ids[p], ids[q]]
        low_p, low_q = ids[p].copy(), ids[q].copy()
        while True:
            new_p = np.minimum(low_p, np.where(hit, low_q, np.iinfo(np.int64).max).min(1))
            new_q = np.minimum(low_q, np.where(hit, new_p[:, None], np.iinfo(np.int64).max).min(0))
            if (new_p == low_p).all() and (new_q == low_q).all():
                break
            low_p, low_q = new_p, new_q
        linked = np.r_[hit.any(1), hit.any(0)]
        return pa.table({"a": both[linked], "b": np.r_[low_p, low_q][linked], "n": count[linked].astype(np.int64)})

    return run


def embed_dedup(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = F.coalesce(finite & F.exists("embedding", lambda v: v != 0), F.lit(False)) & F.col("id").isNotNull()
    rows = stage(rows.withColumn("good", good), "vectors")
    groups = stage(rows.where("good").groupBy("embedding").agg(F.min("id").alias("id"), F.count("*").alias("size")), "groups")
    sample = groups.select("id", "embedding").orderBy(F.xxhash64("id")).limit(SAMPLE).toArrow()["embedding"].combine_chunks().to_pylist()
    lengths = [len(v) for v in sample]
    length = max(set(lengths), key=lengths.count) if lengths else 0
    found, parts = None, None
    if length > 1:
        usable = groups.where(F.size("embedding") == length)
        known = np.array([v for v in sample if len(v) == length], float)
        grid = fit(known / np.linalg.norm(known, axis=1, keepdims=True), usable.count())

        def visit(batches):
            for batch in batches:
                cells = grid.walk(_unit(batch.column("embedding"), length)) if len(batch) else np.empty((0, 1), np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.tolist(), pa.list_(pa.int64()))], [*batch.schema.names, "cells"])

        placed = stage(usable.select("id", "size", "embedding").mapInArrow(visit, "id bigint, size bigint, embedding array<double>, cells array<bigint>"), "placed")
        stored = placed.withColumn("cell", F.col("cells")[0])
        visits = placed.withColumn("cell", F.explode("cells"))
        blocks = stored.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        turns = visits.groupBy("cell").agg(F.ceil(F.count("*") / VISITORS).cast("int").alias("turns"))
        plan = stage(blocks.join(turns, "cell"), "plan")
        spread = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        columns = ["cell", "block", "turn", "visitor", "id", "size", "embedding", "cells"]
        left = stored.join(plan, "cell").withColumns({"block": spread("blocks"), "visitor": F.lit(False)}).withColumn("turn", each("turns"))
        right = visits.join(plan, "cell").withColumns({"turn": spread("turns"), "visitor": F.lit(True)}).withColumn("block", each("blocks"))
        tried = left.select(columns).unionByName(right.select(columns)).groupBy("cell", "block", "turn").applyInArrow(_verify(length), _BLOCKED)
        tried = stage(tried, "tried")
        found = tried.groupBy("a").agg(F.sum("n").alias("more"))
        parts = components(tried.select("a", "b"))
    members = rows.where("good").join(groups.select(F.col("id").alias("first"), "size", F.col("embedding").alias("e")), F.col("embedding") == F.col("e"))
    members = members.select("id", "first", "size")
    if found is not None:
        members = members.join(found, members["first"] == found["a"], "left").drop("a")
        members = members.join(parts.select(F.col("id").alias("part_id"), "component"), F.col("first") == F.col("part_id"), "left")
    else:
        members = members.withColumns({"more": F.lit(None).cast("bigint"), "component": F.lit(None).cast("bigint")})
    out = members.select(
        "id", (F.col("size") - 1 + F.coalesce("more", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component", "first").alias("component_id")
    )
    out = out.unionByName(rows.where("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
