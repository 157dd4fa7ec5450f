"""Exact nearest tracks by cosine for many query vectors at once.

A task takes a block of queries through the catalog as it lies in the shared folder (`sweep.py`). Where workers cannot open that folder, and in
the kernels that both ways share, this is how cells are made:

A catalog of up to CATALOG_ROWS is one group that all query groups meet; a larger one is grouped around centroids, and
queries visit only groups that can hold one of their k best (`pruned.py`). Query groups are cut by a hash of their unique key, and every
cell is one bounded matrix product. A cell gets its rows by an equi-join key (`cell`), so the shuffle
places them; no side is collected, and no cell grows with the data, only the number of cells does.
Rows a query must not see travel to the one cell that could produce them and are masked there, so a
listener with a huge library costs one row per owned track, not a longer result list.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palate.functions.vectors import RANK_DIGITS
from palate.session import even_keys, stage, task_slots

QUERY_ROWS = 65536
CATALOG_ROWS = 1 << 18
#: Mean size of the groups that a larger catalog is cut into.
GROUP_ROWS = 16384
#: The same where the best pair of all is looked for, through boxes.
BOX_ROWS = 256
SLAB = 1 << 23
#: Products in single precision that are looked through at a time, while they lie in a core's cache, and the queries that share them.
TILE, TILE_QUERIES = 1 << 20, 256
#: Result rows that a cell may hold: with longer lists it takes fewer queries.
CELL_RESULTS = 1 << 23
#: Catalog rows per place from which single precision sorts out first.
LIGHT_OVER = 64
NEAR = "array<struct<rank: int, track_id: bigint, sim: double>>"


@dataclass(frozen=True)
class Grid:
    query_groups: int
    catalog_groups: int

    @property
    def cells(self) -> int:
        return self.query_groups * self.catalog_groups


def query_rows(k: int) -> int:
    """Queries of a cell: its lists are results that the cell holds until it is done."""
    return max(1, min(QUERY_ROWS, CELL_RESULTS // max(k, 1)))


def plan_grid(n_queries: int, n_catalog: int, slots: int, k: int = 1) -> Grid:
    """Groups small enough for one task, also with their results; then enough query groups to occupy every slot in every wave."""
    catalog_groups = max(1, -(-n_catalog // CATALOG_ROWS))
    query_groups = max(1, -(-n_queries // query_rows(min(k, n_catalog))), -(-slots // catalog_groups))
    waves = -(-query_groups * catalog_groups // slots)
    query_groups = max(query_groups, waves * slots // catalog_groups)
    return Grid(min(query_groups, max(1, -(-n_queries // 32))), catalog_groups)


def _vectors(table: pa.Table) -> np.ndarray:
    column = table.column("vec").combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype("float64", copy=False)


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _first_k(rows: np.ndarray, cols: np.ndarray, sims: np.ndarray, ids: np.ndarray, n_rows: int, k: int):
    """The k best of the entries of each row, equal scores by id: rows, columns, scores and ranks."""
    order = np.lexsort((ids[cols], -sims, rows))
    rows, cols, sims = rows[order], cols[order], sims[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, np.arange(n_rows))[rows]
    top = rank < k
    return rows[top], cols[top], sims[top], rank[top] + 1


def _maxima(sims: np.ndarray, k: int) -> np.ndarray:
    """Per row the maxima of disjoint column sets, at least k of them where there are as many columns."""
    n = sims.shape[1]
    sets = int(np.clip(n // (4 * k), 1, 64))
    width = n // sets
    most = sims[:, :width].copy()
    for j in range(1, sets):
        np.maximum(most, sims[:, j * width : (j + 1) * width], out=most)
    return most


def _reach(sims: np.ndarray, k: int) -> np.ndarray:
    """Per row a score that its k-th best reaches: the k-th of the maxima of disjoint column sets."""
    if k >= sims.shape[1]:
        return np.full(len(sims), -np.inf)
    most = _maxima(sims, k)
    return np.partition(most, most.shape[1] - k, axis=1)[:, most.shape[1] - k].astype("float64")


def _possible(vectors: np.ndarray, light: np.ndarray, k: int, hide, lowest: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Row and column of all that single precision cannot rule out as one of a row's k best; nothing where that is too much.

    Tile by tile: the k best maxima so far give a score that the k-th best reaches, and only what reaches it is kept.
    """
    n_rows, n = len(vectors), len(light)
    error = 4.0 * (vectors.shape[1] + 4) * 2.0**-24
    queries = vectors.astype("float32")
    tiles = max(1, n // max(TILE // n_rows, LIGHT_OVER * k))
    ends = [n * i // tiles for i in range(tiles + 1)]
    top = np.empty((n_rows, 0), "float32")
    rows, cols, found = np.empty(0, int), np.empty(0, int), np.empty(0, "float32")
    for a, b in zip(ends, ends[1:]):
        sims = queries @ light[a:b].T
        hide(sims, 0, a)
        top = np.concatenate([top, _maxima(sims, k)], axis=1)
        top = np.partition(top, top.shape[1] - k, axis=1)[:, top.shape[1] - k :]
        least = np.maximum(np.maximum(top.min(axis=1).astype("float64"), lowest) - error, -2.0).astype("float32")
        here = np.flatnonzero(sims >= least[:, None])
        row, col = np.divmod(here, b - a)
        rows, cols, found = np.append(rows, row), np.append(cols, col + a), np.append(found, sims.ravel()[here])
        if len(rows) > 4 * k * n_rows or b == n:
            still = found >= least[rows]
            rows, cols, found = rows[still], cols[still], found[still]
            if len(rows) > 8 * k * n_rows:
                return None
    return rows, cols


def _best(vectors: np.ndarray, catalog: np.ndarray, light: np.ndarray, ids: np.ndarray, k: int, hide, floor: np.ndarray | None):
    """Row, column, rounded score and rank of the k best catalog rows of each vector; ``hide(sims, row, column)`` blanks what a row must
    not see in the part that starts there.

    Products in single precision rule out what cannot be among the k best, by more than their error; the rest is compared in
    double precision. Where too much is left, and for long lists, all is in double precision.
    """
    n_rows, n = len(vectors), len(ids)
    lowest = np.full(n_rows, -2.0) if floor is None else np.maximum(np.nan_to_num(floor, nan=-2.0, neginf=-2.0), -2.0)
    if n >= LIGHT_OVER * k:
        left = _possible(vectors, light, k, hide, lowest)
        if left is not None:
            rows, cols = left
            exact = np.empty(len(rows))
            for at in range(0, len(rows), 1 << 15):
                part = slice(at, at + (1 << 15))
                exact[part] = np.einsum("ij,ij->i", vectors[rows[part]], catalog[cols[part]])
            return _first_k(rows, cols, np.round(exact, RANK_DIGITS), ids, n_rows, k)
    out = []
    step = max(1, SLAB // n)
    for start in range(0, n_rows, step):
        sims = vectors[start : start + step] @ catalog.T
        hide(sims, start, 0)
        least = np.maximum(np.maximum(_reach(sims, k), lowest[start : start + step]) - 2 * 10.0**-RANK_DIGITS, -2.0)
        rows, cols = np.nonzero(sims >= least[:, None])
        rows, cols, best, rank = _first_k(rows, cols, np.round(sims[rows, cols], RANK_DIGITS), ids, len(sims), k)
        out.append((rows + start, cols, best, rank))
    return tuple(np.concatenate(c) for c in zip(*out))


def _visited(queries: pa.Table, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which groups of this cell each query visits, and an order that brings queries of the same nearest group together."""
    width = int(groups.max()) + 1
    packed = np.frombuffer(b"".join(queries.column("bits").to_pylist()), np.uint8).reshape(queries.num_rows, -1)
    visits = np.unpackbits(packed, axis=1).astype(bool)
    visits = np.pad(visits, ((0, 0), (0, max(width - visits.shape[1], 0))))
    return visits, np.lexsort((queries.column("query_id").to_numpy(), queries.column("home").to_numpy()))


def _cell_kernel(k: int, packed: bool = False):
    """Queries and owned rows against the tracks of one cell. Tracks with a group are met only by queries that visit the group."""

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        masked = pa.compute.is_valid(left.column("masked_id"))
        queries, owned = left.filter(pa.compute.invert(masked)), left.filter(masked)
        out_q, out_t, out_s, out_r = [], [], [], []
        if queries.num_rows and right.num_rows:
            track_ids = right.column("track_id").to_numpy()
            grouped = "grp" in right.column_names
            groups = right.column("grp").to_numpy() - queries.column("base")[0].as_py() if grouped else np.zeros(len(track_ids), int)
            by_group = np.lexsort((track_ids, groups))
            track_ids, groups = track_ids[by_group], groups[by_group]
            catalog = _unit(_vectors(right))[by_group]
            light = catalog.astype("float32") if len(track_ids) >= LIGHT_OVER * k else None
            query_ids = queries.column("query_id").to_numpy()
            visits, by_query = _visited(queries, groups) if grouped else (None, np.argsort(query_ids, kind="stable"))
            query_ids = query_ids[by_query]
            vectors = _unit(_vectors(queries))[by_query]
            floor = None
            if grouped:
                visits = visits[by_query]
                floor = queries.column("floor").combine_chunks().fill_null(-np.inf).to_numpy(zero_copy_only=False)[by_query]
            # Owned rows as matrix coordinates, in query order.
            mask_q, mask_t = _places(query_ids, owned.column("query_id").to_numpy()), _places(track_ids, owned.column("masked_id").to_numpy())
            here = (mask_q >= 0) & (mask_t >= 0)
            mask_q, mask_t = mask_q[here], mask_t[here]
            order = np.argsort(mask_q, kind="stable")
            mask_q, mask_t = mask_q[order], mask_t[order]
            step = max(1, SLAB // len(track_ids))
            if light is not None and not grouped:
                # Of long lists, results and tiles of so many columns stay within a slab.
                step = min(max(TILE_QUERIES, TILE // len(track_ids)), max(1, SLAB // (LIGHT_OVER * k)))
            for start in range(0, len(query_ids), step):
                stop = min(start + step, len(query_ids))
                a, b = np.searchsorted(mask_q, [start, stop])
                cols = None
                if grouped:
                    used = visits[start:stop].any(axis=0)[groups]
                    if not used.any():
                        continue
                    if used.sum() * 2 <= len(used):
                        cols = np.flatnonzero(used)

                hidden_q, hidden_t = mask_q[a:b] - start, mask_t[a:b] if cols is None else _places(cols, mask_t[a:b])

                def hide(sims, row, column, start=start, hidden_q=hidden_q, hidden_t=hidden_t, cols=cols):
                    at_q, at_t = hidden_q - row, hidden_t - column
                    here = (at_q >= 0) & (at_q < sims.shape[0]) & (at_t >= 0) & (at_t < sims.shape[1]) & (hidden_t >= 0)
                    sims[at_q[here], at_t[here]] = -np.inf
                    if grouped:
                        seen = visits[start + row : start + row + sims.shape[0]]
                        if not seen.all():
                            among = groups if cols is None else groups[cols]
                            sims[~seen[:, among[column : column + sims.shape[1]]]] = -np.inf

                part = (catalog, light, track_ids) if cols is None else (catalog[cols], light[cols] if light is not None else None, track_ids[cols])
                rows, found, sims, rank = _best(vectors[start:stop], *part, k, hide, None if floor is None else floor[start:stop])
                out_q.append(query_ids[start + rows])
                out_t.append(part[2][found])
                out_s.append(sims)
                out_r.append(rank)
        joined = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        query_id, rank = joined(out_q, "int64"), joined(out_r, "int32")
        found = {
            "rank": pa.array(rank, pa.int32()),
            "track_id": pa.array(joined(out_t, "int64"), pa.int64()),
            "sim": pa.array(joined(out_s, "float64"), pa.float64()),
        }
        if not packed:
            return pa.table({"query_id": pa.array(query_id, pa.int64()), **found})
        first = np.flatnonzero(rank == 1)
        entries = pa.StructArray.from_arrays(list(found.values()), list(found))
        near = pa.ListArray.from_arrays(pa.array(np.append(first, len(rank)), pa.int32()), entries)
        return pa.table({"query_id": pa.array(query_id[first], pa.int64()), "near": near})

    return kernel


def _places(ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted id stands among the unique ids, -1 if nowhere."""
    if not len(ids):
        return np.full(len(wanted), -1)
    by_id = np.argsort(ids, kind="stable")
    at = np.minimum(np.searchsorted(ids, wanted, sorter=by_id), len(ids) - 1)
    return np.where(ids[by_id[at]] == wanted, by_id[at], -1)


def nearest_tracks(
    queries: DataFrame,
    catalog: DataFrame,
    k: int,
    exclude: DataFrame | None = None,
    n_queries: int | None = None,
    n_catalog: int | None = None,
    packed: bool = False,
    finish=None,
) -> DataFrame:
    """The k most similar catalog tracks of every query vector.

    queries(query_id, vec), catalog(track_id, vec), exclude(query_id, track_id); all keys bigint and
    unique. The counts only size the grid: any upper bound does. Result: query_id, track_id, sim
    (9 digits), rank 1..k; equal scores rank by track_id. Packed: query_id, near, the same rows as one
    array of (rank, track_id, sim) per query. ``finish`` makes something else of the lists where they are found, if the shared
    folder is readable (`sweep.py`).
    """
    from palate.operators import pruned, sweep

    spark = queries.sparkSession
    if n_queries is None:
        queries = stage(queries, "queries")
        n_queries = queries.count()
    if n_catalog is None:
        catalog = stage(catalog, "catalog")
        n_catalog = catalog.count()
    if sweep.readable(spark):
        finish = finish or sweep.Ranked(k, packed)
        held, groups = sweep.keyed(catalog, CATALOG_ROWS, n_catalog, GROUP_ROWS, finish)
        grouped = None if groups is None else sweep.Grouped(groups, pruned.FIRST_LOOK * k)
        return sweep.sweep(queries, held, finish, sweep.possible(exclude, catalog), n_queries, grouped)
    if n_catalog > CATALOG_ROWS:
        merged, _ = pruned.nearest_pruned(
            queries, catalog, k, _cell_kernel(k), GROUP_ROWS, exclude, n_catalog, CATALOG_ROWS, query_rows(k)
        )
        return _packed(merged) if packed else merged
    n_masked = 0
    if exclude is not None:
        # Only rows that the catalog could return matter; their number counts into the cells' size.
        exclude = stage(exclude.select("query_id", "track_id").join(catalog.select("track_id"), "track_id", "left_semi"), "masked")
        n_masked = exclude.count()
    grid = plan_grid(n_queries + n_masked // 8, n_catalog, task_slots(spark), k)

    group = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    all_groups = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # An explicit partition count keeps adaptive coalescing from packing the cells into few tasks; the keys deal them evenly.
    parts = min(grid.cells, 8 * task_slots(spark)) if grid.cells > task_slots(spark) else grid.cells
    cell = F.element_at(even_keys(spark, grid.cells, parts), F.col("q_group") * grid.catalog_groups + F.col("c_group") + 1).alias("cell")

    left = (
        queries.select("query_id", "vec")
        .withColumn("q_group", group("query_id", grid.query_groups))
        .withColumn("c_group", all_groups(grid.catalog_groups))
        .select(cell, "query_id", F.col("vec").cast("array<double>").alias("vec"), F.lit(None).cast("bigint").alias("masked_id"))
    )
    if exclude is not None:
        left = left.unionByName(
            exclude.select("query_id", "track_id")
            .withColumn("q_group", group("query_id", grid.query_groups))
            .withColumn("c_group", group("track_id", grid.catalog_groups))
            .select(
                cell,
                "query_id",
                # Empty, not NULL: a run of NULL lists is slow to hand over in Arrow batches.
                F.array().cast("array<double>").alias("vec"),
                F.col("track_id").alias("masked_id"),
            )
        )
    right = (
        catalog.select("track_id", "vec")
        .withColumn("c_group", group("track_id", grid.catalog_groups))
        .withColumn("q_group", all_groups(grid.query_groups))
        .select(cell, "track_id", F.col("vec").cast("array<double>").alias("vec"))
    )
    rows, lists = "query_id bigint, rank int, track_id bigint, sim double", f"query_id bigint, near {NEAR}"
    return (
        left.repartition(parts, "cell")
        .groupBy("cell")
        .cogroup(right.repartition(parts, "cell").groupBy("cell"))
        .applyInArrow(_cell_kernel(k, packed), lists if packed else rows)
    )


def highest_cosine(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row, `sim`: the highest cosine of any query(query_id, vec) with any row of catalog(track_id, vec)."""
    from palate.operators import pruned, sweep

    n = catalog.count()
    if n > CATALOG_ROWS and sweep.readable(queries.sparkSession):
        return sweep.highest(queries, catalog, -(-n // BOX_ROWS), CATALOG_ROWS)
    queries, catalog = stage(queries, "queries"), stage(catalog, "catalog")
    if n <= CATALOG_ROWS:
        found = nearest_tracks(queries, catalog, 1, n_queries=queries.count(), n_catalog=n)
    else:
        found, _ = pruned.nearest_pruned(queries, catalog, 1, _cell_kernel(1), GROUP_ROWS, None, n, CATALOG_ROWS, query_rows(1), overall=True)
    return found.agg(F.max("sim").alias("sim"))


def _packed(rows: DataFrame) -> DataFrame:
    near = F.sort_array(F.collect_list(F.struct("rank", "track_id", "sim"))).alias("near")
    return rows.groupBy("query_id").agg(near)
