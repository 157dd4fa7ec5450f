"""Product codes of vectors by Lloyd rounds over cover trees.

Vectors become whole numbers (floor(SCALE * x)) and are cut into PARTS equal consecutive parts, each with a codebook of its own. Every task
builds, for blocks of up to BLOCK vectors, one cover tree per part position, once: a node's first point is its centre and its
first child's too, every child holds the points within a power-of-two distance of its centre, and the centres of one
node's children are further than that from each other (the separation of the simplified cover tree). A node knows
its number of points, their sums and the largest distance from its centre. The trees are a table in the shared folder.

A round walks the trees from the roots with the entries that may still be nearest to a point of the node: by the triangle
inequality those at most twice the radius further from the centre than the nearest one. A node left with one entry adds its sums
to it as a whole; only the others go down, and only points of undecided leaves are compared one by one.
All distances that decide are whole numbers; bounds in floating point have a margin and only ever keep more entries.
Tasks return sums per part, entry and component, so the driver gets PARTS * ENTRIES * width rows however large the table is.

Defined results: vectors that are null or hold null or non-finite components are left out; vectors of another length than the one with
the smallest id whose length PARTS divides are returned without code and error; scaled components beyond LIMIT count as
LIMIT, so that sums stay exact; repeated ids are vectors of their own (the codebooks start in the order of id, then vector,
null ids last); with fewer vectors than ENTRIES the codebooks are smaller; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palate.llm.common import bound_batches
from palate.session import fill_slots, stage

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LIMIT = 1 << 24
BLOCK, LEAF = 4096, 8
#: The totals of a label are dealt to so many keys, so that a label with a third of all rows is many.
SALTS = 32

_TREE = "start array<int>, count array<int>, first array<int>, children array<int>, radius array<double>, sums array<bigint>, points array<int>, member array<int>"


def scaled(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * x), -LIMIT, LIMIT).astype(np.int64)


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for each n, one after another."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def build(points: np.ndarray, roots: int) -> dict[str, np.ndarray]:
    """Cover trees over ``roots`` equally long runs of points, all grown together, level by level.

    Nodes are numbered level by level, so the children of a node are consecutive; a node's points are consecutive in ``order``.
    """
    order, width = np.arange(len(points)), points.shape[1]
    size = len(points) // roots
    start, count = np.arange(roots) * size, np.full(roots, size)
    levels = {name: [] for name in ("start", "count", "first", "children", "radius", "sums")}
    made = roots
    while len(start):
        at = np.repeat(start, count) + _ramp(count)
        inside = points[order[at]]
        node = np.repeat(np.arange(len(start)), count)
        far = ((inside - points[order[start]][node]) ** 2).sum(1)
        heads = np.cumsum(count) - count
        reach = np.maximum.reduceat(far, heads)
        splits = (count > LEAF) & (reach > 0)
        # The children's distance, squared: the largest power of four below the node's own; 0 keeps equal points together.
        bits = np.frexp((reach - 1).astype(float))[1]
        near = np.where(reach > 1, 1 << (2 * ((bits - 1) // 2)).clip(0), 0)
        live = np.flatnonzero(splits[node])
        child = np.zeros(len(at), np.int64)
        left, step = live[far[live] > near[node[live]]], 0
        while len(left):
            step += 1
            owner = node[left]
            new = left[np.append(True, owner[1:] != owner[:-1])]
            centre = np.empty(len(start), np.int64)
            centre[node[new]] = new
            covered = ((inside[left] - inside[centre[owner]]) ** 2).sum(1) <= near[owner]
            child[left[covered]] = step
            left = left[~covered]
        key = node[live] * (step + 1) + child[live]
        by_child = np.argsort(key, kind="stable")
        order[at[live]] = order[at[live[by_child]]]
        groups, counts = np.unique(key, return_counts=True)
        children = np.bincount(groups // (step + 1), minlength=len(start)) if len(groups) else np.zeros(len(start), np.int64)
        levels["start"].append(start)
        levels["count"].append(count)
        levels["children"].append(children)
        levels["first"].append(made + np.cumsum(children) - children)
        levels["radius"].append(np.sqrt(reach))
        levels["sums"].append(np.add.reduceat(inside, heads).reshape(-1, width))
        parent = groups // (step + 1)
        within = np.cumsum(counts) - counts
        offset = within - np.concatenate([[0], np.cumsum(count[splits])])[:-1][np.searchsorted(np.flatnonzero(splits), parent)] if len(groups) else within
        start, count = start[parent] + offset, counts
        made += len(start)
    return {k: np.concatenate(v) for k, v in levels.items()} | {"order": order}


class Assigner:
    """Nearest entries of all points of a block's trees; ties go to the lower entry."""

    def __init__(self, tree: dict[str, np.ndarray], points: np.ndarray, books: np.ndarray):
        self.tree, self.points, self.books = tree, points, books  # points in the order of the trees
        self.whole: list[tuple[np.ndarray, np.ndarray]] = []  # nodes and their entry
        self.single: list[tuple[np.ndarray, np.ndarray]] = []  # places of points and their entry
        parts, entries = books.shape[:2]
        self.size = len(points) // parts
        node, entry = np.repeat(np.arange(parts), entries), np.tile(np.arange(entries), parts)
        while len(node):
            node, entry = self._down(node, entry)

    def _distance(self, places: np.ndarray, entry: np.ndarray) -> np.ndarray:
        return ((self.points[places] - self.books[places // self.size, entry]) ** 2).sum(1)

    def _down(self, node: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = self.tree
        far = np.sqrt(self._distance(t["start"][node], entry))
        heads = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        each = np.diff(np.append(heads, len(node)))
        bound = np.minimum.reduceat(far, heads) + 2 * t["radius"][node[heads]]
        keep = far <= np.repeat(bound * (1 + 1e-9) + 1e-9, each)
        kept = np.add.reduceat(keep.astype(np.int64), heads)
        nodes, entry = node[heads], entry[keep]
        firsts = np.cumsum(kept) - kept
        one = kept == 1
        self.whole.append((nodes[one], entry[firsts[one]]))
        leaf = ~one & (t["children"][nodes] == 0)
        self._exact(nodes[leaf], kept[leaf], firsts[leaf], entry)
        inner = ~one & ~leaf
        n = t["children"][nodes[inner]]
        child = np.repeat(t["first"][nodes[inner]], n) + _ramp(n)
        width, head = np.repeat(kept[inner], n), np.repeat(firsts[inner], n)
        return np.repeat(child, width), entry[np.repeat(head, width) + _ramp(width)]

    def _exact(self, nodes, kept, firsts, entry) -> None:
        n = self.tree["count"][nodes]
        place = np.repeat(self.tree["start"][nodes], n) + _ramp(n)
        width, head = np.repeat(kept, n), np.repeat(firsts, n)
        if not len(place):
            return
        tried = entry[np.repeat(head, width) + _ramp(width)]
        far = self._distance(np.repeat(place, width), tried)
        heads = np.cumsum(width) - width
        best = np.flatnonzero(far == np.repeat(np.minimum.reduceat(far, heads), width))
        owner = np.repeat(np.arange(len(place)), width)[best]
        self.single.append((place, tried[best[np.append(True, owner[1:] != owner[:-1])]]))

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Count and sums per part and entry; whole nodes bring their own sums."""
        parts, entries, width = self.books.shape
        n, total = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for nodes, entry in self.whole:
            to = self.tree["start"][nodes] // self.size * entries + entry
            np.add.at(n, to, self.tree["count"][nodes])
            np.add.at(total, to, self.tree["sums"][nodes])
        for place, entry in self.single:
            to = place // self.size * entries + entry
            np.add.at(n, to, 1)
            np.add.at(total, to, self.points[place])
        return n, total

    def labels(self) -> np.ndarray:
        """The entry of every point, in the order of the trees."""
        out = np.empty(len(self.points), np.int64)
        for nodes, entry in self.whole:
            n = self.tree["count"][nodes]
            out[np.repeat(self.tree["start"][nodes], n) + _ramp(n)] = np.repeat(entry, n)
        for place, entry in self.single:
            out[place] = entry
        return out


def _numbers(column, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, length)


def _trees(length: int, schema: pa.Schema):
    """One row per block of vectors: ids and labels as lists, and the block's trees."""

    def block(table: pa.Table) -> pa.RecordBatch:
        x = scaled(_numbers(table.column("embedding").combine_chunks(), length))
        points = x.reshape(len(x), PARTS, -1).transpose(1, 0, 2).reshape(PARTS * len(x), -1)
        tree = build(points, PARTS)
        order = tree.pop("order")
        columns = {k: v.ravel() for k, v in tree.items()} | {"points": points[order].ravel(), "member": order % len(x)}
        columns |= {"ids": table.column("id").combine_chunks(), "labels": table.column("label").combine_chunks()}
        whole = lambda f: pa.ListArray.from_arrays(pa.array([0, len(columns[f.name])], pa.int32()), pa.array(columns[f.name]).cast(f.type.value_type))
        return pa.RecordBatch.from_arrays([whole(f).cast(f.type) for f in schema], schema=schema)

    def run(batches):
        waiting, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(at, BLOCK)
                if n and n + piece.num_rows > BLOCK:
                    yield block(pa.Table.from_batches(waiting))
                    waiting, n = [], 0
                waiting.append(piece)
                n += piece.num_rows
        if n:
            yield block(pa.Table.from_batches(waiting))

    return run


def _assigners(batches, books: np.ndarray):
    for batch in batches:
        for i in range(batch.num_rows):
            row = {f: batch.column(f)[i].values for f in batch.schema.names}
            tree = {f: row[f].to_numpy(zero_copy_only=False).astype(np.int64) for f in ("start", "count", "first", "children")}
            tree |= {"radius": row["radius"].to_numpy(zero_copy_only=False), "sums": row["sums"].to_numpy(zero_copy_only=False).reshape(-1, books.shape[2])}
            points = row["points"].to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, books.shape[2])
            yield row, Assigner(tree, points, books)


def _partial_sums(books: np.ndarray):
    def run(batches):
        parts, entries, width = books.shape
        n, total = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for _, done in _assigners(batches, books):
            more, sums = done.sums()
            n += more
            total += sums
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"slot": np.repeat(used, width), "position": np.tile(np.arange(width), len(used)), "n": np.repeat(n[used], width), "total": total[used].ravel()})

    return run


def _codes(books: np.ndarray, schema: pa.Schema):
    def run(batches):
        for row, done in _assigners(batches, books):
            n = len(row["ids"])
            place, entry = np.arange(PARTS * n), done.labels()
            member = row["member"].to_numpy(zero_copy_only=False)
            code, error = np.empty((n, PARTS), np.uint8), np.empty((n, PARTS), np.int64)
            code[member, place // n], error[member, place // n] = entry, done._distance(place, entry)
            columns = [row["ids"], row["labels"], pa.array([c.tobytes().hex() for c in code]), pa.array(error.sum(1))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def fit(trees: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """``rounds`` Lloyd rounds; each replaces every used entry by the floor of its points' mean."""
    needed = trees.select("start", "count", "first", "children", "radius", "sums", "points")
    for _ in range(rounds):
        sums = needed.mapInArrow(_partial_sums(books), "slot bigint, position bigint, n bigint, total bigint")
        flat = books.copy().reshape(-1, books.shape[2])
        for r in sums.groupBy("slot", "position").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
            flat[r.slot, r.position] = r.total // r.n
        books = flat.reshape(books.shape)
    return books


def cover_codes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error) of every kept vector, and the codebooks [part, entry, component]."""
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("embedding"))
    rows = rows.where(F.coalesce(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)))
    by_id = [F.asc_nulls_last("id"), "embedding"]
    first = rows.where((F.size("embedding") > 0) & (F.size("embedding") % PARTS == 0)).orderBy(*by_id).select(F.size("embedding").alias("n")).first()
    length = first.n if first else 0
    usable = rows.where(F.size("embedding") == length) if first else rows.where("false")
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}
    out = f"id {kinds['id']}, label {kinds['label']}, code string, error bigint"
    rest = (rows.where(F.size("embedding") != length) if first else rows).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    if not first:
        return rest, np.zeros((PARTS, 0, 0), np.int64)
    seeds = scaled(np.array([r.embedding for r in usable.orderBy(*by_id).select("embedding").limit(ENTRIES).collect()], float))
    books = seeds.reshape(len(seeds), PARTS, -1).transpose(1, 0, 2)
    tree_schema = f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, {_TREE}"
    arrow = lambda ddl: spark.createDataFrame([], ddl).toArrow().schema
    trees = stage(fill_slots(usable).mapInArrow(_trees(length, arrow(tree_schema)), tree_schema), "trees")
    books = fit(trees, books)
    coded = trees.select("ids", "labels", *[c.split()[0] for c in _TREE.split(", ")]).mapInArrow(_codes(books, arrow(out)), out)
    return coded.unionByName(rest), books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def report(vectors: DataFrame) -> DataFrame:
    coded, books = cover_codes(vectors)
    coded = stage(coded, "coded")
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    totals = totals.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
    joined = salted.join(totals, salted["label"].eqNullSafe(totals["of"]) & (salted["salt"] == totals["of_salt"]))
    return joined.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The same by comparing every part with every entry; for vectors of 64 components."""
    w = 64 // PARTS
    square = " + ".join(f"(v[{i}] - c[{i}]) * (v[{i}] - c[{i}])" for i in range(1, w + 1))
    nearest = lambda b: f"(SELECT vec_id, label, p, v, min(({square}) * {ENTRIES} + k) AS best FROM parts JOIN {b} USING (p) GROUP BY ALL)"
    ctes = [
        f"""kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"parts AS MATERIALIZED (SELECT vec_id, label, p, q[{w} * p + 1 : {w} * p + {w}] AS v FROM kept, range({PARTS}) AS t(p))",
        f"""b0 AS MATERIALIZED (SELECT p, k, v AS c FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM kept
            QUALIFY k < {ENTRIES}) USING (vec_id))""",
    ]
    means = ", ".join(f"CAST(floor(sum(v[{i}]) / count(*)) AS BIGINT)" for i in range(1, w + 1))
    for r in range(ROUNDS):
        ctes.append(f"n{r} AS MATERIALIZED (SELECT p, best % {ENTRIES} AS k, [{means}] AS m FROM {nearest(f'b{r}')} GROUP BY ALL)")
        ctes.append(f"b{r + 1} AS MATERIALIZED (SELECT p, k, coalesce(m, c) AS c FROM b{r} LEFT JOIN n{r} USING (p, k))")
    last = f"b{ROUNDS}"
    ctes.append(
        f"""coded AS MATERIALIZED (SELECT vec_id, label, string_agg(printf('%02x', best % {ENTRIES}), '' ORDER BY p) AS code, CAST(sum(best // {ENTRIES}) AS BIGINT) AS error
            FROM {nearest(last)} GROUP BY vec_id, label)"""
    )
    ctes.append(f"digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM {last})")
    return f"WITH {', '.join(ctes)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, digest"


SQL = _sql()
