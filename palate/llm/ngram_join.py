"""N-gram Jaccard join: documents linked by the similarity of their sets of five-word shingles.

Prefix-tree join. The global order of n-grams is the order of their 64-bit hashes, and a document is the path of its
ordered set. The top of the tree is a table: every document is stored under each n-gram of its prefix (the
``n - ceil(0.75 n) + 1`` first ones; similar sets share one), the node key. Below a node, the candidates of one probe
form a trie in the task that verifies them: walked in path order, a path resumes at the depth where it leaves the
one before, with the overlap counted so far, and a subtree is cut where the overlap plus the remaining length is
too small.

Before that, exact steps make the tree small. Equal sets are one entry. And a set with more than a quarter of its
n-grams in no other document is similar to none: n-grams are counted in a fixed part of the hash space, the same for
all documents, with repeats combined in the task that reads them; among the sets that stay, all n-grams are counted.
What a set has in common with any other one is at most its n-grams that are not its own; and two sets, each
divided by a third one, have at most the smaller of either part in common. That bounds a pair's similarity before it
is walked.

Nodes can hold a third of all documents, so no node lists its pairs. Each node tests its members against one pivot.
Jaccard distance is a metric, so a member with a distance d to the pivot can only be linked to a failed member with a
distance of at most d + 0.25: whoever is out of reach leaves the node, the others go to the next round with a
failed member as pivot; members that other links already connect to the pivot have not failed. That is asked anew in each
round: a member connected to one pivot has failed for the pivot of another component, so two members stay as long as
they lie in different components and within reach. What a few rounds don't settle is compared pair by pair, where links
don't connect the pair already.

Defined results: null, empty and blank texts have no n-grams (n_shingles 0) and are linked with nothing; texts under
five words are one n-gram; equal rows are linked; repeated doc_ids with different texts give a row each; an empty
table gives an empty result. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palate.llm.common import bound_batches, components, shuffle_width
from palate.llm.shingles import text_sets
from palate.session import stage

# Similar: intersection / union >= NUM / DEN.
NUM, DEN = 75, 100
#: Part of the hash space in which n-grams are counted and offered; sets of up to WHOLE n-grams are counted in full.
PART = 0.4
WHOLE = 64
#: Sets of up to this size can be similar to one of WHOLE n-grams, so all their n-grams are offered.
_OFFER = WHOLE * DEN // NUM + 1
#: Counted n-grams per bucket (on average) and per flush of a task.
PER_BUCKET = 1 << 20
PER_FLUSH = 1 << 19
PIVOT_ROUNDS = 4
SCREENS = 2
#: (id, digest) rows that are broadcast at most: about 20 MB.
BROADCAST_ROWS = 500_000
#: Bytes of paths that are verified together.
PER_BLOCK = 32 << 20

_SIGNED = "id bigint, n long, digest binary, key bigint, counted bigint"


def _digest(members: np.ndarray) -> bytes:
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest()


def _within(members: np.ndarray, part: float, whole: int) -> np.ndarray:
    """All n-grams of a set of up to ``whole``, of a larger one those in the part of the hash space.

    Sets are counted up to WHOLE and offered up to _OFFER: whatever can be similar to a set offers all that it counts.
    """
    if part >= 1 or len(members) <= whole:
        return members
    return members[: np.searchsorted(members, np.uint64(int(part * 2**64)))]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [(len(s), _digest(s) if len(s) else None, len(_within(s, PART, WHOLE))) for s in text_sets(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                pa.array([n for n, _, _ in sets], pa.int64()),
                pa.array([d for _, d, _ in sets], pa.binary()),
                pa.array([d and int.from_bytes(d[:8], "little", signed=True) for _, d, _ in sets], pa.int64()),
                pa.array([c for _, _, c in sets], pa.int64()),
            ],
            ["id", "n", "digest", "key", "counted"],
        )


def _flush(sets: dict[bytes, np.ndarray], buckets: int, part: float, origin: int) -> pa.RecordBatch:
    """What one flush of a task offers. A row for the flush itself (bucket -1) names its sets, with how many of their counted n-grams
    other sets of the flush have too. A row per bucket holds, by the sets' numbers in the flush, the n-grams that only one set
    counts; and each of the others once.

    What a set offers but does not count is listed for the others only.
    """
    ids = np.frombuffer(b"".join(sets), np.int64)
    grams = np.concatenate(list(sets.values()))
    owner = np.repeat(np.arange(len(ids), dtype=np.uint32), [len(s) for s in sets.values()])
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    del order
    new = np.r_[True, grams[1:] != grams[:-1]]
    single = new & np.r_[new[1:], True]
    counts_all = np.array([len(s) <= WHOLE for s in sets.values()]) | (part >= 1)
    counted = counts_all[owner] | (grams < np.uint64(min(int(part * 2**64), 2**64 - 1)))
    # Bucket by the high half, store the low half: a rare collision only makes an n-gram look shared.
    bucket = ((grams >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    short = (grams & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    met = np.bincount(owner[~single & counted], minlength=len(ids)).astype(np.uint32)
    rows: list[tuple] = [(origin, -1, ids.tobytes(), met.tobytes(), b"", b"")]
    edges = np.searchsorted(bucket, np.arange(buckets + 1))
    for b in range(buckets):
        here = slice(edges[b], edges[b + 1])
        if here.start == here.stop:
            continue
        own = (single & counted)[here]
        by = np.argsort(owner[here][own], kind="stable")
        who, counts = np.unique(owner[here][own], return_counts=True)
        packed = (who.astype(np.uint32), counts.astype(np.uint32), short[here][own][by], short[here][new[here] & ~own])
        rows.append((origin, b, *(x.tobytes() for x in packed)))
    columns = list(zip(*rows))
    kinds = [pa.int64(), pa.int32()] + [pa.binary()] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], _OFFERED_NAMES)


def _sets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    if "text" in batch.schema.names:
        return text_sets(batch.column("text"))
    return (np.frombuffer(p.as_py(), np.uint64) for p in batch.column("path"))


_OFFERED = "origin bigint, bucket int, sets binary, counts binary, own binary, met binary"
_OFFERED_NAMES = [c.split()[0] for c in _OFFERED.split(", ")]


def _offer(buckets: int, part: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        origin = TaskContext.get().partitionId() << 32
        held: dict[bytes, np.ndarray] = {}
        size = 0
        for batch in batches:
            for members in _sets(batch):
                key = _digest(members)[:8]
                if not len(members) or key in held:
                    continue
                held[key] = _within(members, part, _OFFER)
                size += len(held[key])
                if size >= PER_FLUSH:
                    yield _flush(held, buckets, part, origin)
                    held, size, origin = {}, 0, origin + 1
        if held:
            yield _flush(held, buckets, part, origin)

    return run


_COUNTED = "origin bigint, sets binary, counts binary"


def _count_shared(table: pa.Table) -> pa.Table:
    """One row per flush: how many of its sets' n-grams in this bucket another flush offers too."""
    column = lambda c, kind: [np.frombuffer(x.as_py(), kind) for x in table.column(c)]
    sets, counts, own = column("sets", np.uint32), column("counts", np.uint32), column("own", np.uint32)
    starts = np.cumsum([0] + [len(x) for x in sets])
    entry = np.repeat(np.arange(starts[-1], dtype=np.uint64), np.concatenate(counts))
    pairs = np.unique(np.concatenate(own).astype(np.uint64) << np.uint64(32) | entry)
    gram = (pairs >> np.uint64(32)).astype(np.uint32)
    new = np.r_[True, gram[1:] != gram[:-1]][: len(gram)]
    met = np.unique(np.concatenate(column("met", np.uint32)))
    shared = ~(new & np.r_[new[1:], True][: len(gram)]) | np.isin(gram, met)
    n = np.bincount((pairs[shared] & np.uint64(0xFFFFFFFF)).astype(np.int64), minlength=int(starts[-1])).astype(np.uint32)
    rows = {"origin": table.column("origin").to_pylist(), "sets": [], "counts": []}
    for who, start in zip(sets, starts):
        found = n[start : start + len(who)]
        rows["sets"].append(who[found > 0].tobytes())
        rows["counts"].append(found[found > 0].tobytes())
    return pa.table(rows, schema=pa.schema([("origin", pa.int64()), ("sets", pa.binary()), ("counts", pa.binary())]))


def _add_up(flush: pa.Table, counted: pa.Table) -> pa.Table:
    """The sets of one flush with all that was found in its buckets."""
    ids = np.frombuffer(flush.column("sets")[0].as_py(), np.int64)
    total = np.frombuffer(flush.column("counts")[0].as_py(), np.uint32).astype(np.int64)
    for who, n in zip(counted.column("sets"), counted.column("counts")):
        total[np.frombuffer(who.as_py(), np.uint32)] += np.frombuffer(n.as_py(), np.uint32)
    return pa.table({"key": ids[total > 0], "shared": total[total > 0]})


def _shared(sets: DataFrame, total: int, part: float) -> DataFrame:
    """(key, shared): how many counted n-grams of a set others have; sets without such have no row.

    A set that more than one flush offers may count an n-gram more than once: it looks more shared, which is safe. Rows are
    buckets x flushes, whatever the number of sets.
    """
    buckets = int(total * part / PER_BUCKET) + 1
    offered = stage(sets.mapInArrow(_offer(buckets, part), _OFFERED), "offered")
    per_bucket = offered.where("bucket >= 0").repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_count_shared, _COUNTED)
    flushes = offered.where("bucket < 0").select("origin", "sets", "counts")
    counted = flushes.groupBy("origin").cogroup(per_bucket.withColumnRenamed("origin", "of").groupBy("of")).applyInArrow(_add_up, "key bigint, shared bigint")
    return counted.groupBy("key").agg(F.sum("shared").alias("shared"))


def _staying(sets: DataFrame, shared: DataFrame, counted: str) -> DataFrame:
    """Sets of which at most a quarter is their own, with that part's size."""
    alone = F.greatest(F.col(counted) - F.coalesce("shared", F.lit(0)), F.lit(0))
    joined = sets.join(shared, "key", "left").withColumn("alone", alone).drop("shared")
    return joined.where(F.col("alone") * DEN <= F.col("n") * (DEN - NUM))


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets that stay, with their prefixes. A row whose id was kept for another text drops out."""
    for batch in batches:
        rows = []
        for i, members in enumerate(text_sets(batch.column("text"))):
            if len(members) and _digest(members) == batch.column("digest")[i].as_py():
                prefix = members[: len(members) - -(-NUM * len(members) // DEN) + 1]
                key = int.from_bytes(_digest(members)[:8], "little", signed=True)
                rows.append((batch.column("node")[i].as_py(), key, len(members), prefix.view(np.int64), members.tobytes()))
        columns = list(zip(*rows)) if rows else [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
        names = ["node", "key", "n", "prefix", "path"]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)


def walk(probe: np.ndarray, paths: list[np.ndarray], num: int = NUM, den: int = DEN) -> list[int]:
    """Overlap of each path with the probe; -1 where the remaining length rules out a similarity of num / den.

    The paths are one trie, walked in path order: a path resumes at the depth where it leaves the one before.
    """
    order = sorted(range(len(paths)), key=lambda i: paths[i].astype(">u8").tobytes())
    overlap, last, hits = [-1] * len(paths), np.empty(0, np.uint64), np.zeros(1, np.int64)
    for i in order:
        path = paths[i]
        need = -(-num * (len(path) + len(probe)) // (num + den))
        same = min(len(path), len(last))
        differs = np.flatnonzero(path[:same] != last[:same])
        depth = int(differs[0]) if len(differs) else same
        depth = min(depth, len(hits) - 1)
        hits, step, alive = hits[: depth + 1], 64, True
        while depth < len(path):
            if hits[-1] + len(path) - depth < need:
                alive = False
                break
            piece = path[depth : depth + step]
            at = np.searchsorted(probe, piece)
            found = probe[np.minimum(at, len(probe) - 1)] == piece
            hits = np.concatenate([hits, hits[-1] + np.cumsum(found)])
            depth, step = depth + len(piece), step * 2
        last = path[: len(hits) - 1]
        if alive:
            overlap[i] = int(hits[-1])
    return overlap


_VERIFIED = "pivot bigint, node bigint, linked boolean, distance double, overlap bigint"


def _verify(nodes: pa.Table, pivots: pa.Table) -> pa.Table:
    """Each pivot against the trie of its nodes here. Over twice the allowed distance, that is the bound given."""
    far = 2 * (1 - NUM / DEN)
    probes = {p: np.frombuffer(s, np.uint64) for p, s in zip(pivots["pivot"].to_pylist(), pivots["probe"].to_pylist())}
    tries: dict[int, list] = {}
    for node, path, wanted in zip(nodes["node"].to_pylist(), nodes["path"].to_pylist(), nodes["pivots"].to_pylist()):
        path = np.frombuffer(path, np.uint64)
        for pivot in wanted:
            tries.setdefault(pivot, []).append((node, path))
    rows = []
    for pivot, below in tries.items():
        probe = probes[pivot]
        for (node, path), common in zip(below, walk(probe, [p for _, p in below], 2 * NUM - DEN, DEN)):
            if common < 0:
                rows.append((pivot, node, False, far, None))
            else:
                union = len(path) + len(probe) - common
                rows.append((pivot, node, DEN * common >= NUM * union, 1 - common / union, common))
    columns = list(zip(*rows)) if rows else [[]] * 5
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.float64(), pa.int64()]
    names = ["pivot", "node", "linked", "distance", "overlap"]
    return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)


# What a pair can have in common at most, and whether that is enough. ``inner`` and ``outer`` bound what a set can have
# in common with others inside and outside of its last pivot, ``first_``
# of its first one.
_MOST = (
    "least(common, pivot_common, least(inner, pivot_inner) + least(outer, pivot_outer),"
    " least(first_inner, pivot_first_inner) + least(first_outer, pivot_first_outer))"
)
_ENOUGH = f"{_MOST} * {NUM + DEN} >= (n + pivot_n) * {NUM}"
# NUM times the largest partner that a set can have, by what it can have in common; and the same for its two parts.
_REACH = f"common * {NUM + DEN} - n * {NUM}"
_INNER = f"inner * {NUM + DEN} - n * {NUM}"
_OUTER = f"n * {NUM} - outer * {NUM + DEN}"
_STATE = ["node", "n", "common", "inner", "outer", "first_inner", "first_outer", "open"]


def _tested(pairs: DataFrame, paths: DataFrame) -> DataFrame:
    """(pivot, node, linked, distance, overlap) of the distinct pairs that the bounds leave.

    Nodes lie in blocks of bounded size; a path goes to its block once, a pivot's once to each block that needs it.
    """
    near = stage(pairs.where(_ENOUGH).select("pivot", "node").distinct(), "near")
    held = paths.join(near.select("node").distinct(), "node", "left_semi").agg(F.sum("n")).first()[0] or 0
    blocks = max(int(held * 8 / PER_BLOCK) + 1, shuffle_width(pairs.sparkSession))
    near = near.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(blocks)))
    wanted = near.groupBy("block", "node").agg(F.collect_list("pivot").alias("pivots"))
    nodes = wanted.join(paths.select("node", "path"), "node")
    probes = near.select(F.col("block").alias("place"), "pivot").distinct().join(paths.select(F.col("node").alias("pivot"), F.col("path").alias("probe")), "pivot")
    return stage(nodes.groupBy("block").cogroup(probes.groupBy("place")).applyInArrow(_verify, _VERIFIED), "tested")


def _with_parts(pairs: DataFrame, part: DataFrame) -> DataFrame:
    """The components of both ends, null where nothing is linked with them yet."""
    for end in ("node", "pivot"):
        pairs = pairs.join(part.select(F.col("id").alias(end), F.col("component").alias(f"{end}_part")), end, "left")
    return pairs


def _connected():
    return F.coalesce(F.col("node_part") == F.col("pivot_part"), F.lit(False))


def _links(paths: DataFrame) -> DataFrame | None:
    """Edges (a, b) that connect whatever is linked."""
    places = stage(
        paths.withColumn("common", F.col("n") - F.col("alone"))
        .withColumns({c: F.col("common") for c in ("inner", "outer", "first_inner", "first_outer")})
        .withColumn("open", F.lit(True))
        .select(*_STATE, F.explode("prefix").alias("gram")),
        "places",
    )
    found = None
    # Open: not connected to the last pivot. The pivot of a tree node is the open member with the smallest share of n-grams of its own.
    order = F.struct((1 - F.col("common") / F.col("n")).alias("own"), *_STATE)
    for turn in range(PIVOT_ROUNDS):
        pivot = (
            places.groupBy("gram")
            .agg(F.min(F.when(F.col("open"), order)).alias("p"), F.count("*").alias("m"))
            .where("m > 1 and p is not null")
            .select("gram", F.col("p.node").alias("pivot"), *[F.col(f"p.{c}").alias(f"pivot_{c}") for c in _STATE[1:]])
        )
        members = stage(places.join(pivot, "gram").where("node <> pivot"), "members")
        if members.isEmpty():
            return found
        tested = _tested(members, paths)
        edges = tested.where("linked").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
        part = components(edges if found is None else found.unionByName(edges))
        # What is connected so far goes on as one edge per set, not as all links found.
        found = part.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
        judged = _with_parts(members.join(tested, ["pivot", "node"], "left"), part).withColumns(
            {
                # Of two members in different components one is open at least; links are in the components.
                "open": ~_connected(),
                # Not walked: the bound on what they have in common gives one on the distance.
                "distance": F.coalesce("distance", F.expr(f"1 - {_MOST} / (n + pivot_n - {_MOST})")),
                # Without an overlap the distance is a lower bound only.
                "farthest": F.when(F.col("overlap").isNull(), F.lit(1.0)).otherwise(F.col("distance")),
                "inner": F.coalesce("overlap", "common"),
                "outer": F.col("common") - F.coalesce("overlap", F.lit(0)),
            }
        )
        if not turn:
            judged = judged.withColumns({"first_inner": F.col("inner"), "first_outer": F.col("outer")})
        judged = stage(judged.select("gram", *_STATE, "distance", "farthest"), "judged")
        when_open = lambda what: F.when(F.col("open"), F.expr(what))
        reach = judged.groupBy("gram").agg(
            (F.min(when_open("distance")) - (1 - NUM / DEN) - 1e-9).alias("nearest"),
            F.max(when_open(_REACH)).alias("largest"),
            F.max(when_open(_INNER)).alias("largest_inner"),
            F.min(when_open(f"n * {NUM}")).alias("smallest"),
            F.min(F.expr(f"n * {NUM}")).alias("least_n"),
            F.min(F.expr(_OUTER)).alias("least_outer"),
        )
        stays = F.when(F.col("open"), F.expr(f"{_REACH} >= least_n and {_INNER} >= least_outer")).otherwise(
            F.expr(f"farthest >= nearest and n * {NUM} <= largest and {_REACH} >= smallest and {_OUTER} <= largest_inner")
        )
        places = stage(judged.join(reach, "gram").where(stays).select("gram", *_STATE), "places")
    # A pair meets in every tree node that both are left in; the first of these has it. Where all are connected, none is left.
    places = places.join(part.select(F.col("id").alias("node"), F.col("component").alias("part")), "node", "left")
    places = places.withColumn("part", F.coalesce("part", "node"))
    apart = places.groupBy("gram").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("gram")
    places = stage(places.join(apart, "gram"), "places")
    own = places.groupBy("node").agg(F.array_sort(F.collect_set("gram")).alias("grams"))
    places = places.join(own, "node")
    other = places.select("gram", F.col("node").alias("pivot"), *[F.col(c).alias(f"pivot_{c}") for c in [*_STATE[1:], "part", "grams"]])
    rest = places.join(other, "gram").where(f"pivot < node and part <> pivot_part and {_ENOUGH} and gram = array_min(array_intersect(grams, pivot_grams))")
    edges = _tested(rest, paths).where("linked").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    return edges if found is None else found.unionByName(edges)


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id that links reach)."""
    spark = docs.sparkSession
    bound_batches(spark)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = stage(texts.mapInArrow(_sign, _SIGNED), "signed")
    classes = signed.where("n > 0").groupBy("digest").agg(F.min("id").alias("node"), F.max("n").alias("n"), F.min("key").alias("key"), F.max("counted").alias("counted"))
    classes = stage(classes, "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    stays = _staying(classes, _shared(texts.select("text"), total, PART), "counted")
    stays = stage(stays.select("node", "digest"), "stays")
    few = stays.count() <= BROADCAST_ROWS
    paths = texts.join(F.broadcast(stays) if few else stays, texts["id"] == stays["node"]).select("node", "digest", "text")
    paths = paths.mapInArrow(_paths, "node bigint, key bigint, n long, prefix array<bigint>, path binary")
    paths = stage(paths.dropDuplicates(["key", "node"]), "paths")
    for _ in range(SCREENS):
        total = paths.agg(F.sum("n")).first()[0] or 0
        paths = stage(_staying(paths.drop("alone"), _shared(paths.select("path"), total, 1.0), "n"), "paths")
    edges = _links(paths)
    labelled = classes.select("digest", "node")
    if edges is not None:
        part = components(edges)
        labelled = labelled.join(part, labelled["node"] == part["id"], "left").select("digest", F.coalesce("component", "node").alias("node"))
    return signed.join(labelled, "digest", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("node", "id").alias("component_id")
    )
